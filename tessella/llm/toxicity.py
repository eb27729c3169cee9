"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of two hashed ones, of the word and of its first four letters, so that inflected forms
of a known word tell something too; filters of several widths slide over them, and each keeps its greatest response in the
document (max pooling); a logistic layer makes the score. The model sees words only: labels, language, source and ids
are no inputs. Every labelled row counts: all that train are counted for the first embeddings, and each is learned from
in a shard that a hash of id and text fixes; the model is the shards' mean. Scoring runs over all rows. Thresholds are
calibrated per language on all labelled rows kept out of training; they say what is rejected, and never enter a score.

For scoring, embedding times filter is tabulated per bucket and position, so a word costs a few rows of a table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._batches import lean, remember, small_batches
from tessella.plans.columns import pick
from tessella.plans.lineage import hold, scratch

WORDS, STEMS, STEM = 1 << 17, 1 << 15, 4
BUCKETS, DIM, WIDTHS, FILTERS = WORDS + STEMS, 8, (1, 2, 3), 8
#: Rows, and words, of a shard of the training rows; there are as many shards as that takes.
SHARD, SHARD_WORDS = 6000, 8_000_000
#: Ids with a label that are broadcast at most; beyond that a shuffled join does it.
BROADCAST_IDS = 500_000
#: Parts that counts and embeddings are added up in.
SLICES = 64
#: Of ``sample``, which ``fit`` doesn't take: at most so many rows of either label by the order of a hash of the id, so
#: many characters, of which a half is for either label, and so many of one document (a longer one isn't in it).
MAX_TOXIC, MAX_CLEAN, MAX_CHARS, MAX_TEXT = 2500, 5000, 40_000_000, 200_000
#: Windows of words that are held against the filters together, and words whose documents are scored together.
WINDOWS, AT_ONCE = 200_000, 500_000
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 64, 0.02, 1e-4, 7
#: Folds by crc32(id) mod 5: 0 is held out altogether, 1 sets thresholds, the others train.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: A language's threshold lets at most this share of its clean calibration rows be rejected.
MAX_FALSE = 0.002
#: Words a worker remembers the bucket of; beyond that it forgets all and starts again.
REMEMBERED = 100_000

_PAD = BUCKETS
_SHIFT = 20
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’…—–¡¿"


class Words(dict):
    """Word to its two buckets in one integer; a word is lower-cased and stripped of punctuation at its ends."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        plain = word.strip(_STRIP).lower()
        stem = WORDS + zlib.crc32(b"-" + plain[:STEM].encode()) % STEMS
        self[word] = out = (zlib.crc32(plain.encode()) % WORDS) << _SHIFT | stem
        return out


_words = Words()
remember(__name__, _words)


def buckets(text: str | None) -> np.ndarray:
    """The two buckets of each word of the whole text: an array of two columns."""
    words = (text or "").split()
    both = np.fromiter(map(_words.__getitem__, words), dtype=np.int64, count=len(words))
    return np.stack([both >> _SHIFT, both & ((1 << _SHIFT) - 1)], axis=1).astype(np.int32)


def _packed(words: np.ndarray) -> bytes:
    """``buckets`` in four bytes a word."""
    return ((words[:, 1] - WORDS).astype(np.uint32) * np.uint32(WORDS) + words[:, 0].astype(np.uint32)).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    both = np.frombuffer(raw, np.uint32)
    return np.stack([both % WORDS, both // WORDS + WORDS], axis=1).astype(np.int32)


def together(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all words with pads before each document and at the end, where documents start): no filter reaches from one
    document into the next, and an empty document still has its pads."""
    pads = max(WIDTHS) - 1 or 1
    pad = np.full((pads, 2), _PAD, dtype=np.int32)
    starts = np.concatenate([[0], np.cumsum([len(d) + pads for d in docs])]).astype(np.int64)
    parts = [x for d in docs for x in (pad, d)]
    return np.concatenate([*parts, pad]), starts[:-1]


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS + 1, DIM; the last row, the pad's, is zero
    filters: dict[int, np.ndarray]  # width -> width, DIM, FILTERS
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5
    tables: dict = field(default_factory=dict, repr=False)

    def pooled(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Greatest response per document and filter, before the rectifier."""
        if not self.tables:
            self.tables = {(w, o): (self.embed @ self.filters[w][o]).astype(np.float32) for w in WIDTHS for o in range(w)}
        n = len(words) - max(WIDTHS) + 1
        out = np.full((len(starts), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        for a in range(0, n, WINDOWS):
            b = min(n, a + WINDOWS)
            # documents with a window among these; the first may have begun before
            first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)
            cuts = np.maximum(starts[first:last] - a, 0)
            for k, w in enumerate(WIDTHS):
                response = self.tables[w, 0][words[a:b, 0]]
                response += self.tables[w, 0][words[a:b, 1]]
                for o in range(1, w):
                    response += self.tables[w, o][words[a + o : b + o, 0]]
                    response += self.tables[w, o][words[a + o : b + o, 1]]
                own = out[first:last, k * FILTERS : (k + 1) * FILTERS]
                np.maximum(own, np.maximum.reduceat(response, cuts, axis=0), out=own)
        return out + np.concatenate([self.bias[w] for w in WIDTHS])

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        z = np.maximum(self.pooled(*together(docs)), 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def score_texts(self, texts: Iterable[str | None]) -> np.ndarray:
        """Scores of whole texts; held are the words of a bounded number, or of one long text."""
        out, docs, size = [np.zeros(0)], [], 0
        for text in texts:
            docs.append(buckets(text))
            size += len(docs[-1])
            if size >= AT_ONCE:
                out.append(self.score(docs))
                docs, size = [], 0
        return np.concatenate([*out, self.score(docs)])


Parameters = dict[str, np.ndarray]


def greatest(p: Parameters, words: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(places, responses) by width: where each document's filters respond most, and how much. Held are the responses of
    ``WINDOWS`` windows, however long a document is."""
    n = len(words) - max(WIDTHS) + 1
    ends = np.append(starts[1:], n)
    places = [np.zeros((len(starts), FILTERS), dtype=np.int64) for _ in WIDTHS]
    best = [np.full((len(starts), FILTERS), -np.inf) for _ in WIDTHS]
    for a in range(0, n, WINDOWS):
        b = min(n, a + WINDOWS)
        first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)
        x = p["e"][words[a : b + max(WIDTHS) - 1]].sum(axis=1)
        for k, w in enumerate(WIDTHS):
            response = sum(x[o : b - a + o] @ p[f"f{w}"][o] for o in range(w))
            place = np.stack([s + response[s:e].argmax(axis=0) for s, e in zip(np.maximum(starts[first:last] - a, 0), np.minimum(ends[first:last], b) - a)])
            found = np.take_along_axis(response, place, axis=0)
            more = found > best[k][first:last]
            best[k][first:last] = np.where(more, found, best[k][first:last])
            places[k][first:last] = np.where(more, place + a, places[k][first:last])
    return places, best


def gradients(p: Parameters, words: np.ndarray, starts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, Parameters, np.ndarray]:
    """(loss, gradients, rows of the embeddings that ``gradients["e"]`` is of) of documents put ``together``: the
    weighted mean logistic loss and the decay of the last layer. Of the embeddings only those move that a greatest
    response came from; the pad's never does."""
    places, pooled = greatest(p, words, starts)
    h = np.concatenate([x + p[f"b{w}"] for w, x in zip(WIDTHS, pooled)], axis=1)
    r = np.maximum(h, 0)
    y = 1 / (1 + np.exp(-np.clip(r @ p["out"] + p["ob"][0], -30, 30)))
    loss = -(weight * (labels * np.log(y) + (1 - labels) * np.log(1 - y))).mean() + DECAY / 2 * (p["out"] ** 2).sum()
    dz = (y - labels) * weight / len(labels)
    g = {"out": r.T @ dz + DECAY * p["out"], "ob": np.array([dz.sum()])}
    moved, by = [], []
    dh = np.outer(dz, p["out"]) * (h > 0)
    for k, w in enumerate(WIDTHS):
        d, place = dh[:, k * FILTERS : (k + 1) * FILTERS], places[k]
        g[f"b{w}"], f = d.sum(axis=0), p[f"f{w}"]
        g[f"f{w}"] = np.zeros_like(f)
        for o in range(w):
            at_words = words[place + o]
            g[f"f{w}"][o] = np.einsum("bf,bfd->df", d, p["e"][at_words].sum(axis=2))
            pull = (d[:, :, None] * f[o].T[None]).reshape(-1, DIM)
            moved += [at_words[..., 0].ravel(), at_words[..., 1].ravel()]
            by += [pull, pull]
    at_rows, back = np.unique(np.concatenate(moved), return_inverse=True)
    g["e"] = np.zeros((len(at_rows), DIM))
    np.add.at(g["e"], back, np.concatenate(by))
    g["e"][at_rows == _PAD] = 0
    return float(loss), g, at_rows


def beginning(docs: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Parameters:
    """Embeddings start with the log odds of a bucket between the labels in their first component, so that the greatest
    responses, which alone get gradients, are telling from the start."""
    seen = np.zeros((2, BUCKETS + 1))
    for d, y in zip(docs, labels):
        seen[int(y), np.unique(d)] += 1
    return first_weights(seen, int((labels == 0).sum()), int((labels > 0).sum()), rng)


def first_weights(seen: np.ndarray, n0: int, n1: int, rng: np.random.Generator) -> Parameters:
    """``beginning`` by the number of clean and toxic documents that each bucket is in, and that there are."""
    embed = rng.normal(0, 0.1, (BUCKETS + 1, DIM))
    n0, n1 = max(1, n0), max(1, n1)
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    shown = seen.sum(axis=0)
    embed[:, 0] = np.clip(odds, -3, 3) / 3 * shown / (shown + 10)
    embed[_PAD] = 0
    p = {"e": embed, "out": np.full(len(WIDTHS) * FILTERS, 0.5), "ob": np.array([-1.0])}
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, 0.1, (w, DIM, FILTERS))
        p[f"f{w}"][:, 0, :] += 1.0 / w
        p[f"b{w}"] = np.zeros(FILTERS)
    return p


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the logistic loss, in which both labels weigh the same."""
    rng = np.random.default_rng(seed)
    p = beginning(docs, labels, rng)
    n1, n0 = max(1, int((labels > 0).sum())), max(1, int((labels == 0).sum()))
    learn(p, docs, labels, n0 / n1, rng, epochs)
    return _model(p)


def learn(p: Parameters, docs: list[np.ndarray], labels: np.ndarray, toxic_weight: float, rng: np.random.Generator, epochs: int = EPOCHS) -> None:
    """Move ``p`` by epochs of Adam over all of ``docs``."""
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = np.where(labels > 0, toxic_weight, 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            _, g, at_rows = gradients(p, *together([docs[i] for i in rows]), labels[rows], weight[rows])
            step += 1
            for k, v in p.items():
                part = at_rows if k == "e" else ...
                first[k][part] = 0.9 * first[k][part] + 0.1 * g[k]
                second[k][part] = 0.999 * second[k][part] + 0.001 * g[k] ** 2
                v[part] -= RATE * (first[k][part] / (1 - 0.9**step)) / (np.sqrt(second[k][part] / (1 - 0.999**step)) + 1e-8)

def _model(p: Parameters) -> Model:
    return Model(p["e"].astype(np.float32), {w: p[f"f{w}"] for w in WIDTHS}, {w: p[f"b{w}"].astype(np.float32) for w in WIDTHS}, p["out"].astype(np.float32), float(p["ob"][0]))


def calibrate(model: Model, docs: list[np.ndarray], labels: np.ndarray, langs: list[str], max_false: float = MAX_FALSE) -> None:
    """The least threshold from 0.5 on that rejects at most ``max_false`` of the clean rows, per language where it has
    so many clean rows that this share is one of them or more; other languages, and unknown ones, get that of all. So
    no threshold hangs on the one clean row of the highest score."""

    def least(scores: np.ndarray) -> float:
        ordered = np.sort(scores)[::-1]
        allowed = int(max_false * len(ordered))
        return float(max(0.5, np.nextafter(ordered[allowed], 2))) if len(ordered) else 0.5

    scores, names = model.score(docs), np.array(langs, dtype=object)
    clean = labels == 0
    model.default_threshold = least(scores[clean])
    for lang in sorted({x for x in langs if x is not None}):
        of = clean & (names == lang)
        model.thresholds[lang] = least(scores[of]) if max_false * of.sum() >= 1 else model.default_threshold


def _told(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    told = pick(labels, id_col, label_col, **{id_col: "long", label_col: "int"}).toDF("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    return told.filter(fold("doc_id") != HELD_OUT)


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return pick(docs, id_col, text_col, lang_col, **{id_col: "long", text_col: "string", lang_col: "string"}).toDF("doc_id", "text", "lang")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """Every row with a label (doc_id, toxic, text, lang), but for the held-out ones. Labels that are null or neither 0
    nor 1 don't count; of an id with both labels, 1 counts."""
    told = _told(labels, id_col, label_col).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = F.broadcast(told) if told.count() <= BROADCAST_IDS else told
    return _rows(docs, id_col, text_col, lang_col).filter(fold("doc_id") != HELD_OUT).join(told, "doc_id").select("doc_id", "toxic", "text", "lang")


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """A bounded sample (doc_id, toxic, text, lang) of ``labelled``, for a look at the rows or a model of one machine;
    ``fit`` takes all of them.

    Documents of more than
    ``MAX_TEXT`` characters are left out; the others of a label come by a hash of the id until half of ``MAX_CHARS`` are
    full.
    """
    told = _told(labels, id_col, label_col)
    some = [told.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(m) for y, m in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    chosen = some[0].unionByName(some[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = _rows(docs, id_col, text_col, lang_col)
    # at most MAX_TOXIC + MAX_CLEAN ids are broadcast, and their lengths added up
    lengths = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("_chars"))
    up_to = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    lengths = lengths.filter(F.col("_chars") <= MAX_TEXT)
    fitting = lengths.withColumn("_sum", F.sum("_chars").over(up_to)).filter(F.col("_sum") <= MAX_CHARS // 2).select("doc_id", "toxic")
    return rows.join(F.broadcast(fitting), "doc_id").select("doc_id", "toxic", "text", "lang")


def fold(column: str):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(FOLDS))


def coded(rows: DataFrame) -> DataFrame:
    """Of each row of ``labelled``: key (64 bits of id and text), doc_id, toxic, lang, checks (it sets thresholds), n and
    words (their buckets, four bytes a word)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [buckets(text) for text in batch.column(5).to_pylist()]
            n, raw = pa.array([len(w) for w in words], pa.int64()), pa.array([_packed(w) for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], n, raw], names=["key", "doc_id", "toxic", "lang", "checks", "n", "words"])

    asked = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "toxic", "lang", (fold("doc_id") == CALIBRATION).alias("checks"), "text")
    return asked.mapInArrow(run, "key long, doc_id long, toxic int, lang string, checks boolean, n long, words binary")


def _edges() -> np.ndarray:
    return np.linspace(0, BUCKETS + 1, SLICES + 1).astype(np.int64)


def _sums(parts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, sums) of rows (slice, part, weight, at, x): for each bucket, the weights of the parts that have it (``at``)
    and the sum of their vectors ``x`` of ``width`` times their weight, added in the order of the parts."""
    edges = _edges()

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for k, weight, at, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                size = int(edges[k + 1] - edges[k])
                have = found.setdefault(k, [np.zeros(size), np.zeros((size, width))])
                at = np.frombuffer(at, np.int32)
                have[0][at] += weight
                have[1][at] += np.frombuffer(x, np.float32).reshape(-1, width).astype(np.float64) * weight
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v[0].tobytes() for v in found.values()], pa.binary()), pa.array([v[1].tobytes() for v in found.values()], pa.binary())], names=["slice", "weights", "sums"])

    weights, sums = np.zeros(BUCKETS + 1), np.zeros((BUCKETS + 1, width))
    dealt = parts.repartition("slice").sortWithinPartitions("slice", "part")
    for r in dealt.mapInArrow(add, "slice int, weights binary, sums binary").toLocalIterator():
        own = slice(edges[r["slice"]], edges[r["slice"] + 1])
        weights[own], sums[own] = np.frombuffer(r["weights"]), np.frombuffer(r["sums"]).reshape(-1, width)
    return weights, sums


_PART = "slice int, part int, weight double, at binary, x binary"


def _parts(part: int, weight: float, at: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Vectors ``x`` of the buckets ``at`` (sorted), by slice."""
    edges = _edges()
    cuts = np.searchsorted(at, edges)
    have = [k for k in range(SLICES) if cuts[k] < cuts[k + 1]]
    own = [slice(cuts[k], cuts[k + 1]) for k in have]
    columns = [pa.array(have, pa.int32()), pa.array([part] * len(have), pa.int32()), pa.array([weight] * len(have), pa.float64())]
    columns += [pa.array([(at[i] - edges[k]).astype(np.int32).tobytes() for k, i in zip(have, own)], pa.binary()), pa.array([x[i].astype(np.float32).tobytes() for i in own], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "part", "weight", "at", "x"])


def seen_in(rows: DataFrame) -> np.ndarray:
    """In how many clean and toxic rows of ``coded`` each bucket is."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((BUCKETS + 1, 2))
        for batch in batches:
            for toxic, raw in zip(*(c.to_pylist() for c in batch.columns)):
                seen[np.unique(_unpacked(raw)), toxic] += 1
            if seen.max(initial=0) >= 1 << 23:  # sent as 32-bit floats, which are exact so far
                at = np.flatnonzero(seen.any(axis=1))
                yield _parts(0, 1.0, at, seen[at])
                seen[:] = 0
        at = np.flatnonzero(seen.any(axis=1))
        yield _parts(0, 1.0, at, seen[at])

    return _sums(rows.select("toxic", "words").mapInArrow(run, _PART), 2)[1].T


def trained(rows: DataFrame, seed: int = SEED) -> Model | None:
    """The model of all of ``rows`` (from ``coded``); none if they don't have both labels.

    Each shard goes from the same first weights through epochs over its rows. An embedding is the mean over the shards
    that moved it, other weights that over all, weighted by the shards' rows.
    """
    told = {r["toxic"]: r for r in rows.groupBy("toxic").agg(F.count("*").alias("rows"), F.sum("n").alias("words")).collect()}
    if len(told) < 2:
        return None
    n0, n1 = told[0]["rows"], told[1]["rows"]
    shards = max(-(-(n0 + n1) // SHARD), -(-sum(r["words"] for r in told.values()) // SHARD_WORDS))
    first = first_weights(seen_in(rows), n0, n1, np.random.default_rng(seed))
    first["e"] = first["e"].astype(np.float32).astype(np.float64)
    shared = rows.sparkSession.sparkContext.broadcast(first | {"e": first["e"].astype(np.float32)})
    rest = [k for k in first if k != "e"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs, labels = None, [], []

        def learned() -> Iterator[pa.RecordBatch]:
            if not docs:
                return
            p = {k: v.astype(np.float64) for k, v in shared.value.items()}
            learn(p, docs, np.array(labels, dtype=float), n0 / n1, np.random.default_rng([seed, shard]))
            at = np.flatnonzero((p["e"].astype(np.float32) != shared.value["e"]).any(axis=1))
            yield _parts(shard, float(len(docs)), at, p["e"][at])
            others = np.concatenate([p[k].ravel() for k in rest])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([shard], pa.int32()), pa.array([float(len(docs))]), pa.array([None], pa.binary()), pa.array([others.tobytes()], pa.binary())], names=["slice", "part", "weight", "at", "x"])

        for batch in batches:
            for at, toxic, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if at != shard:
                    yield from learned()
                    shard, docs, labels = at, [], []
                docs.append(_unpacked(raw))
                labels.append(toxic)
        yield from learned()

    dealt = rows.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "toxic", "words", "key", "doc_id")
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "key", "doc_id").select("shard", "toxic", "words")
    parts = hold(dealt.mapInArrow(run, _PART))
    weights, sums = _sums(parts.filter("slice >= 0"), DIM)
    p = {"e": np.where(weights[:, None] > 0, sums / np.maximum(weights, 1)[:, None], first["e"])}
    total, mean = 0.0, np.zeros(sum(first[k].size for k in rest))
    for r in parts.filter("slice < 0").select("weight", "x").orderBy("part").toLocalIterator():
        total, mean = total + r["weight"], mean + np.frombuffer(r["x"]) * r["weight"]
    cuts = np.cumsum([first[k].size for k in rest])[:-1]
    p |= {k: x.reshape(first[k].shape) for k, x in zip(rest, np.split(mean / total, cuts))}
    return _model(p)


def calibrate_by(model: Model, rows: DataFrame, max_false: float = MAX_FALSE) -> None:
    """``calibrate`` on all clean ones of ``rows`` (from ``coded``)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score([_unpacked(raw) for raw in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["lang", "score"])

    scored = hold(rows.filter("toxic = 0").select("lang", "words").mapInArrow(run, "lang string, score double"))
    # of each group, and of all (_all), the score after the highest ones that may be rejected, where it is 0.5 or more
    groups = scored.select("score", F.explode(F.array(F.struct(F.lit(True).alias("_all"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("_all"), "lang"))).alias("_g")).select("_g._all", "_g.lang", "score")
    groups = groups.filter("_all or lang is not null")
    sizes = groups.groupBy("_all", "lang").count().filter(F.col("_all") | (F.col("count") * F.lit(max_false) >= 1)).select("_all", F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.col("count") * F.lit(max_false)).alias("allowed"))
    sizes = {(r["_all"], r["lang"]): r["allowed"] for r in sizes.collect()}
    if not sizes:
        return
    # from an Arrow table: a list of rows would start Python workers of another kind, which then stay
    columns = [pa.array([k[0] for k in sizes], pa.bool_()), pa.array([k[1] for k in sizes], pa.string()), pa.array(list(sizes.values()), pa.int64())]
    allowed = rows.sparkSession.createDataFrame(pa.table(columns, names=["_all", "lang", "allowed"]))
    high = groups.filter("score >= 0.5").withColumn("lang", F.coalesce("lang", F.lit(""))).groupBy("_all", "lang", "score").count()
    up_to = Window.partitionBy("_all", "lang").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    beyond = high.withColumn("_rank", F.sum("count").over(up_to)).join(F.broadcast(allowed), ["_all", "lang"]).filter("_rank > allowed")
    found = {(r["_all"], r["lang"]): float(np.nextafter(r["score"], 2)) for r in beyond.groupBy("_all", "lang").agg(F.max("score").alias("score")).collect()}
    model.default_threshold = found.get((True, ""), 0.5)
    model.thresholds = {lang: found.get((False, lang), 0.5) for every, lang in sizes if not every}


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Model:
    """Train and calibrate, on every labelled row. Without labels of both kinds the model says 0.5 or less of everything."""
    with scratch():
        rows = hold(coded(labelled(docs, labels, **columns)))
        model = trained(rows.filter("not checks"))
        if model is None:
            model = train([np.zeros((0, 2), dtype=np.int32)], np.zeros(1), epochs=0)
            model.out[:] = 0
            return model
        calibrate_by(model, rows.filter("checks"))
        return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, rejected.

    Null texts count as empty, and empty ones get the score of no words; null ids count as the empty string for
    held_out; repeated rows give repeated results. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = pick(docs, id_col, text_col, lang_col, **{id_col: "long", text_col: "string", lang_col: "string"}).toDF("doc_id", "_text", "_lang")
    rows = rows.select("doc_id", "_text", "_lang", (fold("doc_id") == HELD_OUT).alias("held_out"))

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            scores = model.score_texts(batch["_text"])
            limits = np.array([model.thresholds.get(x, model.default_threshold) for x in batch["_lang"]])
            ids = batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            yield pd.DataFrame({"doc_id": ids, "held_out": batch["held_out"], "score": scores, "predicted": (scores >= 0.5).astype("int32"), "rejected": scores >= limits})

    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, rejected boolean")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the language's threshold doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text, lang = names.index(text_col), names.index(lang_col)

    @lean
    def run(batches):
        model = shared.value
        for batch in batches:
            scores = model.score_texts(batch.column(text).to_pylist())
            limits = np.array([model.thresholds.get(x, model.default_threshold) for x in batch.column(lang).to_pylist()])
            yield batch.filter(pa.array(scores < limits))

    fresh = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    return fresh.mapInArrow(run, fresh.schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
