"""Language-model scoring by masked pseudo-likelihood.

A small bidirectional network predicts every token from the ``WINDOW`` tokens on either side: position-wise
embeddings are summed and squashed, a first softmax names the token's class and a second the token within it. The sum
of the log probabilities of all tokens, each from its neighbours, scores a document.

Words from a number of occurrences on have ids of their own; that number grows as the square root of the corpus, and so
does the vocabulary, about, up to what can be broadcast. All others share ids, buckets by hash; a word's share of its
bucket is its count against the bucket's, so the probabilities of all words add up to 1. Counts of rare words are too
many to send to the executors: those words are joined with them.

Nothing is sampled: word counts come from all documents, and training passes over every token once. Documents are dealt
to shards of a few million tokens by a hash of id and text, and come in the order of that hash, so the model doesn't
depend on how rows are partitioned. Each shard starts from the unigram model, runs minibatches of Adagrad in numpy, and
hands over its weights and number of tokens; the weighted mean is the model. What is gathered so grows with the corpus,
while a task's sum holds one slice of the weights at a time. Texts are cut into words twice, to count them and to code
them; training and scoring read the codes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import isqrt, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._batches import small_batches
from tessella.plans.columns import pick
from tessella.plans.lineage import hold, scratch, spool
from tessella.plans.skew import lookup

CLASSES, EACH, DIM, WINDOW = 32, 32, 16, 2
#: Ids by falling count; the last ones are buckets for all other words, by hash. The least vocabulary, its buckets, and
#: the occurrences, as a multiple of the square root of the number of tokens, from which a word has its own id; the
#: greatest vocabulary, whose weights of 20 MB go to every worker.
VOCABULARY, OTHERS, OWN, MOST = CLASSES * EACH, 124, 0.2, 255 * 255
RATE, BATCH, SEED = 0.3, 8192, 11
#: Distinct words that a task counts before it hands on its counts; words whose id a worker remembers.
COUNTED, REMEMBERED = 200_000, 100_000
#: Words in buckets whose counts the workers have; the counts of all others are joined. Occurrences of a word without any.
KNOWN, UNSEEN = 300_000, 0.5
#: Tokens of a shard: at least so many, and so many for each weight.
SHARD, A_WEIGHT = 2_000_000, 8
#: Tokens that are scored together; so many are put in order of their classes at once, and so many go through the
#: softmaxes at once, as many as a core's cache has room for.
AT_ONCE, SORTED, BLOCK = 500_000, 32768, 512
#: Logits up to so much need no greatest one taken off before they are exponentiated, as none of the sums can overflow.
LOW = 40

#: The last row of the embeddings, whatever their number.
PAD = -1
OFFSETS = tuple(o for o in range(-WINDOW, WINDOW + 1) if o)


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def sized(own: int) -> tuple[int, int]:
    """(size of the vocabulary, a square; the first bucket) where ``own`` words have ids of their own."""
    own = max(own, VOCABULARY - OTHERS)
    side = isqrt(own * VOCABULARY // (VOCABULARY - OTHERS) - 1) + 1
    return side * side, own


def most_own() -> int:
    """So many words at most have ids of their own."""
    return MOST * (VOCABULARY - OTHERS) // VOCABULARY


class Vocabulary(dict):
    """Word to id."""

    def __init__(self, ranked: list[str]):
        super().__init__({w: i for i, w in enumerate(ranked)})
        self.fixed = len(self)
        size, self.first = sized(self.fixed)
        self.others = size - self.first

    def __missing__(self, word: str) -> int:
        out = self.first + zlib.crc32(word.encode()) % self.others
        if len(self) - self.fixed < REMEMBERED:
            self[word] = out
        return out


class Coder(dict):
    """Word to code, in four bytes: the id of a word with its own, then the places of the known words of buckets."""

    def __init__(self, ranked: list[str], known: list[str], counts: list[int]):
        codes = np.arange(len(ranked) + len(known), dtype=np.int32).tobytes()
        super().__init__({w: codes[4 * i : 4 * i + 4] for i, w in enumerate([*ranked, *known])})
        vocabulary = Vocabulary(ranked)
        self.first, self.others, self.unknown = vocabulary.first, vocabulary.others, []
        # with fewer words than the least vocabulary has, some ids stand for none; the last place is that of unknown words
        ids = np.concatenate([np.arange(len(ranked)), np.array(self.buckets([w.encode() for w in known]), dtype=np.int64), [0]])
        self.ids, self.logs = ids.astype(np.uint16), np.concatenate([np.zeros(len(ranked)), np.log(np.array(counts, dtype=float)), [0]])

    def buckets(self, raw: list[bytes]) -> list[int]:
        first, others, crc32 = self.first, self.others, zlib.crc32
        return [first + crc32(x) % others for x in raw]

    def __missing__(self, word: str) -> bytes:
        self.unknown.append(word)
        return b"\xff\xff\xff\xff"

    def encode(self, text: str | None) -> tuple[np.ndarray, float, list[int]]:
        """(ids of the words, two bytes each, sum of the logarithms of the known counts in buckets, hashes of the unknown
        words)."""
        self.unknown = []
        codes = np.frombuffer(b"".join(map(self.__getitem__, words(text))), np.int32)
        ids, logs = np.take(self.ids, codes), float(np.take(self.logs, codes).sum())
        if not self.unknown:
            return ids, logs, []
        raw = [w.encode() for w in self.unknown]
        ids[codes < 0] = self.buckets(raw)
        return ids, logs, hashes(raw)


def hashes(raw: list[bytes]) -> list[int]:
    """What Spark's xxhash64 says of words."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, 42) for x in raw], dtype=np.uint64).view(np.int64).tolist()


def word_hash(word: str) -> int:
    return hashes([word.encode()])[0]


Weights = dict[str, np.ndarray]


class Lexicon(NamedTuple):
    """``words`` have ids of their own; ``counts`` are the tokens of each id. ``known`` are words in buckets, with their
    numbers; ``counted`` (word, count) has all words, of which ``known`` has the ones from ``known_from`` on."""

    words: list[str]
    counts: np.ndarray
    known: list[str]
    known_counts: list[int]
    known_from: int
    counted: DataFrame

    def buckets(self) -> np.ndarray:
        return self.counts[sized(len(self.words))[1] :]


class Model(NamedTuple):
    words: list[str]
    weights: Weights
    lexicon: Lexicon


def start(counts: np.ndarray, seed: int = SEED) -> Weights:
    """The unigram model: biases are log frequencies, embeddings small and random."""
    rng = np.random.default_rng(seed)
    side = isqrt(len(counts))
    p = (counts + 0.5).reshape(side, side)
    return {
        "in": rng.normal(0, 0.1, (len(OFFSETS), len(counts) + 1, DIM)).astype(np.float32),
        "class": np.zeros((DIM, side), dtype=np.float32),
        "class_bias": np.log(p.sum(axis=1) / p.sum()).astype(np.float32),
        "word": np.zeros((side, DIM, side), dtype=np.float32),
        "word_bias": np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def pack(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)]).astype(np.float32)


def unpack(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids with pads around each document, places of the tokens)."""
    pad = np.full(WINDOW, PAD, dtype=np.int64)
    ids = np.concatenate([pad, *(x for d in docs for x in (d, pad))])
    return ids, np.flatnonzero(ids != PAD)


def _softmax(z: np.ndarray, low: bool = False) -> np.ndarray:
    """Of each row, in place; ``low``: no entry goes beyond ``LOW``."""
    if not low:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray, low: bool = False) -> np.ndarray:
    """The log probability of one column per row; each row goes by its own greatest value, unless no entry goes beyond
    ``LOW``."""
    if not low:
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(z)), at].astype(np.float64)
    np.exp(z, out=z)
    return own - np.log(z.sum(axis=1))


def _short(x: np.ndarray) -> np.ndarray:
    """Ids in two bytes: these are sorted fastest."""
    return x.astype(np.uint16)


class Joined(NamedTuple):
    """Weights as they are worked with: embeddings of an id together, by offset; those of the classes, and of the tokens
    within each class, with the biases as their last column."""

    table: np.ndarray
    classes: np.ndarray
    within: np.ndarray

    @classmethod
    def of(cls, w: Weights) -> Joined:
        classes = np.concatenate([w["class"].T, w["class_bias"][:, None]], axis=1)
        within = np.concatenate([w["word"].transpose(0, 2, 1), w["word_bias"][:, :, None]], axis=2)
        return cls(np.ascontiguousarray(w["in"].transpose(1, 0, 2)), classes, within)

    def named(self) -> Weights:
        """Views of all weights."""
        return {
            "in": self.table.transpose(1, 0, 2),
            "class": self.classes[:, :-1].T,
            "class_bias": self.classes[:, -1],
            "word": self.within[:, :, :-1].transpose(0, 2, 1),
            "word_bias": self.within[:, :, -1],
        }

    def low(self) -> bool:
        """Whether no logit can go beyond ``LOW``: hidden states are within -1 and 1."""
        return all(np.abs(x).sum(axis=-1).max() < LOW for x in (self.classes, self.within))

    def logits(self, h: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Those of the classes and of the tokens within their class. Memory goes by columns, which are long: sums and
        greatest values of short rows cost several times more."""
        p = self.classes @ h
        q = np.empty_like(p)
        for c, a, b in runs:
            np.matmul(self.within[c], h[:, a:b], out=q[:, a:b])
        return p.T, q.T


def _by_class(ids: np.ndarray, rows: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the tokens by class, and in that order their places, classes, and numbers within their class)."""
    of = _short(ids[rows] // side)
    order = np.argsort(of, kind="stable")
    rows, of = rows[order], of[order]
    return order, rows, of, ids[rows] - of.astype(np.int64) * side


def _hidden(flat: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    """Hidden states of tokens with their neighbours' rows in ``flat``, and a last column of ones, for the biases."""
    out = np.ones((len(near[0]), flat.shape[1] + 1), dtype=flat.dtype)
    x = np.take(flat, near[0], axis=0)
    for rows in near[1:]:
        x += np.take(flat, rows, axis=0)
    np.tanh(x, out=out[:, :-1])
    return out


def _blocks(of: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(from, to, [(class, from, to) within the block]) of tokens in order of their classes."""
    for a in range(0, len(of), BLOCK):
        x = of[a : a + BLOCK]
        cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
        yield a, a + len(x), list(zip(x[cuts[:-1]].tolist(), cuts, cuts[1:]))


def log_probabilities(w: Weights, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each token at ``at``, from its neighbours."""
    out, side, x = np.empty(len(at)), len(w["word"]), Joined.of(w)
    flat, low = x.table.reshape(-1, x.table.shape[2]), x.low()
    for first in range(0, len(at), SORTED):
        order, rows, of, place = _by_class(ids, at[first : first + SORTED], side)
        # the pad's rows are the last ones
        h = np.ascontiguousarray(_hidden(flat, [ids[rows + o] * len(OFFSETS) + k for k, o in enumerate(OFFSETS)]).T)
        for a, b, runs in _blocks(of):
            p, q = x.logits(h[:, a:b], runs)
            out[first + order[a:b]] = _log_softmax_at(p, of[a:b], low) + _log_softmax_at(q, place[a:b], low)
    return out


def _gradients(x: Joined, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, Joined]:
    """(ids with a gradient, gradients of the mean negative log probability of the tokens at ``rows``; of the embeddings,
    those of these ids)."""
    n, side, first = len(rows), len(x.within), rows.min() - WINDOW
    around = ids[first : rows.max() + WINDOW + 1]
    _, rows, of, place = _by_class(ids, rows, side)
    number = np.zeros(len(x.table), dtype=np.int64)
    number[around] = 1
    met = np.flatnonzero(number)
    number[met] = np.arange(len(met))
    around, rows = number[around], rows - first
    near = [around[rows + o] for o in OFFSETS]
    flat = np.take(x.table, met, axis=0).reshape(-1, x.table.shape[2])
    by_row = _hidden(flat, [at * len(OFFSETS) + k for k, at in enumerate(near)])
    h, low, each = np.ascontiguousarray(by_row.T), x.low(), np.arange(BLOCK)
    classes, within, dh = np.zeros_like(x.classes), np.zeros_like(x.within), np.empty_like(h[:-1])
    for a, b, runs in _blocks(of):
        d = dh[:, a:b]
        p, q = x.logits(h[:, a:b], runs)
        for z, at in ((p, of[a:b]), (q, place[a:b])):
            _softmax(z, low)[each[: b - a], at] -= 1
        classes += p.T @ by_row[a:b]
        for c, i, j in runs:
            within[c] += q[i:j].T @ by_row[a + i : a + j]
            np.matmul(x.within[c, :, :-1].T, q[i:j].T, out=d[:, i:j])
        d += x.classes[:, :-1].T @ p.T
    classes /= n
    within /= n
    dh *= (1 - h[:-1] * h[:-1]) / n
    table = np.empty((len(met), *x.table.shape[1:]), dtype=dh.dtype)
    summed = dh.astype(np.float64)
    for k, at in enumerate(near):
        table[:, k] = np.array([np.bincount(at, d, len(met)) for d in summed]).T
    return met, Joined(table, classes, within)


def gradients(w: Weights, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[str, np.ndarray, object]]:
    """Gradients of the mean negative log probability of the tokens at ``rows``, by the names of the weights: (weights,
    gradient, what part of them)."""
    met, found = _gradients(Joined.of(w), ids, rows)
    for key, gradient in found.named().items():
        yield key, gradient, (slice(None), met) if key == "in" else ...


def _adagrad(w: np.ndarray, seen: np.ndarray, gradient: np.ndarray) -> None:
    seen += gradient * gradient
    step = np.sqrt(seen)
    np.divide(gradient, step, out=step)
    step *= RATE
    w -= step


class Trainer:
    """Adagrad over minibatches, as documents come."""

    def __init__(self, weights: Weights):
        self.joined = Joined.of(weights)
        self.seen = Joined(*(np.full_like(x, 1e-3) for x in self.joined))
        self.w = self.joined.named()
        self.tokens = 0

    def learn(self, ids: np.ndarray, at: np.ndarray) -> None:
        for a in range(0, len(at), BATCH):
            met, found = _gradients(self.joined, ids, at[a : a + BATCH])
            _adagrad(self.joined.classes, self.seen.classes, found.classes)
            _adagrad(self.joined.within, self.seen.within, found.within)
            table, seen = self.joined.table[met], self.seen.table[met]
            _adagrad(table, seen, found.table)
            self.joined.table[met], self.seen.table[met] = table, seen
        self.tokens += len(at)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, count) over all documents; tasks hand on partial counts whenever they hold many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "count"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                counts.update(words(text))
                if len(counts) > COUNTED:
                    yield told()
                    counts.clear()
        yield told()

    return docs.mapInArrow(run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def lexicon(docs: DataFrame) -> Lexicon:
    """The words of ``docs`` (doc_id, _text), counted over all of them."""
    counted = hold(count_words(docs))
    levels = sorted(((r["count"], r["words"]) for r in counted.groupBy("count").agg(F.count("*").alias("words")).collect()), reverse=True)
    least = OWN * sqrt(sum(c * n for c, n in levels))
    own = min(most_own(), max(VOCABULARY - OTHERS, sum(n for c, n in levels if c >= least)))
    ranked = [(r["word"], r["count"]) for r in counted.orderBy(F.desc("count"), "word").limit(own).collect()]
    top, (size, bucket) = [w for w, _ in ranked], sized(len(ranked))
    counts = np.zeros(size)
    counts[: len(ranked)] = [c for _, c in ranked]
    # the buckets of other words: the total of all words, shared out by hash, less that of the words with ids
    others = size - bucket
    for r in counted.groupBy((F.crc32(F.col("word")) % others).cast("int").alias("bucket")).agg(F.sum("count").alias("count")).collect():
        counts[bucket + r["bucket"]] = r["count"]
    for w, c in ranked:
        counts[bucket + zlib.crc32(w.encode()) % others] -= c
    known_from, room = 2**62, len(ranked) + KNOWN
    for c, n in levels:
        room -= n
        if room < 0:
            break
        known_from = c
    found, mine = counted.filter(F.col("count") >= known_from).toArrow(), set(top)
    known = [(w, c) for w, c in zip(found["word"].to_pylist(), found["count"].to_pylist()) if w not in mine]
    return Lexicon(top, counts, [w for w, _ in known], [c for _, c in known], known_from, counted)


def coded(docs: DataFrame, words: Lexicon) -> DataFrame:
    """Of each row of ``docs`` (doc_id, _text): doc_id, _text_id (128 bits that name the text), _key (64 bits of id and
    text), n_tokens, _known (the sum of the logarithms of known counts), _ids (two bytes a token), _rare (hashes of
    the words whose counts have to be joined)."""
    # made once here, and unpacked once in a worker
    shared = docs.sparkSession.sparkContext.broadcast(Coder(words.words, words.known, words.known_counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            found = [coder.encode(text) for text in batch.column(3).to_pylist()]
            n = pa.array([len(ids) for ids, _, _ in found], pa.int64())
            ids = pa.array([ids.tobytes() for ids, _, _ in found], pa.binary())
            rare = pa.array([x for _, _, x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n, pa.array([x for _, x, _ in found], pa.float64()), ids, rare], names=["doc_id", "_text_id", "_key", "n_tokens", "_known", "_ids", "_rare"])

    text = F.coalesce("_text", F.lit(""))
    named = F.concat_ws("/", F.xxhash64(text).cast("string"), F.xxhash64(F.lit(1), text).cast("string"))
    rows = docs.select("doc_id", named.alias("_text_id"), F.xxhash64("doc_id", "_text").alias("_key"), "_text")
    return rows.mapInArrow(run, "doc_id long, _text_id string, _key long, n_tokens long, _known double, _ids binary, _rare array<long>")


def _decoded(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in column.to_pylist()]


def trained(rows: DataFrame, words: Lexicon) -> Model:
    """The model of all of ``rows`` (from ``coded``)."""
    first = start(words.counts)
    shared = rows.sparkSession.sparkContext.broadcast(first)
    total, slices = pack(first).size, 64
    size = -(-total // slices)
    n = rows.agg(F.sum("n_tokens")).first()[0] or 0
    shards = -(-n // max(SHARD, A_WEIGHT * total))
    if not n:
        return Model(words.words, first, words)
    names = ["shard", "slice", "weights", "tokens"]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, shard, waiting, held = None, None, [], 0

        def learn() -> None:
            nonlocal waiting, held
            if held:
                trainer.learn(*padded(waiting))
            waiting, held = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            learn()
            if trainer is not None and trainer.tokens:
                flat = pack(trainer.w)
                parts = [flat[i * size : (i + 1) * size].tobytes() for i in range(slices)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * slices, pa.int32()), pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary()), pa.array([trainer.tokens] * slices, pa.int64())], names=names)

        for batch in batches:
            for at, ids in zip(batch.column(0).to_pylist(), _decoded(batch.column(1))):
                if at != shard:
                    yield from told()
                    trainer, shard = Trainer(shared.value), at
                waiting.append(ids)
                held += len(ids)
                if held >= 4 * BATCH:
                    learn()
        yield from told()

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, k, raw, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                have = sums.setdefault(k, [0.0, 0])
                have[0] = have[0] + np.frombuffer(raw, np.float32).astype(np.float64) * tokens
                have[1] += tokens
        means = [(x / n).astype(np.float32).tobytes() for x, n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(sums), pa.int32()), pa.array(list(sums), pa.int32()), pa.array(means, pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], names=names)

    kinds = "shard int, slice int, weights binary, tokens long"
    dealt = rows.filter("n_tokens > 0").select(F.pmod("_key", F.lit(shards)).cast("int").alias("shard"), "_ids", "_key")
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "_key").select("shard", "_ids")
    parts = dealt.mapInArrow(train, kinds).repartition("slice").sortWithinPartitions("slice", "shard")
    means = {r["slice"]: r["weights"] for r in parts.mapInArrow(average, kinds).collect()}
    return Model(words.words, unpack(np.frombuffer(b"".join(means[k] for k in range(slices)), np.float32), first), words)


def fit(docs: DataFrame) -> Model:
    """The model of all of ``docs`` (doc_id, _text)."""
    with scratch() as keep:
        words = lexicon(docs)
        keep(words.counted)
        return trained(hold(coded(docs, words)), words)


def score(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, log_likelihood (the sum, natural log), mean (per token).

    The model is fitted on ``docs`` itself unless given; a word that it has not seen counts as one that occurs
    ``UNSEEN`` times. Null, empty and white texts have no tokens: the sum is 0 and the mean null. Null ids stay null.
    Equal texts get equal results: the last digits of a sum can hang on a document's place in its batch, so of the sums
    of one text the least counts. An empty table gives an empty result.
    """
    rows = pick(docs, id_col, text_col, **{id_col: "long", text_col: "string"}).toDF("doc_id", "_text")
    with scratch() as keep:
        words = lexicon(rows) if model is None else model.lexicon
        found = hold(coded(rows, words))
        scored = _scored(found, trained(found, words) if model is None else model)
        return keep(spool(scored))


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    words = model.lexicon
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, words.buckets()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, buckets = shared.value
        share = np.zeros(len(weights["word"]) ** 2)
        share[len(share) - len(buckets) :] = -np.log(np.maximum(buckets, UNSEEN))

        def totals(docs: list[np.ndarray]) -> np.ndarray:
            out, n = np.zeros(len(docs)), np.array([len(d) for d in docs], dtype=np.int64)
            if n.any():
                ids, at = padded(docs)
                each = log_probabilities(weights, ids, at) + share[ids[at]]
                out[n > 0] = np.add.reduceat(each, (np.cumsum(n) - n)[n > 0])
            return out

        for batch in batches:
            docs, found, size = [], [], 0
            for ids in _decoded(batch.column(2)):
                docs.append(ids)
                size += len(ids)
                if size >= AT_ONCE:
                    found.append(totals(docs))
                    docs, size = [], 0
            found.append(totals(docs))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate(found)), *batch.columns[3:]], names=["doc_id", "_text_id", "_sum", "n_tokens", "_known", "_rare"])

    coded = rows.select("doc_id", "_text_id", "_ids", "n_tokens", "_known", "_rare")
    scored = hold(coded.mapInArrow(run, "doc_id long, _text_id string, _sum double, n_tokens long, _known double, _rare array<long>").withColumn("_row", F.monotonically_increasing_id()))
    counts = words.counted.filter(F.col("count") < words.known_from).groupBy(F.xxhash64("word").alias("_word")).agg(F.max("count").alias("count"))
    rare = scored.select("_row", F.explode("_rare").alias("_word")).join(counts, "_word", "left")
    # in units of 1e-9, so that the sum is the same in any order
    own = F.round(F.log(F.coalesce(F.col("count").cast("double"), F.lit(UNSEEN))) * 1e9).cast("long")
    rare = rare.groupBy("_row").agg(F.sum(own).alias("_own"))
    slim = scored.drop("_rare").join(rare, "_row", "left")
    same = scored.groupBy("_text_id").agg(F.min("_sum").alias("_least"), F.count("*").alias("_copies")).filter("_copies > 1")
    found = lookup(slim, same, "_text_id", "_copies", scored.count(), F.col("_row"))
    total = F.coalesce("_least", "_sum") + F.col("_known") + F.coalesce("_own", F.lit(0)) / F.lit(1e9)
    out = found.select("doc_id", "n_tokens", total.alias("log_likelihood"))
    return out.withColumn("mean", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
