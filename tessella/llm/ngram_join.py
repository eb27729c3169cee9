"""N-gram Jaccard join with a count-vector R-tree.

Documents with equal shingle sets are one class, and classes are what is joined. Linked sets share an element of their
first n - ceil(L n) + 1 elements in an order that all sets have in common, so classes meet at such elements, and nowhere
all pairs of a group of rows are made:

1. One pass over the texts names the classes and counts, over all documents, in how many sets the elements below a
   certain hash are. Elements of many sets come last in the common order, the more frequent the later, so what most
   sets meet at is rare. Counts go by 32 bits of the hash; an order may be any, so a collision only costs time.
2. A second pass gives a row for each first element of a set, and rows of one element meet. Small groups are leaves of
   the R-tree: their pairs are held against the bounds (size, sum of coordinate minima of the count vectors). Larger
   ones index their points in a tree and give a star: each point to the best leader it may link to. Groups beyond
   ``TILE`` points are dealt to tiles, and pairs of tiles meet in tasks of their own; rows of an element that may be in
   very many sets never come together before that.
3. Surviving pairs are verified on whole sets, and linked classes get labels.
4. Within the larger groups, pairs of different labels that may link are searched in the tree, each pair at its first
   common element only, and verified. Pairs within a label need no check: they are connected already.

The result has each document's class and component; links between different texts are all accounted for. Elements are
64-bit hashes of shingles, and sets are compared by these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import count_rtree as tree
from tessella.llm._batches import lean, remember, small_batches
from tessella.llm.count_rtree import Rule
from tessella.operators.components import components
from tessella.plans.columns import pick
from tessella.plans.lineage import hold, scratch, spool
from tessella.plans.skew import lookup

#: Up to so many classes a group is a leaf; a tile of a larger group has so many points.
SMALL, TILE = 8, 2048
#: An element is frequent in more than ``COMMON`` sets; the tasks know so many such elements at most, the most frequent
#: ones (5 bytes each).
COMMON, FREQUENT = 8, 1_000_000
#: Elements of 2 ** HOT sets and more, and such that nobody has counted, are dealt to ``SALTS`` tasks before they meet.
HOT, SALTS = 12, 256
#: Addresses (24 bytes each) of documents to fetch or drop that are broadcast at most; beyond that a shuffled join does it.
BROADCAST_IDS = 500_000
#: Rounds in which the leaders of a group's tiles are tied to each other.
ROUNDS = 3
#: Sets of a file, and pairs of sets that a task verifies.
SETS = 1000
#: Elements and classes that a worker gathers before it hands them on; names of sets it remembers to pass over copies.
AT_ONCE, CLASSES, REMEMBERED = 1_000_000, 20_000, 200_000
#: Of each class the first elements of larger groups that mark where a pair has met before. Marks only save finding a
#: pair twice; without one it is found again and made distinct.
MARKS = 16

_INT = np.int64
remember(__name__, tree._words)


def _column(values, kind=None) -> pa.Array:
    return pa.array(values, type=kind or pa.int64())


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _points(column: pa.Array | list) -> np.ndarray:
    joined = b"".join(column if isinstance(column, list) else column.to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, tree.GROUPS)


def halves(h: np.ndarray) -> np.ndarray:
    """The lower 32 bits of elements, sorted."""
    return np.sort(h.astype(np.uint32))


def _packed(t: np.ndarray) -> bytes:
    """Sorted 32-bit values in two bytes each, where their differences allow."""
    steps = np.diff(t)
    if len(steps) and steps.max() < 1 << 16:
        return b"\x02" + t[:1].tobytes() + steps.astype(np.uint16).tobytes()
    return b"\x04" + t.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if raw[0] == 4:
        return np.frombuffer(raw, np.uint32, offset=1)
    first = np.frombuffer(raw, np.uint32, 1, 1)
    return np.concatenate([first, first + np.cumsum(np.frombuffer(raw, np.uint16, offset=5), dtype=np.uint32)])


_SCANNED = "kind int, doc_id long, text_key long, node long, n int, other long, point binary, rows long, bucket int, tokens binary"
_KINDS = {"doc_id": pa.int64(), "text_key": pa.int64(), "node": pa.int64(), "n": pa.int32(), "other": pa.int64(), "point": pa.binary(), "rows": pa.int64(), "bucket": pa.int32(), "tokens": pa.binary()}


def _told(kind: int, size: int, **columns) -> pa.RecordBatch:
    rest = {n: _column(columns[n], t) if n in columns else pa.nulls(size, t) for n, t in _KINDS.items()}
    return _batch(kind=_column(np.full(size, kind, np.int32), pa.int32()), **rest)


def _scan(rule: Rule, seed: int, buckets: int) -> Callable:
    """From (doc_id, text_key, text): each document's address, set's name and size (kind 0); classes with their number
    of rows here and the first address (kind 1); counted elements, sorted, by range of their lower halves (kind 2)."""
    edges = np.array([-(-(k << 32) // buckets) for k in range(buckets + 1)], dtype=np.uint64)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[int, list] = {}
        waiting, size, limit = [], 0, rule.counted()

        def told_classes() -> pa.RecordBatch:
            parts = list(zip(*classes.values())) or [()] * 6
            ids = [x[1] for x in parts[4]]
            return _told(1, len(classes), node=list(classes), other=parts[0], n=parts[1], point=parts[2], rows=parts[3], doc_id=ids, text_key=[x[2] for x in parts[4]])

        def told_elements() -> pa.RecordBatch:
            t = halves(np.concatenate(waiting)) if waiting else np.zeros(0, np.uint32)
            cuts = np.searchsorted(t, edges)
            have = np.flatnonzero(np.diff(cuts))
            return _told(2, len(have), bucket=have.astype(np.int32), tokens=[_packed(t[cuts[k] : cuts[k + 1]]) for k in have])

        for batch in batches:
            nodes, sizes = [], []
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, key, text in zip(ids, keys, batch.column(2).to_pylist()):
                h = tree.shingles(text, rule.size)
                node = tree.name(h, seed)
                nodes.append(node)
                sizes.append(len(h))
                if not len(h):
                    continue
                at = (i is None, i, key)
                if (have := classes.get(node)) is not None:
                    have[3] += 1
                    if (at[0], at[1] or 0, key) < (have[4][0], have[4][1] or 0, have[4][2]):
                        have[4] = at
                    continue
                classes[node] = [tree.check(h), len(h), tree.counts(h).tobytes(), 1, at]
                waiting.append(h[: np.searchsorted(h, limit)])
                size += len(waiting[-1])
                if len(classes) >= CLASSES:
                    yield told_classes()
                    classes.clear()
                if size >= AT_ONCE:
                    yield told_elements()
                    waiting, size = [], 0
            yield _told(0, len(nodes), doc_id=ids, text_key=keys, node=nodes, n=np.array(sizes, np.int32))
        yield told_classes()
        yield told_elements()

    return run


def _count(common: int) -> Callable:
    """From counted elements (bucket, tokens), sorted by bucket: those of more than ``common`` sets, by the logarithm of
    how many (level)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ("bucket",)):
            t = np.sort(np.concatenate([_unpacked(x) for x in table.column("tokens").to_pylist()]))
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            times = np.diff(np.r_[starts, len(t)])
            many = times > common
            level = np.log2(times[many]).astype(np.int32)
            t = t[starts[many]]
            found = np.unique(level)
            yield _batch(level=_column(found, pa.int32()), tokens=_column([t[level == x].tobytes() for x in found], pa.binary()), count=_column([int((level == x).sum()) for x in found]))

    return run


class Frequent:
    """Elements known to be in many sets, by the lower halves of their hashes, and the logarithm of their number."""

    def __init__(self, rule: Rule, tokens: np.ndarray, levels: np.ndarray):
        order = np.argsort(tokens, kind="stable")
        self.limit, self.tokens, self.levels = rule.counted(), tokens[order], levels[order].astype(np.uint8)

    def level(self, h: np.ndarray) -> np.ndarray:
        """Of each element of a sorted set; 0 for all that aren't known."""
        out = np.zeros(len(h), dtype=np.uint8)
        n = int(np.searchsorted(h, self.limit))
        if n and len(self.tokens):
            t = h[:n].astype(np.uint32)
            at = np.minimum(np.searchsorted(self.tokens, t), len(self.tokens) - 1)
            out[:n] = np.where(self.tokens[at] == t, self.levels[at], 0)
        return out


def _post(rule: Rule, seed: int, frequent, hot: int) -> Callable:
    """From (doc_id, text_key, text): (token, node, tag) for every first element of a set. The tag is the set's size and
    a salt: from 1 on for elements that may be in very many sets, whose rows so don't come together in one task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known = frequent.value
        for batch in batches:
            tokens, nodes, sizes, salts = [], [], [], []
            for text in batch.column(2).to_pylist():
                h = tree.shingles(text, rule.size)
                node = tree.name(h, seed)
                if not len(h) or node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                level = known.level(h)
                at = rule.first(len(h), level)
                tokens.append(h[at])
                salts.append(np.where((level[at] >= hot) | (tokens[-1] >= known.limit), node % SALTS + 1, 0))
                nodes.append(node)
                sizes.append(len(h))
            if tokens:
                each = [len(t) for t in tokens]
                tag = np.repeat(np.array(sizes, _INT) << 16, each) | np.concatenate(salts).astype(_INT)
                yield _batch(token=_column(np.concatenate(tokens).view(_INT)), node=_column(np.repeat(np.array(nodes, _INT), each)), tag=_column(tag))

    return run


def _meet(rule: Rule, most: int) -> Callable:
    """From rows sorted by token and node: the members of small groups that have another of a size that allows a link
    (kind 0), and rows of larger groups and of salted elements (kind 1)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, _INT) for _ in range(3)]  # the last group so far, as more of it may follow
        large = None  # the token of a group that is known to be large
        before = None  # the last row

        def out(token, node, tag, last: bool):
            nonlocal kept, large
            more = tag & 0xFFFF > 0
            if large is not None:
                more |= token == large
            rows = [token[more]], [node[more]]
            token, node, tag = token[~more], node[~more], tag[~more]
            if len(token) and not last:
                large = None
            groups, ends = np.zeros(0, _INT), np.zeros(0, _INT)
            if len(token):
                starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                sizes = np.diff(np.r_[starts, len(token)])
                if not last:
                    at = starts[-1]
                    if sizes[-1] <= most:
                        kept = [token[at:], node[at:], tag[at:]]
                        starts, sizes = starts[:-1], sizes[:-1]
                    else:
                        large = token[-1]
                beyond = np.repeat(sizes > most, sizes)
                at = int(sizes.sum())
                rows[0].append(token[:at][beyond])
                rows[1].append(node[:at][beyond])
                leaf = (sizes > 1) & (sizes <= most)
                a, b = tree.within(starts[leaf], sizes[leaf])
                n = tag >> 16
                fits = rule.sizes(n[a], n[b])
                stays = np.zeros(at, dtype=bool)
                stays[a[fits]] = stays[b[fits]] = True
                groups = node[:at][stays]
                left = np.add.reduceat(stays.astype(_INT), starts) if len(starts) else ends
                ends = np.cumsum(left[left > 0])
            t, r = np.concatenate(rows[0]), np.concatenate(rows[1])
            members = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), _column(groups))
            return _batch(kind=_column(np.repeat(np.array([0, 1], np.int32), [len(ends), len(t)]), pa.int32()), members=pa.concat_arrays([members, pa.nulls(len(t), pa.list_(pa.int64()))]), token=pa.concat_arrays([pa.nulls(len(ends), pa.int64()), _column(t)]), node=pa.concat_arrays([pa.nulls(len(ends), pa.int64()), _column(r)]))

        for batch in batches:
            if not batch.num_rows:
                continue
            token, node, tag = (_array(batch, c) for c in ("token", "node", "tag"))
            fresh = np.r_[before != (token[0], node[0]), (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
            before = token[-1], node[-1]
            rows = [np.concatenate([k, c[fresh]]) for k, c in zip(kept, (token, node, tag))]
            kept = [np.zeros(0, _INT) for _ in range(3)]
            yield out(*rows, False)
        yield out(*kept, True)

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows with one key each, from batches sorted by key; only one tile is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_array(batch, k) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change)
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _leaves(rule: Rule) -> Callable:
    """From rows of small groups sorted by token: the pairs of each that the bounds allow; a group may go on from one
    batch into the next."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> pa.RecordBatch:
            if not table.num_rows:
                return _batch(a=_column([]), b=_column([]))
            token, node, n = (table.column(c).to_numpy() for c in ("token", "node", "n"))
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            a, b = tree.within(starts, np.diff(np.r_[starts, len(token)]))
            n, fine = n.astype(_INT), _points(table.column("point").to_pylist())
            stays = rule.sizes(n[a], n[b])
            a, b = a[stays], b[stays]
            near = np.concatenate([rule.may_link(n[a[i : i + 4096]], fine[a[i : i + 4096]], n[b[i : i + 4096]], fine[b[i : i + 4096]]) for i in range(0, len(a), 4096)]) if len(a) else np.zeros(0, bool)
            a, b = node[a[near]], node[b[near]]
            return _batch(a=_column(np.minimum(a, b)), b=_column(np.maximum(a, b)))

        for batch in batches:
            if not batch.num_rows:
                continue
            token = _array(batch, "token")
            change = np.flatnonzero(np.r_[bool(rest) and _array(rest[-1], "token")[-1] != token[0], token[1:] != token[:-1]])
            if len(change):
                yield pairs(pa.Table.from_batches([*rest, batch.slice(0, change[-1])]))
                rest = [batch.slice(change[-1])]
            else:
                rest.append(batch)
        if rest:
            yield pairs(pa.Table.from_batches(rest))

    return run


_TILE = ("token", "i", "j")


def _stars(rule: Rule) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, _TILE):
            node = table.column("node").to_numpy()
            a, b = tree.star(rule, table.column("n").to_numpy().astype(_INT), _points(table.column("point").to_pylist()))
            yield _batch(a=_column(np.minimum(node[a], node[b])), b=_column(np.maximum(node[a], node[b])))

    return run


def _across(rule: Rule) -> Callable:
    """Pairs of different labels, each at the first element that marks both."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, _TILE):
            node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
            lists = table.column("marks").combine_chunks()
            row, mark = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            before = mark < table.column("token")[0].as_py()
            row, mark = row[before], mark[before]
            _, back, times = np.unique(mark, return_inverse=True, return_counts=True)
            place = np.cumsum(times > 1) - 1  # a mark of one class alone tells nothing
            row, at = row[times[back] > 1], place[back][times[back] > 1]
            bits = np.zeros((len(node), -(-max(1, int((times > 1).sum())) // 8)), dtype=np.uint8)
            np.bitwise_or.at(bits, (row, at // 8), (1 << (at % 8)).astype(np.uint8))
            a, b = tree.across(rule, table.column("n").to_numpy().astype(_INT), _points(table.column("point").to_pylist()), label, table.column("side").to_numpy(), bits)
            yield _batch(a=_column(np.minimum(node[a], node[b])), b=_column(np.maximum(node[a], node[b])))

    return run


def _fetch(rule: Rule, seed: int, whole: bool) -> Callable:
    """From (node, text): the set of each node, in whole hashes or in halves."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node, blob = [], []
            for wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if wanted in seen:
                    continue
                h = tree.shingles(text, rule.size)
                if tree.name(h, seed) == wanted:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(wanted)
                    node.append(wanted)
                    blob.append((h if whole else halves(h)).tobytes())
            yield _batch(node=_column(node), elements=_column(blob, pa.binary()))

    return run


def _verify(rule: Rule, whole: bool) -> Callable:
    """The linked ones of pairs with sets; sure is false where halves don't tell."""
    kind = np.uint64 if whole else np.uint32

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(np.frombuffer(x, kind), np.frombuffer(y, kind)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            found = [rule.links(x, y) if whole else rule.links_by_half(x, y) for x, y in sets]
            stays = np.array([x is not False for x in found], dtype=bool)
            yield _batch(a=_column(_array(batch, "a")[stays]), b=_column(_array(batch, "b")[stays]), sure=pa.array([x is True for x in found if x is not False], pa.bool_()))

    return run


def _buckets(spark: SparkSession) -> int:
    return max(16, min(1 << 16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


class _Join:
    """The tables of one join. A document's address is its id and a hash of its text, so rows without an id, and rows
    that share one, have addresses too."""

    def __init__(self, docs: DataFrame, rule: Rule, id_col: str, text_col: str):
        spark = docs.sparkSession
        self.rule = rule
        self.docs = pick(docs, id_col, text_col, **{id_col: "long", text_col: "string"}).toDF("doc_id", "_text").select("doc_id", F.xxhash64("_text").alias("text_key"), "_text")
        for self.seed in range(4):  # 64 bits name a set; should two sets share a name, other names are taken
            self.scanned = hold(self.docs.mapInArrow(_scan(rule, self.seed, _buckets(spark)), _SCANNED))
            found = self.scanned.filter("kind = 1").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node")
            first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))).alias("first")
            agreed = F.min(F.struct("n", "point")).alias("_set")
            grouped = found.groupBy("node").agg(first, F.sum("rows").alias("rows"), agreed, F.min("other").alias("_other"), F.max("other").alias("_other2"))
            # held as the join deals it: other tables come to it, and its points stay where they are
            self.classes = hold(grouped.select("node", "_set.n", "_set.point", "first", "rows", (F.col("_other") != F.col("_other2")).alias("_two")))
            if self.classes.filter("_two").isEmpty():
                break
        else:
            raise RuntimeError("sets share 64-bit names under four seeds; their number is beyond what such names can tell apart")
        rows = self.scanned.filter("kind = 0").select("doc_id", "text_key", "node", "n")
        self.total = rows.count()
        self.rows = spool(rows, self.total, 10 * SETS)
        self.frequent = spark.sparkContext.broadcast(self._frequent())

    def _frequent(self) -> Frequent:
        counted = self.scanned.filter("kind = 2").select("bucket", "tokens").repartition("bucket").sortWithinPartitions("bucket")
        many = hold(counted.mapInArrow(_count(COMMON), "level int, tokens binary, count long"))
        levels = sorted(((r["level"], r["count"]) for r in many.groupBy("level").agg(F.sum("count").alias("count")).collect()), reverse=True)
        least, room = 64, FREQUENT
        for level, n in levels:
            room -= n
            if room < 0:
                break
            least = level
        told = [(r["level"], np.frombuffer(r["tokens"], np.uint32)) for r in many.filter(F.col("level") >= least).collect()]
        tokens = [t for _, t in told] or [np.zeros(0, np.uint32)]
        return Frequent(self.rule, np.concatenate(tokens), np.repeat(np.array([x for x, _ in told], dtype=np.uint8), [len(t) for _, t in told]))

    def points(self) -> DataFrame:
        return self.classes.select("node", "n", "point")

    def sized(self, members: DataFrame) -> DataFrame:
        """``members`` (token, node, ...) of groups of two or more, with the number of tiles that their group takes."""
        sizes = members.groupBy("token").agg(F.count("*").alias("_members")).select(F.col("token").cast("string").alias("_token"), "_members")
        keyed = members.withColumn("_token", F.col("token").cast("string"))
        sized = lookup(keyed, sizes, "_token", "_members", members.count(), F.col("node")).filter("_members > 1")
        return sized.withColumn("_tiles", F.ceil(F.col("_members") / TILE).cast("long")).drop("_token", "_members")

    def gathered(self, dealt: DataFrame, about: DataFrame) -> DataFrame:
        """Dealt members with what ``about`` has of their nodes, sorted for ``_runs``."""
        return dealt.join(about, "node").repartition(*_TILE).sortWithinPartitions(*_TILE)

    def starred(self, members: DataFrame) -> DataFrame:
        """Candidate pairs (a, b) that tie the members (token, node) of each group and tile to its leaders."""
        dealt = self.sized(members).withColumn("i", F.pmod(F.xxhash64("node"), F.col("_tiles"))).withColumn("j", F.col("i"))
        return self.gathered(dealt.drop("_tiles"), self.points()).select(*_TILE, "node", "n", "point").mapInArrow(_stars(self.rule), "a long, b long")

    def paired(self, members: DataFrame) -> DataFrame:
        """``members`` (token, node, label) of groups with more than one label dealt to tiles (i, j), so that any two of
        different labels share one. A group beyond a tile has the label that most have (side 0, tiles i) apart from the
        others (side 1, tiles j), and these once more among themselves (tiles below 0): a member of that label has a row
        for each tile of the others, and not for each tile of the group."""
        by = members.groupBy("token", "label").count().groupBy("token").agg(F.max(F.struct("count", "label")).alias("_top"), F.sum("count").alias("_all"))
        mixed = by.filter("_all > _top.count").select("token", F.col("_top.label").alias("_main"), F.ceil(F.col("_top.count") / TILE).cast("long").alias("_mains"), F.ceil((F.col("_all") - F.col("_top.count")) / TILE).cast("long").alias("_others"), (F.col("_all") <= TILE).alias("_one"))

        def spread(n: str) -> Column:
            return F.pmod(F.xxhash64("node"), F.col(n))

        def places(n: str, at: Callable) -> Column:
            return F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda k: F.struct(*[x.cast("long").alias(c) for x, c in zip(at(k), ("i", "j", "side"))]))

        mine, zero = spread("_others"), F.lit(0)
        main = places("_others", lambda k: (spread("_mains"), k, zero))
        other = F.concat(places("_mains", lambda k: (k, mine, F.lit(1))), places("_others", lambda k: (-1 - F.least(k, mine), F.greatest(k, mine), mine)))
        one = F.array(F.struct(*[zero.cast("long").alias(c) for c in ("i", "j", "side")]))
        at = F.explode(F.when(F.col("_one"), one).when(F.col("label") == F.col("_main"), main).otherwise(other))
        return members.join(mixed, "token").select("token", "node", "label", at.alias("_at")).select("token", "node", "label", "_at.i", "_at.j", "_at.side")

    def leaves(self, groups: DataFrame) -> DataFrame:
        """Candidate pairs (a, b) of small groups (members)."""
        rows = groups.select(F.xxhash64("members").alias("token"), F.explode("members").alias("node")).join(self.points(), "node")
        return rows.repartition("token").sortWithinPartitions("token").select("token", "node", "n", "point").mapInArrow(_leaves(self.rule), "a long, b long")

    def verified(self, pairs: DataFrame, whole: bool = False) -> DataFrame:
        """The linked ones of ``pairs`` (a, b), checked on the whole sets of their documents: on halves of the elements'
        hashes first, and where those leave a doubt on the hashes themselves."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        n = pairs.count()
        wanted = spool(nodes.join(self.classes, "node").select("node", F.col("first.id").alias("_id"), F.col("first.key").alias("_key")), 2 * n)
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
        texts = self.docs.join(wanted, here).select("node", "_text")
        sets = texts.mapInArrow(_fetch(self.rule, self.seed, whole), "node long, elements binary").groupBy("node").agg(F.first("elements").alias("elements"))
        sets = hold(sets)
        told = pairs.join(sets.toDF("a", "elements_a"), "a").join(sets.toDF("b", "elements_b"), "b")
        found = spool(told.select("a", "b", "elements_a", "elements_b").mapInArrow(_verify(self.rule, whole), "a long, b long, sure boolean"), n, SETS)
        sure, doubt = found.filter("sure").select("a", "b"), found.filter("not sure").select("a", "b")
        return sure if whole or doubt.isEmpty() else sure.union(self.verified(doubt, True))

    def labels(self) -> DataFrame:
        rule = self.rule
        posted = self.docs.mapInArrow(_post(rule, self.seed, self.frequent, HOT), "token long, node long, tag long")
        dealt = posted.repartition(F.col("token"), F.expr("tag & 65535")).sortWithinPartitions("token", "node")
        met = hold(dealt.mapInArrow(_meet(rule, SMALL), "kind int, members array<long>, token long, node long"))
        small, n = met.filter("kind = 0").select("members").distinct(), met.count()
        large = spool(met.filter("kind = 1").select("token", "node").distinct(), n)
        # collected per class are at most the elements of its prefix
        marks = spool(large.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("token")), 1, MARKS).alias("marks")), n)
        # stars of all elements: who finds no link to one group's leader may find one to another's, and needn't be
        # searched for among all members
        tried = spool(self.leaves(small).union(self.starred(large)).distinct(), n)
        linked = self.verified(tried)
        first = components(linked)

        # Tiles of one group have leaders of their own; one class per group and label stands for these, and is tied to
        # the others' before pairs are sought, so that a group of near copies is one label however many tiles it has.
        beyond = spool(large.groupBy("token").count().filter(F.col("count") > TILE).select("token"), n)
        # later rounds go on from the heads of the one before: labels only merge
        heads = large.join(beyond, "token", "left_semi")
        for _ in range(0 if beyond.isEmpty() else ROUNDS):
            heads = heads.join(first, "node", "left").groupBy("token", F.coalesce("label", "node").alias("_label")).agg(F.min("node").alias("node"))
            heads = spool(heads.select("token", "node"), n)
            more = spool(self.starred(heads).distinct().join(tried, ["a", "b"], "left_anti"), n)
            if more.isEmpty():
                break
            tried, linked = tried.union(more), linked.union(self.verified(more))
            first = components(linked)

        members = spool(large.join(first, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label")), n)
        rest = self.gathered(self.paired(members), self.points().join(marks, "node")).select(*_TILE, "side", "node", "n", "point", "label", "marks")
        rest = rest.mapInArrow(_across(rule), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        rest = spool(rest, n)
        if rest.isEmpty():
            return first
        return components(linked.union(self.verified(rest)))


def _resolved(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, least (the first address of the component: that of the
    smallest id, or where none has an id of the least text), class_rows; least is null for texts without shingles."""
    with scratch() as keep:
        join = _Join(docs, rule, id_col, text_col)
        labelled = join.classes.join(join.labels(), "node", "left").select("node", "first", F.col("rows").alias("class_rows"), F.coalesce("label", "node").cast("string").alias("_label"))
        labelled, rows, total = keep(spool(labelled, join.total)), keep(join.rows), join.total
    least = labelled.groupBy("_label").agg(F.min("first").alias("least"), F.count("*").alias("_classes"))
    named = lookup(labelled, least, "_label", "_classes", labelled.count(), F.col("node"))
    named = named.select(F.col("node").cast("string").alias("_node"), "class_rows", "least")
    rows = rows.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node").cast("string")).otherwise(F.concat(F.lit("-"), F.col("text_key"), F.lit("/"), F.coalesce(F.col("doc_id"), F.lit(0)))).alias("_node"))
    return lookup(rows, named, "_node", "class_rows", total, F.xxhash64("doc_id", "text_key"))


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_rows.

    component_id is the smallest id reachable by links, the document's own included; class_rows counts the rows with
    an equal set. Null and empty texts, and those of white space, have no shingles and link with nothing. Rows that
    repeat an id are documents of their own. Rows without an id link like all others, also between two that have one;
    a component without any id has none. An empty table gives an empty result.
    """
    found = _resolved(docs, rule, id_col, text_col)
    alone = F.col("n_shingles") == 0
    return found.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least.id")).alias("component_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_rows")).cast("long").alias("class_rows"))


def keep_one(docs: DataFrame, rule: Rule = Rule(size=5, least=80), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one with the smallest id, or where none has
    an id the one with the least hash of its text. Rows that agree in id and text are one document and stay together;
    texts without shingles all stay."""
    with scratch() as keep:
        found = _resolved(docs, rule, id_col, text_col)
        stays = F.col("least").isNull() | (F.col("least.id").eqNullSafe(F.col("doc_id")) & (F.col("least.key") == F.col("text_key")))
        gone = found.filter(~stays).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
        gone = keep(spool(gone, docs.count()))
    names = docs.columns
    fresh = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    at = {n: F.col(f"_in{names.index(n)}") for n in (id_col, text_col)}
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    addressed = at[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(at[text_col].cast("string")) == F.col("_key"))
    return fresh.join(few, addressed, "left_anti").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
