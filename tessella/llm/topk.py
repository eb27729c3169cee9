"""Exact top-k search by inner product with a three-phase uniform threshold.

Vectors are dealt to cells, each around one of a bounded number of vectors, and cells to blocks of some thousand rows.
The components are dealt to ``LISTS`` lists; a list scores a vector by its own components only, and the score is the
sum over lists. Of each cell and list the tasks know the vector in the middle, how far others are from it, and the
greatest norm: by Cauchy and Schwarz, a bound on what any vector of the cell scores.

1. Each query goes to one block each of its ``FIRST`` cells of the highest bounds, whose lists name their best entries;
   the k-th best of their full scores is a safe cutoff, since the true k-th is at least that.
2. The cutoff goes with the query to the cells whose bound reaches it, and to no other. A score that reaches it needs
   one list with at least cutoff / LISTS (pigeonhole, also for negative scores), so the lists hand over just the
   entries from there on.
3. The scores of these entries are resolved exactly, and those behind the cutoff (by score, then id) are left out.

A task holds one block of vectors, and queries pass by in batches. Entries and scores are integers, held as doubles
while every sum is below 2 ** 53 and as integers beyond. How many cells a cutoff leaves out depends on the data: of
clustered vectors most, of vectors that are spread evenly over a sphere of many dimensions hardly any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.columns import pick
from tessella.plans.lineage import hold, scratch, spool

SCALE, K, LISTS = 64, 20, 2
#: Rows of a block, and the least if they are wide; numbers of a block, and of what all tasks know of the cells.
BLOCK, LEAST_BLOCK, NUMBERS = 4096, 64, 1 << 21
#: Cells at most; cells whose blocks make the cutoff.
CELLS, FIRST = 1024, 2
#: Queries that are scored at once: their scores against a block of vectors are 8 MB a list.
AT_ONCE = 256
#: What bounds in doubles are raised by, against their rounding, as a share of the numbers that they are made of.
SLACK = 1e-9

_FOUND = "query_id long, vec_id long, score long"


def _integers(values: list[list[float]], scale: float, width: int) -> np.ndarray:
    """Integer components as doubles; a missing component counts as 0."""
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def _exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of a type in which all scores are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return q, x
    return tuple(np.array([[int(c) for c in row] for row in m], dtype=object).reshape(m.shape) for m in (q, x))


def _cuts(width: int, lists: int) -> list[tuple[int, int]]:
    at = np.linspace(0, width, lists + 1).astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def _lists(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    return [q[:, a:b] @ x[:, a:b].T if b > a else np.zeros((len(q), len(x)), dtype=q.dtype) for a, b in _cuts(q.shape[1], lists)]


def _long(score) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=int)
    return np.lexsort((ids, -scores))[:k]


def _norms(x: np.ndarray, lists: int) -> np.ndarray:
    """Of each row and list; finite, as squares of great numbers would not be."""
    most = np.abs(x).max(initial=1.0)
    return np.stack([np.linalg.norm(x[:, a:b] / most, axis=1) * most for a, b in _cuts(x.shape[1], lists)], axis=1)


def bounds(q: np.ndarray, middle: np.ndarray, far: np.ndarray, norm: np.ndarray, lists: int) -> np.ndarray:
    """Of each query and cell: no vector of the cell scores more. ``far`` and ``norm`` are by cell and list."""
    total, own = np.zeros((len(q), len(middle))), _norms(q, lists)
    for k, (a, b) in enumerate(_cuts(q.shape[1], lists)):
        near = q[:, a:b] @ middle[:, a:b].T
        reach = own[:, k : k + 1] * far[None, :, k]
        total += np.minimum(near + reach + SLACK * (np.abs(near) + reach), own[:, k : k + 1] * norm[None, :, k] * (1 + SLACK))
    return total


def _assign(scale: float, width: int, middle: np.ndarray, lists: int) -> Callable:
    """From (vec_id, v): the cell of each vector, with its integers; at the end, what the cells hold here: (cell, null,
    null, the greatest distance from the middle and the greatest norm by list, the number of vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = np.zeros(len(middle), dtype=np.int64), np.zeros((len(middle), 2 * lists))
        none = pa.list_(pa.float64())
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column(1).to_pylist(), scale, width)
            great = max(np.abs(x).max(initial=1.0), np.abs(middle).max(initial=1.0))
            y, m = x / great, middle / great
            cell = ((m * m).sum(axis=1)[None, :] - 2 * y @ m.T).argmin(axis=1)
            told = np.concatenate([_norms(x - middle[cell], lists), _norms(x, lists)], axis=1)
            np.maximum.at(most, cell, told)
            n += np.bincount(cell, minlength=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.nulls(len(x), none), pa.nulls(len(x), pa.int64())], names=["cell", "vec_id", "x", "most", "rows"])
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.nulls(len(have), pa.int64()), pa.nulls(len(have), pa.binary()), pa.array([r.tolist() for r in most[have]], none), pa.array(n[have])], names=["cell", "vec_id", "x", "most", "rows"])

    return run


class Cells:
    """The cells that have vectors: vector in the middle, greatest distances and norms, number of blocks."""

    def __init__(self, middle: np.ndarray, told: dict[int, tuple[list[float], int]], lists: int, block: int):
        self.at = np.array(sorted(told), dtype=np.int64)
        most = np.array([told[c][0] for c in self.at.tolist()]).reshape(-1, 2 * lists)
        self.middle, self.far, self.norm, self.lists = middle[self.at], most[:, :lists], most[:, lists:], lists
        self.blocks = np.array([-(-told[c][1] // block) for c in self.at.tolist()], dtype=np.int64)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return bounds(q, self.middle, self.far, self.norm, self.lists)


def _route(cells: Cells, first: int | None) -> Callable:
    """From (vec_id, x, cut_score, cut_id): the cells that a query goes to: the ``first`` ones by bound, or if none is
    given all that its cutoff doesn't leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(batch.num_rows, -1)
            most = cells.bounds(q)
            if first is None:
                cut = np.array([-np.inf if c is None else float(c) for c in batch.column(2).to_pylist()])
                # a score held as a double may be rounded up
                to = [cells.at[row].tolist() for row in most >= (cut - np.abs(cut) * SLACK)[:, None]]
            else:
                to = cells.at[np.argsort(-most, axis=1, kind="stable")[:, :first]].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int32()))], names=["vec_id", "x", "cut_score", "cut_id", "cells"])

    return run


def _search(k: int, lists: int) -> Callable:
    """From rows sorted by block, each block's vectors before the queries that came to it: the entries that may count."""

    def answers(qids: np.ndarray, q: np.ndarray, cuts: list, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        q, x = _exact(q, x)
        scored = _lists(q, x, lists)
        for row, (query, cut) in enumerate(zip(qids.tolist(), cuts)):
            if cut is None:
                seen = np.unique(np.concatenate([np.argpartition(-s[row], min(k, len(ids) - 1))[: k + 1] if s.dtype != object else _best(ids, s[row], k + 1) for s in scored])) if len(ids) > k else np.arange(len(ids))
                # the query's own rows may be among a list's best; without them enough others have to be left
                if len(ids) > k and (ids[seen] == query).any():
                    seen = np.arange(len(ids))
            else:
                enough = np.zeros(len(ids), dtype=bool)
                for s in scored:
                    enough |= (s[row] * lists >= cut[0]).astype(bool)
                seen = np.flatnonzero(enough)
            seen = seen[ids[seen] != query]
            total = sum(s[row, seen] for s in scored)
            if cut is not None:
                stays = ((total > cut[0]) | ((total == cut[0]) & (ids[seen] <= cut[1]))).astype(bool)
                seen, total = seen[stays], total[stays]
            for i in _best(ids[seen], total, k):
                yield query, int(ids[seen[i]]), _long(total[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, x, done = None, [], [], None
        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key[a] != block:
                    block, ids, x, done = key[a], [], [], None
                part = batch.slice(a, b - a)
                asks = np.array(part.column(2).to_pylist(), dtype=bool)
                at, raw = np.array(part.column(3).to_pylist(), dtype=np.int64), part.column(4).to_pylist()
                if not asks.all():
                    ids.append(at[~asks])
                    x += [r for r, y in zip(raw, asks) if not y]
                if asks.any() and ids:
                    if done is None:
                        done = np.concatenate(ids), np.frombuffer(b"".join(x)).reshape(len(x), -1)
                        x = []
                    rows = np.flatnonzero(asks)
                    score, cut_id = part.column(5).to_pylist(), part.column(6).to_pylist()
                    for some in range(0, len(rows), AT_ONCE):
                        own = rows[some : some + AT_ONCE]
                        q = np.frombuffer(b"".join(raw[i] for i in own)).reshape(len(own), -1)
                        found = list(answers(at[own], q, [None if score[i] is None else (score[i], cut_id[i]) for i in own], *done))
                        told = [list(c) for c in zip(*found)] or [[], [], []]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in told], names=["query_id", "vec_id", "score"])

    return run


def index(vectors: DataFrame, scale: float = SCALE, lists: int = LISTS, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Cells] | None:
    """(vectors: cell, vec_id, x; the cells), or None if no vector takes part. The middles are those vectors, at most
    ``CELLS``, whose ids come first by hash; every vector is in a cell."""
    rows = pick(vectors, id_col, vector_col, **{id_col: "long", vector_col: "array<double>"}).toDF("vec_id", "v")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    width = max(1, width)
    block = max(LEAST_BLOCK, min(BLOCK, NUMBERS // width))
    most = max(1, min(CELLS, -(-n // block), NUMBERS // width))
    middle = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).collect()]
    middle = np.unique(_integers(middle, scale, width), axis=0)
    dealt = hold(rows.mapInArrow(_assign(scale, width, middle, lists), "cell int, vec_id long, x binary, most array<double>, rows long"))
    greatest = F.array(*[F.max(F.col("most")[i]) for i in range(2 * lists)])
    told = dealt.filter("vec_id is null").groupBy("cell").agg(greatest.alias("most"), F.sum("rows").alias("rows")).collect()
    return dealt.filter("vec_id is not null").select("cell", "vec_id", "x"), Cells(middle, {r["cell"]: (r["most"], r["rows"]) for r in told}, lists, block)


def routes(queries: DataFrame, cells: Cells, first: int | None = None) -> DataFrame:
    """``queries`` (vec_id, x, cut_score, cut_id) with the cells that each goes to."""
    return queries.mapInArrow(_route(cells, first), "vec_id long, x binary, cut_score long, cut_id long, cells array<int>")


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = K, scale: float = SCALE, lists: int = LISTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per query and rank: query_id, rank, vec_id, score.

    ``is_query`` is a condition on vec_id (every 20th id if not given). Vectors that are null or have a null, NaN or
    infinite component, and rows without an id, take no part. Every other row is a candidate, also where ids repeat; but
    rows with the query's own id are not. A query's id that repeats asks with each of its vectors, and the scores of
    all are ranked together. Vectors of different length are compared as if the shorter ended in zeros. A query with
    fewer than k others gets all of them; an empty table gives an empty result.
    """
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    chosen = F.pmod(F.col("vec_id"), F.lit(20)) == 0 if is_query is None else is_query
    with scratch() as keep:
        found = index(vectors, scale, lists, id_col, vector_col)
        if found is None:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        rows, cells = found
        blocks = F.lit(np.bincount(cells.at, cells.blocks).astype(int).tolist())
        of = F.element_at(blocks, F.col("cell") + 1)
        none = F.lit(None).cast("long")
        held = rows.select("cell", F.pmod(F.xxhash64("vec_id", "x"), of).cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "x", none.alias("cut_score"), none.alias("cut_id"))

        def searched(routed: DataFrame, parts: Column) -> DataFrame:
            routed = routed.withColumn("cell", F.explode("cells")).withColumn("part", F.explode(parts)).select("cell", F.col("part").cast("int").alias("part"), F.lit(True).alias("asks"), "vec_id", "x", "cut_score", "cut_id")
            return held.unionByName(routed).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks").mapInArrow(_search(k, lists), _FOUND)

        queries = rows.filter(chosen).select("vec_id", "x")
        asked = queries.select("vec_id", "x", none.alias("cut_score"), none.alias("cut_id"))
        local = searched(routes(asked, cells, FIRST), F.array(F.pmod(F.xxhash64("vec_id"), of)))
        cutoff = ranked(local).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cut_score"), F.col("vec_id").alias("cut_id"))
        told = queries.join(cutoff, "vec_id", "left").select("vec_id", "x", "cut_score", "cut_id")
        found = searched(routes(told, cells), F.sequence(F.lit(0), (of - 1).cast("int")))
        return keep(spool(ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
