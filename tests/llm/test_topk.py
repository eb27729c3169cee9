from __future__ import annotations

import math
import random

import pytest

from tessella.llm.topk import top_k


def brute(rows, k=20):
    """Every sound row is a candidate; rows with the query's id are the query's own."""
    sound = [(i, [math.floor(64 * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in sound if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for own, v in sound if own == q for i, w in sound if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(seed, n, dim=8, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, scale), 3) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, [1.0] * dim) for i in range(30)]  # a common vector: ties
    rows += [(None, [1.0] * dim), (n + 40, None), (n + 41, [1.0, None] + [0.0] * (dim - 2)), (n + 42, [float("nan")] * dim), (n + 43, [float("inf")] * dim), (0, [9.0] * dim), (1, [0.5] * dim), rows[5]]
    return rows


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_like_brute_force(spark, monkeypatch, lists):
    from tessella.llm import topk

    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "LEAST_BLOCK", 40)
    monkeypatch.setattr(topk, "AT_ONCE", 3)
    rows = vectors(1, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(df, lists=lists).collect())
    asked = [(i, v and [spark_float(x) for x in v]) for i, v in rows]
    assert got == brute(asked)


def spark_float(x):
    import numpy as np

    return None if x is None else float(np.float32(x))


def test_few_rows_and_extra_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (20, [])], "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("v", F.lit("z"))
    got = sorted(tuple(r) for r in top_k(df).collect())
    assert got == [(0, 1, 1, 64 * 64), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]
    assert top_k(df.limit(0)).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    big = float(2**24)
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [big, 3.0])]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 2, 2**60 + 64 * 192), (0, 2, 1, 2**60 + 64 * 128)]


def test_repeated_ids_are_candidates_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (20, [0.0, 1.0]), (20, [3.0, 0.0])]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == brute(rows) and [r[2:] for r in got if r[0] == 0][:2] == [(1, 64 * 320), (1, 64 * 320)]


def test_cutoffs_leave_cells_out(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessella.llm import topk

    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = random.Random(8)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in middles[i % 12]]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(df).collect()) == brute(rows)
    held, cells = topk.index(df)
    queries = held.filter("vec_id % 20 = 0").join(top_k(df).filter("rank = 20").selectExpr("query_id AS vec_id", "score AS cut_score", "vec_id AS cut_id"), "vec_id")
    sent = topk.routes(queries.select("vec_id", "x", "cut_score", "cut_id"), cells).agg(F.sum(F.size("cells"))).first()[0]
    assert len(cells.at) > 15 and sent < 0.5 * queries.count() * len(cells.at)


def test_bounds_hold():
    import numpy as np

    from tessella.llm import topk

    rng = np.random.default_rng(1)
    for scale in (1.0, 1e3, 1e150):
        x = np.floor(rng.normal(0, 50, (300, 7)) * scale)
        q, middle = np.floor(rng.normal(0, 50, (40, 7)) * scale), x[:1]
        most = topk.bounds(q, middle, topk._norms(x - middle, 2).max(axis=0)[None], topk._norms(x, 2).max(axis=0)[None], 2)
        assert (q @ x.T <= most).all()
