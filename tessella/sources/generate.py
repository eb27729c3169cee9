"""Random graphs of a given size, by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.vocabulary import OWN, TYPE


def _term(name: str, number: Column) -> Column:
    return F.concat(F.lit(f"<{OWN}{name}/"), number.cast("string"), F.lit(">"))


def random_triples(spark: SparkSession, n: int, nodes: int, properties: int, classes: int = 0, typed: float = 0.2, seed: int = 0) -> DataFrame:
    """[s, p, o]: ``n`` draws of data triples, and of a type for a share of them; repeated draws are one triple.

    Numbers come from hashes of (seed, row), so the graph doesn't depend on partitioning.
    """
    draw = lambda salt, most: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(max(1, most)))
    rows = spark.range(n)
    is_type = (draw("kind", 1000) < int(typed * 1000)) & F.lit(classes > 0)
    p = F.when(is_type, F.lit(TYPE)).otherwise(_term("property", draw("p", properties)))
    o = F.when(is_type, _term("class", draw("o", classes))).otherwise(_term("node", draw("o", nodes)))
    return rows.select(_term("node", draw("s", nodes)).alias("s"), p.alias("p"), o.alias("o")).distinct()
