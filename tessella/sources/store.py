"""Summaries on disk: Parquet tables and a manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.summary import Summary


@dataclass
class Stored:
    manifest: dict[str, str]
    rep: DataFrame
    node_stats: DataFrame
    edges: DataFrame


def save(summary: Summary, path: str, mode: str = "errorifexists") -> dict[str, str]:
    """Write rep, node statistics and edges under ``path``, and a manifest that names them; returns the manifest."""
    names = {"representation": f"{path}/rep", "summary_node_stats": f"{path}/node_stats", "edges": f"{path}/edges"}
    summary.rep.write.mode(mode).parquet(names["representation"])
    summary.node_support().write.mode(mode).parquet(names["summary_node_stats"])
    summary.edges.write.mode(mode).partitionBy("kind").parquet(names["edges"])
    v = summary.graph.vocabulary
    told = names | {"kind": summary.kind.name, "default_type": str(v.default_type), "variant_types": ",".join(map(str, v.variant_types))}
    spark = summary.rep.sparkSession
    spark.createDataFrame(sorted(told.items()), "role string, name string").coalesce(1).write.mode(mode).json(f"{path}/manifest")
    return told


def load(spark: SparkSession, path: str) -> Stored:
    """A stored summary, with the counts of its edges."""
    told = {r["role"]: r["name"] for r in spark.read.schema("role string, name string").json(f"{path}/manifest").collect()}
    edges = spark.read.parquet(told["edges"]).withColumn("kind", F.col("kind").cast("string"))
    return Stored(told, spark.read.parquet(told["representation"]), spark.read.parquet(told["summary_node_stats"]), edges.select("s", "p", "o", "cnt", "kind"))
