"""Analyses of graphs and summaries: accuracy by patterns, objects and types, graph statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vocabulary import equals
from tessella.operators.graph import Graph, ends


def patterns(edges: DataFrame) -> DataFrame:
    """[p1, p2, connection], distinct: two edges that meet, object to subject (os), object to object (oo) or subject to
    subject (ss). The two ends of a node are reduced to distinct properties before they are paired, so a node costs
    the square of its properties and not of its edges.
    """
    starts = edges.select(F.col("s").alias("node"), F.col("p")).distinct()
    stops = edges.select(F.col("o").alias("node"), F.col("p")).distinct()
    found = None
    for name, left, right in (("os", stops, starts), ("oo", stops, stops), ("ss", starts, starts)):
        pairs = left.toDF("node", "p1").join(right.toDF("node", "p2"), "node").select("p1", "p2", F.lit(name).alias("connection")).distinct()
        found = pairs if found is None else found.union(pairs)
    return found


def accuracy(graph: Graph, edges: DataFrame) -> DataFrame:
    """[found, total, accuracy]: of the patterns of a summary's edges those that the graph has too. Without patterns
    the accuracy is not a number."""
    told = patterns(edges)
    real = patterns(graph.all).withColumn("_real", F.lit(1))
    both = told.join(real, ["p1", "p2", "connection"], "left")
    counted = both.agg(F.count("_real").alias("found"), F.count("*").alias("total"))
    return counted.withColumn("accuracy", F.when(F.col("total") > 0, F.col("found") / F.col("total")).otherwise(F.lit(float("nan"))))


def object_analysis(graph: Graph) -> DataFrame:
    """[measure, value]: subjects with types, with data properties, with both, with one of the two only."""
    typed = graph.types.select(F.col("s").alias("node"), F.lit(1).alias("_t")).distinct()
    data = graph.data.select(F.col("s").alias("node"), F.lit(1).alias("_d")).distinct()
    both = typed.join(data, "node", "full")
    t, d = F.col("_t").isNotNull(), F.col("_d").isNotNull()
    wide = both.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("typed", t), ("with_data", d), ("typed_with_data", t & d), ("untyped_with_data", ~t & d), ("typed_without_data", t & ~d))])
    return wide.unpivot([], wide.columns, "measure", "value")


def untyped_ratio(graph: Graph) -> DataFrame:
    """[nodes, typed, ratio]: the share of nodes without a type (by the default type property)."""
    typed = graph.all.filter(equals(F.col("p"), graph.vocabulary.default_type)).select(F.countDistinct("s").alias("typed"))
    nodes = ends(graph.all).agg(F.count("*").alias("nodes"))
    return nodes.crossJoin(typed).select("nodes", "typed", (1 - F.col("typed") / F.col("nodes")).alias("ratio"))  # one row each


def statistics(graph: Graph) -> DataFrame:
    """[measure, value]: triples by kind, distinct nodes, data properties and classes."""
    p, v = F.col("p"), graph.vocabulary
    classes = F.when(equals(p, v.domain) | equals(p, v.range) | v.is_type(p), F.array("o")).when(equals(p, v.subclass), F.array("s", "o"))
    counted = graph.all.select("s", "o", "p", graph.vocabulary.kind(p).alias("kind"), classes.alias("_c"))
    by_kind = counted.agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_triples") for k in ("data", "type", "schema", "generic")], F.countDistinct(F.when(F.col("kind").isin("data", "generic"), p)).alias("data_properties"))
    tall = by_kind.unpivot([], by_kind.columns, "measure", "value")
    nodes = ends(graph.all).agg(F.count("*").alias("value")).select(F.lit("nodes").alias("measure"), "value")
    distinct_classes = counted.filter("_c is not null").select(F.explode("_c").alias("c")).agg(F.countDistinct("c").alias("value")).select(F.lit("classes").alias("measure"), "value")
    return tall.union(nodes).union(distinct_classes)
