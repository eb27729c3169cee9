"""Terms as integers: dictionary encoding and decoding of triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vocabulary import Vocabulary
from tessella.operators.graph import Graph
from tessella.plans.lineage import spool


def numbered(rows: DataFrame, order: str, name: str, first: int = 1) -> DataFrame:
    """``rows`` with their place in the order of a column of distinct values, from ``first`` on.

    Ranges of the order are numbered apart and shifted by the number of rows before, so nothing is sorted in one task.
    """
    dealt = spool(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row per partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_before") + F.lit(first - 1)
    return dealt.join(F.broadcast(parts), "_part").withColumn(name, place.cast("long")).drop("_part", "_before")


def dictionary(triples: DataFrame) -> DataFrame:
    """[key, value]: all terms of a table of triples in sorted order, numbered from 1."""
    terms = triples.select(F.explode(F.array("s", "p", "o")).alias("value")).filter("value is not null").distinct()
    return numbered(terms, "value", "key").select("key", "value")


def encode(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """Triples of codes; a term that the dictionary lacks becomes -1."""
    return _translate(triples, terms.select(F.col("value").alias("_from"), F.col("key").alias("_to")), F.lit(-1).cast("long"))


def decode(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """Triples of terms; a code that the dictionary lacks ends the query."""
    missing = F.raise_error(F.lit("a code is not in the dictionary"))
    return _translate(triples, terms.select(F.col("key").alias("_from"), F.col("value").alias("_to")), missing)


def vocabulary_codes(terms: DataFrame, vocabulary: Vocabulary) -> Vocabulary:
    """The vocabulary in the dictionary's codes; it names some dozens of terms."""
    known = terms.filter(F.col("value").isin(*vocabulary.terms())).collect()
    return vocabulary.encoded({r["value"]: r["key"] for r in known})


def encoded_graph(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph in codes, and its dictionary, which has the default type property in any case: saturation and type
    edges write it even where no triple has it."""
    kind = F.lit(graph.vocabulary.default_type)
    always = graph.all.sparkSession.range(1).select(kind.alias("s"), kind.alias("p"), kind.alias("o"))
    terms = spool(dictionary(graph.all.union(always)))
    return Graph(encode(graph.all, terms), vocabulary_codes(terms, graph.vocabulary), distinct=False), terms


#: Properties whose codes are broadcast at most; graphs have few, and each holds many rows.
BROADCAST_PROPERTIES = 100_000


def _translate(triples: DataFrame, by: DataFrame, missing: Column) -> DataFrame:
    """Subjects and objects by joins with all terms; of the properties only those in use are looked up there."""
    used = spool(triples.select("p").distinct().join(by.withColumnRenamed("_from", "p"), "p", "left"))
    used = F.broadcast(used) if used.count() <= BROADCAST_PROPERTIES else used
    out = triples.join(used, "p", "left").withColumn("p", F.coalesce("_to", missing)).drop("_to")
    for column in "so":
        out = out.join(by.withColumnRenamed("_from", column), column, "left").withColumn(column, F.coalesce("_to", missing)).drop("_to")
    return out.select("s", "p", "o")


def extend(terms: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary with the terms of ``new`` (value) that it lacks, numbered on from its greatest code."""
    top = terms.agg(F.max("key")).first()[0] or 0
    fresh = new.select("value").filter("value is not null").distinct().join(terms, "value", "left_anti")
    return terms.select("key", "value").unionByName(numbered(fresh, "value", "key", top + 1).select("key", "value"))
