"""Exact deduplication of texts.

Texts are equal when they are identical after every run of white space is replaced by one space. Rows are grouped by
the 128-bit MD5 of that text together with the text itself: the hash decides where a row goes, and the grouping
compares the bytes, so a collision of hashes can't merge two texts. Partial aggregation keeps one row per text and
map task, so a text that holds a third of all rows reaches the reducers as a handful of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.columns import pick
from tessella.plans.skew import lookup

#: Only runs that the normal form changes; single spaces stay as they are.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _addressed(docs: DataFrame, id_col: str, text_col: str, hashed: Callable[[Column], Column]) -> DataFrame:
    rows = pick(docs, id_col, text_col, **{id_col: "long", text_col: "string"}).select(F.col(id_col).alias("doc_id"), normal(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("_text"), 256))
    return rows.withColumn("_key", F.concat(hashed(F.col("_text")), F.lit("/"), F.col("text_sha256")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest id among equal texts (null ids count only when a group has no other, and keep_id is null
    then); group_size counts rows; kept says whether the row's id is keep_id. Null texts equal empty ones. Rows that
    repeat an id with an equal text are one document: each says the same. ``hashed`` is the content hash, replaceable
    to test that collisions are told apart. An empty table gives an empty result.
    """
    rows = _addressed(docs, id_col, text_col, hashed)
    groups = rows.groupBy("_key", "_text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # A row is sent back to its class by both hashes; two different texts (told apart by bytes above) under one pair
    # of hashes would show here as a second row for the key.
    groups = groups.groupBy("_key").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("_texts"))
    groups = groups.withColumn("group_size", F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts agree in MD5 and SHA-256"))))
    groups = groups.select("_key", "keep_id", "group_size")
    slim = rows.select("doc_id", "_key", "text_sha256")
    found = lookup(slim, groups, "_key", "group_size", docs.count(), F.xxhash64("doc_id", "text_sha256"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the smallest id.

    Rows that agree in id and text are one document, and one of them stays (the least by the other columns, in order).
    """
    names = docs.columns
    fresh = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    at = {n: f"_in{names.index(n)}" for n in (id_col, text_col)}
    text = normal(F.col(at[text_col]))
    rest = [F.col(f"_in{i}") for i, n in enumerate(names)]
    rows = fresh.select(F.md5(text).alias("_key"), text.alias("_text"), F.struct(F.col(at[id_col]).isNull().alias("_none"), F.col(at[id_col]).alias("_id"), *rest).alias("_row"))
    first = rows.groupBy("_key", "_text").agg(F.min("_row").alias("_row"))
    return first.select(*[F.col(f"_row._in{i}").alias(n) for i, n in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
