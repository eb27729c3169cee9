"""Mixing sources to target weights.

Water-filling with caps: every source gets its weight's share of the words wanted, sources are clamped at a maximum
of epochs, and the excess goes to the others by weight until no target is above its cap. A target then becomes whole
repetitions of all the source's documents plus a fractional one: documents in the order of a seeded hash, up to the
word where the target is met. Only DataFrame operations; the texts are read once, to count their words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.columns import pick
from tessella.plans.lineage import hold, spool

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix"
#: Rows of a source that are ordered together; there are 16 ** k hash buckets, k from 2 to 5.
BUCKET_ROWS = 4096
#: Cutoffs are one row per source; up to so many are broadcast, beyond that they are joined by a shuffle.
BROADCAST_SOURCES = 100_000

_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place in code-point order, null last: ranges are numbered apart and shifted by those before."""
    order = F.col("source").asc_nulls_last()
    dealt = spool(sources.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.join(parts, "_part").withColumn("_place", place + F.col("_before") - 1).drop("_part", "_rows", "_before")


def targets(sources: DataFrame, rows: int, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, ...; at most ``rows``) with weight and target.

    Each round is one aggregate of scalars: what the clamped sources take, and the weight of the others. The level
    only rises, so a clamped source stays clamped, and the loop ends when a round clamps no further one.
    """
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    sources = spool(sources, rows)
    n = sources.count()
    table = spool(_numbered(sources).withColumn("weight", F.element_at(pattern, (F.col("_place") % len(weights) + 1).cast("int"))).drop("_place"), n)
    cap = F.col("source_size") * F.lit(float(epochs))
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, clamped = share * (total or 0), 0
    level = wanted / weight if weight else 0.0
    while weight:
        over = F.col("weight") * F.lit(level) > cap
        taken, rest, n = table.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == clamped or not rest:
            break
        level, clamped = (wanted - taken) / rest, n
    return table.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, size, _skey, _order; cutoffs: one row per source)."""
    picked = pick(docs, id_col, text_col, source_col, **{id_col: "long", text_col: "string", source_col: "string"}).toDF("doc_id", "_text", "source")
    rows = hold(picked.select("doc_id", "source", n_words(F.col("_text")).alias("size"), _source_key(F.col("source")).alias("_skey"), _order_key(F.col("doc_id"), seed).alias("_order")))
    sources = rows.groupBy("source", "_skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    n = rows.count()
    filled = targets(sources, n, weights, share, epochs)
    n_sources = filled.count()
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = spool(filled.select("_skey", "source_size", "target", whole.alias("_whole"), F.greatest(goal - whole * F.col("source_size"), F.lit(0)).alias("_more")), n_sources)

    digits = next((k for k in (2, 3, 4) if n / 16**k <= BUCKET_ROWS), 5)
    bucketed = rows.filter(F.col("size") > 0).withColumn("_bucket", F.substring("_order", 1, digits))
    buckets = bucketed.groupBy("_skey", "_bucket").agg(F.sum("size").alias("_words"))
    up_to = Window.partitionBy("_skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("_end", F.sum("_words").over(up_to)).join(filled.select("_skey", "_more"), "_skey")
    # the one bucket of each source in which the fractional repetition ends
    last = buckets.filter((F.col("_end") >= F.col("_more")) & (F.col("_end") - F.col("_words") < F.col("_more")))
    near = bucketed.join(last.select("_skey", "_bucket", "_more", (F.col("_end") - F.col("_words")).alias("_before")), ["_skey", "_bucket"])
    ties = near.groupBy("_skey", "_order", "_more", "_before").agg(F.sum("size").alias("_tied"))
    ties = ties.withColumn("_end", F.col("_before") + F.sum("_tied").over(Window.partitionBy("_skey").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)))
    cut = ties.filter((F.col("_end") >= F.col("_more")) & (F.col("_end") - F.col("_tied") < F.col("_more")))
    cut = cut.select("_skey", F.col("_order").alias("_cut"), "_tied", (F.col("_more") - F.col("_end") + F.col("_tied")).alias("_left"))
    return rows, spool(filled.join(cut, "_skey", "left"), n_sources)


def _with_cutoffs(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_SOURCES else cutoffs, "_skey")


def _taken() -> Column:
    size, more = F.col("size"), F.when(F.col("_order") < F.col("_cut"), F.col("size")).when(F.col("_order") == F.col("_cut"), F.floor(F.col("_left") * F.col("size") / F.col("_tied")))
    return (F.col("_whole") * size + F.coalesce(more, F.lit(0))).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (see ``plan`` for options).

    Null texts have size 0 and take nothing; a null source is a source of its own, last in order. The documents of a
    source take round(target) words together: whole repetitions of each, and one more of those first by the seeded
    hash of the id; the document where it ends gives its first words. Rows with the same id tie and share what is
    left there by size. An empty table gives an empty result.
    """
    rows, cutoffs = plan(docs, **options)
    return _with_cutoffs(rows, cutoffs).select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, length_col: str = "n_chars") -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, as often as taken; where a repetition is cut, the
    text has the words it takes, joined by spaces, and ``length_col``, if there is one, its number of code points.
    Documents without words aren't in a mix of words.
    """
    _, cutoffs = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    names = docs.columns
    fresh = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    of = lambda n: F.col(f"_in{names.index(n)}")
    rows = fresh.withColumns({"size": n_words(of(text_col)), "_skey": _source_key(of(source_col).cast("string")), "_order": _order_key(of(id_col).cast("long"), seed)})
    mixed = _with_cutoffs(rows, cutoffs).withColumn("_taken", _taken()).filter(F.col("_taken") > 0)
    copies = F.ceil(F.col("_taken") / F.col("size")).cast("int")
    mixed = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("_part", F.col("_taken") - (F.col("_copy") - 1) * F.col("size"))
    text = of(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1)), F.lit(1), F.col("_part").cast("int")), " ")
    short = F.col("_part") < F.col("size")
    new = {text_col: cut, length_col: F.length(cut)}
    return mixed.select(*[(F.when(short, new[n].cast(fresh.schema[f"_in{i}"].dataType)).otherwise(F.col(f"_in{i}")) if n in new and i == names.index(n) else F.col(f"_in{i}")).alias(n) for i, n in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS wanted, sum(weight) OVER () AS all_weight,
  coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  coalesce(sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_below FROM w),
l AS (SELECT arg_min((wanted - below) / (all_weight - weight_below), weight_below) AS level FROM r WHERE 2.0::DOUBLE * source_size / weight >= (wanted - below) / (all_weight - weight_below)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, level * weight) AS target FROM w, l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT *, greatest(CAST(round(target) AS BIGINT) - whole * source_size, 0) AS more FROM f),
c AS (SELECT d.*, g.source_size, g.target, g.whole, g.more, sum(size) OVER (PARTITION BY d.source ORDER BY o) AS e, sum(size) OVER (PARTITION BY d.source, o) AS tied
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + CASE WHEN e <= more THEN size WHEN e - tied >= more THEN 0 ELSE floor((more - e + tied) * size / tied) END AS BIGINT) AS taken FROM c
"""
