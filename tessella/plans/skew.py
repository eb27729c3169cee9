"""Looking up one value per key where single keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of the rows, and in any case above ``HOT_ROWS`` rows, which is what one task should get
#: of one key; but there are never more than ``HOT_KEYS`` hot keys, since they are broadcast.
HOT_SHARE, HOT_ROWS, HOT_KEYS = 1 / 1000, 1_000_000, 50_000


def hot_limit(rows: int) -> int:
    """Rows above which a key is hot, if there are ``rows`` in all; at most ``HOT_KEYS`` keys can have more."""
    return max(1, int(min(rows * HOT_SHARE, max(HOT_ROWS, rows / HOT_KEYS))))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int, spread: Column) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row per ``key`` (a string, not null).

    ``weight`` is the number of rows of ``left`` that have the key and ``rows`` the number of all. Hot keys (see
    ``hot_limit``) are broadcast; their rows of ``left`` get a key of their own made of ``spread`` in the shuffled join
    that serves all other keys, so no task gets a hot key's rows together.
    """
    values = [c for c in right.columns if c != key]
    limit = hot_limit(rows)
    hot = right.filter(F.col(weight) > limit).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values])
    cold = right.filter(F.col(weight) <= limit).select(F.col(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in values])
    near = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    near = near.withColumn("_jk", F.when(F.col("_hk").isNull(), F.col(key)).otherwise(F.concat(F.lit("~"), spread.cast("string"))))
    far = near.join(cold, F.col("_jk") == F.col("_ck"), "left")
    return far.select(*left.columns, *[F.when(F.col("_hk").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in values])
