"""Picking columns by name where an input may carry further columns, even of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick(df: DataFrame, *names: str, **kinds: str) -> DataFrame:
    """Only ``names``, cast to ``kinds`` where given.

    A name is looked up with its case first, then without; of several columns the first counts. A missing column is
    null. Whatever else ``df`` has can't clash with an operator's own columns.
    """
    have = df.columns
    fresh = df.toDF(*[f"_in{i}" for i in range(len(have))])
    out = []
    for name in names:
        at = next((i for i, c in enumerate(have) if c == name), None)
        if at is None:
            at = next((i for i, c in enumerate(have) if c.lower() == name.lower()), None)
        col = F.lit(None) if at is None else F.col(f"_in{at}")
        if name in kinds:
            col = col.cast(kinds[name])
        elif at is None:
            col = col.cast(T.StringType())
        out.append(col.alias(name))
    return fresh.select(*out)
