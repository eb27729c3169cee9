"""A graph of triples and its parts.

A graph is a DataFrame (s, p, o) of strings in N-Triples form or of integer codes alike; everything below works on
either. Triples are made distinct once, on entry.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vocabulary import Vocabulary

TRIPLE = ("s", "p", "o")


@dataclass
class Graph:
    triples: DataFrame
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    distinct: bool = True

    @cached_property
    def all(self) -> DataFrame:
        """Distinct triples; those with a null are none."""
        rows = self.triples.select(*TRIPLE).filter("s is not null and p is not null and o is not null")
        return rows.distinct() if self.distinct else rows

    @cached_property
    def types(self) -> DataFrame:
        return self.all.filter(self.vocabulary.is_type(F.col("p")))

    @cached_property
    def schema(self) -> DataFrame:
        return self.all.filter(self.vocabulary.is_schema(F.col("p")))

    @cached_property
    def generic(self) -> DataFrame:
        return self.all.filter(self.vocabulary.is_generic(F.col("p")))

    @cached_property
    def data(self) -> DataFrame:
        return self.all.filter(self.vocabulary.is_data(F.col("p")))

    @cached_property
    def non_types(self) -> DataFrame:
        return self.all.filter(~self.vocabulary.is_type(F.col("p")))

    @cached_property
    def schema_nodes(self) -> DataFrame:
        """[node]: subjects of schema triples, objects of schema or type triples, and subjects declared to be a class
        or a property. One pass: each triple names the schema nodes among its ends."""
        v = self.vocabulary
        p, declared = F.col("p"), v.declares(F.col("o"))
        ends = F.when(v.is_schema(p), F.array("s", "o")).when(v.is_type(p) & declared, F.array("s", "o")).when(v.is_type(p), F.array("o"))
        return self.all.filter(v.is_schema(p) | v.is_type(p)).select(F.explode(ends).alias("node")).distinct()

    def nodes(self) -> DataFrame:
        return ends(self.all)

    def with_triples(self, triples: DataFrame) -> Graph:
        return Graph(triples, self.vocabulary)


def ends(triples: DataFrame) -> DataFrame:
    """[node]: all subjects and objects."""
    return triples.select(F.explode(F.array("s", "o")).alias("node")).distinct()


def roles(triples: DataFrame) -> DataFrame:
    """[node, role, p], distinct: which properties a node is source (S) or target (T) of.

    Everything that groups nodes starts from this table; a node of high degree has no more rows here than properties.
    """
    pair = F.array(F.struct(F.col("s").alias("node"), F.lit("S").alias("role")), F.struct(F.col("o").alias("node"), F.lit("T").alias("role")))
    return triples.select("p", F.explode(pair).alias("_end")).select("_end.node", "_end.role", "p").distinct()
