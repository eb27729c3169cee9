"""Summaries of graphs that grow: triples arrive in batches, and the summary follows.

State is a folder of Parquet tables: the new distinct triples, one partition per batch, and a mark of the last
snapshot. Writing a batch again replaces its partition, so a batch that Structured Streaming repeats after a failure
counts once, and a stream that starts anew knows whether the summary has changed since. What is incremental is the
set of triples; a summary is made from all of them when it is asked for, which is exact also when a late schema triple
turns a node that was data into a schema node.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessella.functions.vocabulary import Vocabulary
from tessella.operators.graph import Graph
from tessella.operators.quotient import KINDS
from tessella.operators.summary import Summary, summarize
from tessella.plans.lineage import shared_dir
from tessella.sources.ntriples import triples as parse_lines

TRIPLES = T.StructType([T.StructField(c, T.StringType()) for c in "spo"])
_STORED = T.StructType([*TRIPLES, T.StructField("batch", T.LongType())])

#: When a snapshot is taken.
ALWAYS, WHEN_CHANGED, NEVER = "always", "when_changes", "false"


@dataclass
class Growing:
    """A growing graph and its summary of one kind."""

    spark: SparkSession
    path: str
    kind: str = "strong"
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    snapshots: str = NEVER
    on_snapshot: Callable[[int, Summary], None] | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.snapshots not in (ALWAYS, WHEN_CHANGED, NEVER):
            raise ValueError(f"snapshots are {ALWAYS}, {WHEN_CHANGED} or {NEVER}")

    def _stored(self) -> DataFrame:
        """All triples so far, with their batch."""
        try:
            return self.spark.read.schema(_STORED).parquet(f"{self.path}/triples")
        except Exception as error:  # nothing was stored yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], _STORED)

    def add(self, batch: DataFrame, number: int) -> None:
        """Take the triples (s, p, o) of a batch; those known from other batches say nothing new."""
        known = self._stored().filter(F.col("batch") != number).select("s", "p", "o")
        fresh = batch.select("s", "p", "o").filter("s is not null and p is not null and o is not null").distinct().join(known, ["s", "p", "o"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.path}/triples/batch={number}")
        if self.snapshots != NEVER and self.on_snapshot:
            summary = self.summary()
            now = ",".join(map(str, summary.edges.agg(F.count("*"), F.sum("cnt"), F.bit_xor(F.xxhash64("s", "p", "o", "cnt"))).first()))
            if self.snapshots == ALWAYS or now != self._mark():
                self.on_snapshot(number, summary)
                self.spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/mark")

    def _mark(self) -> str | None:
        """What was seen at the last snapshot."""
        try:
            return next((r["value"] for r in self.spark.read.text(f"{self.path}/mark").collect()), None)
        except Exception as error:  # there was none yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def graph(self) -> Graph:
        return Graph(self._stored().select("s", "p", "o"), self.vocabulary)

    def summary(self) -> Summary:
        return summarize(self.graph(), self.kind)

    def follow(self, source: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Follow a stream of triples (s, p, o), or of N-Triples lines (value)."""
        lines = source.columns == ["value"]

        def take(batch: DataFrame, number: int) -> None:
            self.add(parse_lines(batch) if lines else batch, number)

        writer = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def replay(graph: Graph, kind: str, batches: int) -> Summary:
    """The summary after the graph's triples came in ``batches`` batches, dealt by a hash."""
    spark = graph.triples.sparkSession
    growing = Growing(spark, f"{shared_dir(spark).rstrip('/')}/growing-{uuid.uuid4().hex}", kind, graph.vocabulary)
    for i in range(batches):
        growing.add(graph.all.filter(F.pmod(F.xxhash64("s", "p", "o"), F.lit(batches)) == i), i)
    return growing.summary()
