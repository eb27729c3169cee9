"""Quotient summaries: one node per class, one edge per property between classes, with the number of triples it stands
for, and the statistics of nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vocabulary import OWN
from tessella.operators.graph import Graph
from tessella.operators.quotient import KINDS, TOGETHER, TYPE_FIRST, Kind, representation
from tessella.operators.saturation import saturate
from tessella.plans.lineage import spool, tidy

#: Kinds that take no detour over the summary of the unsaturated graph.
NO_SHORTCUT = ("typedweak", "2ptypedweak", "typedstrong", "2ptypedstrong")
#: Kinds that can replace classes by their most general ones.
GENERAL = NO_SHORTCUT


def quotient_edges(triples: DataFrame, rep: DataFrame) -> DataFrame:
    """[s, p, o, cnt, ...]: every triple between the representatives of its ends, counted, by further columns too.

    Once subjects are mapped, triples are counted by (class, property, object): of an object that holds any share of all
    triples there is a row a class and property then, so the join that maps the objects meets no hot key."""
    by = ["p", *[c for c in triples.columns if c not in ("s", "p", "o")]]
    of = lambda end: rep.select(F.col("node").alias(end), F.col("rep").alias(f"_{end}"))
    halfway = triples.join(of("s"), "s").groupBy("_s", "o", *by).agg(F.count("*").alias("cnt"))
    mapped = halfway.join(of("o"), "o").groupBy(F.col("_s").alias("s"), F.col("_o").alias("o"), *by).agg(F.sum("cnt").alias("cnt"))
    return mapped.select("s", "p", "o", "cnt", *by[1:])


def type_edges(graph: Graph, kind: Kind, rep: DataFrame) -> DataFrame:
    """Type edges as the kind's family has them.

    Data first: one for each type triple, by the default type property. Types first: one for each node and class, by
    the default type property; of schema nodes as they stand. Where data and types go together they are ordinary
    triples, and not made here.
    """
    default = F.lit(graph.vocabulary.default_type)
    own = rep.select(F.col("node").alias("s"), F.col("rep").alias("_s"))
    if kind.family == TYPE_FIRST:
        schema = graph.schema_nodes.select(F.col("node").alias("s"))
        fixed = graph.types.join(schema, "s", "left_semi").groupBy("s", "p", "o").agg(F.count("*").alias("cnt"))
        free = graph.types.join(schema, "s", "left_anti").select("s", "o").distinct().join(own, "s")
        return fixed.unionByName(free.groupBy(F.col("_s").alias("s"), default.alias("p"), "o").agg(F.count("*").alias("cnt")))
    return graph.types.join(own, "s").groupBy(F.col("_s").alias("s"), default.alias("p"), "o").agg(F.count("*").alias("cnt"))


@dataclass
class Summary:
    """rep [node, rep], edges [s, p, o, cnt, kind]; both are written tables."""

    graph: Graph
    kind: Kind
    rep: DataFrame
    edges: DataFrame

    def node_support(self) -> DataFrame:
        """[rep, cnt]: nodes that each summary node stands for, schema nodes included."""
        return self.rep.groupBy("rep").agg(F.count("*").alias("cnt"))

    def edge_support(self) -> DataFrame:
        return self.edges.select("s", "p", "o", "cnt")

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds))

    def leaves(self) -> DataFrame:
        """[node]: objects of edges that are no subject of any."""
        objects = self.edges.filter("kind <> 'type'").select(F.col("o").alias("node")).distinct()
        return objects.join(self.edges.select(F.col("s").alias("node")), "node", "left_anti")

    def leaf_support(self) -> DataFrame:
        """[s, p, o, cnt]: for each edge into a leaf, how many nodes of the leaf it reaches."""
        of = lambda end: self.rep.select(F.col("node").alias(end), F.col("rep").alias(f"_{end}"))
        mapped = self.graph.data.union(self.graph.generic).join(of("s"), "s").join(of("o"), "o")
        reached = mapped.groupBy(F.col("_s").alias("s"), "p", F.col("_o").alias("_leaf")).agg(F.countDistinct("o").alias("cnt"))
        return reached.join(self.leaves().withColumnRenamed("node", "_leaf"), "_leaf", "left_semi").withColumnRenamed("_leaf", "o").select("s", "p", "o", "cnt")

    def type_histogram(self) -> DataFrame:
        """[rep, type, cnt]: nodes by class within each summary node."""
        typed = self.graph.types.select(F.col("s").alias("node"), F.col("o").alias("type")).distinct()
        return typed.join(self.rep, "node").groupBy("rep", "type").agg(F.count("*").alias("cnt"))

    def schema_inlined(self) -> DataFrame:
        """Edges without schema triples, and without type edges of schema nodes: what is left when a drawing writes
        types into the boxes of nodes."""
        return self.edges.filter(F.col("kind").isin("data", "generic"))

    def adjacent(self, node, incoming: bool = False) -> DataFrame:
        """The edges that leave a summary node, or enter it."""
        return self.edges.filter(F.col("o" if incoming else "s") == node)

    def members(self) -> DataFrame:
        """[rep, nodes]: the inverse of rep. For summaries of small graphs; a class is one array."""
        return self.rep.groupBy("rep").agg(F.sort_array(F.collect_list("node")).alias("nodes"))

    def as_graph(self) -> Graph:
        """The summary as a graph of its own: schema nodes as they are, others under names in our namespace."""
        schema = self.graph.schema_nodes.withColumn("_schema", F.lit(True))
        plain = self.edges.select("s", "p", "o")
        for end in ("s", "o"):
            plain = plain.join(schema.withColumnRenamed("node", end), end, "left").withColumn(end, F.when(F.col("_schema"), F.col(end)).otherwise(F.concat(F.lit(f"<{OWN}{self.kind.code}/"), F.md5(F.col(end).cast("string")), F.lit(">")))).drop("_schema")
        return self.graph.with_triples(plain.select("s", "p", "o"))

    def check(self) -> list[str]:
        """What is wrong with the summary; nothing if all invariants hold.

        Every node has one representative; edges stand for all triples of their kind; with weak kinds a property has
        one source and one target among the nodes they group.
        """
        wrong = []
        nodes, reps = self.graph.nodes().count(), self.rep.count()
        if nodes != reps or self.rep.select("node").distinct().count() != reps:
            wrong.append(f"{nodes} nodes have {reps} representatives")
        for name, triples in (("data", self.graph.data), ("schema", self.graph.schema), ("generic", self.graph.generic)):
            stands, has = self.of_kind(name).agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0], triples.count()
            if stands != has:
                wrong.append(f"{name} edges stand for {stands} of {has} triples")
        if self.kind.name in ("weak", "2pweak", "2pweakunionfind"):
            schema = self.graph.schema_nodes
            for end in ("s", "o"):
                own = self.of_kind("data").join(schema.withColumnRenamed("node", end), end, "left_anti")
                if not own.groupBy("p").agg(F.countDistinct(end).alias("n")).filter("n > 1").isEmpty():
                    wrong.append(f"a property has several nodes as {end}")
        return wrong


def summarize(graph: Graph, kind: str = "strong", generalise: bool = False) -> Summary:
    """The quotient of a graph. ``generalise`` replaces classes by their most general ones before grouping, which only
    kinds in ``GENERAL`` can."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known are {', '.join(KINDS)}")
    if generalise and kind not in GENERAL:
        raise ValueError(f"{kind} can't generalise types; {', '.join(GENERAL)} can")
    k = KINDS[kind]
    with tidy(graph.triples.sparkSession):
        graph = graph if not graph.distinct else Graph(spool(graph.all), graph.vocabulary, distinct=False)
        rep = spool(representation(graph, k, generalise))
        ordinary = ("data", "generic", "type") if k.family == TOGETHER else ("data", "generic")
        kinds = graph.all.withColumn("kind", graph.vocabulary.kind(F.col("p")))
        edges = quotient_edges(kinds.filter(F.col("kind").isin(*ordinary)), rep)
        edges = edges.unionByName(graph.schema.select("s", "p", "o", F.lit(1).cast("long").alias("cnt"), F.lit("schema").alias("kind")))
        if k.family != TOGETHER:
            edges = edges.unionByName(type_edges(graph, k, rep).withColumn("kind", F.lit("type")))
        return Summary(graph, k, rep, spool(edges))


def summarize_saturated(graph: Graph, kind: str = "strong", generalise: bool = False) -> Summary:
    return summarize(graph.with_triples(saturate(graph)), kind, generalise)


def summarize_shortcut(graph: Graph, kind: str = "strong") -> Summary:
    """The summary of the saturated summary, which for weak and strong kinds has the edges of the saturated graph's
    summary and needs no saturation of the data."""
    if kind in NO_SHORTCUT:
        raise ValueError(f"{kind} takes no shortcut")
    return summarize_saturated(summarize(graph, kind).as_graph(), kind)
