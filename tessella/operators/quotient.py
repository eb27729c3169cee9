"""Equivalences on the nodes of a graph: for every kind, a table [node, rep] that is total on the graph's nodes.

A class is named by its least member, so results depend neither on order nor on partitioning. Classes that are given
by a rule rather than by members (nodes with types only, untyped nodes, ends of generic properties only) have names of
their own that no term has.

Cliques and weak components are components of a graph on properties, which is small, and never of the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tessella.operators.components import components
from tessella.operators.graph import Graph, roles
from tessella.operators.saturation import top_classes
from tessella.plans.lineage import drop, scratch, spool, tidy
from tessella.plans.skew import lookup

DATA_FIRST, TYPE_FIRST, TOGETHER = "data first", "type first", "data and types"


@dataclass(frozen=True)
class Kind:
    name: str
    code: str
    family: str
    typed_apart: bool  # nodes with types are grouped by their classes
    keys: Callable[[Graph, DataFrame], DataFrame]  # (graph, roles) -> [node, key]


def _coded(graph: Graph) -> bool:
    return isinstance(graph.triples.schema["s"].dataType, T.IntegralType)


def special(graph: Graph, what: str, p: Column | None = None) -> Column:
    """The name of a class without a least member: a blank node that isn't in N-Triples' grammar, or a code below 0."""
    at = {"types": 0, "untyped": 1, "source": 2, "target": 3}[what]
    if _coded(graph):
        return F.lit(-1 - at).cast("long") if p is None else (-(p * 2 + at + 1)).cast("long")
    return F.lit(f"_: {what}") if p is None else F.concat(F.lit(f"_: {what} "), p)


def represent(keyed: DataFrame) -> DataFrame:
    """[node, rep] from [node, key] (a string): the least node of each key. Keys may hold any share of the nodes."""
    keyed = spool(keyed.select("node", "key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("_n"))
    return lookup(keyed, least, "key", "_n", keyed.count(), F.xxhash64("node")).select("node", "rep")


def cliques(found: DataFrame, role: str) -> DataFrame:
    """[p, clique]: properties that occur together at a node in ``role`` (S source, T target) are in one clique, which
    is named by its least property. ``found`` is a table of roles."""
    own = found.filter(F.col("role") == role)
    linked = own.withColumn("_least", F.min("p").over(Window.partitionBy("node"))).select("p", "_least").distinct()
    return components(linked, "p", "_least").toDF("p", "clique")


def class_sets(graph: Graph) -> DataFrame:
    """[node, classes]: sorted classes of every node with types that isn't a schema node."""
    typed = graph.types.select(F.col("s").alias("node"), "o").distinct().join(graph.schema_nodes, "node", "left_anti")
    return typed.groupBy("node").agg(F.sort_array(F.collect_set("o")).alias("classes"))


def general_class_sets(graph: Graph) -> DataFrame:
    """``class_sets`` with every class replaced by its most general ones."""
    tops = top_classes(graph).toDF("o", "top")
    typed = graph.types.select(F.col("s").alias("node"), "o").distinct().join(graph.schema_nodes, "node", "left_anti")
    lifted = typed.join(tops, "o", "left").select("node", F.coalesce("top", "o").alias("o")).distinct()
    return lifted.groupBy("node").agg(F.sort_array(F.collect_set("o")).alias("classes"))


def _text(*parts: Column) -> Column:
    """One short string per combination of values."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), "\u0003")


def property_sets(found: DataFrame) -> DataFrame:
    """[node, outgoing, incoming]: sorted property sets; as long as a node has properties, whatever its degree."""
    sets = [F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("p")))).alias(n) for r, n in (("S", "outgoing"), ("T", "incoming"))]
    return found.groupBy("node").agg(*sets)


def _weak(graph: Graph, found: DataFrame) -> DataFrame:
    token = F.concat(F.col("role"), F.col("p").cast("string"))
    tokens = found.select("node", token.alias("token"))
    linked = tokens.withColumn("_least", F.min("token").over(Window.partitionBy("node")))
    groups = components(linked.select("token", "_least").distinct(), "token", "_least").toDF("token", "key")
    first = tokens.groupBy("node").agg(F.min("token").alias("token"))
    return first.join(groups, "token").select("node", "key")


def _strong(graph: Graph, found: DataFrame) -> DataFrame:
    found = spool(found)
    firsts = [F.min(F.when(F.col("role") == r, F.col("p"))).alias(r) for r in "ST"]
    ends = found.groupBy("node").agg(*firsts)
    for role in "ST":
        ends = ends.join(cliques(found, role).toDF(role, f"clique{role}"), role, "left")
    return ends.select("node", _text(F.col("cliqueS"), F.col("cliqueT")).alias("key"))


def _source_clique(graph: Graph, found: DataFrame) -> DataFrame:
    found = spool(found)
    ends = found.groupBy("node").agg(F.min(F.when(F.col("role") == "S", F.col("p"))).alias("S"))
    return ends.join(cliques(found, "S").toDF("S", "clique"), "S", "left").select("node", _text(F.col("clique")).alias("key"))


def _forward(graph: Graph, found: DataFrame) -> DataFrame:
    return property_sets(found).select("node", _text(_joined(F.col("outgoing"))).alias("key"))


def _both_ways(graph: Graph, found: DataFrame) -> DataFrame:
    return property_sets(found).select("node", _text(_joined(F.col("outgoing")), _joined(F.col("incoming"))).alias("key"))


def _one(graph: Graph, found: DataFrame) -> DataFrame:
    return found.select("node").distinct().withColumn("key", F.lit("untyped"))


#: Steps (two of each data triple) that a round of bisimulation shuffles at a time.
STEPS = 20_000_000


def identified(graph: Graph, nodes: DataFrame) -> Callable[[Column], Column]:
    """A number of 64 bits for each of ``nodes`` and of the schema nodes: the first of some hashes that tells all apart."""
    every = nodes.union(graph.schema_nodes)
    for seed in range(4):
        if every.groupBy(F.xxhash64(F.lit(seed), "node").alias("id")).count().filter("count > 1").isEmpty():
            return lambda node: F.xxhash64(F.lit(seed), node)
    raise RuntimeError("nodes share 64-bit numbers under four seeds; there are more than such numbers can tell apart")


def refined(graph: Graph, labels: DataFrame, number: Callable[[Column], Column], at: int, of: int) -> DataFrame:
    """One round, of the nodes of part ``at`` out of ``of``: [id, k1, k2] split by the set of (direction, property, key
    of neighbour). Ids and keys are numbers, so that a step is a few bytes wherever it is shuffled.

    The set is folded into 128 bits by exclusive or of two hashes over its distinct elements, so no node's
    neighbourhood is ever collected, however many neighbours it has.
    """
    s, o = number(F.col("s")), number(F.col("o"))
    both = F.array(F.struct(s.alias("id"), F.xxhash64(F.lit("out"), "p").alias("way"), o.alias("to")), F.struct(o.alias("id"), F.xxhash64(F.lit("in"), "p").alias("way"), s.alias("to")))
    mine = F.pmod("id", F.lit(of)) == at
    steps = graph.data.select(F.explode(both).alias("_e")).select("_e.id", "_e.way", "_e.to").filter(mine)
    near = steps.join(labels.toDF("to", "_k1", "_k2"), "to", "left").select("id", "way", F.coalesce("_k1", "to").alias("_k1"), F.coalesce("_k2", F.lit(0)).alias("_k2")).distinct()
    folded = near.groupBy("id").agg(*[F.bit_xor(F.xxhash64(F.lit(i), "way", "_k1", "_k2")).alias(f"_h{i}") for i in (1, 2)])
    return labels.filter(mine).join(folded, "id", "left").select("id", *[F.xxhash64(F.lit(i), "k1", "k2", "_h1", "_h2").alias(f"k{i}") for i in (1, 2)])


def bisimulation(graph: Graph, found: DataFrame, rounds: int | None = None) -> DataFrame:
    """[node, key]: the coarsest partition that is stable both ways, starting from property and class sets; with
    ``rounds`` that after so many rounds. Schema nodes are told apart as neighbours, and not grouped.

    A round goes by parts of the nodes, each of some ``STEPS`` steps, and writes their keys; what it has shuffled, and the
    keys of the round before, go when they have been read."""
    spark = found.sparkSession
    with tidy(spark), scratch() as keep:
        start = property_sets(found).join(class_sets(graph), "node", "left")
        named = spool(start.select("node", _text(_joined(F.col("outgoing")), _joined(F.col("incoming")), _joined(F.col("classes"))).alias("key")))
        number = identified(graph, named.select("node"))
        labels = [spool(named.select(number(F.col("node")).alias("id"), *[F.xxhash64(F.lit(i), "key").alias(f"k{i}") for i in (1, 2)]))]
        parts = max(1, -(-2 * graph.data.count() // STEPS))
        whole = lambda: reduce(DataFrame.union, labels)
        n = whole().select("k1", "k2").distinct().count()
        while rounds is None or rounds > 0:
            before = labels
            labels = [spool(refined(graph, reduce(DataFrame.union, before), number, at, parts)) for at in range(parts)]
            for old in before:
                drop(old)
            if rounds is not None:
                rounds -= 1
            elif (m := whole().select("k1", "k2").distinct().count()) == n:
                break
            else:
                n = m
        key = F.concat(F.hex("k1"), F.lit("/"), F.hex("k2")).alias("key")
        return keep(spool(named.select("node", number(F.col("node")).alias("id")).join(whole(), "id").select("node", key)))


_ALL = [
    Kind("weak", "w", DATA_FIRST, False, _weak),
    Kind("2pweak", "2pw", DATA_FIRST, False, _weak),
    Kind("2pweakunionfind", "2pwuf", DATA_FIRST, False, _weak),
    Kind("strong", "s", DATA_FIRST, False, _strong),
    Kind("2pstrong", "2ps", DATA_FIRST, False, _strong),
    Kind("typedweak", "tw", TYPE_FIRST, True, _weak),
    Kind("2ptypedweak", "2ptw", TYPE_FIRST, True, _weak),
    Kind("typedstrong", "ts", TYPE_FIRST, True, _strong),
    Kind("2ptypedstrong", "2pts", TYPE_FIRST, True, _strong),
    Kind("typed", "t", TYPE_FIRST, True, _one),
    Kind("2pinputoutput", "2pioat", TOGETHER, False, _both_ways),
    Kind("2ponefw", "2p1fw", DATA_FIRST, False, _forward),
    Kind("2ponefb", "2p1fb", DATA_FIRST, False, _both_ways),
    Kind("2pbisim", "2pfb", TOGETHER, False, bisimulation),
    Kind("2psourceclique", "2psc", DATA_FIRST, False, _source_clique),
]
#: All kinds by name. One-pass and two-pass names share a plan: an equivalence doesn't depend on how it is found.
KINDS = {k.name: k for k in _ALL}


def grouped_roles(graph: Graph, kind: Kind) -> DataFrame:
    """The roles that a kind groups by: of data triples, or of data and type triples, of nodes that are neither schema
    nodes nor, where types come first, typed."""
    triples = graph.data.union(graph.types) if kind.family == TOGETHER else graph.data
    found = roles(triples).join(graph.schema_nodes, "node", "left_anti")
    if kind.typed_apart:
        found = found.join(graph.types.select(F.col("s").alias("node")).distinct(), "node", "left_anti")
    return found


def representation(graph: Graph, kind: str | Kind, generalise: bool = False) -> DataFrame:
    """[node, rep] for every node of the graph.

    The first that fits: a schema node stands for itself; a typed node, where types come first, for its class set;
    a node of data triples for its key; one with types only for the node of these; one in generic triples only for the
    source or else the target of its least generic property.
    """
    kind = KINDS[kind] if isinstance(kind, str) else kind
    found = grouped_roles(graph, kind)
    keyed = kind.keys(graph, found)
    if kind.typed_apart:
        sets = (general_class_sets if generalise else class_sets)(graph)
        keyed = keyed.select("node", F.concat(F.lit("d"), "key").alias("key")).union(sets.select("node", F.concat(F.lit("t"), _text(_joined(F.col("classes")))).alias("key")))
    named = represent(keyed)
    if kind.name == "typed":
        typed = graph.types.select(F.col("s").alias("node")).distinct().withColumn("_typed", F.lit(True))
        named = named.join(typed, "node", "left").select("node", F.when(F.col("_typed"), F.col("rep")).otherwise(special(graph, "untyped")).alias("rep"))
    so_far = graph.schema_nodes.select("node", F.col("node").alias("rep")).union(named)
    if kind.family == DATA_FIRST:
        only_types = graph.types.select(F.col("s").alias("node")).distinct().join(so_far, "node", "left_anti")
        so_far = so_far.union(only_types.select("node", special(graph, "types").alias("rep")))
    so_far = spool(so_far)
    rest = roles(graph.generic).join(so_far, "node", "left_anti")
    first = rest.groupBy("node").agg(F.min(F.struct("role", "p")).alias("_f"))
    by_role = F.when(F.col("_f.role") == "S", special(graph, "source", F.col("_f.p"))).otherwise(special(graph, "target", F.col("_f.p")))
    return so_far.union(first.select("node", by_role.alias("rep")))
