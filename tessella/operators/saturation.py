"""RDFS assertion saturation, and hierarchies of classes and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.vocabulary import among, equals
from tessella.operators.components import components
from tessella.operators.graph import Graph
from tessella.plans.lineage import spool


def closure(edges: DataFrame, lower: str = "s", upper: str = "o") -> DataFrame:
    """[lower, upper]: transitive closure of a hierarchy, by doubling; cycles are fine. A hierarchy is small next to the
    data, and a path of length n needs log n rounds."""
    known = spool(edges.select(F.col(lower).alias("lower"), F.col(upper).alias("upper")).distinct())
    n = known.count()
    while n:
        step = known.select(F.col("lower").alias("upper"), F.col("upper").alias("_top"))
        longer = known.join(step, "upper").select("lower", F.col("_top").alias("upper"))
        known = spool(known.union(longer).distinct())
        if (m := known.count()) == n:
            break
        n = m
    return known


def saturate(graph: Graph) -> DataFrame:
    """[s, p, o]: the triples with all instance-level consequences of subPropertyOf, domain, range and subClassOf.

    The schema is closed first; then one pass over the data is the fixpoint, as long as no property is declared to be
    a subproperty of a schema or type property, and none of these has a domain or range. If one is, triples of the
    schema or types can follow from data, and passes repeat until none is new. Schema triples themselves aren't closed.
    """
    v = graph.vocabulary
    special, p = (*v.schema, *v.types), F.col("p")
    told = graph.schema
    upward = told.filter(equals(p, v.subproperty) & among(F.col("o"), special)).limit(1)
    onto = told.filter((equals(p, v.domain) | equals(p, v.range)) & among(F.col("s"), special)).limit(1)
    again = not upward.unionAll(onto).isEmpty()
    triples = graph.all
    n = triples.count() if again else 0
    while True:
        out = _pass(graph.with_triples(triples) if again else graph)
        if not again:
            return out
        triples = spool(out)
        if (m := triples.count()) == n:
            return triples
        n = m


def _pass(graph: Graph) -> DataFrame:
    v, told, p = graph.vocabulary, graph.schema, F.col("p")
    supers = closure(told.filter(equals(p, v.subproperty))).toDF("p", "q")
    classes = closure(told.filter(equals(p, v.subclass))).toDF("o", "c")
    # what a property says of its ends: one row per property, end and class, superclasses included
    ends = told.filter(equals(p, v.domain) | equals(p, v.range)).select(F.col("s").alias("p"), equals(p, v.domain).alias("subject"), F.col("o").alias("o"))
    ends = ends.union(ends.join(classes, "o").select("p", "subject", F.col("c").alias("o"))).distinct()
    # triples are read once, and meet the schema as one row a property and a class
    out = graph.all.join(_gathered(supers, "p", F.col("q"), "_supers"), "p", "left")
    out = out.select("s", "o", F.explode(F.when(F.col("_supers").isNull(), F.array("p")).otherwise(F.array_union(F.array("p"), F.col("_supers")))).alias("p"))
    out = out.join(_gathered(ends, "p", F.struct("subject", F.col("o").alias("class")), "_ends"), "p", "left")
    out = out.join(_gathered(classes, "o", F.col("c"), "_above"), "o", "left")
    triple = lambda s, p, o: F.struct(s.alias("s"), p.alias("p"), o.alias("o"))
    own = F.array(triple(F.col("s"), F.col("p"), F.col("o")))
    none = F.filter(own, lambda x: F.lit(False))
    typed = F.transform("_ends", lambda e: triple(F.when(e["subject"], F.col("s")).otherwise(F.col("o")), F.lit(v.default_type), e["class"]))
    lifted = F.when(v.is_type(F.col("p")), F.transform("_above", lambda c: triple(F.col("s"), F.col("p"), c)))
    every = F.concat(own, F.coalesce(typed, none), F.coalesce(lifted, none))
    return out.select(F.explode(every).alias("_t")).select("_t.s", "_t.p", "_t.o").distinct()


#: Keys of a part of the schema that are broadcast at most; beyond that it is joined by a shuffle.
BROADCAST_SCHEMA = 100_000


def _gathered(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """[key, name]: a part of the schema with the values of each key as one array, to be broadcast if it is small."""
    rows = spool(rows.groupBy(key).agg(F.collect_set(value).alias(name)))
    few = rows.agg(F.coalesce(F.sum(F.size(name)), F.lit(0))).first()[0] <= BROADCAST_SCHEMA
    return F.broadcast(rows) if few else rows


def top_classes(graph: Graph) -> DataFrame:
    """[class, top]: for every class of a subClassOf triple its ancestors (or itself) that have no class above.

    Classes on a cycle that nothing is above have no top of their own; there the least of the cycle stands for all.
    """
    below = graph.schema.filter(equals(F.col("p"), graph.vocabulary.subclass)).filter("s <> o")
    above = closure(below)
    both = above.alias("x").join(above.alias("y"), (F.col("x.lower") == F.col("y.upper")) & (F.col("x.upper") == F.col("y.lower")))
    cycles = components(both.select(F.col("x.lower").alias("a"), F.col("x.upper").alias("b"))).toDF("lower", "least")
    named = above.join(cycles, "lower", "left").withColumn("lower_name", F.coalesce("least", "lower")).drop("least")
    named = named.join(cycles.toDF("upper", "least"), "upper", "left").withColumn("upper_name", F.coalesce("least", "upper")).drop("least")
    named = spool(named)
    covered = named.filter("lower_name <> upper_name").select(F.col("lower_name").alias("upper_name")).distinct()
    from_above = named.join(covered, "upper_name", "left_anti").select(F.col("lower").alias("class"), F.col("upper_name").alias("top"))
    alone = named.select(F.col("upper").alias("class"), F.col("upper_name").alias("top")).join(covered.toDF("top"), "top", "left_anti").select("class", "top")
    return from_above.union(alone).distinct()
