"""A graph made from relational tables (orders, customers, parts, suppliers, nations, regions, events).

Where a property would be shared by all rows of a table, and so join all others into one clique, the row's category is
put into the property's name; where a merge is wanted it is not. Every row of every table has its triples. By their
values, some entities have types, some only through the variant type property, some none, and some nothing but types
or labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.vocabulary import DOMAIN, RANGE, RDFS, SUBCLASS, SUBPROPERTY, TYPE, VARIANTS
from tessella.operators.graph import Graph

LABEL = f"<{RDFS}label>"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def iri(kind: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"<urn:{kind}/"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit(">"))


def literal(value: Column) -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))


def schema_rows() -> list[tuple[str, str, str]]:
    """The schema triples of the graph."""
    rows = [(f"<urn:class/{s}>", SUBCLASS, "<urn:class/Customer>") for s in SEGMENTS]
    rows += [("<urn:class/Customer>", SUBCLASS, "<urn:class/Agent>"), ("<urn:p/placedBy_F>", SUBPROPERTY, "<urn:p/placedBy>")]
    rows += [("<urn:p/placedBy>", DOMAIN, "<urn:class/Order>"), ("<urn:p/nation>", RANGE, "<urn:class/Place>")]
    return rows


def table_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[s, p, o] from the tables under ``sf_dir``; not yet distinct."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, customer, part, supplier = read("orders"), read("customer"), read("part"), read("supplier")
    nation, events = read("nation"), read("events")
    order, status = iri("order", F.col("o_orderkey")), F.col("o_orderstatus")
    person, thing = iri("customer", F.col("c_custkey")), iri("part", F.col("p_partkey"))
    seller, labelled = iri("supplier", F.col("s_suppkey")), F.col("s_nationkey") < 8
    urgent, filed, home = F.col("o_orderpriority") < "3", F.col("o_orderpriority") == "5-LOW", F.col("c_mktsegment") == "HOUSEHOLD"
    rank = literal(F.col("o_orderpriority"))
    country = iri("nation", F.col("n_nationkey"))
    lines = read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    # several triples of a row come out of one scan of its table
    def several(df: DataFrame, *triples: Column) -> DataFrame:
        return df.select(F.explode(F.array(*triples)).alias("t")).select("t.s", "t.p", "t.o")

    def triple(s: Column, p: Column, o: Column) -> Column:
        return F.struct(s.alias("s"), p.alias("p"), o.alias("o"))

    unclassified = F.col("p_brand").endswith("2")
    p = lambda name: F.lit(f"<urn:p/{name}>")
    parts = [
        several(
            orders,
            triple(order, iri("p", "placedBy_", status), iri("customer", F.col("o_custkey"))),
            triple(order, F.when(urgent, iri("p", "urgency_", status)).otherwise(iri("p", "priority_", status)), rank),
            triple(order, F.when(filed, iri("p", "filed_", status)).otherwise(TYPE), F.when(filed, rank).otherwise(iri("class", "order_", status))),
        ),
        several(lines, triple(order, iri("p", "contains_", status), iri("part", F.col("l_partkey")))),
        several(
            customer,
            triple(person, p("nation"), iri("nation", F.col("c_nationkey"))),
            triple(person, p("segment"), literal(F.col("c_mktsegment"))),
            triple(person, F.when(home, p("home")).otherwise(F.lit(TYPE)), F.when(home, iri("nation", F.col("c_nationkey"))).otherwise(iri("class", F.col("c_mktsegment")))),
        ),
        several(
            part,
            triple(thing, p("brand"), literal(F.col("p_brand"))),
            triple(thing, p("kind"), literal(F.col("p_type"))),
            triple(thing, F.when(F.col("p_brand").endswith("1"), VARIANTS[0]).when(unclassified, p("unclassified")).otherwise(TYPE), F.when(unclassified, literal(F.col("p_brand"))).otherwise(iri("class", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")))),
        ),
        several(
            supplier,
            triple(seller, F.when(labelled, F.lit(LABEL)).otherwise(p("nation")), F.when(labelled, literal(F.col("s_name"))).otherwise(iri("nation", F.col("s_nationkey")))),
            triple(iri("store", F.col("s_suppkey")), F.lit(TYPE), F.lit("<urn:class/Store>")),
        ),
        several(nation, triple(country, p("region"), iri("region", F.col("n_regionkey"))), triple(country, F.lit(LABEL), literal(F.col("n_name")))),
        several(events, triple(iri("event", F.col("event_id")), iri("p", "by_", F.col("event_type")), iri("user", F.col("user_id")))),
        spark.createDataFrame(schema_rows(), "s string, p string, o string"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def table_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(table_triples(spark, sf_dir))
