"""Summaries as text: N-Triples with support numbers, representation, statistics, drawings in DOT, CSV.

Lines are DataFrames of strings, so a summary of any size can be written by ``write.text``. Drawings are for people:
they take the first ``MOST`` lines of a total order.
"""

from __future__ import annotations

import csv
import io
import shutil
import subprocess

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import terms
from tessella.functions.vocabulary import OWN
from tessella.operators.summary import Summary
from tessella.plans.lineage import spool
from tessella.sources.dictionary import numbered

MOST = 1000
#: Classes of one namespace that a box names before it says how many more there are.
CLASSES_SHOWN = 5
PALETTES = {
    "bw": ("white",),
    "light": ("lightblue", "lightyellow", "palegreen", "mistyrose", "lavender", "wheat"),
    "vivid": ("gold", "tomato", "skyblue", "limegreen", "orchid", "orange"),
    "dark": ("navy", "darkgreen", "maroon", "indigo", "saddlebrown", "teal"),
}
_MEMBER = "<http://www.w3.org/2004/02/skos/core#member>"
_INTEGER = "^^<http://www.w3.org/2001/XMLSchema#integer>"


def names(summary: Summary, prefix: str = OWN) -> DataFrame:
    """[rep, number, name]: every summary node with a number in sorted order and a term: a schema node's own, and for
    others one of our namespace made of the kind's code and the number."""
    schema = summary.graph.schema_nodes.select(F.col("node").alias("rep"), F.lit(True).alias("_schema"))
    nodes = numbered(summary.rep.select("rep").distinct(), "rep", "number")
    named = nodes.join(schema, "rep", "left").withColumn("name", F.when(F.col("_schema"), F.col("rep")).otherwise(terms.summary_iri(summary.kind.code, F.col("number"), prefix)))
    return spool(named.select("rep", "number", "name"))


def _named_edges(summary: Summary, named: DataFrame) -> DataFrame:
    of = lambda end: named.select(F.col("rep").alias(end), F.col("name").alias(f"_{end}"))
    return summary.edges.join(of("s"), "s").join(of("o"), "o").select(F.col("_s").alias("s"), "p", F.col("_o").alias("o"), "cnt", "kind")


def _own(term: str) -> Column:
    return F.lit(f"<{OWN}{term}>")


def _line(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts, F.lit("."))


def _quoted(number: Column, kind: str = "") -> Column:
    return F.concat(F.lit('"'), number.cast("string"), F.lit(f'"{kind}'))


def ntriples(summary: Summary, support: bool = True, named: DataFrame | None = None) -> DataFrame:
    """[value]: the summary's triples; with ``support`` also the number of nodes of every summary node, and every edge
    reified with the number of triples it stands for. Edges are numbered in sorted order."""
    named = names(summary) if named is None else named
    edges = _named_edges(summary, named)
    out = edges.select(_line(F.col("s"), F.col("p"), F.col("o")).alias("value"))
    if not support:
        return out
    nodes = summary.node_support().join(named, "rep").select(_line(F.col("name"), _own("nodeSupport"), _quoted(F.col("cnt"))).alias("value"))
    keyed = edges.groupBy("s", "p", "o").agg(F.sum("cnt").alias("cnt")).withColumn("_order", F.concat_ws("\u0001", "s", "p", "o"))
    keyed = numbered(keyed, "_order", "_n", 0)
    edge = F.concat(F.lit(f"<{OWN}edge{summary.kind.code}"), F.col("_n").cast("string"), F.lit(">"))
    four = [("reifiedEdgeSubject", F.col("s")), ("reifiedEdgeProperty", F.col("p")), ("reifiedEdgeObject", F.col("o")), ("edgeSupport", _quoted(F.col("cnt")))]
    return out.union(nodes).union(keyed.select(F.explode(F.array(*[_line(edge, _own(p), o) for p, o in four])).alias("value")))


def representation_ntriples(summary: Summary, named: DataFrame | None = None) -> DataFrame:
    """[value]: which nodes each summary node stands for."""
    named = names(summary) if named is None else named
    return summary.rep.join(named, "rep").select(_line(F.col("name"), F.lit(_MEMBER), F.col("node")).alias("value"))


def node_statistics_ntriples(summary: Summary, named: DataFrame | None = None) -> DataFrame:
    named = names(summary) if named is None else named
    return summary.node_support().join(named, "rep").select(_line(F.col("name"), _own("nodeSupport"), _quoted(F.col("cnt"), _INTEGER)).alias("value"))


def edge_statistics_ntriples(summary: Summary) -> DataFrame:
    """[value]: how many triples the edges of each property stand for."""
    by = summary.edges.groupBy("p").agg(F.sum("cnt").alias("cnt"))
    return by.select(_line(F.col("p"), _own("edgeSupport"), _quoted(F.col("cnt"), _INTEGER)).alias("value"))


def encoded_lines(summary: Summary, named: DataFrame | None = None) -> DataFrame:
    """[value]: edges between numbers of summary nodes."""
    named = names(summary) if named is None else named
    of = lambda end: named.select(F.col("rep").alias(end), F.col("number").alias(f"_{end}"))
    return summary.edges.join(of("s"), "s").join(of("o"), "o").select(F.format_string("<%d %s %d>", "_s", "p", "_o").alias("value"))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')


def _label(term: Column) -> Column:
    return _escaped(F.when(terms.is_iri(term), terms.suffix(terms.last_segment(term))).otherwise(terms.suffix(terms.unquoted(term))))


_STYLES = {"data": "solid", "schema": "bold", "type": "dashed", "generic": "dotted"}


def dot_lines(summary: Summary, palette: str = "light", generic: bool = False, most: int = MOST) -> DataFrame:
    """[value]: the summary as a plain drawing; edge labels have the number of triples."""
    named = names(summary)
    edges = _named_edges(summary, named).filter(F.lit(generic) | (F.col("kind") != "generic")).orderBy("s", "p", "o", "kind").limit(most)
    style = F.element_at(F.create_map(*[F.lit(x) for kv in _STYLES.items() for x in kv]), F.col("kind"))
    arrow = F.concat(F.lit('"'), _escaped(F.col("s")), F.lit('" -> "'), _escaped(F.col("o")), F.lit('" [label="'), _label(F.col("p")), F.lit(" ("), F.col("cnt").cast("string"), F.lit(')", style='), style, F.lit("];"))
    nodes = edges.select(F.explode(F.array("s", "o")).alias("name")).distinct().join(named, "name").join(summary.node_support(), "rep")
    box = F.concat(F.lit('"'), _escaped(F.col("name")), F.lit('" [label="'), _label(F.col("name")), F.lit(" ("), F.col("cnt").cast("string"), F.lit(')", style=filled, fillcolor='), terms.colour(F.col("number"), PALETTES[palette]), F.lit("];"))
    return _drawing(nodes.select(box.alias("value")), edges.select(arrow.alias("value")))


def dot_split_leaves(summary: Summary, most: int = MOST) -> DataFrame:
    """[value]: a drawing in which every edge into a leaf has a leaf of its own, with the number of nodes it reaches."""
    named = names(summary)
    of = lambda end: named.select(F.col("rep").alias(end), F.col("name").alias(f"_{end}"))
    inner = summary.of_kind("data", "generic").join(summary.leaves().withColumnRenamed("node", "o"), "o", "left_anti").select("s", "p", "o", "cnt", F.lit(None).cast("long").alias("reached"))
    leaf = summary.leaf_support().withColumnRenamed("cnt", "reached").join(summary.of_kind("data", "generic").groupBy("s", "p", "o").agg(F.sum("cnt").alias("cnt")), ["s", "p", "o"]).select("s", "p", "o", "cnt", "reached")
    edges = inner.union(leaf).join(of("s"), "s").join(of("o"), "o").orderBy("_s", "p", "_o").limit(most)
    goal = F.when(F.col("reached").isNull(), _escaped(F.col("_o"))).otherwise(F.concat(_escaped(F.col("_o")), F.lit(" "), F.md5(F.concat_ws(" ", "_s", "p"))))
    arrow = F.concat(F.lit('"'), _escaped(F.col("_s")), F.lit('" -> "'), goal, F.lit('" [label="'), _label(F.col("p")), F.lit(" ("), F.col("cnt").cast("string"), F.coalesce(F.concat(F.lit(" to "), F.col("reached").cast("string")), F.lit("")), F.lit(')"];'))
    return _drawing(edges.select(arrow.alias("value")))


def dot_folded_leaves(summary: Summary, most: int = MOST, shown: int = CLASSES_SHOWN) -> DataFrame:
    """[value]: a drawing in which leaves are lines in the box of their subject, ``property (edges to nodes)``, below
    its classes; of a namespace the first ``shown`` classes, and how many more there are."""
    named = names(summary)
    of = lambda end: named.select(F.col("rep").alias(end), F.col("name").alias(f"_{end}"))
    leaf = summary.leaf_support().withColumnRenamed("cnt", "reached").join(summary.of_kind("data", "generic").groupBy("s", "p", "o").agg(F.sum("cnt").alias("cnt")), ["s", "p", "o"])
    rows = leaf.select(F.col("s").alias("rep"), F.concat(F.lit("2"), "p").alias("_at"), F.format_string("%s (%d to %d)", _label(F.col("p")), "cnt", "reached").alias("row"))
    space, within = terms.namespace(F.col("type")), Window.partitionBy("rep", "_space").orderBy("type")
    classes = summary.type_histogram().withColumn("_space", space).withColumn("_n", F.row_number().over(within)).withColumn("_all", F.count("*").over(Window.partitionBy("rep", "_space")))
    said = F.when(F.col("_n") <= shown, F.format_string("%s (%d)", _label(F.col("type")), "cnt")).when(F.col("_n") == shown + 1, F.format_string("%d more from %s", F.col("_all") - shown, "_space"))
    rows = rows.union(classes.select("rep", F.concat(F.lit("1"), "_space", F.lpad(F.col("_n").cast("string"), 9, "0")).alias("_at"), said.alias("row")).filter("row is not null"))
    boxes = rows.groupBy("rep").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "row"))), lambda r: r["row"]), r"\l").alias("text"))
    schema = summary.graph.schema_nodes.withColumnRenamed("node", "rep")
    nodes = named.join(summary.rep.select("rep").distinct().join(summary.leaves().withColumnRenamed("node", "rep"), "rep", "left_anti").join(schema, "rep", "left_anti"), "rep", "left_semi").join(boxes, "rep", "left").join(summary.node_support(), "rep")
    box = F.concat(F.lit('"'), _escaped(F.col("name")), F.lit('" [shape=box, label="'), _label(F.col("name")), F.lit(" ("), F.col("cnt").cast("string"), F.lit(r")\n"), F.coalesce(F.concat("text", F.lit(r"\l")), F.lit("")), F.lit('"];'))
    inner = summary.of_kind("data", "generic").join(summary.leaves().withColumnRenamed("node", "o"), "o", "left_anti").join(of("s"), "s").join(of("o"), "o")
    arrow = F.concat(F.lit('"'), _escaped(F.col("_s")), F.lit('" -> "'), _escaped(F.col("_o")), F.lit('" [label="'), _label(F.col("p")), F.lit(" ("), F.col("cnt").cast("string"), F.lit(')"];'))
    return _drawing(nodes.orderBy("name").limit(most).select(box.alias("value")), inner.orderBy("_s", "p", "_o").limit(most).select(arrow.alias("value")))


def dot_encoded(summary: Summary, most: int = MOST) -> DataFrame:
    """[value]: the summary with numbers for its nodes, as ``encoded_lines`` has them."""
    named = names(summary)
    of = lambda end: named.select(F.col("rep").alias(end), F.col("number").alias(f"_{end}"))
    edges = summary.edges.join(of("s"), "s").join(of("o"), "o").orderBy("_s", "p", "_o", "kind").limit(most)
    arrow = F.concat(F.col("_s").cast("string"), F.lit(" -> "), F.col("_o").cast("string"), F.lit(' [label="'), _label(F.col("p")), F.lit(" ("), F.col("cnt").cast("string"), F.lit(')"];'))
    return _drawing(edges.select(arrow.alias("value")))


def dot_graph(summary: Summary, palette: str = "light", most: int = 100) -> DataFrame:
    """[value]: the first triples of the input graph, nodes coloured by their class."""
    numbers = summary.rep.join(names(summary), "rep").select("node", "number")
    first = summary.graph.all.orderBy("s", "p", "o").limit(most)
    nodes = first.select(F.explode(F.array("s", "o")).alias("node")).distinct().join(numbers, "node")
    box = F.concat(F.lit('"'), _escaped(F.col("node")), F.lit('" [label="'), _label(F.col("node")), F.lit('", style=filled, fillcolor='), terms.colour(F.col("number"), PALETTES[palette]), F.lit("];"))
    arrow = F.concat(F.lit('"'), _escaped(F.col("s")), F.lit('" -> "'), _escaped(F.col("o")), F.lit('" [label="'), _label(F.col("p")), F.lit('"];'))
    return _drawing(nodes.select(box.alias("value")), first.select(arrow.alias("value")))


def dot_triples(triples: DataFrame, most: int = MOST) -> DataFrame:
    """[value]: a table of triples as it is, terms in blue on white."""
    first = triples.select("s", "p", "o").orderBy("s", "p", "o").limit(most)
    nodes = first.select(F.explode(F.array("s", "o")).alias("node")).distinct()
    box = F.concat(F.lit('"'), _escaped(F.col("node")), F.lit('" [label="'), _label(F.col("node")), F.lit('", color=blue, fontcolor=blue];'))
    arrow = F.concat(F.lit('"'), _escaped(F.col("s")), F.lit('" -> "'), _escaped(F.col("o")), F.lit('" [label="'), _label(F.col("p")), F.lit('", color=blue];'))
    return _drawing(nodes.select(box.alias("value")), first.select(arrow.alias("value")))


def _drawing(*parts: DataFrame) -> DataFrame:
    spark = parts[0].sparkSession
    lines = spark.createDataFrame([(0, "digraph summary {"), (9, "}")], "_at int, value string")
    for i, part in enumerate(parts, 1):
        lines = lines.union(part.select(F.lit(i), "value"))
    return lines.orderBy("_at", "value").select("value")


def to_text(lines: DataFrame) -> str:
    """A drawing as one text, on the driver; it has at most some thousand lines."""
    return "\n".join(r["value"] for r in lines.collect()) + "\n"


def to_png(dot: str, path: str) -> bool:
    """Draw with the dot program; false if there is none or it fails."""
    if not shutil.which("dot"):
        return False
    return subprocess.run(["dot", "-Tpng", "-o", path], input=dot.encode(), capture_output=True).returncode == 0


def statistics(summary: Summary) -> dict[str, int]:
    """Sizes of a summary and its input, by name."""
    e = summary.edges.agg(F.count("*"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("cnt"))), F.lit(0)) for k in ("data", "type", "schema", "generic")]).first()
    n = summary.rep.agg(F.count("*"), F.countDistinct("rep")).first()
    named = ["summary_edges", "data_triples", "type_triples", "schema_triples", "generic_triples"]
    return dict(zip(named, e)) | {"input_nodes": n[0], "summary_nodes": n[1], "leaves": summary.leaves().count()}


def to_csv(told: dict) -> str:
    """A header of sorted names, and their values."""
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(sorted(told))
    writer.writerow([told[k] for k in sorted(told)])
    return out.getvalue()


