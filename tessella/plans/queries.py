"""Queries by name on the graph of tables: one for each operator of the library."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import analysis, quotient
from tessella.operators.saturation import saturate, top_classes
from tessella.operators.summary import Summary, summarize, summarize_saturated, summarize_shortcut
from tessella.plans.lineage import shared_dir, spool
from tessella.sources import dictionary, export, ntriples, store
from tessella.sources.tables import table_graph
from tessella.streaming.incremental import replay

Query = Callable[[SparkSession, str], DataFrame]


def _graph(build: Callable) -> Query:
    return lambda spark, sf_dir: build(table_graph(spark, sf_dir))


def _summary(kind: str, build: Callable[[Summary], DataFrame] = lambda s: s.edges) -> Query:
    return lambda spark, sf_dir: build(summarize(table_graph(spark, sf_dir), kind))


def _classified(graph) -> DataFrame:
    return graph.all.select(graph.vocabulary.kind(F.col("p")).alias("kind"), "p").groupBy("kind", "p").agg(F.count("*").alias("cnt"))


def _cliques(role: str) -> Query:
    return _graph(lambda g: quotient.cliques(quotient.grouped_roles(g, quotient.KINDS["strong"]), role))


def _two_rounds(graph) -> DataFrame:
    kind = quotient.KINDS["2pbisim"]
    return quotient.represent(quotient.bisimulation(graph, quotient.grouped_roles(graph, kind), rounds=2))


def _encoded(graph) -> DataFrame:
    return dictionary.encode(graph.all, dictionary.dictionary(graph.all))


def _decoded(graph) -> DataFrame:
    terms = spool(dictionary.dictionary(graph.all))
    return dictionary.decode(dictionary.encode(graph.all, terms), terms)


def _extended(graph) -> DataFrame:
    """The dictionary of the schema, grown by the terms of all triples."""
    return dictionary.extend(dictionary.dictionary(graph.schema), graph.all.select(F.explode(F.array("s", "p", "o")).alias("value")))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    store.save(summarize(table_graph(spark, sf_dir), "strong"), path)
    return store.load(spark, path).edges


QUERIES: dict[str, Query] = {
    "scan_types": _graph(lambda g: g.types),
    "scan_data": _graph(lambda g: g.data),
    "schema_nodes": _graph(lambda g: g.schema_nodes),
    "classify_triples": _graph(_classified),
    "dictionary": _graph(lambda g: dictionary.dictionary(g.all)),
    "dictionary_encode": _graph(_encoded),
    "saturate": _graph(saturate),
    "top_types": _graph(top_classes),
    "class_sets": _graph(lambda g: quotient.class_sets(g).select("node", F.array_join("classes", " ").alias("classes"))),
    "source_cliques": _cliques("S"),
    "target_cliques": _cliques("T"),
    "weak_rep": _summary("weak", lambda s: s.rep),
    "strong_rep": _summary("strong", lambda s: s.rep),
    "weak_edges": _summary("weak"),
    "strong_edges": _summary("strong"),
    "typed_edges": _summary("typed"),
    "typed_weak_edges": _summary("typedweak"),
    "typed_strong_edges": _summary("typedstrong"),
    "io_typed_edges": _summary("2pinputoutput"),
    "onefw_edges": _summary("2ponefw"),
    "onefb_edges": _summary("2ponefb"),
    "bisim_edges": _summary("2pbisim"),
    "bisim_two_rounds": _graph(_two_rounds),
    "source_clique_edges": _summary("2psourceclique"),
    "generic_edges": _summary("strong", lambda s: s.of_kind("generic")),
    "type_only_node": _summary("strong", lambda s: s.adjacent("_: types")),
    "node_support": _summary("strong", lambda s: s.node_support()),
    "edge_support": _summary("weak", lambda s: s.edges.groupBy("kind").agg(F.count("*").alias("edges"), F.sum("cnt").alias("triples"))),
    "leaf_nodes": _summary("2ponefb", lambda s: s.leaves()),
    "split_leaf_support": _summary("2ponefb", lambda s: s.leaf_support()),
    "type_histogram": _summary("typedstrong", lambda s: s.type_histogram()),
    "saturated_strong_edges": lambda spark, d: summarize_saturated(table_graph(spark, d), "strong").edges,
    "saturated_weak_edges": lambda spark, d: summarize_saturated(table_graph(spark, d), "weak").edges,
    "shortcut_weak_edges": lambda spark, d: summarize_shortcut(table_graph(spark, d), "weak").edges.groupBy("p", "kind").agg(F.count("*").alias("edges")),
    "patterns": _summary("strong", lambda s: analysis.patterns(s.edges)),
    "accuracy_al2": _summary("strong", lambda s: analysis.accuracy(s.graph, s.edges)),
    "object_analysis": _graph(analysis.object_analysis),
    "untyped_ratio": _graph(analysis.untyped_ratio),
    "graph_statistics": _graph(analysis.statistics),
    "inlined_edges": _summary("strong", lambda s: s.schema_inlined()),
    "general_typed_edges": lambda spark, d: summarize(table_graph(spark, d), "typedstrong", generalise=True).edges,
    "stored_edges": _stored,
    "dictionary_decode": _graph(_decoded),
    "dictionary_extend": _graph(_extended),
    "ntriples_lines": _graph(lambda g: ntriples.triples(ntriples.lines(g.all), strict=True)),
    "summary_ntriples": _summary("strong", lambda s: export.ntriples(s)),
    "representation_ntriples": _summary("strong", lambda s: export.representation_ntriples(s)),
    "summary_dot": _summary("strong", lambda s: export.dot_lines(s)),
    "stream_strong_edges": lambda spark, d: replay(table_graph(spark, d), "strong", batches=3).edges,
}
