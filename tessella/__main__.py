"""python -m tessella load|summarize|batch|read ...: the library from the command line."""

from __future__ import annotations

import argparse
import dataclasses
import time
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.graph import Graph
from tessella.operators.saturation import saturate
from tessella.operators.summary import Summary, summarize, summarize_saturated, summarize_shortcut
from tessella.plans.options import Options, properties
from tessella.sources import dictionary, export, ntriples, store
from tessella.streaming.incremental import Growing

DRAWINGS = {"plain": export.dot_lines, "split_leaves": export.dot_split_leaves, "split_and_fold_leaves": export.dot_folded_leaves, "encoded": export.dot_encoded, "graph": export.dot_graph}


def _write(lines: DataFrame, path: str, mode: str) -> None:
    lines.write.mode(mode).text(path)


def _csv(spark: SparkSession, told: dict, path: str, mode: str) -> None:
    _write(spark.createDataFrame([(x,) for x in export.to_csv(told).splitlines()], "value string").coalesce(1), path, mode)


def _ms(began: float) -> int:
    return int(1000 * (time.time() - began))


def load(spark: SparkSession, source: str, out: str, options: Options) -> dict:
    """N-Triples to Parquet: triples, dictionary and encoded triples, by kind of triple, saturated ones too if asked
    for. Existing folders are kept unless ``overwrite``. Returns times in ms and counts, and writes them to
    loading.csv."""
    mode, began = "overwrite" if options.overwrite else "errorifexists", time.time()
    graph = Graph(ntriples.read_ntriples(spark, source), options.vocabulary())
    graph.all.withColumn("kind", graph.vocabulary.kind(graph.all["p"])).write.mode(mode).partitionBy("kind").parquet(f"{out}/triples")
    stored = spark.read.parquet(f"{out}/triples").select("s", "p", "o")
    told = {"loadingTime": int(1000 * (time.time() - began)), "saturationTime": 0}
    if options.saturation != "NONE":
        began = time.time()
        saturate(Graph(stored, options.vocabulary())).write.mode(mode).parquet(f"{out}/saturated_triples")
        told["saturationTime"] = int(1000 * (time.time() - began))
        stored = spark.read.parquet(f"{out}/saturated_triples")
    dictionary.dictionary(stored).write.mode(mode).parquet(f"{out}/dictionary")
    terms = spark.read.parquet(f"{out}/dictionary")
    dictionary.encode(stored, terms).write.mode(mode).parquet(f"{out}/encoded_triples")
    told |= {"triples": stored.count(), "terms": terms.count()}
    _csv(spark, told, f"{out}/loading.csv", mode)
    return told


def run_summarize(spark: SparkSession, source: str, out: str, options: Options) -> Summary:
    """Summarize a file of N-Triples, or a folder that ``load`` wrote, and write what the options ask for."""
    graph, began = Graph(_source(spark, source), options.vocabulary()), time.time()
    if options.saturate_summary:
        summary = summarize_shortcut(graph, options.kind)
    elif options.saturation != "NONE":
        summary = summarize_saturated(graph, options.kind, options.replace_type_with_most_general_type)
    else:
        summary = summarize(graph, options.kind, options.replace_type_with_most_general_type)
    times = {"summarizingTime": _ms(began)}
    if options.consistency_checks and (wrong := summary.check()):
        raise RuntimeError("; ".join(wrong))
    began = time.time()
    prefix, mode = options.prefix(out, PurePath(source).stem), "overwrite" if options.overwrite else "errorifexists"
    write = lambda lines, name: _write(lines, f"{prefix}/{name}", mode)
    if options.export_tables:
        store.save(summary, f"{prefix}/tables", mode)
    if options.export_ntriples:
        write(export.ntriples(summary, options.support), "summary.nt")
    if options.export_representation:
        write(export.representation_ntriples(summary), "representation.nt")
    if options.export_support_statistics:
        write(export.node_statistics_ntriples(summary), "node_statistics.nt")
        write(export.edge_statistics_ntriples(summary), "edge_statistics.nt")
    if options.export_statistics:
        _csv(spark, export.statistics(summary) | times | {"savingTime": _ms(began)}, f"{prefix}/statistics.csv", mode)
    spark.createDataFrame([(x,) for x in options.lines()], "value string").coalesce(1).write.mode(mode).text(f"{prefix}/options")
    if options.drawing != "none":
        draw = DRAWINGS[options.drawing]
        lines = (draw(summary, options.palette) if options.drawing in ("plain", "graph") else draw(summary)).coalesce(1)
        write(lines, "summary.dot")
        if options.png:
            export.to_png(export.to_text(lines), f"{prefix}.png")
    if options.step_by_step != "false":
        _step_by_step(graph, prefix, mode, options)
    return summary


def _source(spark: SparkSession, source: str) -> DataFrame:
    """Triples of a folder that ``load`` wrote, or of a file of N-Triples, whatever its name."""
    try:
        return spark.read.parquet(f"{source}/triples").select("s", "p", "o")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return ntriples.read_ntriples(spark, source)


def _step_by_step(graph: Graph, prefix: str, mode: str, options: Options) -> None:
    """Drawings of the summary of the first triples, as they come one by one: those of types last, as they are
    handled after all others."""
    spark, v = graph.all.sparkSession, graph.vocabulary
    first = graph.all.orderBy(v.is_type(F.col("p")), "s", "p", "o").limit(options.steps).collect()
    at = f"{prefix}/steps"
    draw = lambda number, summary: _write(export.dot_lines(summary, options.palette).coalesce(1), f"{at}/{number:04}.dot", mode)
    growing = Growing(spark, f"{at}/state", options.kind, v, options.step_by_step, draw)
    for number, triple in enumerate(first):
        growing.add(spark.createDataFrame([triple], "s string, p string, o string"), number)


def batch(spark: SparkSession, sources: list[str], kinds: list[str], out: str, options: Options) -> dict[str, str]:
    """Summaries of several graphs and kinds, one after the other; what went wrong with one, by its graph and kind,
    doesn't keep the others."""
    wrong = {}
    for source in sources:
        for kind in kinds:
            try:
                run_summarize(spark, source, out, dataclasses.replace(options, kind=kind).checked())
            except Exception as error:  # noqa: BLE001  told at the end
                wrong[f"{source} {kind}"] = str(error).splitlines()[0]
    return wrong


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    parser.add_argument("action", choices=["load", "summarize", "batch", "read"])
    parser.add_argument("source", help="a file of N-Triples, or a folder written before; several, with commas between, for batch")
    parser.add_argument("out", nargs="?", default=".")
    parser.add_argument("-p", "--properties", help="a file of options")
    parser.add_argument("-k", "--kinds", default="", help="kinds for batch, with commas between")
    parser.add_argument("-o", "--option", action="append", default=[], metavar="NAME=VALUE")
    parser.add_argument("-d", "--dry-run", action="store_true", help="show the options in effect and end")
    args = parser.parse_args(argv)
    given = dict(x.partition("=")[::2] for x in args.option)
    try:
        options = Options.from_layers(properties(args.properties) if args.properties else {}, given)
    except ValueError as error:
        parser.error(str(error))
    if args.dry_run:
        print("\n".join(options.lines()))
        return 0
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if args.action == "load":
        print(export.to_csv(load(spark, args.source, args.out, options)), end="")
    elif args.action == "summarize":
        print(export.to_csv(export.statistics(run_summarize(spark, args.source, args.out, options))), end="")
    elif args.action == "batch":
        wrong = batch(spark, args.source.split(","), args.kinds.split(",") if args.kinds else [options.kind], args.out, options)
        print("".join(f"{what}: {why}\n" for what, why in wrong.items()), end="")
        return int(bool(wrong))
    else:
        stored = store.load(spark, args.source)
        print(export.to_csv({"edges": stored.edges.count(), "summary_nodes": stored.node_stats.count(), "kind": stored.manifest["kind"]}), end="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
