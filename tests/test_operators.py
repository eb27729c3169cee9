"""Saturation, hierarchies, components, analyses, dictionary, sources, exports, streaming, options."""

from __future__ import annotations

import math
import random

import graphs
import pytest

from tessella.functions.vocabulary import DOMAIN, OWN, RANGE, SUBCLASS, SUBPROPERTY, TYPE
from tessella.operators import analysis
from tessella.operators.components import components
from tessella.operators.graph import Graph
from tessella.operators.saturation import closure, saturate, top_classes
from tessella.operators.summary import summarize
from tessella.plans.options import Options
from tessella.sources import dictionary, export, generate, ntriples, store
from tessella.streaming.incremental import ALWAYS, WHEN_CHANGED, Growing, replay

COLUMNS = "s string, p string, o string"


def graph(spark, text):
    return Graph(spark.createDataFrame(graphs.triples(text) if isinstance(text, str) else text, COLUMNS))


def rows(df):
    return {tuple(r) for r in df.collect()}


def fixpoint(triples):
    """Instance-level consequences, rule by rule until nothing is new."""
    known = set(triples)
    while True:
        new = set()
        for s, p, o in known:
            for a, q, b in known:
                if q == SUBPROPERTY and a == p:
                    new.add((s, b, o))
                if q == DOMAIN and a == p:
                    new.add((s, TYPE, b))
                if q == RANGE and a == p:
                    new.add((o, TYPE, b))
                if q == SUBCLASS and p == TYPE and a == o:
                    new.add((s, TYPE, b))
        if new <= known:
            return known
        known |= new


@pytest.mark.parametrize(
    "text",
    [
        graphs.SCHEMA,
        "a p b\np subp q\nq subp r\nr dom C:1\nC:1 sub C:2\nC:2 sub C:1",  # a chain of properties, a cycle of classes
        "a p C:1\np subp type\nC:1 sub C:2\nC:2 sub C:3",  # types follow from data
        "a p b\nb q c",
    ],
)
def test_saturation_is_the_fixpoint(spark, text):
    assert rows(saturate(graph(spark, text))) == fixpoint(graphs.triples(text))


def test_closure_of_a_cycle_and_a_chain(spark):
    edges = [(f"c{i}", "x", f"c{i + 1}") for i in range(9)] + [("c9", "x", "c7")]
    got = rows(closure(spark.createDataFrame(edges, COLUMNS)))
    want = {(f"c{i}", f"c{j}") for i in range(10) for j in range(10) if j > i or (i >= 7 and j >= 7)}
    assert got == want


def test_top_classes(spark):
    got = rows(top_classes(graph(spark, "C:a sub C:b\nC:b sub C:c\nC:x sub C:y\nC:y sub C:x\nC:z sub C:y\nC:q sub C:c\nC:q sub C:d")))
    t = graphs.term
    want = {("a", "c"), ("b", "c"), ("c", "c"), ("q", "c"), ("q", "d"), ("d", "d"), ("x", "x"), ("y", "x"), ("z", "x")}
    assert got == {(t(f"C:{a}"), t(f"C:{b}")) for a, b in want}


def test_components_like_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)] + [(None, 3), (9, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert rows(components(spark.createDataFrame(edges, "a long, b long"))) == {(x, find(x)) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def patterns(triples):
    out = set()
    for a in triples:
        for b in triples:
            out |= {(a[1], b[1], n) for n, x, y in (("os", a[2], b[0]), ("oo", a[2], b[2]), ("ss", a[0], b[0])) if x == y}
    return out


def test_patterns_and_accuracy(spark):
    g = graph(spark, graphs.SCHEMA)
    summary = summarize(g, "weak")
    told = patterns([(r.s, r.p, r.o) for r in summary.edges.collect()])
    real = patterns(graphs.triples(graphs.SCHEMA))
    assert rows(analysis.patterns(summary.edges)) == told
    got = analysis.accuracy(g, summary.edges).first()
    assert (got.found, got.total) == (len(told & real), len(told)) and got.accuracy == pytest.approx(got.found / got.total)
    assert math.isnan(analysis.accuracy(g, summary.edges.limit(0)).first().accuracy)


def test_statistics(spark):
    g = graph(spark, graphs.MIXED)
    told = {r.measure: r.value for r in analysis.statistics(g).collect()}
    assert told == {"data_triples": 3, "type_triples": 5, "schema_triples": 0, "generic_triples": 2, "data_properties": 3, "nodes": 11, "classes": 2}
    assert {r.measure: r.value for r in analysis.object_analysis(g).collect()} == {"typed": 4, "with_data": 3, "typed_with_data": 2, "untyped_with_data": 1, "typed_without_data": 2}
    ratio = analysis.untyped_ratio(g).first()
    assert (ratio.nodes, ratio.typed) == (11, 3) and ratio.ratio == pytest.approx(1 - 3 / 11)


def test_dictionary_is_sorted_and_grows(spark):
    g = graph(spark, graphs.SCHEMA)
    terms = dictionary.dictionary(g.all)
    want = sorted({x for t in graphs.triples(graphs.SCHEMA) for x in t})
    assert rows(terms) == {(i, t) for i, t in enumerate(want, 1)}
    coded = dictionary.encode(g.all, terms)
    assert rows(dictionary.decode(coded, terms)) == set(graphs.triples(graphs.SCHEMA))
    more = dictionary.extend(terms, spark.createDataFrame([("zz",), (want[0],), ("aa",), (None,)], "value string"))
    assert rows(more) - rows(terms) == {(len(want) + 1, "aa"), (len(want) + 2, "zz")}
    assert rows(dictionary.encode(spark.createDataFrame([("no", want[0], want[1])], COLUMNS), terms)) == {(-1, 1, 2)}


def test_ntriples_lines(spark, tmp_path):
    good = ['<urn:a> <urn:p> <urn:b> .', '_:x <urn:p> "a b \\" c"@en-GB . # said', '  <urn:a>\t<urn:p> "1"^^<urn:int>.', '<urn:a> <urn:p> "é 日本" .', '<urn:a> <urn:p> <urn:b> .']
    idle = ["", "# comment", "   "]
    bad = ["<urn:a> <urn:p> .", '<urn:a> "p" <urn:b> .', "<urn:a> <urn:p> <urn:b>", '<urn:a> <urn:p> "open .']
    (tmp_path / "g.nt").write_text("\n".join(good + idle + bad) + "\n")
    got = rows(ntriples.read_ntriples(spark, str(tmp_path / "g.nt")))
    assert got == {("<urn:a>", "<urn:p>", "<urn:b>"), ("_:x", "<urn:p>", '"a b \\" c"@en-GB'), ("<urn:a>", "<urn:p>", '"1"^^<urn:int>'), ("<urn:a>", "<urn:p>", '"é 日本"')}
    with pytest.raises(Exception, match="not a triple"):
        ntriples.read_ntriples(spark, str(tmp_path / "g.nt"), strict=True).collect()
    ntriples.write_ntriples(spark.createDataFrame(list(got), COLUMNS), str(tmp_path / "out"))
    assert rows(ntriples.read_ntriples(spark, str(tmp_path / "out"), strict=True)) == got
    assert all(ntriples.valid(x) for x in good) and not any(ntriples.valid(x) for x in bad)


def test_store_keeps_counts(spark, tmp_path):
    summary = summarize(graph(spark, graphs.MIXED), "strong")
    store.save(summary, str(tmp_path / "s"))
    back = store.load(spark, str(tmp_path / "s"))
    assert rows(back.edges) == rows(summary.edges) and rows(back.rep) == rows(summary.rep) and back.manifest["kind"] == "strong"
    with pytest.raises(Exception, match="exists"):
        store.save(summary, str(tmp_path / "s"))


def test_random_triples_depend_on_the_seed_alone(spark):
    a = generate.random_triples(spark, 300, 40, 5, classes=3, seed=1)
    assert rows(a) == rows(generate.random_triples(spark, 300, 40, 5, classes=3, seed=1).repartition(5))
    assert rows(a) != rows(generate.random_triples(spark, 300, 40, 5, classes=3, seed=2))


def test_exports(spark):
    summary = summarize(graph(spark, graphs.SCHEMA), "2ponefb")
    lines = [r.value for r in export.ntriples(summary).collect()]
    assert all(ntriples.valid(x) for x in lines)
    assert sum("nodeSupport" in x for x in lines) == 13 and sum("reified" in x or "edgeSupport" in x for x in lines) == 4 * 13
    assert sum(OWN not in x for x in lines) == 5  # schema edges are written as they are
    again = Graph(ntriples.triples(export.ntriples(summary)), summary.graph.vocabulary)
    assert again.generic.count() == 13 + 4 * 13 and again.data.count() == 7
    members = [r.value for r in export.representation_ntriples(summary).collect()]
    assert len(members) == summary.rep.count() and all(map(ntriples.valid, members))
    for made in (export.node_statistics_ntriples(summary), export.edge_statistics_ntriples(summary)):
        assert made.count() and all(ntriples.valid(r.value) for r in made.collect())
    assert export.encoded_lines(summary).count() == 13
    for draw in (export.dot_lines, export.dot_split_leaves, export.dot_folded_leaves, export.dot_graph, export.dot_encoded):
        text = export.to_text(draw(summary))
        assert text.startswith("digraph summary {\n") and text.endswith("}\n") and "[" in text
    assert "color=blue" in export.to_text(export.dot_triples(summary.graph.all))
    told = export.statistics(summary)
    assert told["data_triples"] == 8 and told["type_triples"] == 1 and told["schema_triples"] == 5 and told["summary_nodes"] == 13
    assert export.to_csv({"b": 1, "a": 2}) == "a,b\r\n2,1\r\n"


def test_leaves_split(spark):
    summary = summarize(graph(spark, 'a p "1"\na p "2"\nb p "2"\nc q a'), "2ponefb")
    assert {r.node for r in summary.leaves().collect()} == {'"1"'}
    assert {(r.p, r.cnt) for r in summary.leaf_support().collect()} == {("<urn:p>", 2), ("<urn:p>", 1)}


def test_growing_graph_ends_at_the_batch_result(spark, tmp_path):
    g = graph(spark, graphs.SCHEMA + graphs.MIXED)
    for kind in ("strong", "typedweak"):
        assert rows(replay(g, kind, 3).edges) == rows(summarize(g, kind).edges)
    seen = []
    growing = Growing(spark, str(tmp_path / "g"), "weak", snapshots=WHEN_CHANGED, on_snapshot=lambda i, s: seen.append(i))
    batch = spark.createDataFrame(graphs.triples(graphs.BACK), COLUMNS)
    for i in (0, 0, 1):  # a batch that comes again counts once, and one that says nothing new changes nothing
        growing.add(batch, i)
    assert seen == [0] and growing.graph().all.count() == 5
    always = Growing(spark, str(tmp_path / "h"), "weak", snapshots=ALWAYS, on_snapshot=lambda i, s: seen.append(("h", i)))
    always.add(batch, 0)
    always.add(batch, 1)
    assert seen[1:] == [("h", 0), ("h", 1)]
    anew = Growing(spark, str(tmp_path / "g"), "weak", snapshots=WHEN_CHANGED, on_snapshot=lambda i, s: seen.append(("anew", i)))
    anew.add(batch, 2)  # started again, it knows what was seen
    assert seen[3:] == []
    with pytest.raises(ValueError):
        Growing(spark, str(tmp_path), snapshots="true")


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [" ".join((*t, ".")) for t in graphs.triples(graphs.SCHEMA)]
    growing = Growing(spark, str(tmp_path / "state"), "strong")
    for i, part in enumerate((lines[:5], lines[5:])):
        (tmp_path / "in" / f"{i}.nt").write_text("\n".join(part) + "\n")
        growing.follow(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert rows(growing.summary().edges) == rows(summarize(graph(spark, graphs.SCHEMA), "strong").edges)


def test_options():
    options = Options.from_layers({"kind": "weak", "support": "false"}, {"kind": "typed", "variant_type_properties": "<a>, <b>"})
    assert (options.kind, options.support, options.variant_type_properties) == ("typed", False, ("<a>", "<b>"))
    assert options.prefix("out/", "g") == "out/g_t" and "support=false" in options.lines()
    for bad in ({"kind": "x"}, {"nothing": "1"}, {"support": "maybe"}, {"kind": "typedweak", "saturate_summary": "true"}, {"replace_type_with_most_general_type": "true"}, {"step_by_step": "true"}, {"drawing": "x"}, {"saturation": "x"}):
        with pytest.raises(ValueError):
            Options.from_layers(bad)


def test_command_line(spark, tmp_path, capsys):
    from tessella.__main__ import main

    (tmp_path / "g.nt").write_text("\n".join(" ".join((*t, ".")) for t in graphs.triples(graphs.SCHEMA)) + "\n")
    assert main(["summarize", "x.nt", "-d", "-o", "kind=weak"]) == 0 and "kind=weak" in capsys.readouterr().out
    assert main(["load", str(tmp_path / "g.nt"), str(tmp_path / "loaded"), "-o", "saturation=ASSERTION_SAT"]) == 0
    assert main(["summarize", str(tmp_path / "loaded"), str(tmp_path / "out"), "-o", "kind=2ponefb", "-o", "drawing=plain", "-o", "consistency_checks=true"]) == 0
    assert (tmp_path / "out" / "loaded_2p1fb" / "summary.nt").exists()
    capsys.readouterr()
    assert main(["read", str(tmp_path / "out" / "loaded_2p1fb" / "tables")]) == 0 and "2ponefb" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["summarize", "x.nt", "-o", "kind=nothing"])


def test_command_line_reaches_all_exports(spark, tmp_path):
    from tessella.__main__ import main

    lines = [" ".join((*t, ".")) for t in graphs.triples(graphs.BACK)]
    (tmp_path / "g").write_text("\n".join(lines) + "\n")  # a file without a suffix
    assert main(["load", str(tmp_path / "g"), str(tmp_path / "loaded")]) == 0
    assert "loadingTime" in "".join(x.read_text() for x in (tmp_path / "loaded" / "loading.csv").glob("part-*"))
    extra = ["-o", "export_support_statistics=true", "-o", "drawing=encoded", "-o", "step_by_step=always", "-o", "steps=2"]
    assert main(["summarize", str(tmp_path / "g"), str(tmp_path / "out"), "-o", "kind=weak", *extra]) == 0
    at = tmp_path / "out" / "g_w"
    read = lambda name: "".join(x.read_text() for x in (at / name).glob("part-*"))
    assert "nodeSupport" in read("node_statistics.nt") and "edgeSupport" in read("edge_statistics.nt")
    assert "summarizingTime" in read("statistics.csv") and " -> " in read("summary.dot")
    assert " -> " in read("steps/0000.dot") and " -> " in read("steps/0001.dot") and not (at / "steps" / "0002.dot").exists()
    assert main(["batch", f"{tmp_path / 'g'},{tmp_path / 'nowhere.nt'}", str(tmp_path / "many"), "-k", "typed"]) == 1
    assert (tmp_path / "many" / "g_t").exists()


def test_conflicting_replacements(spark):
    from tessella.operators.components import conflicts

    told = [(1, 9), (2, 9), (2, 8), (3, 4), (4, 5), (6, 6), (7, 6)]
    assert rows(conflicts(spark.createDataFrame(told, "node long, to long"))) == {(2,), (3,)}


def test_a_hub_is_counted_before_it_is_joined(spark):
    """A literal that nearly all triples lead to, with more than one property, and a subject of many."""
    text = "\n".join([f'a{i} p "hub"' for i in range(200)] + [f'a{i} q "hub"' for i in range(0, 200, 2)] + [f"a0 r b{i}" for i in range(150)])
    g = graph(spark, text)
    for kind in ("weak", "2ponefb"):
        summary = summarize(g, kind)
        rep = {r.node: r.rep for r in summary.rep.collect()}
        want = {}
        for s, p, o in graphs.triples(text):
            want[rep[s], p, rep[o]] = want.get((rep[s], p, rep[o]), 0) + 1
        assert {(r.s, r.p, r.o): r.cnt for r in summary.edges.collect()} == want and not summary.check()
