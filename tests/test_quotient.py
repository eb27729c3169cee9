"""Summaries against a plain in-memory model of the definitions, and against counts worked out by hand."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import graphs
import pytest

from tessella.functions.vocabulary import CLASS, PROPERTY, SCHEMA, TYPE, Vocabulary
from tessella.operators.graph import Graph
from tessella.operators.quotient import DATA_FIRST, KINDS, TOGETHER, TYPE_FIRST
from tessella.operators.summary import summarize, summarize_saturated, summarize_shortcut
from tessella.sources import dictionary

V = Vocabulary()


def graph(spark, triples):
    return Graph(spark.createDataFrame(triples, "s string, p string, o string"))


class Model:
    """The definitions, with dictionaries and sets."""

    def __init__(self, triples):
        all_ = set(triples)
        self.types = {t for t in all_ if t[1] in V.types}
        self.schema = {t for t in all_ if t[1] in SCHEMA}
        self.generic = {t for t in all_ if t[1] in V.generic}
        self.data = all_ - self.types - self.schema - self.generic
        self.nodes = {x for t in all_ for x in (t[0], t[2])}
        self.sn = {x for t in self.schema for x in (t[0], t[2])} | {t[2] for t in self.types} | {t[0] for t in self.types if t[2] in (CLASS, PROPERTY)}

    def sets(self, triples, skip):
        out, into = defaultdict(set), defaultdict(set)
        for s, p, o in triples:
            out[s].add(p)
            into[o].add(p)
        return {n: (frozenset(out[n]), frozenset(into[n])) for n in {*out, *into} - skip}

    def classes(self):
        found = defaultdict(set)
        for s, _, o in self.types:
            if s not in self.sn:
                found[s].add(o)
        return found

    @staticmethod
    def merged(groups):
        """Least element of the group that each element ends in, when groups that share one merge."""
        groups = [set(g) for g in groups if g]
        label = {}
        while groups:
            g = groups.pop()
            while touching := [h for h in groups if h & g]:
                for h in touching:
                    g |= h
                    groups.remove(h)
            label |= {x: min(g) for x in g}
        return label

    def keys(self, kind):
        typed = {s for s, _, _ in self.types}
        skip = self.sn | (typed if kind.typed_apart else set())
        sets = self.sets(self.data | self.types if kind.family == TOGETHER else self.data, skip)
        name = kind.keys.__name__
        if name == "_weak":
            tokens = {n: {("S", p) for p in out} | {("T", p) for p in into} for n, (out, into) in sets.items()}
            label = self.merged(tokens.values())
            return {n: label[min(t)] for n, t in tokens.items()}
        if name in ("_strong", "_source_clique"):
            source, target = self.merged([out for out, _ in sets.values()]), self.merged([into for _, into in sets.values()])
            clique = lambda label, ps: label[min(ps)] if ps else None
            return {n: (clique(source, out), clique(target, into) if name == "_strong" else 0) for n, (out, into) in sets.items()}
        if name == "_forward":
            return {n: out for n, (out, _) in sets.items()}
        if name == "_both_ways":
            return sets
        if name == "_one":
            return dict.fromkeys(sets, "untyped")
        classes = self.classes()
        label = {n: (x, frozenset(classes.get(n, ()))) for n, x in sets.items()}
        while True:
            near = defaultdict(set)
            for s, p, o in self.data:
                near[s].add(("out", p, label.get(o, o)))
                near[o].add(("in", p, label.get(s, s)))
            fresh = {n: (x, frozenset(near[n])) for n, x in label.items()}
            numbers = {x: i for i, x in enumerate(dict.fromkeys(fresh.values()))}
            if len(numbers) == len(set(label.values())):
                return label
            label = {n: numbers[x] for n, x in fresh.items()}

    def rep(self, name):
        kind = KINDS[name]
        keys = {n: ("d", k) for n, k in self.keys(kind).items()}
        if kind.typed_apart:
            keys |= {n: ("t", frozenset(c)) for n, c in self.classes().items()}
        least = {}
        for n, k in keys.items():
            least[k] = min(n, least.get(k, n))
        rep = {n: ("_: untyped" if k == ("d", "untyped") else least[k]) for n, k in keys.items()}
        rep |= {n: n for n in self.sn}
        if kind.family == DATA_FIRST:
            rep |= {s: "_: types" for s, _, _ in self.types if s not in rep}
        rest = defaultdict(set)
        for s, p, o in self.generic:
            rest[s].add((0, p))
            rest[o].add((1, p))
        return rep | {n: f"_: {('source', 'target')[min(x)[0]]} {min(x)[1]}" for n, x in rest.items() if n not in rep}

    def edges(self, name):
        kind, rep, out = KINDS[name], self.rep(name), Counter()
        for t in self.data | self.generic | (self.types if kind.family == TOGETHER else set()):
            out[rep[t[0]], t[1], rep[t[2]]] += 1
        for t in self.schema:
            out[t] += 1
        if kind.family == DATA_FIRST:
            for s, _, o in self.types:
                out[rep[s], TYPE, o] += 1
        elif kind.family == TYPE_FIRST:
            for s, p, o in self.types:
                if s in self.sn:
                    out[s, p, o] += 1
            for s, o in {(s, o) for s, _, o in self.types if s not in self.sn}:
                out[rep[s], TYPE, o] += 1
        return out


def random_triples(seed):
    rng = random.Random(seed)
    nodes, ps, classes = [f"n{i}" for i in range(14)], [f"p{i}" for i in range(5)], [f"C:{i}" for i in range(4)]
    lines = [f"{rng.choice(nodes)} {rng.choice(ps)} {rng.choice([*nodes, *nodes, classes[0]])}" for _ in range(16)]
    lines += [f"{rng.choice([*nodes, 'only1', 'only2'])} {rng.choice(['type', 'type', 'P31'])} {rng.choice(classes)}" for _ in range(6)]
    lines += [f"{rng.choice(classes)} sub {rng.choice(classes)}", "p1 dom C:1", f"{rng.choice([*nodes, 'named'])} label x", "y comment named", "C:2 type C:3"]
    return graphs.triples("\n".join(lines))


DISTINCT = ["weak", "strong", "typedweak", "typedstrong", "typed", "2pinputoutput", "2ponefw", "2ponefb", "2pbisim", "2psourceclique"]


@pytest.mark.parametrize("kind", DISTINCT)
def test_like_the_model(spark, kind):
    for triples in (graphs.triples(graphs.MIXED), random_triples(1)):
        summary, model = summarize(graph(spark, triples), kind), Model(triples)
        assert {r.node: r.rep for r in summary.rep.collect()} == model.rep(kind)
        got = Counter()
        for r in summary.edges.collect():
            got[r.s, r.p, r.o] += r.cnt
        assert got == model.edges(kind)
        assert summary.check() == []


@pytest.mark.parametrize(
    ("kind", "edges", "nodes"),
    [("weak", 10, 9), ("strong", 10, 9), ("typedweak", 11, 10), ("typedstrong", 11, 10), ("2ponefw", 12, 10), ("2ponefb", 13, 13), ("2pbisim", 13, 14)],
)
def test_counts_by_hand(spark, kind, edges, nodes):
    summary = summarize(graph(spark, graphs.triples(graphs.SCHEMA)), kind)
    assert (summary.edges.count(), summary.node_support().count()) == (edges, nodes)


@pytest.mark.parametrize(("kind", "edges", "nodes"), [("weak", 13, 8), ("typedstrong", 18, 11), ("2ponefw", 17, 10), ("2ponefb", 21, 13), ("2pbisim", 22, 14)])
def test_saturated_counts_by_hand(spark, kind, edges, nodes):
    summary = summarize_saturated(graph(spark, graphs.triples(graphs.SCHEMA)), kind)
    assert (summary.edges.count(), summary.node_support().count()) == (edges, nodes)


def test_weak_and_strong_differ_on_a_back_edge(spark):
    # the same shape as a, p, b / c, p, d with d the source of another property and a the target of it
    g = graph(spark, graphs.triples(graphs.BACK))
    weak, strong = summarize(g, "weak"), summarize(g, "strong")
    assert weak.edges.count() < strong.edges.count()


@pytest.mark.parametrize("kind", ["weak", "strong"])
def test_shortcut_has_the_edges_of_the_saturated_summary(spark, kind):
    g = graph(spark, graphs.triples(graphs.SCHEMA))
    shape = lambda s: Counter((r.p, r.kind) for r in s.edges.collect())
    assert shape(summarize_shortcut(g, kind)) == shape(summarize_saturated(g, kind))


GENERAL = """
n1 type C:1
n1 type C:2
n2 type C:3
n3 type C:4
n4 type C:9
n1 p n2
n3 p n4
C:1 sub C:2
C:2 sub C:3
C:4 sub C:1
C:5 sub C:6
"""


@pytest.mark.parametrize("kind", ["typedweak", "typedstrong"])
def test_general_types_group_and_actual_types_are_counted(spark, kind):
    t = graphs.term
    summary = summarize(graph(spark, graphs.triples(GENERAL)), kind, generalise=True)
    rep = {r.node: r.rep for r in summary.rep.collect()}
    assert rep[t("n1")] == rep[t("n2")] == rep[t("n3")] != rep[t("n4")]
    counted = {(r.type, r.cnt) for r in summary.type_histogram().collect() if r.rep == rep[t("n1")]}
    assert counted == {(t(f"C:{i}"), 1) for i in range(1, 5)}
    plain = {r.node: r.rep for r in summarize(graph(spark, graphs.triples(GENERAL)), kind).rep.collect()}
    assert len({plain[t(f"n{i}")] for i in range(1, 5)}) == 4


def test_names_share_plans(spark):
    assert len(KINDS) == 15 and len({k.code for k in KINDS.values()}) == 15
    for a, b in (("weak", "2pweak"), ("weak", "2pweakunionfind"), ("strong", "2pstrong"), ("typedweak", "2ptypedweak"), ("typedstrong", "2ptypedstrong")):
        assert KINDS[a].keys is KINDS[b].keys and KINDS[a].family == KINDS[b].family


@pytest.mark.parametrize("kind", ["strong", "typedweak", "2pbisim"])
def test_codes_in_place_of_terms(spark, kind):
    triples = graphs.triples(graphs.SCHEMA + graphs.MIXED)
    coded, terms = dictionary.encoded_graph(graph(spark, triples))
    codes = {r.value: r.key for r in terms.collect()}
    rep = {r.node: r.rep for r in summarize(coded, kind).rep.collect()}
    groups = lambda rep: sorted(sorted(n for n in rep if rep[n] == r) for r in set(rep.values()))
    assert groups(rep) == groups({codes[n]: r for n, r in Model(triples).rep(kind).items()})
    assert all(r in rep or r < 0 for r in rep.values())


def test_wrong_requests_are_told(spark):
    g = graph(spark, graphs.triples(graphs.BACK))
    for bad in (lambda: summarize(g, "nothing"), lambda: summarize(g, "weak", generalise=True), lambda: summarize_shortcut(g, "typedweak")):
        with pytest.raises(ValueError):
            bad()


def test_empty_graph_and_rows_with_nulls(spark):
    summary = summarize(graph(spark, [(None, "p", "o"), ("s", None, "o")]), "strong")
    assert summary.edges.count() == 0 and summary.rep.count() == 0 and summary.check() == []


def test_bisimulation_in_parts_leaves_nothing_behind(spark, monkeypatch):
    """Parts of a round change nothing, and only the result stays written of what all rounds wrote."""
    from tessella.operators import quotient
    from tessella.plans import lineage

    rows = [(f"<n{i}>", f"<p{i % 2}>", f"<n{i + 1}>") for i in range(6)] + [(f"<m{i}>", f"<p{i % 2}>", f"<m{i + 1}>") for i in range(6)] + [("<x>", "<p0>", "<n3>")]
    chains = graph(spark, rows)
    classes = []
    for steps in (10**6, 9):
        monkeypatch.setattr(quotient, "STEPS", steps)
        before = len(lineage._spooled)
        keyed = quotient.bisimulation(chains, quotient.grouped_roles(chains, quotient.KINDS["2pbisim"]))
        assert len(lineage._spooled) == before + 1
        by = {}
        for r in keyed.collect():
            by.setdefault(r.key, set()).add(r.node)
        classes.append(sorted(map(sorted, by.values())))
    assert classes[0] == classes[1]
    ends = {f"<{c}{i}>" for c in "nm" for i in range(7)} | {"<x>"}
    assert classes[0] == [[x] for x in sorted(ends)]  # <x> tells the chains apart, wherever one is on them
