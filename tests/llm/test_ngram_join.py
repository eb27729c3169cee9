from __future__ import annotations

import numpy as np
import pytest

from tessella.llm import count_rtree as tree
from tessella.llm import ngram_join
from tessella.llm.count_rtree import Rule


def brute(corpus, rule):
    """id -> (number of shingles, component) by comparing all with all."""
    sets, parent = {}, {}
    for row, (i, t, *_) in enumerate(corpus):
        w = (t or "").encode().lower().split()
        k = min(rule.size, len(w))
        sets[row] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        parent[row] = row

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= rule.least * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    least = {}
    for row, (i, *_) in enumerate(corpus):
        if i is not None:
            least[find(row)] = min(i, least.get(find(row), i))
    return sorted(((i is None, i or 0, len(sets[row]), least.get(find(row))) for row, (i, *_) in enumerate(corpus)), key=str)


def ours(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("rule", [Rule(), Rule(5, 80), Rule(1, 60)])
def test_like_brute_force(docs, corpus, rule):
    assert ours(ngram_join.near_duplicates(docs, rule)) == brute(corpus, rule)


def test_large_groups_in_tiles(docs, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "MARKS", 1)
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    assert ours(ngram_join.near_duplicates(docs, Rule())) == brute(corpus, Rule())


def test_hot_and_uncounted_elements(docs, corpus, monkeypatch):
    """All elements salted, and none known to be frequent."""
    monkeypatch.setattr(ngram_join, "HOT", 0)
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    assert ours(ngram_join.near_duplicates(docs, Rule(5, 80))) == brute(corpus, Rule(5, 80))


def test_rows_without_an_id_are_bridges(spark):
    words = [f"w{i}" for i in range(200)]
    a, b = words[:], words[:]
    a[:8] = [f"a{i}" for i in range(8)]
    b[-8:] = [f"b{i}" for i in range(8)]
    rows = [(1, " ".join(a)), (None, " ".join(words)), (2, " ".join(b)), (None, "so many other words that link with nothing"), (None, "so many other words that link with nothing")]
    rows += [(9, " ".join(a)), (9, "the id again and another text of its own"), (5, "not like any of the other rows that are here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(df)
    assert ours(got) == brute(rows, Rule())
    assert {r.component_id for r in got.collect() if r.doc_id in (1, 2)} == {1}
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(df, Rule()).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[3], rows[4], rows[6], rows[7]], key=str)


def test_too_many_shared_names_are_an_error(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "hold", lambda df: df.withColumn("_two", ngram_join.F.lit(True)) if "_two" in df.columns else df)
    with pytest.raises(RuntimeError, match="64-bit names"):
        ngram_join.near_duplicates(docs)


def test_rare_elements_come_first():
    rng = np.random.default_rng(3)
    rule = Rule()
    h = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    low = h[h < rule.counted()]
    known = ngram_join.Frequent(rule, low[:10].astype(np.uint32), np.arange(10, 0, -1).astype(np.uint8))
    level = known.level(h)
    assert list(np.flatnonzero(level)) == list(range(10)) and level[0] == 10
    at = rule.first(len(h), level)
    assert len(at) == len(rule.prefix(h, h[:0])) and not level[at].any()
    every = rule.first(12, np.r_[level[:10], 0, 0].astype(np.uint8))
    assert list(every) == [10, 11][: len(every)]


def test_packed_elements_round_trip():
    rng = np.random.default_rng(4)
    for n, most in ((1, 2**32), (1000, 2**32), (5000, 2**20), (3000, 3000)):
        t = np.sort(rng.integers(0, most, n).astype(np.uint32))
        assert np.array_equal(ngram_join._unpacked(ngram_join._packed(t)), t)


def test_halves_of_hashes_never_contradict_the_whole():
    rng = np.random.default_rng(5)
    rule, told = Rule(), []
    for _ in range(400):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, int(len(a) * rng.uniform(0.85, 1)), replace=False), rng.integers(0, 2**63, rng.integers(0, 1 + len(a) // 9)).astype(np.uint64)]))
        half = rule.links_by_half(ngram_join.halves(a), ngram_join.halves(b))
        assert half is None or half == rule.links(a, b)
        told.append(half)
    assert {True, False, None} == set(told)
    same = np.arange(1, 200, dtype=np.uint64)  # the same lower halves, no element in common
    other = same + np.uint64(1 << 32)
    assert rule.links_by_half(ngram_join.halves(same), ngram_join.halves(other)) is not False


def test_clashing_columns_and_empty_table(clashing, empty, corpus):
    assert ours(ngram_join.near_duplicates(clashing)) == brute(corpus, Rule())
    assert ngram_join.near_duplicates(empty).count() == 0


def test_keep_one_keeps_the_smallest_of_each_component(docs, corpus):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    component = {(n, i): c for n, i, _, c in brute(corpus, Rule(5, 80))}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for (n, i), c in component.items() if not n and c == i}


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(1)
    rule = Rule()
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, int(len(a) * rng.uniform(0.7, 1)), replace=False), rng.integers(0, 2**63, rng.integers(0, 1 + len(a) // 5)).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        assert rule.links(a, b) == (100 * shared >= 85 * (len(a) + len(b) - shared))
        if rule.links(a, b):
            pa, pb = tree.counts(a), tree.counts(b)
            assert rule.may_link(len(a), pa, len(b), pb) and rule.may_link(len(a), tree.coarse(pa), len(b), tree.coarse(pb))
            none = np.zeros(0, np.uint64)
            assert len(np.intersect1d(rule.prefix(a, none), rule.prefix(b, none)))
            common = np.sort(rng.choice(a, len(a) // 3, replace=False))
            assert len(np.intersect1d(rule.prefix(a, common), rule.prefix(b, common)))


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    rule, sets = Rule(), []
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    for _ in range(700):
        keep = rng.uniform(0.6, 1)
        sets.append(np.unique(np.concatenate([base[rng.random(len(base)) < keep], rng.integers(0, 2**63, 30).astype(np.uint64)])))
    n, fine = np.array([len(s) for s in sets]), np.stack([tree.counts(s) for s in sets])
    index = tree.Tree(rule, len(sets))
    for i in np.argsort(n, kind="stable"):
        index.add(i, n[i], fine[i], tree.coarse(fine[i]))
    for i in range(0, 700, 35):
        found = set(index.at[index.search(n[i], fine[i], tree.coarse(fine[i]))])
        assert found == {j for j in range(700) if rule.may_link(n[j], fine[j], n[i], fine[i]) and rule.may_link(n[j], tree.coarse(fine[j]), n[i], tree.coarse(fine[i]))}


def test_a_large_group_is_not_dealt_by_the_square_of_its_size(spark, monkeypatch):
    """Rows that one group of near copies makes, with few members of other labels, grow with the group."""
    monkeypatch.setattr(ngram_join, "TILE", 8)
    join = object.__new__(ngram_join._Join)
    made = []
    for size in (40, 160):
        rows = [(7, i, 1 if i < size - 3 else i) for i in range(size)] + [(8, 1000 + i, 5) for i in range(9)] + [(9, 1, 1), (9, size - 1, size - 1)]
        dealt = join.paired(spark.createDataFrame(rows, "token long, node long, label long")).collect()
        made.append(len(dealt))
        together = {}
        for r in dealt:
            together.setdefault((r.token, r.i, r.j), []).append(r)
        met = {(t, *sorted((x.node, y.node))) for (t, _, _), m in together.items() for x in m for y in m if x.label != y.label and (len({z.side for z in m}) == 1 or x.side != y.side)}
        label = {(t, n): x for t, n, x in rows}
        assert met == {(t, a, b) for t, a in label for u, b in label if t == u and a < b and label[t, a] != label[t, b]}
        members = join.sized(spark.createDataFrame([(7, i) for i in range(size)], "token long, node long"))
        assert members.count() == size
    assert made[1] <= 4.5 * made[0]
