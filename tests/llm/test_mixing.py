from __future__ import annotations

import re
from collections import defaultdict

import pytest

from tessella.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0):
    """By bisection of the level instead of rounds of clamping."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, low, high = share * sum(sizes.values()), 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(cap * sizes[s], level * w[s]) for s in order) < total else (low, level)
    return {s: min(cap * sizes[s], high * w[s]) for s in order}


def check(rows, corpus):
    by_source, sizes = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in corpus:
        sizes[s] += size(t)
    want = targets(sizes)
    source = {i: s for i, _, _, s, _ in corpus}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        by_source[s] += r.taken
    assert sorted(r.size for r in rows) == sorted(size(t) for _, t, *_ in corpus)
    for s, t in want.items():
        assert abs(by_source[s] - t) <= 2


def test_targets_and_taken_words(docs, corpus):
    rows = mixing.mix(docs).collect()
    check(rows, corpus)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_clashing_columns_and_empty_table(clashing, docs, empty):
    assert sorted(map(str, mixing.mix(clashing).collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0


def test_many_sources_clamp_in_rounds(spark):
    rows = [(i, "w " * (1 + i * i), "en", f"s{i:03}", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(mixing.mix(docs).collect(), rows)


def test_rows_of_the_mix_have_the_words_taken(docs, corpus):
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns
    taken, words = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    for r in mixed.collect():
        words[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text) or (r.doc_id is None and r.n_chars == 5)  # what a row says of its text is still so
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in taken.items() if n}
    assert mixing.mix_rows(docs.limit(0)).count() == 0
