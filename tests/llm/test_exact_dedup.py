from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from conftest_llm import as_rows
from tessella.llm.exact_dedup import exact_dedup, keep_first


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(corpus):
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[normal(t)].append(i)
    out = []
    for i, t, *_ in corpus:
        ids = [x for x in groups[normal(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[normal(t)]), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


def ours(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[4]))


def test_like_brute_force(docs, corpus):
    assert ours(exact_dedup(docs)) == brute(corpus)


def test_colliding_hashes_are_told_apart(docs, corpus):
    assert ours(exact_dedup(docs, hashed=lambda t: F.lit("same"))) == brute(corpus)


def test_clashing_columns_and_empty_table(clashing, empty, corpus):
    assert ours(exact_dedup(clashing)) == brute(corpus)
    assert exact_dedup(empty).count() == 0


def test_keep_first_keeps_one_row_per_text_with_all_columns(docs, corpus):
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    rows = as_rows(kept)
    assert len(rows) == len({normal(t) for _, t, *_ in corpus})
    want = {r[4]: r[1] for r in brute(corpus)}
    assert {hashlib.sha256(normal(r[1]).encode()).hexdigest(): r[0] for r in rows} == want
