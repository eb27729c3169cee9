from __future__ import annotations

import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from tessella.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def codec():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Codec(f.read())


def texts():
    rng = random.Random(1)
    out = ["", " ", "a", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoft", "x" * 3000, "ab" * 2000 + " \n\n c", "日本語" * 200, "don't I'LL we've   x\t\t\n y"]
    pick = lambda: chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x3000, 0x3100), 32, 10, 97, 0x1F600 + rng.randrange(50)]))
    return out + ["".join(pick() for _ in range(rng.randrange(1, 150))) for _ in range(200)]


def test_ids_and_text_like_the_library(codec, library):
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bytes_that_are_no_text_decode_like_the_library(codec, library):
    rng = random.Random(2)
    for _ in range(50):
        ids = [rng.randrange(50_000) for _ in range(20)]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_both_ways_to_merge_agree(codec):
    rng = random.Random(3)
    for _ in range(300):
        raw = bytes(rng.choice(b"abethinosr aaa") for _ in range(rng.randrange(1, 60)))
        assert codec.short(raw) == codec.long(raw)


def test_forgetting_words_changes_nothing(codec, monkeypatch):
    want = [codec.encode(t) for t in texts()]
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert [codec.encode(t) for t in texts()] == want


def test_table(docs, clashing, empty, corpus, library):
    def want(i, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())

    order = lambda rows: sorted(map(tuple, rows), key=str)
    rows = order(want(i, t) for i, t, *_ in corpus)
    assert order(bpe.tokenize(docs, bpe.default_path()).collect()) == rows
    assert order(bpe.tokenize(clashing, bpe.default_path()).collect()) == rows
    assert bpe.tokenize(empty, bpe.default_path()).count() == 0
    full = bpe.tokenize(docs, bpe.default_path(), with_ids=True).filter("doc_id = 0").first()
    assert full.decoded == corpus[0][1] and full.n_tokens == len(full.ids)


def test_vocabularies_that_are_encoded_otherwise_are_refused(empty):
    import json

    with open(bpe.default_path(), encoding="utf-8") as f:
        told = json.load(f)
    for part, key, value in (("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "use_regex", False), ("model", "dropout", 0.1), ("model", "ignore_merges", True), ("model", "byte_fallback", True)):
        with pytest.raises(ValueError, match=key):
            bpe.Codec(json.dumps({**told, part: {**told[part], key: value}}))
    assert bpe.tokenize(empty, bpe.default_path(), with_ids=True).columns[-2:] == ["ids", "decoded"]
    assert bpe.tokenize(empty, bpe.default_path(), with_ids=True).count() == 0
