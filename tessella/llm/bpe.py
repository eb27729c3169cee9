"""Byte-level BPE, encoding and decoding, from a vocabulary file of the tokenizers library.

A short word is held as one contiguous list of parts and one of adjacent ranks. The least rank is found by scanning
the whole list; its boundary is deleted, and the ranks of the two neighbouring pairs are refreshed. At the length of
words this beats any heap. Words beyond ``LONG`` bytes (junk, or scripts without spaces) would make the scan
quadratic; those alone go through a linked list with a heap, which merges the same pairs in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from tessella.llm._batches import lean, remember, small_batches
from tessella.plans.columns import pick

LONG = 200
#: Words whose ids a Python worker remembers, about 250 bytes each; beyond that it forgets all and starts again.
REMEMBERED = 100_000

#: The split of the byte-level pre-tokenizer; fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec(dict):
    """A codec made from the text of a vocabulary file. As a dict it remembers the ids of words."""

    def __init__(self, file_text: str):
        told = json.loads(file_text)
        model, letters = told["model"], byte_letters()
        if model["type"] != "BPE" or (told.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or told.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        split = told["pre_tokenizer"]
        odd = [k for k in ("dropout", "ignore_merges", "byte_fallback", "fuse_unk", "continuing_subword_prefix", "end_of_word_suffix", "unk_token") if model.get(k)]
        odd += ["add_prefix_space"] * bool(split.get("add_prefix_space")) + ["use_regex"] * (split.get("use_regex") is False)
        odd += [k for t in told.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word") if t.get(k)]
        if odd:
            raise ValueError(f"vocabularies with {', '.join(sorted(set(odd)))} are encoded otherwise, and not supported")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        self.rank = {(vocab[a] << 32) | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = word.encode()
        ids = self.short(raw) if len(raw) <= LONG else self.long(raw)
        if len(raw) <= LONG:
            self[word] = ids
        return ids

    def short(self, raw: bytes) -> list[int]:
        """Contiguous parts and adjacent ranks, scanned for the minimum again and again."""
        rank, made, first = self.rank, self.made, self.first
        parts = [first[b] for b in raw]
        ranks = [rank.get((a << 32) | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i = ranks.index(least)
            part = parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1] << 32) | part, _NEVER)
            if i < len(ranks):
                ranks[i] = rank.get((part << 32) | parts[i + 1], _NEVER)
        return parts

    def long(self, raw: bytes) -> list[int]:
        """The same merges in the same order (least rank, then leftmost) in n log n."""
        rank, made = self.rank, self.made
        parts: list[int] = [self.first[b] for b in raw]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i] << 32) | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get((parts[i] << 32) | parts[k])) is not None:
                    heapq.heappush(heap, (q, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (q := rank.get((parts[h] << 32) | parts[i])) is not None:
                heapq.heappush(heap, (q, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; null counts as empty. Special tokens in the text get their ids."""
        text, out, at = text or "", [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += chain.from_iterable(map(self.__getitem__, self.words.findall(text[at : m.start()])))
            out.append(self.special[m.group()])
            at = m.end()
        out += chain.from_iterable(map(self.__getitem__, self.words.findall(text[at:] if at else text)))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}
remember(__name__, _codecs)


def codec(file_text: str) -> Codec:
    """One codec per process and vocabulary, so that words stay remembered from task to task."""
    key = hashlib.sha256(file_text.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(file_text)
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str) -> str:
    """The vocabulary file's text, read on the driver and sent along with the tasks (1.6 MB for 50,000 tokens)."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return spark.read.text(path, wholetext=True).first()[0]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded].

    Null texts count as empty (no tokens); null ids stay null; repeated rows give repeated results. Narrow: no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(spark, path))

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(shared.value)
        names = {i: str(i) for i in bpe.bytes}
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for text in batch["_text"]:
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(decoded)
            frame = pd.DataFrame({k: v for k, v in out.items() if with_ids or k not in ("ids", "decoded")})
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield frame

    rows = pick(docs, id_col, text_col, **{id_col: "long", text_col: "string"}).toDF("doc_id", "_text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return rows.mapInPandas(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
