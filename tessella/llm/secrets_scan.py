"""Secret scans over whole texts.

Three base patterns find assigned credentials, access keys and hexadecimal strings. Beside them, the entropy scan
takes every candidate string (a long run of key-like characters), slides a window over it and keeps the window's
character counts incrementally: a step removes one character and adds one, and changes two terms of the sum. The
greatest entropy of any window is held against the threshold of the candidate's character class. An allow-list then
suppresses candidates that are known to be harmless. Base matches always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessella.plans.columns import pick

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Width of the sliding window, and the least entropy (bits a character) of its best position by class. The most a
#: window of 20 can have is log2(20) = 4.32, over hexadecimal digits 4. Candidates shorter than the window are held
#: against the same share of what their length can have.
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "alpha": 4.0, "alnum": 3.7, "base64": 3.9}

#: Harmless shapes: identifiers, words joined by - or _ or /, paths, and numbers. A word is letters in one case, with or
#: without a capital, or several such in a row that begin with capitals, of two letters or more.
_PLAIN = r"(?:[A-Z]+|[A-Z]?[a-z]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})+)"
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(rf"{_PLAIN}(?:[-_/=+]{_PLAIN})*"),
    re.compile(r"/?[a-z0-9]{1,12}(?:/[a-z0-9]{1,12})+/?"),
    re.compile(r"[0-9+=_-]+"),
)

_XLOGX = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]
_CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+")), ("alpha", re.compile(r"[A-Za-z]+")), ("alnum", re.compile(r"[A-Za-z0-9]+")))


def char_class(string: str) -> str:
    return next((name for name, form in _CLASSES if form.fullmatch(string)), "base64")


def best_window(string: str, window: int = WINDOW) -> float:
    """The greatest Shannon entropy (bits a character) of any ``window`` characters in a row."""
    width = min(window, len(string))
    if not width:
        return 0.0
    xlogx = _XLOGX if width <= WINDOW else [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of n * log2(n); entropy is log2(width) - total / width, so the least total is wanted
    for c in string[:width]:
        n = counts.get(c, 0)
        total += xlogx[n + 1] - xlogx[n]
        counts[c] = n + 1
    least = total
    for out, c in zip(string, string[width:]):
        if out == c:
            continue
        n = counts[out]
        total += xlogx[n - 1] - xlogx[n]
        counts[out] = n - 1
        n = counts.get(c, 0)
        total += xlogx[n + 1] - xlogx[n]
        counts[c] = n + 1
        if total < least:
            least = total
    return math.log2(width) - least / width


def threshold(string: str) -> float:
    """The entropy from which a candidate is reported."""
    return THRESHOLDS[char_class(string)] * min(1.0, math.log2(len(string)) / math.log2(WINDOW))


def allowed(string: str) -> bool:
    return any(form.fullmatch(string) for form in ALLOW)


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text by start, then kind; offsets in code points, ends exclusive."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        string = m.group()
        if not allowed(string) and best_window(string) >= threshold(string):
            found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones joined, replaced by [SECRET]."""
    text, out, at = text or "", [], 0
    for _, s, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = e
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans[, redacted].

    Null texts count as empty and have no span; null ids stay null; repeated rows give repeated results. Narrow: no
    shuffle, one batch of texts in memory at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["_text"]:
                spans = scan(text)
                base = [x for x in spans if x[0] != "entropy"]
                told = [",".join(f"{k}:{s}:{e}" for k, s, e in x) for x in (base, spans)]
                row = [sum(x[0] == k for x in spans) for k in KINDS] + [hashlib.sha256(told[0].encode()).hexdigest(), told[1]]
                out.append(row + [redact(text, spans)] * with_text)
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"] + ["redacted"] * with_text
            frame = pd.DataFrame(out, columns=names)
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield frame

    rows = pick(docs, id_col, text_col, **{id_col: "long", text_col: "string"}).toDF("doc_id", "_text")
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + ", redacted string" * with_text
    return rows.mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm._batches import small_batches

    small_batches(spark)
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
