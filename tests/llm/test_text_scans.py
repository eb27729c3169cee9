"""Personal data and secrets, against plain scans with the standard library."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import pii, secrets_scan


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_pii(text):
    forms = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in forms for m in re.finditer(p, text or "") if ok(m.group(), re.sub("[^0-9]", "", m.group()))]


def base_secrets(text):
    forms = [
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
    ]
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(forms) for m in re.finditer(p, text or "") if ok(m)]
    return [x[2] for x in sorted(found)]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abX019. -@+()%_é🎉\n") for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    texts += ["".join(rng.choice("tokenAKIA=:\"' f0d9") for _ in range(rng.randrange(1, 90))) for _ in range(400)]
    texts += ["1" * 40_000, "a." * 30_000, "x@" + "a." * 30_000 + "b", "+1" + " " * 30_000, "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "0001.002.3.0255", "", None]
    texts += ["token = token = abcdefghijklmnop", "AKIA" + "A" * 30_000, "f" * 30_000, "ſecret=abcdefghijklmnop"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_pii_base_spans(odd, docs):
    for df in (odd, docs):
        texts = {(r.doc_id): r.text for r in df.collect()}
        for r in pii.find_and_sanitise(df).collect():
            want = base_pii(texts[r.doc_id])
            got = [x for x in r.spans.split(",") if x and not x.startswith("term")]
            assert got == want, texts[r.doc_id][:100]
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in pii.KINDS]


def test_pii_terms_follow_corpus_statistics(spark):
    filler = [(100 + i, f"plain words about the weather number {i}") for i in range(40)]
    told = [(i, f"Professor Wunderlich writes bob{i % 2}@example.com about weather") for i in range(6)]
    df = spark.createDataFrame(told + filler, "doc_id long, text string")
    found = pii.find_and_sanitise(df)
    rows = {r.doc_id: r for r in found.collect()}
    n, df_t, df_e, df_et = 46, 6, 3, 3
    risk = math.log(df_et * n / (df_t * df_e)) / math.log(n / df_e)
    assert pii.GENERALISE <= risk < pii.REMOVE
    text = told[0][1]
    spans = rows[0].spans.split(",")
    assert spans[0].startswith("email:")
    assert {text[int(a) : int(b)] for a, b in (x.split(":")[1:] for x in spans[1:])} == {"Professor", "Wunderlich", "writes"}  # weather is everywhere
    assert rows[0].removed == "" and rows[100].spans == ""
    clean = df.join(found, "doc_id").filter("doc_id = 0").select(pii.sanitised(F.col("text"), F.col("spans"), F.col("removed")).alias("t")).first().t
    assert clean == "[TERM] [TERM] [TERM] [EMAIL] about weather"


def test_pii_entities_of_one_document(spark):
    filler = [(100 + i, f"plain words about the weather number {i}") for i in range(40)]
    text = "Wunderlich writes from once@example.com about weather"
    rows = {r.doc_id: r for r in pii.find_and_sanitise(spark.createDataFrame([(1, text), *filler], "doc_id long, text string")).collect()}
    gone = {text[int(a) : int(b)] for a, b in (x.split(":")[1:] for x in rows[1].removed.split(","))}
    assert gone == {"Wunderlich", "writes", "from"} and rows[1].n_term == 3


def test_pii_terms_of_the_whole_document(spark):
    common = "plain words about the weather "
    text = "Wunderlich 🎉 " + common * 150 + "from once@example.com " + common * 150 + "wunderlich"
    rows = [(1, text), *((100 + i, common) for i in range(40))]
    row = next(r for r in pii.find_and_sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id == 1)
    assert [text[int(a) : int(b)] for a, b in (x.split(":")[1:] for x in row.removed.split(","))] == ["Wunderlich", "from", "wunderlich"]


def brute_terms(texts):
    """Per text (places of terms that disclose, of those the ones that go), by counting all pairs."""
    n = len(texts)
    held = [{t[int(a) : int(b)] for a, b in (x.split(":")[1:] for x in base_pii(t))} for t in texts]
    words = [[(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"(?<!\S)[A-Za-z]{4,}(?!\S)", t)] for t in texts]
    terms = [{w for w, *_ in x} for x in words]
    df_e, df_t = Counter(e for x in held for e in x), Counter(w for x in terms for w in x)
    df_et = Counter((e, w) for x, y in zip(held, terms) for e in x for w in y)

    def risk(e, w):
        return math.log(df_et[e, w] * n / (df_t[w] * df_e[e])) / math.log(n / df_e[e]) if df_e[e] < n else 0

    out = []
    for x, y in zip(held, words):
        risks = [(f"term:{s}:{e}", max(risk(v, w) for v in x)) for w, s, e in y] if x else []
        out.append(([p for p, r in risks if r >= pii.GENERALISE], [p for p, r in risks if r >= pii.REMOVE]))
    return out


def test_pii_terms_like_brute_force(spark):
    rng = random.Random(9)
    names = [f"Name{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    mails = [f"box{i}@example.com" for i in range(12)] + ["10.0.0.7", "+49 170 1234567"]
    texts = []
    for i in range(150):
        words = [rng.choice(["weather", "plain", "words", "about", "the", "report"]) for _ in range(rng.randrange(3, 30))] + rng.sample(names, rng.randrange(4))
        who = rng.randrange(len(mails))
        if rng.random() < 0.4:
            words += [mails[who], names[who], names[who].upper()]
        if rng.random() < 0.1:
            words += [f"only{i}@example.org", mails[rng.randrange(len(mails))]]
        rng.shuffle(words)
        texts.append(" ".join(words))
    texts.append(texts[0])
    want = brute_terms(texts)
    assert sum(bool(a) for a, _ in want) > 30 and any(b for _, b in want) and any(len(a) > len(b) for a, b in want)
    for r in pii.find_and_sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        terms = [x for x in r.spans.split(",") if x.startswith("term")]
        assert (terms, [x for x in r.removed.split(",") if x]) == want[r.doc_id] and r.n_term == len(terms)


def test_pii_long_texts_take_time_in_proportion(spark):
    text = "call 10.0.0.1 or 4111 1111 1111 1111x " * 5000 + "7 12 345 " * 30_000
    row = pii.find_and_sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_ip, row.n_card) == (5000, 5000)
    assert [x for x in row.spans.split(",") if not x.startswith("term")] == base_pii(text)


def test_pii_clashing_columns_repeats_and_empty(clashing, docs, empty):
    order = lambda df: sorted(map(str, df.collect()))
    assert order(pii.find_and_sanitise(clashing)) == order(pii.find_and_sanitise(docs))
    assert pii.find_and_sanitise(docs).count() == docs.count()
    assert pii.find_and_sanitise(empty).count() == 0


def test_secret_base_spans(odd, docs):
    for df in (odd, docs):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in secrets_scan.scan_secrets(df).collect():
            want = base_secrets(texts[r.doc_id])
            assert [x for x in r.spans.split(",") if x and not x.startswith("entropy")] == want
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in want) for k in secrets_scan.KINDS[:3]]


def entropy(s):
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def test_incremental_entropy_is_the_best_window():
    rng = random.Random(1)
    for _ in range(200):
        s = "".join(rng.choice("abcdef0123") for _ in range(rng.randrange(1, 80)))
        w = rng.randrange(1, 40)
        assert secrets_scan.best_window(s, w) == pytest.approx(max(entropy(s[i : i + w]) for i in range(max(1, len(s) - w + 1))), abs=1e-9)


def test_entropy_spans_and_allow_list():
    assert ("entropy", 4, 32) in secrets_scan.scan("key aB3dE5fG7hI9jK1lM3nO5pQ7rS9t")
    for harmless in ("123e4567-e89b-12d3-a456-426614174000", "averylongwordwithoutanymeaninginit", "src/main/java/org/example/thing/else", "=" * 40, "a" * 40):
        assert not [x for x in secrets_scan.scan(harmless) if x[0] == "entropy"]


def brute_entropy(text):
    """Spans of candidates by all their windows, with classes and shapes written out anew."""
    word = r"([A-Z]+|[A-Z]?[a-z]+|[A-Z]?[a-z]{2,}([A-Z][a-z]{2,})+)"
    harmless = [r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", rf"{word}([-_/=+]{word})*", r"/?[a-z0-9]{1,12}(/[a-z0-9]{1,12})+/?", r"[0-9+=_-]+"]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        s = m.group()
        if any(re.fullmatch(f, s) for f in harmless):
            continue
        least = 3.0 if set(s) <= set("0123456789abcdefABCDEF") else 4.0 if s.isalpha() else 3.7 if s.isalnum() else 3.9
        least *= min(1, math.log2(len(s)) / math.log2(20))
        if max(entropy(s[i : i + 20]) for i in range(max(1, len(s) - 19))) >= least - 1e-12:
            out.append(("entropy", m.start(), m.end()))
    return out


def test_entropy_spans_like_brute_force(corpus):
    rng = random.Random(12)
    alphabets = ["abcdef0123456789", "ABCDEFGHIJKLMabcdefghijklmnop", "abcdefghijklmnopqrstuvwxyzABC0123456789", "abc/+=_-XYZ019", "0123456789-", "ab"]
    texts = [" ".join("".join(rng.choice(a) for _ in range(rng.randrange(10, 50))) for a in alphabets) for _ in range(150)]
    texts += [f"{w}{x}" for w in ("getUserAccountInformationFromDatabase", "SOME-upper-And-lower", "MixedCaseWordsInARowHere") for x in ("", "X", "9", "/x")]
    texts += [t or "" for _, t, *_ in corpus]
    found = [brute_entropy(t) for t in texts]
    assert sum(map(len, found)) > 100
    assert [[x for x in secrets_scan.scan(t) if x[0] == "entropy"] for t in texts] == found


def test_letters_of_both_cases_are_no_word():
    assert ("entropy", 0, 40) in secrets_scan.scan("qWeRtZuIoPaSdFgHjKlYxCvBnMqAzWsXeDcRfVtG")
    assert not [x for x in secrets_scan.scan("getUserAccountInformationFromDatabase") if x[0] == "entropy"]


def test_redaction_joins_overlaps():
    text = "x token=abcdefabcdefabcdef01 y"
    assert secrets_scan.redact(text, secrets_scan.scan(text)) == "x [SECRET] y"


def test_secrets_clashing_columns_and_empty(clashing, docs, empty):
    order = lambda df: sorted(map(str, df.collect()))
    assert order(secrets_scan.scan_secrets(clashing, with_text=True)) == order(secrets_scan.scan_secrets(docs, with_text=True))
    assert secrets_scan.scan_secrets(empty).count() == 0
