from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import warc


@pytest.mark.parametrize(
    ("url", "name"),
    [
        ("HTTP://www.Example.com:80/A/b/?utm_source=x&b=2&a=1#top", "example.com/A/b?a=1&b=2"),
        ("https://user@example.com/", "example.com"),
        ("example.com?ref=1", "example.com"),
        ("https://www2.example.com/x.html", "example.com/x.html"),
        (" https://m.example.com/x?q=%20 ", "m.example.com/x?q=%20"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, name):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.canonical(F.col("u")).alias("c")).first().c == name


def records(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        url = rng.choice(["http://a.org/x", "https://www.a.org/x/", "http://b.org/", "http://c.org/?utm_x=1", None])
        url = url if rng.random() < 0.5 else "http://hot.org"
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        tag, day = f'"{rng.randrange(3)}"', f"day {rng.randrange(2)}"
        headers = {k: v for k, v in (("ETag", rng.choice([tag, "W/" + tag])), ("Last-Modified", day), ("Content-Length", str(i)), ("X-Id", str(i))) if rng.random() < 0.7}
        out.append((f"r{i:04}", kind, url, rng.choice([None, rng.randrange(60), rng.randrange(60), rng.randrange(60)]), rng.choice([200, 200, 404, None]), headers, rng.choice(["d1", "d2", None]), b"p%d" % i))
    return out


def brute(rows, key):
    out = []
    for rid, kind, url, ts, *_rest in rows:
        if kind != "revisit":
            continue
        headers, digest = {k.lower(): v for k, v in _rest[1].items()}, _rest[2]
        full = [r for r in rows if r[1] == "response" and r[2] is not None and r[3] is not None and (r[4] is None or 200 <= r[4] < 300) and url is not None and ts is not None and key[r[2]] == key[url] and r[3] < ts]
        if not full:
            out.append((rid, "no response", None, None))
            continue
        of = max(full, key=lambda r: (r[3], r[0]))
        stored = {k.lower(): v for k, v in of[5].items()}
        bare = lambda h: h.get("etag", "").removeprefix("W/")
        if "etag" in stored and "etag" in headers:
            good = bare(stored) == bare(headers)
        elif "last-modified" in stored and "last-modified" in headers:
            good = stored["last-modified"] == headers["last-modified"]
        else:
            good = of[6] is not None and of[6] == digest
        if good:
            merged = stored | {k: v for k, v in headers.items() if k not in warc.KEPT_HEADERS}
            out.append((rid, "resolved", of[0], merged))
        else:
            out.append((rid, "validator mismatch", None, None))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("ranges", [None, 1, 23])
def test_like_brute_force(spark, ranges):
    rows = records(1)
    key = {r[2]: None for r in rows}
    for url, name in spark.createDataFrame([(u,) for u in key], "u string").select("u", warc.canonical(F.col("u"))).collect():
        key[url] = name
    got = [(r.record_id, r.outcome, r.response_id, r.headers) for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD), ranges).collect()]
    assert sorted(got, key=lambda r: r[0]) == brute(rows, key)


def test_payloads_follow(spark):
    df = spark.createDataFrame(records(2), warc.RECORD)
    resolved = warc.resolve_revisits(df)
    full = {r.record_id: r for r in warc.materialise(df, resolved).collect()}
    payload = {r.record_id: r.payload for r in df.collect()}
    want = {r.record_id: payload[r.response_id] for r in resolved.filter("outcome = 'resolved'").collect()}
    assert {k: r.payload for k, r in full.items()} == want


def test_files_round_trip(spark, tmp_path):
    rows = [dict(zip(("record_id", "kind", "url", "ts", "status", "headers", "digest", "payload"), r)) for r in records(3, 50)]
    for r in rows:
        r["kind"] = "response" if r["kind"] == "request" else r["kind"]
        r["headers"] = {k.lower(): v for k, v in r["headers"].items()}
        r["status"] = r["status"] or 200
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.render, rows[:25])))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.render(r)) for r in rows[25:]))
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert len(got) == 50
    for r in rows:
        x = got[r["record_id"]]
        assert (x.kind, x.url, x.ts, x.status, dict(x.headers), x.digest, bytes(x.payload)) == tuple(r[k] for k in ("kind", "url", "ts", "status", "headers", "digest", "payload"))


def test_cut_files_end_and_empty_tables_stay_empty(spark):
    whole = warc.render({"record_id": "a", "kind": "response", "url": "u", "ts": 0, "status": 200, "headers": {"x": "1"}, "payload": b"abc"})
    assert len(list(warc.parse(whole + whole[:-6]))) == 1
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"junk")) == []
    assert warc.resolve_revisits(spark.createDataFrame([], warc.RECORD)).count() == 0


def test_crawl_of_pages_with_nulls_and_clashing_names(spark):
    rows = [(1, "http://a.org/", "<p>"), (2, None, None), (None, "http://a.org", "x"), (1, "http://a.org/", "<p>"), (3, "https://www.a.org", "<q>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("z")).withColumn("ts", F.lit(1))
    got = {(r.record_id, r.outcome) for r in warc.resolve_revisits(warc.captures(df)).collect()}
    assert got == {("v1", "validator mismatch"), ("v2", "no response"), ("v3", "resolved"), (None, "no response")}


def test_one_url_at_few_times_over_many_ranges(spark):
    """Rows of one URL and one time come in several ranges; a response of the revisit's own time is no earlier one."""
    rng = random.Random(5)
    rows = [(f"r{i:04}", rng.choice(["response", "revisit"]), rng.choice(["http://hot.org", "http://hot.org", "http://hot.org", None]), rng.choice([1, 2, 2, 2, 2, 3]), 200, {"ETag": '"e"', "X-Id": str(i)}, "d", b"") for i in range(300)]
    key = {"http://hot.org": "hot.org", None: None}
    for ranges in (1, 40):
        got = [(r.record_id, r.outcome, r.response_id, r.headers) for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD), ranges).collect()]
        assert sorted(got, key=lambda r: r[0]) == brute(rows, key)


def test_connection_headers_stay_as_stored(spark):
    rows = [("a", "response", "u", 1, 200, {"ETag": "x", "Connection": "close", "Age": "1"}, None, b""), ("b", "revisit", "u", 2, 304, {"ETag": "x", "Connection": "keep-alive", "Upgrade": "h2c", "TE": "gzip", "Age": "2"}, None, None)]
    assert warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).first().headers == {"etag": "x", "connection": "close", "age": "2"}


def test_malformed_files_end_and_do_not_fail():
    whole = warc.render({"record_id": "a", "kind": "response", "url": "u", "ts": 0, "status": 200, "headers": {"x": "1"}, "payload": b"abc"})
    assert len(list(warc.parse(gzip.compress(whole) + gzip.compress(whole)[:-9]))) in (1, 2)
    assert len(list(warc.parse(whole + whole.replace(b"Content-Length: ", b"Content-Length: x")))) == 1
    assert len(list(warc.parse(whole + whole.replace(b"Content-Length: ", b"Content-Length: 9999999999999999999999")))) == 1
    late = whole.replace(b"WARC-Date: 1970", b"WARC-Date: no time at all 1970")
    assert [r["ts"] for r in warc.parse(late + whole)] == [None, 0]
    rng = random.Random(7)
    for raw in (whole * 3, gzip.compress(whole) * 3):
        for _ in range(400):
            broken = bytearray(raw)
            for _ in range(rng.randrange(1, 6)):
                broken[rng.randrange(len(broken))] = rng.randrange(256)
            for r in warc.parse(bytes(broken[: rng.randrange(len(broken) + 1)])):
                assert set(r) == {"record_id", "kind", "url", "ts", "status", "headers", "digest", "payload"}


def test_files_beyond_the_limit_are_named(spark, tmp_path, monkeypatch):
    (tmp_path / "large.warc").write_bytes(b"x" * 100)
    monkeypatch.setattr(warc, "MOST_BYTES", 50)
    with pytest.raises(Exception, match="large.warc has more than 50 bytes"):
        warc.read_warc(spark, str(tmp_path)).collect()
