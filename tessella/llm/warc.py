"""Web archives: WARC records, and the resolution of not-modified revisits.

A revisit record says that a page was asked for again and had not changed; it has headers, and no body. It is resolved
to the latest earlier full response of the same canonical URL, if the validators of both agree, and gets that
response's headers updated by its own where a not-modified answer may update them.

The as-of join needs no sort of one URL in one task: records are dealt by ranges of (URL, time, a hash of the id), each
range finds the latest response within itself, and what a URL that goes on from one range into the next has seen
before is carried over; at most one URL per range boundary does. Carried are references to responses; their headers
are looked up for those alone. Records without URL or time resolve nothing, and aren't dealt.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.columns import pick
from tessella.plans.lineage import scratch, spool

#: Headers of a stored response that a not-modified answer leaves as they are: what describes the stored body, and what
#: concerns one connection only. All others it may update.
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "upgrade")
#: Query parameters that name no other page.
_TRACKING = "^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)="

#: Bytes of an archive file at most; bytes of URLs, two for each range, that are broadcast at most.
MOST_BYTES, BROADCAST_BYTES = 1 << 30, 10_000_000

RECORD = "record_id string, kind string, url string, ts long, status int, headers map<string,string>, digest string, payload binary"


def canonical(url: Column) -> Column:
    """One name for the ways to write a URL: no scheme, user, fragment, leading www, default port, trailing slash or
    tracking parameter; host in lower case, parameters in order. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"^www[0-9]*\.", ""), ":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that agree then, the last in the order of names counts."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, updated by those that a not-modified answer may update."""
    fresh = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_HEADERS) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def _seen(what: Column | str) -> Column:
    """A response by time, id, digest and a hash of its headers, with ``what``; the greatest of several is the latest."""
    return F.when(F.col("kind") == "response", F.struct("ts", "record_id", "digest", F.xxhash64(F.map_entries("headers")).alias("tie"), what))


def _carried(dealt: DataFrame) -> DataFrame:
    """_part, url_key, _first, _last, _before for URLs that go on from earlier ranges: the first time in this range, and
    of the earlier ones the latest response, and the latest one before that time. Rows of one URL and one time may be
    in several ranges, so the latest response of an earlier range needn't be strictly before."""
    # only the first and the last URL of a range can go on from one range into another
    edges = spool(dealt.groupBy("_part").agg(F.min("url_key").alias("_from"), F.max("url_key").alias("_to")))
    size = edges.agg(F.sum(F.octet_length("_from") + F.octet_length("_to"))).first()[0] or 0
    edges = F.broadcast(edges) if size <= BROADCAST_BYTES else edges
    ends = dealt.select("_part", "url_key", "ts", _seen("_row").alias("_seen")).join(edges, "_part")
    ends = ends.filter((F.col("url_key") == F.col("_from")) | (F.col("url_key") == F.col("_to"))).drop("_from", "_to")
    parts = ends.groupBy("_part", "url_key").agg(F.min("ts").alias("_first"), F.max("ts").alias("_end"), F.max("_seen").alias("_last"))
    several = spool(parts.withColumn("_n", F.count("*").over(Window.partitionBy("url_key"))).filter("_n > 1").drop("_n"))
    # what each of these ranges has seen before its last time
    rows = ends.join(several.select("_part", "url_key", "_end"), ["_part", "url_key"]).filter(F.col("ts") < F.col("_end"))
    short = rows.groupBy("_part", "url_key").agg(F.max("_seen").alias("_short"))
    parts = several.join(short, ["_part", "url_key"], "left")
    before = Window.partitionBy("url_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_all": F.max("_last").over(before), "_short": F.max("_short").over(before)})
    # ends of ranges before a range's first time are strictly before it: an as-of of its own, over ends and firsts
    marks = parts.select("url_key", F.col("_end").alias("_at"), F.col("_last").alias("_seen"), F.lit(None).cast("int").alias("_part"))
    marks = marks.unionByName(parts.select("url_key", F.col("_first").alias("_at"), F.lit(None).cast(parts.schema["_last"].dataType).alias("_seen"), "_part"))
    at = Window.partitionBy("url_key").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("_ended", F.max("_seen").over(at)).filter("_part is not null").select("_part", "url_key", "_ended")
    parts = parts.join(marks, ["_part", "url_key"]).select("_part", "url_key", "_first", F.col("_all").alias("_last"), F.greatest("_ended", "_short").alias("_before"))
    responses = dealt.select("_row", _seen(F.map_entries("headers").alias("headers")).alias("_found"))
    for name in ("_last", "_before"):
        parts = parts.withColumn("_row", F.col(f"{name}._row")).drop(name).join(responses, "_row", "left").withColumnRenamed("_found", name).drop("_row")
    return parts.filter("_last is not null or _before is not null")


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per revisit: record_id, url_key, ts, outcome, response_id, digest, headers.

    ``records`` has the columns of ``RECORD``; other kinds than response and revisit are passed over. A full response
    has a status from 200 to 299 or none. The latest one strictly before the revisit is taken, of several at one time
    that with the greatest record_id. outcome is "resolved", "validator mismatch" (entity tags differ; or, where one
    is missing, the dates of last modification; or, where those are missing too, the digests), or "no response". Only
    resolved ones have response_id, digest and merged headers. Revisits without URL or time find no response. Rows
    that repeat are resolved each; an empty table gives an empty result.
    """
    slim = pick(records, "record_id", "kind", "url", "ts", "status", "headers", "digest", record_id="string", kind="string", url="string", ts="long", status="int", headers="map<string,string>", digest="string")
    slim = slim.filter(F.col("kind").isin("response", "revisit")).select("record_id", "kind", canonical(F.col("url")).alias("url_key"), "ts", "status", lower_names(F.coalesce("headers", F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"))).alias("headers"), "digest")
    known = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = (F.col("kind") == "response") & F.coalesce(F.col("status").between(200, 299), F.lit(True))
    timeless = slim.filter(~known & (F.col("kind") == "revisit"))
    with scratch() as keep:
        order = [F.col("url_key"), F.col("ts"), F.xxhash64("record_id")]
        timed = slim.filter(known & (full | (F.col("kind") == "revisit")))
        dealt = timed.repartitionByRange(ranges, *order) if ranges else timed.repartitionByRange(*order)
        dealt = keep(spool(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})))
        carried = keep(spool(_carried(dealt)))
    entries = F.map_entries("headers").alias("headers")
    seen = _seen(entries)
    earlier = Window.partitionBy("_part", "url_key").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_own", F.max(seen).over(earlier)).filter(F.col("kind") == "revisit")
    # carried has a row or none for each range, and goes where the window has the rows: nothing is broadcast
    rows = rows.join(carried.hint("merge"), ["_part", "url_key"], "left")
    rows = rows.withColumn("_of", F.greatest("_own", F.when(F.col("ts") > F.col("_first"), F.col("_last")).otherwise(F.col("_before")))).drop("_first", "_last", "_before", "_part", "_row")
    rows = rows.unionByName(timeless.withColumns({"_own": F.lit(None).cast(rows.schema["_own"].dataType), "_of": F.lit(None).cast(rows.schema["_of"].dataType)}))

    stored = F.map_from_entries("_of.headers")
    rows = rows.withColumns({"_stored": stored, "_tag": _tag(stored), "_tag2": _tag(F.col("headers")), "_mod": F.element_at(stored, "last-modified"), "_mod2": F.element_at("headers", "last-modified")})
    agrees = F.when(F.col("_tag").isNotNull() & F.col("_tag2").isNotNull(), F.col("_tag") == F.col("_tag2")).when(F.col("_mod").isNotNull() & F.col("_mod2").isNotNull(), F.col("_mod") == F.col("_mod2")).otherwise(F.col("_of.digest") == F.col("digest"))
    outcome = F.when(F.col("_of").isNull() | F.col("url_key").isNull() | F.col("ts").isNull(), "no response").when(agrees, "resolved").otherwise("validator mismatch")
    good = lambda c: F.when(F.col("outcome") == "resolved", c)
    rows = rows.withColumn("outcome", outcome)
    return rows.select("record_id", "url_key", "ts", "outcome", good(F.col("_of.record_id")).alias("response_id"), good(F.col("_of.digest")).alias("digest"), good(merge_headers(F.col("_stored"), F.col("headers"))).alias("headers"))


def materialise(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Full records for resolved revisits: the response's payload and status under the revisit's id, url and time.

    Payloads move once, to the ids that need them."""
    wanted = resolved.filter("outcome = 'resolved'").select(F.col("record_id").alias("_id"), "response_id", F.col("ts").alias("_ts"), F.col("headers").alias("_headers"))
    responses = records.filter("kind = 'response'")
    found = responses.join(wanted, responses["record_id"] == wanted["response_id"])
    return found.select(F.col("_id").alias("record_id"), F.lit("response").alias("kind"), "url", F.col("_ts").alias("ts"), "status", F.col("_headers").alias("headers"), "digest", "payload")


def parse(content: bytes) -> Iterator[dict]:
    """Records of a WARC file, gzipped (by member or whole) or plain; HTTP headers of responses and revisits are read,
    and what follows them is the payload.

    The file ends with the first record that is cut short, has no number as its length, or doesn't start like a record,
    and where its compression is broken. A time that is none is null."""
    stream: io.BufferedIOBase = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = gzip.open(stream)
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                return
            fields = _headers(stream)
            length = fields.get("content-length", "0")
            if not (length.isascii() and length.isdigit()):
                return
            block = stream.read(int(length)) if len(length) < 19 else b""
            if len(block) < int(length):
                return
            yield _record(fields, block)
    except (EOFError, OSError, zlib.error):
        return


def _record(fields: dict[str, str], block: bytes) -> dict:
    kind, http, status = fields.get("warc-type", ""), {}, None
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        inner = io.BytesIO(block)
        said = inner.readline().split()
        status = int(said[1]) if len(said) > 1 and re.fullmatch(rb"[0-9]{3}", said[1]) else None
        http = _headers(inner)
        block = inner.read()
    return {"record_id": fields.get("warc-record-id"), "kind": kind, "url": fields.get("warc-target-uri", "").strip("<>") or None, "ts": _microseconds(fields.get("warc-date")), "status": status, "headers": http, "digest": fields.get("warc-payload-digest"), "payload": block}


def _microseconds(date: str | None) -> int | None:
    try:
        time = pd.Timestamp(date) if date else pd.NaT
        return None if time is pd.NaT else int(time.timestamp() * 1_000_000)
    except (ValueError, OverflowError):
        return None


def _headers(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def render(record: dict) -> bytes:
    """A record as one WARC/1.1 record, the inverse of ``parse``."""
    http = b""
    if record["kind"] in ("response", "revisit") and (record.get("headers") or record.get("status")):
        http = f"HTTP/1.1 {record.get('status') or 200} -\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in (record.get("headers") or {}).items()) + b"\r\n"
    block = http + bytes(record.get("payload") or b"")
    fields = {"WARC-Type": record["kind"], "WARC-Record-ID": record.get("record_id"), "WARC-Target-URI": record.get("url"), "WARC-Payload-Digest": record.get("digest")}
    if record.get("ts") is not None:
        fields["WARC-Date"] = pd.Timestamp(record["ts"], unit="us", tz="UTC").strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under ``path``; a task reads a file at a time.

    A file is one value in a task's memory, through whatever store Spark reads; its records are read one by one. Files
    of more than ``MOST_BYTES`` are an error that names them: such archives have to be split between records."""
    files = spark.read.format("binaryFile").load(path)
    large = F.raise_error(F.concat(F.col("path"), F.lit(f" has more than {MOST_BYTES} bytes")))
    files = files.select(F.when(F.col("length") > MOST_BYTES, large.cast("binary")).otherwise(F.col("content")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for record in parse(bytes(content)):
                    rows.append(record)
                    if len(rows) == 256:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(run, RECORD)


def captures(pages: DataFrame, later: int = 1000) -> DataFrame:
    """The records of a crawl of ``pages`` (page_id, url, html): each page is a full response at second 2 * page_id
    with the MD5 of its body as entity tag, and is asked for again ``later`` pages on, with that tag: a revisit."""
    rows = pick(pages, "page_id", "url", "html", page_id="long", url="string", html="string").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    at = F.col("page_id") * 2
    headers = lambda *more: F.create_map(F.lit("ETag"), tag, F.lit("Date"), at.cast("string"), *more)
    response = rows.select(F.concat(F.lit("r"), "page_id").alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("ts"), F.lit(200).alias("status"), headers(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string")).alias("headers"), F.sha2("html", 256).alias("digest"), F.encode("html", "UTF-8").alias("payload"))
    revisit = rows.select(F.concat(F.lit("v"), "page_id").alias("record_id"), F.lit("revisit").alias("kind"), "url", (at + 2 * later + 1).alias("ts"), F.lit(304).alias("status"), headers(F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("binary").alias("payload"))
    return response.union(revisit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    number = lambda c: F.substring(c, 2, 20).cast("long")
    names = F.array_sort(F.map_entries("headers"))
    told = F.array_join(F.transform(names, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select(number(F.col("record_id")).alias("page_id"), "url_key", "outcome", F.coalesce(number(F.col("response_id")), F.lit(-1)).alias("response_page_id"), F.col("digest").alias("payload_sha256"), told.alias("merged_headers"))


SQL = r"""
WITH b AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
k AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), '^www[0-9]*\.', ''), ':(?:80|443)$', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS front,
  list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)='))) AS q FROM b),
u AS (SELECT page_id, html, front || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM k),
m AS (SELECT v.page_id, v.url_key, v.html, r.page_id AS of, r.html AS stored FROM (SELECT *, 2 * page_id + 2001 AS ts FROM u) v ASOF LEFT JOIN (SELECT *, 2 * page_id AS ts FROM u) r ON v.url_key = r.url_key AND v.ts > r.ts)
SELECT page_id, url_key, CASE WHEN of IS NULL THEN 'no response' WHEN md5(html) = md5(stored) THEN 'resolved' ELSE 'validator mismatch' END AS outcome,
  CASE WHEN md5(html) = md5(stored) THEN of ELSE -1 END AS response_page_id, CASE WHEN md5(html) = md5(stored) THEN sha256(stored) END AS payload_sha256,
  CASE WHEN md5(html) = md5(stored) THEN 'cache-control=max-age=60;content-length=' || strlen(stored) || ';content-type=text/html;date=' || (2 * page_id) || ';etag="' || md5(html) || '"' END AS merged_headers
FROM m
"""
