"""Finding personal data, and information-theoretic sanitisation of what gives it away.

Protected entities are the values of four base patterns. Terms of a document with an entity can reveal it: over the whole corpus,
PMI(t; e) = log(df(t, e) N / (df(t) df(e))) says how much term t tells about entity e, and IC(e) = log(N / df(e)) how
much there is to tell. A term whose PMI reaches ``REMOVE`` of IC gives the entity away and is removed; from
``GENERALISE`` on it is generalised to its kind. Only DataFrame operations.

Positions are code points. A pattern's matches and the pieces between them give the offsets by running sums. Patterns
are written with possessive quantifiers, so long runs of digits or dots need no stack and no retries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.columns import pick
from tessella.plans.lineage import scratch, spool
from tessella.plans.skew import lookup

KINDS = ("email", "ip", "card", "phone")
#: In Java's syntax. A run of local-part characters is tried from its start only, or from the last match's end. Shorter
#: runs of digits than a card has fail anyway, and are not matched to begin with: a run is matched whole or not at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a pattern can't match.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}

#: Matches whose places are summed up together.
CHUNK = 256
#: Terms are words of four letters or more that are no part of an address.
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{4,}+(?![._%+-]*[\p{L}\p{N}@_%+-])"
#: Shares of an entity's information from which a term is generalised or removed.
GENERALISE, REMOVE = 0.6, 0.9


_NO_SPANS = "cast(array() as array<struct<v:string,s:int,e:int>>)"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def matches(text: Column, pattern: str) -> Column:
    """Array of struct(v, s, e): leftmost non-overlapping matches with their places.

    Places are running sums of the lengths of matches and of the gaps between. Adding to an array copies it, so sums run
    over chunks of ``CHUNK`` matches, and then over the chunks: long texts take time in proportion to their length.
    """

    def within(chunk: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr(_NO_SPANS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["gap"]
            e = s + F.length(x["v"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(x["v"].alias("v"), s.alias("s"), e.alias("e")))).alias("out"))

        return F.aggregate(chunk, start, step)

    def starts(chunks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(chunks, start, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def placed(chunks: Column) -> Column:
        shift = lambda c, by: F.transform(c["out"], lambda x: F.struct(x["v"].alias("v"), (x["s"] + by).alias("s"), (x["e"] + by).alias("e")))
        return F.flatten(F.zip_with(chunks, starts(chunks), shift))

    def chunked(steps: Column) -> Column:
        count = F.ceil(F.size(steps) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: within(F.slice(steps, (i - 1) * CHUNK + 1, F.lit(CHUNK))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the last gap, after the last match, has no match to go with
    steps = F.filter(F.zip_with(found, F.split(text, pattern, -1), lambda v, gap: F.struct(v.alias("v"), F.length(gap).alias("gap"))), lambda x: x["v"].isNotNull())
    return _once(steps, lambda x: F.when(F.size(x) > 0, _once(chunked(x), placed)).otherwise(F.expr(_NO_SPANS)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """From the right, every second digit is doubled, and its digits summed."""
    each = F.split(F.reverse(_digits(v)), "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(v)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda m: _valid(kind, m["v"])


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the array of valid matches; ``text`` must not be null."""
    out = {}
    for kind in KINDS:
        valid = F.filter(matches(text, PATTERNS[kind]), _check(kind))
        may = F.contains(text, F.lit(NEEDED[kind])) if kind in NEEDED else text.rlike(PATTERNS[kind])
        out[kind] = F.when(may, valid).otherwise(F.expr(_NO_SPANS))
    return out


def _words(text: Column) -> Column:
    """All terms of a text, in lower case, with their places: array of struct(term, s, e)."""
    return F.transform(matches(text, TERM), lambda m: F.struct(F.lower(m["v"]).alias("term"), m["s"].alias("s"), m["e"].alias("e")))


def _told(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda m: F.concat(F.lit(f"{kind}:"), m["s"].cast("string"), F.lit(":"), m["e"].cast("string")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _key, n_email ... n_phone, _base (array of kind:start:end), _entities (distinct values), _words (all
    terms of texts with entities), written to the shared folder: statistics and spans are made from these."""
    rows = pick(docs, id_col, text_col, **{id_col: "long", text_col: "string"}).toDF("doc_id", "_text").withColumn("_text", F.coalesce("_text", F.lit("")))
    rows = rows.withColumn("_key", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("_text").cast("string")))
    rows = rows.withColumns({f"_{k}": c for k, c in base_spans(F.col("_text")).items()})
    every = F.concat(*[F.col(f"_{k}") for k in KINDS])
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    told = F.concat(*[_told(F.col(f"_{k}"), k) for k in KINDS])
    none = F.expr("cast(array() as array<struct<term:string,s:int,e:int>>)")
    words = F.when(F.size(every) > 0, _words(F.col("_text"))).otherwise(none)
    return spool(rows.select("doc_id", "_key", *counts, told.alias("_base"), F.array_distinct(F.transform(every, lambda m: m["v"])).alias("_entities"), words.alias("_words")))


def disclosures(docs: DataFrame, found: DataFrame, text_col: str = "text", generalise: float = GENERALISE) -> DataFrame:
    """_key, term, risk (the greatest PMI / IC of the term with an entity of the text) from ``generalise`` on.

    Counts are numbers of documents over the whole corpus, wherever in a document entity and term are; entities of one
    document count too. Entities that occur in exactly the same documents have equal figures and count as one group (by
    128 bits of a sum over the documents), so a text with many entities of its own makes one pair a term.
    """
    n = max(1, found.count())
    holders = found.filter(F.size("_entities") > 0)
    entities = holders.select("_key", F.explode("_entities").alias("entity"))
    mark = lambda *more: F.sum(F.xxhash64("_key", *more).cast("decimal(20,0)")).cast("string")
    sets = entities.groupBy("entity").agg(F.count("*").alias("df_e"), F.md5(F.concat_ws("/", mark(), mark(F.lit(1)))).alias("group"))
    groups = lookup(entities, spool(sets), "entity", "df_e", n, F.xxhash64("_key", "entity")).groupBy("_key").agg(F.collect_set(F.struct("group", "df_e")).alias("_groups"))
    terms_of = F.array_distinct(F.transform("_words", lambda t: t["term"]))
    near = holders.join(groups, "_key").select("_key", "_groups", F.explode(terms_of).alias("term")).select("_key", "term", F.explode("_groups").alias("_g"))
    near = spool(near.select("_key", "term", "_g.group", "_g.df_e"))
    text = pick(docs, text_col, **{text_col: "string"}).toDF("_text")
    words = F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)), F.lower))
    terms = spool(text.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")))
    pmi = F.log(F.col("df_et") * F.lit(float(n)) / (F.col("df_t") * F.col("df_e")))
    risk = F.when(F.col("df_e") < n, pmi / F.log(F.lit(float(n)) / F.col("df_e"))).otherwise(F.lit(0.0))
    # with entities of one document a term occurs once; only those of several documents have to be counted
    once = lookup(near.filter("df_e = 1").withColumn("df_et", F.lit(1)), terms, "term", "df_t", n, F.xxhash64("_key", "term"))
    several = near.filter("df_e > 1")
    pairs = several.groupBy("group", "term").agg(F.count("*").alias("df_et"), F.first("df_e").alias("df_e"))
    scored = lookup(pairs, terms, "term", "df_t", n, F.xxhash64("group", "term"))
    pair = F.md5(F.concat_ws("\u0001", "group", "term")).alias("_pair")
    risky = spool(scored.select(pair, "df_et", risk.alias("risk")).filter(F.col("risk") >= generalise))
    more = lookup(several.select("_key", "term", pair), risky, "_pair", "df_et", n, F.xxhash64("_key", "term")).filter(F.col("risk").isNotNull())
    told = once.select("_key", "term", risk.alias("risk")).filter(F.col("risk") >= generalise).union(more.select("_key", "term", "risk"))
    # a term that tells about two entities counts by the one it tells most about
    return told.groupBy("_key", "term").agg(F.max("risk").alias("risk"))


def find_and_sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, removed.

    ``spans`` has kind:start:end of all spans, by kind (email, ip, card, phone, term), then start; ``removed`` are the
    terms' spans that are to go altogether. Null texts count as empty; null ids stay null; rows that repeat an id and
    a text get equal results. An empty table gives an empty result.
    """
    with scratch() as keep:
        found = find_pii(docs, id_col, text_col)
        risky = disclosures(docs, found, text_col, generalise)
        places = found.filter(F.size("_words") > 0).select("_key", F.explode("_words").alias("_w")).select("_key", "_w.*")
        told = places.join(risky, ["_key", "term"])
        told = told.groupBy("_key", "s", "e").agg(F.max("risk").alias("risk")).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("s", "e", "risk"))).alias("_terms"))
        out = found.drop("_entities", "_words").join(told, "_key", "left").withColumn("_terms", F.coalesce("_terms", F.expr("cast(array() as array<struct<s:int,e:int,risk:double>>)")))
        gone = F.filter("_terms", lambda t: t["risk"] >= remove)
        out = out.select("doc_id", *[f"n_{k}" for k in KINDS], F.size("_terms").cast("long").alias("n_term"), F.sha2(F.array_join("_base", ","), 256).alias("base_sha256"), F.array_join(F.concat("_base", _told(F.col("_terms"), "term")), ",").alias("spans"), F.array_join(_told(gone, "term"), ",").alias("removed"))
        return keep(spool(out))


def sanitised(text: Column, spans: Column, removed: Column) -> Column:
    """``text`` with every span replaced by [KIND], those in ``removed`` by nothing."""
    kept = F.filter(F.split(spans, ","), lambda x: x != "")
    gone = F.split(removed, ",")

    def span(x: Column) -> Column:
        part = F.split(x, ":")
        return F.struct(part[1].cast("int").alias("s"), part[2].cast("int").alias("e"), F.when(F.array_contains(gone, x), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(part[0]), F.lit("]"))).alias("to"))

    def step(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), x["to"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.when(inside, F.lit("")).otherwise(piece)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.sort_array(F.transform(kept, span)), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_and_sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
