"""Reading and writing N-Triples with Spark's text source and one pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IRI = r"<[^<>\"{}|^`\x00-\x20]*>"
_BLANK = r"_:[^\s<>\"]+"
_LITERAL = r'"(?:[^"\\]|\\.)*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)?'
#: Subject, property and object of a line; a comment may follow the full stop.
LINE = rf"^\s*({_IRI}|{_BLANK})\s+({_IRI}|{_BLANK})\s+({_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"


def parse(line: Column) -> Column:
    """struct(s, p, o) of a line, or null for blank lines, comments and what isn't a triple."""
    parts = [F.regexp_extract(line, LINE, i).alias(n) for i, n in enumerate("spo", 1)]
    return F.when(line.rlike(LINE), F.struct(*parts))


def read_ntriples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """[s, p, o], distinct. With ``strict`` a line that is neither triple, blank nor comment ends the query."""
    return triples(spark.read.text(path), strict)


def triples(lines: DataFrame, strict: bool = False) -> DataFrame:
    """The triples of a table of lines (its first column)."""
    line = F.col(lines.columns[0])
    found = parse(line)
    if strict:
        idle = line.rlike(r"^\s*(?:#.*)?$")
        found = F.when(idle | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), line)))
    return lines.select(found.alias("t")).filter("t is not null").select("t.*").distinct()


def valid(line: str) -> bool:
    """Whether one line is a triple (for input typed by hand)."""
    return re.match(LINE, line) is not None


def lines(triples: DataFrame) -> DataFrame:
    """[value]: one N-Triples line per triple."""
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines(triples).write.mode(mode).text(path)
