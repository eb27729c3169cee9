"""Scalar functions on terms: shortening, namespaces, summary IRIs, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.vocabulary import OWN

#: Longest label suffix in drawings.
LABEL = 20


def unquoted(term: Column) -> Column:
    """Without the quotes of a literal."""
    return F.regexp_replace(term, '"', "")


def bare(term: Column) -> Column:
    """An IRI without its brackets; other terms as they are."""
    return F.regexp_replace(term, "^<(.*)>$", "$1")


def last_segment(term: Column) -> Column:
    """What follows the last / of an IRI (or all of it), without brackets."""
    return F.regexp_extract(bare(term), "([^/]*)/?$", 1)


def suffix(term: Column, most: int = LABEL) -> Column:
    """The last ``most`` characters."""
    text = bare(term)
    return F.when(F.length(text) > most, F.right(text, F.lit(most))).otherwise(text)


def namespace(term: Column) -> Column:
    """Up to and with the last / of an IRI; empty if there is none."""
    return F.regexp_extract(bare(term), "^(.*/)", 1)


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def summary_iri(code: str, number: Column, prefix: str = OWN) -> Column:
    return F.concat(F.lit(f"<{prefix}{code}"), number.cast("string"), F.lit(">"))


def colour(number: Column, palette: tuple[str, ...]) -> Column:
    """The palette's colour for a number, by remainder."""
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod(number, F.lit(len(palette))) + 1).cast("int"))
