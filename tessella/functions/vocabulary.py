"""RDF and RDFS terms, and the classes of triples they make."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_derived = property

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"

SUBCLASS = f"<{RDFS}subClassOf>"
SUBPROPERTY = f"<{RDFS}subPropertyOf>"
DOMAIN = f"<{RDFS}domain>"
RANGE = f"<{RDFS}range>"
SCHEMA = (SUBCLASS, SUBPROPERTY, DOMAIN, RANGE)
CLASS = f"<{RDFS}Class>"
PROPERTY = f"<{RDF}Property>"
TYPE = f"<{RDF}type>"

#: Namespace of what a summary adds: its nodes, support numbers and reified edges.
OWN = "http://tessella.example/"
SUPPORT_TERMS = ("nodeSupport", "edgeSupport", "edge", "reifiedEdgeSubject", "reifiedEdgeProperty", "reifiedEdgeObject")

#: Default variant type property and generic properties (labels and the like group nothing).
VARIANTS = ("<http://www.wikidata.org/prop/direct/P31>",)
GENERIC = (
    f"<{RDFS}label>",
    f"<{RDFS}comment>",
    f"<{RDF}value>",
    "<http://www.w3.org/2002/07/owl#sameAs>",
    *(f"<{OWN}{x}>" for x in SUPPORT_TERMS),
)


Term = str | int


@dataclass(frozen=True)
class Vocabulary:
    """Which properties are type, schema and generic ones. Terms are written as in N-Triples, or are codes.

    A vocabulary of codes lacks the terms that the dictionary lacks; those are None and match nothing.
    """

    default_type: Term | None = TYPE
    variant_types: tuple[Term, ...] = VARIANTS
    generic: tuple[Term, ...] = field(default=GENERIC)
    subclass: Term | None = SUBCLASS
    subproperty: Term | None = SUBPROPERTY
    domain: Term | None = DOMAIN
    range: Term | None = RANGE
    class_: Term | None = CLASS
    property: Term | None = PROPERTY

    def encoded(self, codes: dict[str, int]) -> Vocabulary:
        """The vocabulary in codes; ``codes`` has those of the terms that the data knows."""
        one = lambda t: codes.get(t)
        several = lambda ts: tuple(codes[t] for t in ts if t in codes)
        return Vocabulary(one(self.default_type), several(self.variant_types), several(self.generic), *[one(t) for t in (self.subclass, self.subproperty, self.domain, self.range, self.class_, self.property)])

    def terms(self) -> list[Term]:
        """All terms that it names, some dozens."""
        return [t for t in (*self.types, *self.schema, *self.generic, self.class_, self.property) if t is not None]

    @_derived
    def types(self) -> tuple[Term, ...]:
        return tuple(t for t in (self.default_type, *self.variant_types) if t is not None)

    @_derived
    def schema(self) -> tuple[Term, ...]:
        return tuple(t for t in (self.subclass, self.subproperty, self.domain, self.range) if t is not None)

    def is_type(self, p: Column) -> Column:
        return among(p, self.types)

    def is_schema(self, p: Column) -> Column:
        return among(p, self.schema)

    def is_generic(self, p: Column) -> Column:
        return ~self.is_type(p) & ~self.is_schema(p) & among(p, self.generic)

    def is_data(self, p: Column) -> Column:
        return ~among(p, (*self.types, *self.schema, *self.generic))

    def declares(self, o: Column) -> Column:
        """Whether the object of a type triple says that its subject is a class or a property."""
        return among(o, tuple(t for t in (self.class_, self.property) if t is not None))

    def kind(self, p: Column) -> Column:
        """type, schema, generic or data, tested in this order."""
        return F.when(self.is_type(p), "type").when(self.is_schema(p), "schema").when(self.is_generic(p), "generic").otherwise("data")


def among(column: Column, terms: tuple[Term, ...]) -> Column:
    return column.isin(*terms) if terms else F.lit(False)


def equals(column: Column, term: Term | None) -> Column:
    return F.lit(False) if term is None else column == F.lit(term)
