"""Small graphs by hand. A line is subject, property and object: ``a`` is a node, ``"5"`` a literal, ``C:x`` a class, and
the properties type, sub, subp, dom, rng and label stand for those of RDF and RDFS."""

from __future__ import annotations

from tessella.functions.vocabulary import DOMAIN, RANGE, RDFS, SUBCLASS, SUBPROPERTY, TYPE, VARIANTS

NAMED = {"type": TYPE, "P31": VARIANTS[0], "sub": SUBCLASS, "subp": SUBPROPERTY, "dom": DOMAIN, "rng": RANGE, "label": f"<{RDFS}label>", "comment": f"<{RDFS}comment>"}


def term(x: str) -> str:
    return x if x.startswith('"') else NAMED.get(x, f"<urn:{x}>")


def triples(text: str) -> list[tuple[str, str, str]]:
    return [tuple(term(x) for x in line.split()) for line in text.strip().splitlines() if line.strip()]


#: All four schema properties, a literal with two incoming properties, a class hierarchy of three.
SCHEMA = """
n1 type C:1
n1 p1 "1"
n1 p1 "2"
n2 p1 "3"
n2 p2 "4"
C:1 sub C:2
C:2 sub C:3
n2 p3 "5"
n3 p2 "6"
p1 subp p2
p1 dom C:3
p1 rng C:4
n2 p1 "5"
n3 p4 "6"
"""

#: A back edge: the smallest graph whose weak and strong summaries differ.
BACK = """
a p b
c p d
d q e
f q a
g r c
"""

#: Typed ends and an untyped middle, a node with types only, and one with labels only.
MIXED = """
a p b
b p c
d q c
a type C:x
d type C:x
d type C:y
t type C:x
t2 P31 C:y
b label "b"
l label "l"
"""
