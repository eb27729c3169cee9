"""SQL for the queries on the graph of tables, for an engine with recursive common table expressions.

Every text is a chain of expressions: the triples, their kinds, then representatives and edges of one kind of summary.
"""

from __future__ import annotations

from tessella.functions.vocabulary import CLASS, DOMAIN, GENERIC, OWN, PROPERTY, RANGE, SCHEMA, SUBCLASS, SUBPROPERTY, TYPE, VARIANTS
from tessella.operators.quotient import DATA_FIRST, KINDS, TOGETHER
from tessella.sources.export import PALETTES
from tessella.sources.tables import LABEL, schema_rows


def _in(terms) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


_TYPES = (TYPE, *VARIANTS)
_VALUES = ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in schema_rows())

TRIPLES = f"""
raw AS (
  SELECT '<urn:order/' || o_orderkey || '>' AS s, '<urn:p/placedBy_' || o_orderstatus || '>' AS p, '<urn:customer/' || o_custkey || '>' AS o FROM orders
  UNION ALL SELECT '<urn:order/' || o_orderkey || '>', CASE WHEN o_orderpriority < '3' THEN '<urn:p/urgency_' ELSE '<urn:p/priority_' END || o_orderstatus || '>', '"' || o_orderpriority || '"' FROM orders
  UNION ALL SELECT '<urn:order/' || o_orderkey || '>', CASE WHEN o_orderpriority = '5-LOW' THEN '<urn:p/filed_' || o_orderstatus || '>' ELSE '{TYPE}' END, CASE WHEN o_orderpriority = '5-LOW' THEN '"5-LOW"' ELSE '<urn:class/order_' || o_orderstatus || '>' END FROM orders
  UNION ALL SELECT '<urn:order/' || o_orderkey || '>', '<urn:p/contains_' || o_orderstatus || '>', '<urn:part/' || l_partkey || '>' FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT '<urn:customer/' || c_custkey || '>', '<urn:p/nation>', '<urn:nation/' || c_nationkey || '>' FROM customer
  UNION ALL SELECT '<urn:customer/' || c_custkey || '>', '<urn:p/segment>', '"' || c_mktsegment || '"' FROM customer
  UNION ALL SELECT '<urn:customer/' || c_custkey || '>', CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '<urn:p/home>' ELSE '{TYPE}' END, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '<urn:nation/' || c_nationkey || '>' ELSE '<urn:class/' || c_mktsegment || '>' END FROM customer
  UNION ALL SELECT '<urn:part/' || p_partkey || '>', '<urn:p/brand>', '"' || p_brand || '"' FROM part
  UNION ALL SELECT '<urn:part/' || p_partkey || '>', '<urn:p/kind>', '"' || p_type || '"' FROM part
  UNION ALL SELECT '<urn:part/' || p_partkey || '>', CASE right(p_brand, 1) WHEN '1' THEN '{VARIANTS[0]}' WHEN '2' THEN '<urn:p/unclassified>' ELSE '{TYPE}' END, CASE right(p_brand, 1) WHEN '2' THEN '"' || p_brand || '"' ELSE '<urn:class/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '>' END FROM part
  UNION ALL SELECT '<urn:supplier/' || s_suppkey || '>', CASE WHEN s_nationkey < 8 THEN '{LABEL}' ELSE '<urn:p/nation>' END, CASE WHEN s_nationkey < 8 THEN '"' || s_name || '"' ELSE '<urn:nation/' || s_nationkey || '>' END FROM supplier
  UNION ALL SELECT '<urn:store/' || s_suppkey || '>', '{TYPE}', '<urn:class/Store>' FROM supplier
  UNION ALL SELECT '<urn:nation/' || n_nationkey || '>', '<urn:p/region>', '<urn:region/' || n_regionkey || '>' FROM nation
  UNION ALL SELECT '<urn:nation/' || n_nationkey || '>', '{LABEL}', '"' || n_name || '"' FROM nation
  UNION ALL SELECT '<urn:event/' || event_id || '>', '<urn:p/by_' || event_type || '>', '<urn:user/' || user_id || '>' FROM events
  UNION ALL SELECT * FROM (VALUES {_VALUES}) v(s, p, o))"""

PARTS = f"""
types AS (SELECT * FROM t WHERE p IN {_in(_TYPES)}),
schema_t AS (SELECT * FROM t WHERE p IN {_in(SCHEMA)}),
generic AS (SELECT * FROM t WHERE p IN {_in(GENERIC)}),
data AS (SELECT * FROM t WHERE p NOT IN {_in((*_TYPES, *SCHEMA, *GENERIC))}),
sn AS (SELECT s AS node FROM schema_t UNION SELECT o FROM schema_t UNION SELECT o FROM types UNION SELECT s FROM types WHERE o IN {_in((CLASS, PROPERTY))})"""

PLAIN = f"WITH RECURSIVE {TRIPLES}, t AS (SELECT DISTINCT s, p, o FROM raw), {PARTS}"

SATURATED = f"""WITH RECURSIVE {TRIPLES}, t0 AS (SELECT DISTINCT s, p, o FROM raw),
supers(p, q) AS (SELECT s, o FROM t0 WHERE p = '{SUBPROPERTY}' UNION SELECT supers.p, t0.o FROM supers JOIN t0 ON t0.s = supers.q AND t0.p = '{SUBPROPERTY}'),
uppers(c, d) AS (SELECT s, o FROM t0 WHERE p = '{SUBCLASS}' UNION SELECT uppers.c, t0.o FROM uppers JOIN t0 ON t0.s = uppers.d AND t0.p = '{SUBCLASS}'),
t1 AS (SELECT * FROM t0 UNION SELECT t0.s, supers.q, t0.o FROM t0 JOIN supers ON t0.p = supers.p),
t2 AS (SELECT * FROM t1 UNION SELECT t1.s, '{TYPE}', d.o FROM t1 JOIN t0 d ON d.p = '{DOMAIN}' AND d.s = t1.p
  UNION SELECT t1.o, '{TYPE}', d.o FROM t1 JOIN t0 d ON d.p = '{RANGE}' AND d.s = t1.p),
t AS (SELECT * FROM t2 UNION SELECT t2.s, t2.p, uppers.d FROM t2 JOIN uppers ON t2.o = uppers.c WHERE t2.p IN {_in(_TYPES)}), {PARTS}"""

#: Rounds of refinement that are written out for the full bisimulation; on these tables it is stable before.
ROUNDS = 6


def _roles(kind) -> str:
    source = "(SELECT * FROM data UNION ALL SELECT * FROM types)" if kind.family == TOGETHER else "data"
    typed = " AND node NOT IN (SELECT s FROM types)" if kind.typed_apart else ""
    return f"roles AS (SELECT DISTINCT node, role, p FROM (SELECT s AS node, 'S' AS role, p FROM {source} a UNION ALL SELECT o, 'T', p FROM {source} b) x WHERE node NOT IN (SELECT node FROM sn){typed})"


def components(name: str, tokens: str) -> str:
    """Expressions ending in name(token, label), from ``tokens``: SQL for a table (node, token)."""
    return f"""
{name}_l AS (SELECT DISTINCT token, min(token) OVER (PARTITION BY node) AS other FROM ({tokens}) x),
{name}_r(token, reached) AS (SELECT token, token FROM {name}_l UNION SELECT r.token, CASE WHEN l.token = r.reached THEN l.other ELSE l.token END FROM {name}_r r JOIN {name}_l l ON l.token = r.reached OR l.other = r.reached),
{name} AS (SELECT token, min(reached) AS label FROM {name}_r GROUP BY token)"""


_SETS = "sets AS (SELECT node, coalesce(list_sort(list(DISTINCT p) FILTER (role = 'S')), []) AS outgoing, coalesce(list_sort(list(DISTINCT p) FILTER (role = 'T')), []) AS incoming FROM roles GROUP BY node)"
_CLASSES = "class_sets AS (SELECT s AS node, list_sort(list(DISTINCT o)) AS classes FROM types WHERE s NOT IN (SELECT node FROM sn) GROUP BY s)"


def keys(kind, rounds: int = ROUNDS) -> str:
    """Expressions ending in keyed(node, key)."""
    roles = _roles(kind)
    base = kind.keys.__name__
    if base == "_weak":
        own = roles + "," + components("comp", "SELECT node, role || p AS token FROM roles") + ", keyed AS (SELECT DISTINCT node, label AS key FROM roles JOIN comp ON token = role || p)"
    elif base in ("_strong", "_source_clique"):
        target = ", tc AS (SELECT DISTINCT node, label FROM roles JOIN tcomp ON token = p WHERE role = 'T')" if base == "_strong" else ", tc AS (SELECT NULL AS node, NULL AS label)"
        own = roles + "," + components("scomp", "SELECT node, p AS token FROM roles WHERE role = 'S'") + "," + components("tcomp", "SELECT node, p AS token FROM roles WHERE role = 'T'")
        own += ", sc AS (SELECT DISTINCT node, label FROM roles JOIN scomp ON token = p WHERE role = 'S')" + target
        own += ", keyed AS (SELECT n.node, coalesce(sc.label, '-') || ' ' || coalesce(tc.label, '-') AS key FROM (SELECT DISTINCT node FROM roles) n LEFT JOIN sc ON sc.node = n.node LEFT JOIN tc ON tc.node = n.node)"
    elif base == "_one":
        own = roles + ", keyed AS (SELECT DISTINCT node, 'untyped' AS key FROM roles)"
    elif base == "bisimulation":
        own = roles + f", {_SETS}, {_CLASSES}, steps AS (SELECT s AS node, 'out' AS way, p, o AS goal FROM data UNION SELECT o, 'in', p, s FROM data), r0 AS (SELECT sets.node, min(sets.node) OVER (PARTITION BY outgoing, incoming, classes) AS label FROM sets LEFT JOIN class_sets c ON c.node = sets.node)"
        for i in range(rounds):
            own += f", s{i} AS (SELECT steps.node, list_sort(list(DISTINCT way || ' ' || p || ' ' || coalesce(label, goal))) AS near FROM steps LEFT JOIN r{i} ON r{i}.node = goal GROUP BY steps.node)"
            own += f", r{i + 1} AS (SELECT r{i}.node, min(r{i}.node) OVER (PARTITION BY label, near) AS label FROM r{i} LEFT JOIN s{i} ON s{i}.node = r{i}.node)"
        own += f", keyed AS (SELECT node, label AS key FROM r{rounds})"
    else:
        key = "array_to_string(outgoing, ' ')" + ("" if base == "_forward" else " || '|' || array_to_string(incoming, ' ')")
        own = roles + f", {_SETS}, keyed AS (SELECT node, {key} AS key FROM sets)"
    if kind.typed_apart:
        own = own.replace("keyed AS (", "free AS (", 1) if "keyed AS (" in own else own
        own += f", {_CLASSES}, keyed AS (SELECT node, 'd' || key AS key FROM free UNION ALL SELECT node, 't' || array_to_string(classes, ' ') FROM class_sets)"
    return own


def rep(name: str, start: str = PLAIN, rounds: int = ROUNDS) -> str:
    """Expressions ending in rep(node, rep)."""
    kind = KINDS[name]
    own = "least" if kind.name != "typed" else "CASE WHEN key = 'duntyped' THEN '_: untyped' ELSE least END"
    only = "UNION ALL SELECT DISTINCT s, '_: types' FROM types WHERE s NOT IN (SELECT node FROM sn) AND s NOT IN (SELECT node FROM keyed)" if kind.family == DATA_FIRST else ""
    return f"""{start}, {keys(kind, rounds)},
named AS (SELECT node, node AS rep FROM sn UNION ALL SELECT node, {own} FROM (SELECT node, key, min(node) OVER (PARTITION BY key) AS least FROM keyed) k {only}),
rest AS (SELECT node, min(role || p) AS f FROM (SELECT s AS node, 'S' AS role, p FROM generic UNION ALL SELECT o, 'T', p FROM generic) g WHERE node NOT IN (SELECT node FROM named) GROUP BY node),
rep AS (SELECT * FROM named UNION ALL SELECT node, CASE WHEN f[1] = 'S' THEN '_: source ' ELSE '_: target ' END || f[2:] FROM rest)"""


def edges(name: str, start: str = PLAIN, rounds: int = ROUNDS) -> str:
    """Expressions ending in edges(s, p, o, cnt, kind)."""
    kind = KINDS[name]
    mapped = lambda table, label: f"SELECT a.rep AS s, p, b.rep AS o, count(*) AS cnt, '{label}' AS kind FROM {table} JOIN rep a ON a.node = s JOIN rep b ON b.node = o GROUP BY ALL"
    if kind.family == TOGETHER:
        typed = mapped("types", "type")
    elif kind.family == DATA_FIRST:
        typed = f"SELECT a.rep, '{TYPE}', o, count(*), 'type' FROM types JOIN rep a ON a.node = s GROUP BY ALL"
    else:
        typed = f"SELECT s, p, o, count(*), 'type' FROM types WHERE s IN (SELECT node FROM sn) GROUP BY ALL UNION ALL SELECT a.rep, '{TYPE}', o, count(*), 'type' FROM (SELECT DISTINCT s, o FROM types WHERE s NOT IN (SELECT node FROM sn)) x JOIN rep a ON a.node = s GROUP BY ALL"
    return f"{rep(name, start, rounds)}, edges AS ({mapped('data', 'data')} UNION ALL SELECT s, p, o, 1, 'schema' FROM schema_t UNION ALL {typed} UNION ALL {mapped('generic', 'generic')})"


_EDGES = "SELECT s, p, o, CAST(cnt AS BIGINT) AS cnt, kind FROM edges"


def _patterns(table: str, name: str) -> str:
    return f"""{name} AS (SELECT DISTINCT a.p AS p1, b.p AS p2, 'os' AS connection FROM (SELECT DISTINCT o, p FROM {table}) a JOIN (SELECT DISTINCT s, p FROM {table}) b ON a.o = b.s
UNION SELECT a.p, b.p, 'oo' FROM (SELECT DISTINCT o, p FROM {table}) a JOIN (SELECT DISTINCT o, p FROM {table}) b ON a.o = b.o
UNION SELECT a.p, b.p, 'ss' FROM (SELECT DISTINCT s, p FROM {table}) a JOIN (SELECT DISTINCT s, p FROM {table}) b ON a.s = b.s)"""


#: Names of summary nodes: numbers in sorted order, in our namespace, but for schema nodes; edges between names.
_NAMED = f"""nm AS (SELECT rep, number, CASE WHEN rep IN (SELECT node FROM sn) THEN rep ELSE '<{OWN}s' || number || '>' END AS name FROM (SELECT rep, row_number() OVER (ORDER BY rep) AS number FROM (SELECT DISTINCT rep FROM rep) r) r),
ne AS (SELECT a.name AS s, p, b.name AS o, cnt, kind FROM edges JOIN nm a ON a.rep = s JOIN nm b ON b.rep = o),
ns AS (SELECT rep, count(*) AS cnt FROM rep GROUP BY rep)"""
_NTRIPLES = f"""{_NAMED}, reified AS (SELECT s, p, o, CAST(sum(cnt) AS BIGINT) AS cnt, row_number() OVER (ORDER BY s || chr(1) || p || chr(1) || o) - 1 AS n FROM ne GROUP BY s, p, o),
four AS (SELECT '<{OWN}edges' || n || '> ' AS e, * FROM reified)
SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM ne UNION ALL SELECT name || ' <{OWN}nodeSupport> "' || cnt || '" .' FROM ns JOIN nm USING (rep)
UNION ALL SELECT e || '<{OWN}reifiedEdgeSubject> ' || s || ' .' FROM four UNION ALL SELECT e || '<{OWN}reifiedEdgeProperty> ' || p || ' .' FROM four
UNION ALL SELECT e || '<{OWN}reifiedEdgeObject> ' || o || ' .' FROM four UNION ALL SELECT e || '<{OWN}edgeSupport> "' || cnt || '" .' FROM four"""


def _dot_label(term: str) -> str:
    bare = lambda x: rf"regexp_replace({x}, '^<(.*)>$', '\1')"
    last = lambda x: f"(CASE WHEN length({bare(x)}) > 20 THEN right({bare(x)}, 20) ELSE {bare(x)} END)"
    segment = f"regexp_extract({bare(term)}, '([^/]*)/?$', 1)"
    return _dot_escaped(f"CASE WHEN {term} LIKE '<%' THEN {last(segment)} ELSE {last(f"replace({term}, chr(34), '')")} END")


def _dot_escaped(text: str) -> str:
    return f"replace(replace({text}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"


_COLOURS = "['" + "', '".join(PALETTES["light"]) + "']"
_DOT = f"""{_NAMED}, de AS (SELECT * FROM ne WHERE kind <> 'generic' ORDER BY s, p, o, kind LIMIT 1000),
dn AS (SELECT nm.name, nm.number, ns.cnt FROM (SELECT s AS name FROM de UNION SELECT o FROM de) x JOIN nm ON nm.name = x.name JOIN ns ON ns.rep = nm.rep)
SELECT 'digraph summary {{' AS value UNION ALL SELECT '}}' UNION ALL SELECT '"' || {_dot_escaped('name')} || '" [label="' || {_dot_label('name')} || ' (' || cnt || ')", style=filled, fillcolor=' || {_COLOURS}[number % {len(PALETTES["light"])} + 1] || '];' FROM dn
UNION ALL SELECT '"' || {_dot_escaped('s')} || '" -> "' || {_dot_escaped('o')} || '" [label="' || {_dot_label('p')} || ' (' || cnt || ')", style=' || CASE kind WHEN 'data' THEN 'solid' WHEN 'schema' THEN 'bold' ELSE 'dashed' END || '];' FROM de"""

_UP = f"up(c, d) AS (SELECT s, o FROM t WHERE p = '{SUBCLASS}' UNION SELECT up.c, t.o FROM up JOIN t ON t.s = up.d AND t.p = '{SUBCLASS}'), every AS (SELECT c, d FROM up UNION SELECT d, d FROM up), tops AS (SELECT c, d FROM every WHERE d NOT IN (SELECT c FROM up))"
_GENERAL = f"{_UP}, class_sets AS (SELECT s AS node, list_sort(list(DISTINCT coalesce(d, o))) AS classes FROM types LEFT JOIN tops ON c = o WHERE s NOT IN (SELECT node FROM sn) GROUP BY s)"


_KIND = f"CASE WHEN p IN {_in(_TYPES)} THEN 'type' WHEN p IN {_in(SCHEMA)} THEN 'schema' WHEN p IN {_in(GENERIC)} THEN 'generic' ELSE 'data' END"
_LEAF = "leaves AS (SELECT DISTINCT o AS node FROM edges WHERE kind <> 'type' AND o NOT IN (SELECT s FROM edges))"
_MEASURES = lambda pairs, source: " UNION ALL ".join(f"SELECT '{n}' AS measure, CAST({e} AS BIGINT) AS value FROM {source}" for n, e in pairs)

SQL: dict[str, str] = {
    "scan_types": f"{PLAIN} SELECT * FROM types",
    "scan_data": f"{PLAIN} SELECT * FROM data",
    "schema_nodes": f"{PLAIN} SELECT * FROM sn",
    "classify_triples": f"{PLAIN} SELECT kind, p, count(*) AS cnt FROM (SELECT p, {_KIND} AS kind FROM t) k GROUP BY ALL",
    "dictionary": f"{PLAIN} SELECT row_number() OVER (ORDER BY value) AS key, value FROM (SELECT s AS value FROM t UNION SELECT p FROM t UNION SELECT o FROM t) d",
    "dictionary_encode": f"{PLAIN}, d AS (SELECT row_number() OVER (ORDER BY value) AS key, value FROM (SELECT s AS value FROM t UNION SELECT p FROM t UNION SELECT o FROM t) d) SELECT a.key AS s, b.key AS p, c.key AS o FROM t JOIN d a ON a.value = t.s JOIN d b ON b.value = t.p JOIN d c ON c.value = t.o",
    "saturate": f"{SATURATED} SELECT s, p, o FROM t",
    "top_types": f"""{PLAIN}, up(c, d) AS (SELECT s, o FROM t WHERE p = '{SUBCLASS}' UNION SELECT up.c, t.o FROM up JOIN t ON t.s = up.d AND t.p = '{SUBCLASS}'),
every AS (SELECT c, d FROM up UNION SELECT d, d FROM up) SELECT c AS class, d AS top FROM every WHERE d NOT IN (SELECT c FROM up)""",
    "class_sets": f"{PLAIN}, {_CLASSES} SELECT node, array_to_string(classes, ' ') AS classes FROM class_sets",
    "source_cliques": f"{PLAIN}, {_roles(KINDS['strong'])}, {components('c', 'SELECT node, p AS token FROM roles WHERE role = ' + chr(39) + 'S' + chr(39))} SELECT token AS p, label AS clique FROM c",
    "target_cliques": f"{PLAIN}, {_roles(KINDS['strong'])}, {components('c', 'SELECT node, p AS token FROM roles WHERE role = ' + chr(39) + 'T' + chr(39))} SELECT token AS p, label AS clique FROM c",
    "weak_rep": f"{rep('weak')} SELECT node, rep FROM rep",
    "strong_rep": f"{rep('strong')} SELECT node, rep FROM rep",
    "weak_edges": f"{edges('weak')} {_EDGES}",
    "strong_edges": f"{edges('strong')} {_EDGES}",
    "typed_edges": f"{edges('typed')} {_EDGES}",
    "typed_weak_edges": f"{edges('typedweak')} {_EDGES}",
    "typed_strong_edges": f"{edges('typedstrong')} {_EDGES}",
    "io_typed_edges": f"{edges('2pinputoutput')} {_EDGES}",
    "onefw_edges": f"{edges('2ponefw')} {_EDGES}",
    "onefb_edges": f"{edges('2ponefb')} {_EDGES}",
    "bisim_edges": f"{edges('2pbisim')} {_EDGES}",
    "bisim_two_rounds": f"{rep('2pbisim', rounds=2)} SELECT node, min(node) OVER (PARTITION BY key) AS rep FROM keyed",
    "source_clique_edges": f"{edges('2psourceclique')} {_EDGES}",
    "generic_edges": f"{edges('strong')} {_EDGES} WHERE kind = 'generic'",
    "type_only_node": f"{edges('strong')} {_EDGES} WHERE s = '_: types'",
    "node_support": f"{rep('strong')} SELECT rep, count(*) AS cnt FROM rep GROUP BY rep",
    "edge_support": f"{edges('weak')} SELECT kind, count(*) AS edges, CAST(sum(cnt) AS BIGINT) AS triples FROM edges GROUP BY kind",
    "leaf_nodes": f"{edges('2ponefb')}, {_LEAF} SELECT node FROM leaves",
    "split_leaf_support": f"{edges('2ponefb')}, {_LEAF} SELECT a.rep AS s, p, b.rep AS o, count(DISTINCT o) AS cnt FROM (SELECT * FROM data UNION ALL SELECT * FROM generic) d JOIN rep a ON a.node = s JOIN rep b ON b.node = o WHERE b.rep IN (SELECT node FROM leaves) GROUP BY ALL",
    "type_histogram": f"{rep('typedstrong')} SELECT rep, o AS type, count(*) AS cnt FROM (SELECT DISTINCT s, o FROM types) x JOIN rep ON node = s GROUP BY ALL",
    "saturated_strong_edges": f"{edges('strong', SATURATED)} {_EDGES}",
    "saturated_weak_edges": f"{edges('weak', SATURATED)} {_EDGES}",
    "shortcut_weak_edges": f"{edges('weak', SATURATED)} SELECT p, kind, count(*) AS edges FROM edges GROUP BY ALL",
    "patterns": f"{edges('strong')}, {_patterns('edges', 'pat')} SELECT * FROM pat",
    "accuracy_al2": f"{edges('strong')}, {_patterns('edges', 'pat')}, {_patterns('t', 'own')}, k AS (SELECT count(own.p1) AS found, count(*) AS total FROM pat LEFT JOIN own ON pat.p1 = own.p1 AND pat.p2 = own.p2 AND pat.connection = own.connection) SELECT found, total, CAST(found AS DOUBLE) / total AS accuracy FROM k",
    "object_analysis": f"{PLAIN}, a AS (SELECT DISTINCT s FROM types), b AS (SELECT DISTINCT s FROM data), k AS (SELECT a.s AS x, b.s AS y FROM a FULL JOIN b ON a.s = b.s) " + _MEASURES([("typed", "count(x)"), ("with_data", "count(y)"), ("typed_with_data", "count(*) FILTER (x = y)"), ("untyped_with_data", "count(*) FILTER (x IS NULL)"), ("typed_without_data", "count(*) FILTER (y IS NULL)")], "k"),
    "untyped_ratio": f"{PLAIN}, n AS (SELECT count(*) AS nodes FROM (SELECT s FROM t UNION SELECT o FROM t) x), k AS (SELECT count(DISTINCT s) AS typed FROM t WHERE p = '{TYPE}') SELECT nodes, typed, 1 - CAST(typed AS DOUBLE) / nodes AS ratio FROM n, k",
    "graph_statistics": f"{PLAIN}, k AS (SELECT *, {_KIND} AS kind FROM t) " + _MEASURES([*((f"{k}_triples", f"count(*) FILTER (kind = '{k}')") for k in ("data", "type", "schema", "generic")), ("data_properties", "count(DISTINCT p) FILTER (kind IN ('data', 'generic'))")], "k") + f" UNION ALL SELECT 'nodes', count(*) FROM (SELECT s FROM t UNION SELECT o FROM t) x UNION ALL SELECT 'classes', count(*) FROM (SELECT o FROM t WHERE p IN {_in((DOMAIN, RANGE, SUBCLASS, *_TYPES))} UNION SELECT s FROM t WHERE p = '{SUBCLASS}') y",
    "summary_ntriples": f"{edges('strong')}, {_NTRIPLES}",
    "representation_ntriples": f"{edges('strong')}, {_NAMED} SELECT name || ' <http://www.w3.org/2004/02/skos/core#member> ' || node || ' .' AS value FROM rep JOIN nm USING (rep)",
    "summary_dot": f"{edges('strong')}, {_DOT}",
    "general_typed_edges": f"{edges('typedstrong').replace(_CLASSES, _GENERAL)} {_EDGES}",
    "stored_edges": f"{edges('strong')} {_EDGES}",
    "dictionary_decode": f"{PLAIN} SELECT s, p, o FROM t",
    "dictionary_extend": f"{PLAIN}, k AS (SELECT s AS value FROM schema_t UNION SELECT p FROM schema_t UNION SELECT o FROM schema_t), d AS (SELECT s AS value FROM t UNION SELECT p FROM t UNION SELECT o FROM t) SELECT row_number() OVER (ORDER BY value NOT IN (SELECT value FROM k), value) AS key, value FROM d",
    "ntriples_lines": f"{PLAIN} SELECT s, p, o FROM t",
    "inlined_edges": f"{edges('strong')} {_EDGES} WHERE kind IN ('data', 'generic')",
    "stream_strong_edges": f"{edges('strong')} {_EDGES}",
}
