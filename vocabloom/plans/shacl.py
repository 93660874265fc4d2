"""Registered queries of the shape tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shapes
from ..vocabulary import OWL, RDF, RDFS, SH, SKOS, TYPE
from .models import KNOWN, PRELUDE, model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def short(iri: str) -> str:
    """SQL for prefix:local of an IRI, else the IRI; needs a left join of pof as n on its namespace."""
    return f"coalesce(coalesce(n.declared, {KNOWN.format(ns(iri))}) || ':' || nullif(regexp_extract({iri}, '^(.*[#/])([^#/]+)$', 2), ''), {iri})"


def ns(iri: str) -> str:
    return f"nullif(regexp_extract({iri}, '^(.*[#/])([^#/]+)$', 1), '')"


_MEMBER = "CASE {0}kind WHEN 'bnode' THEN '_:' || {0}member ELSE {0}member END"
_ONE = "arg_min(o, seq) FILTER (p = '" + SH + "{0}' AND o_kind = 'literal')"
_IRI = "min(o) FILTER (p = '" + SH + "{0}' AND o_kind = 'iri')"
_SET = "list_sort(coalesce(list(DISTINCT o) FILTER (p = '" + SH + "{0}' AND o_kind = 'iri'), []))"
SHAPES = f"""{PRELUDE},
cell AS MATERIALIZED (SELECT release, s AS node, arg_min(o, seq) FILTER (p = '{RDF}first') AS member, arg_min(o_kind, seq) FILTER (p = '{RDF}first') AS kind, arg_min(o, seq) FILTER (p = '{RDF}rest') AS next FROM q WHERE p IN ('{RDF}first', '{RDF}rest') GROUP BY ALL),
walk AS (SELECT release, o AS head, o AS node, 0 AS nth, [o] AS seen FROM (SELECT DISTINCT release, o FROM q WHERE p IN ('{SH}in', '{SH}or', '{SH}path') AND o_kind <> 'literal')
  UNION ALL SELECT w.release, w.head, k.next, w.nth + 1, list_append(w.seen, k.next) FROM walk w JOIN cell k USING (release, node) WHERE k.next <> '{RDF}nil' AND NOT list_contains(w.seen, k.next)),
lst AS MATERIALIZED (SELECT release, head, nth, member, kind FROM walk JOIN cell USING (release, node) WHERE member IS NOT NULL),
pth AS MATERIALIZED (SELECT x.release, x.node, CASE x.k WHEN 'iri' THEN 'predicate' WHEN 'bnode' THEN CASE WHEN i.o IS NOT NULL THEN 'inverse' ELSE 'complex' END END AS path_kind, CASE x.k WHEN 'iri' THEN x.o WHEN 'bnode' THEN coalesce(i.o, l.names, 'a path expression') END AS path
  FROM (SELECT release, s AS node, arg_min(o, seq) AS o, arg_min(o_kind, seq) AS k FROM q WHERE p = '{SH}path' GROUP BY ALL) x
  LEFT JOIN (SELECT release, s, min(o) AS o FROM q WHERE p = '{SH}inversePath' AND o_kind = 'iri' GROUP BY ALL) i ON i.release = x.release AND i.s = x.o
  LEFT JOIN (SELECT release, head, string_agg(CASE kind WHEN 'literal' THEN '?' WHEN 'bnode' THEN '_:' || member ELSE member END, ' / ' ORDER BY nth) AS names FROM lst GROUP BY ALL) l ON l.release = x.release AND l.head = x.o),
asked AS (SELECT DISTINCT a.release, a.s AS here, v.o AS scheme FROM q a JOIN pth p ON p.release = a.release AND p.node = a.o AND p.path_kind = 'predicate' AND p.path = '{SKOS}inScheme' JOIN q v ON v.release = a.release AND v.s = a.o AND v.p = '{SH}hasValue' AND v.o_kind = 'iri' WHERE a.p = '{SH}property'),
deep AS (SELECT release, s AS node, o AS here, 1 AS d FROM q WHERE p = '{SH}node' AND o_kind <> 'literal' UNION ALL SELECT d.release, d.node, q.o, d + 1 FROM deep d JOIN q ON q.release = d.release AND q.s = d.here AND q.p = '{SH}node' AND q.o_kind <> 'literal' WHERE d < 4),
sch AS (SELECT DISTINCT d.release, d.node, a.scheme FROM deep d JOIN asked a USING (release, here)),
ort AS (SELECT DISTINCT a.release, a.s AS node, k.o AS dt FROM q a JOIN lst l ON l.release = a.release AND l.head = a.o AND l.kind <> 'literal' JOIN q k ON k.release = a.release AND k.s = l.member AND k.p = '{SH}datatype' AND k.o_kind = 'iri' WHERE a.p = '{SH}or'),
sset AS (SELECT DISTINCT release, s AS shape FROM q WHERE s_kind = 'iri' AND (p = '{TYPE}' AND o = '{SH}NodeShape' AND o_kind = 'iri' OR p IN ('{SH}property', '{SH}targetClass', '{SH}targetSubjectsOf', '{SH}targetObjectsOf'))),
con AS MATERIALIZED (SELECT l.release, l.s AS shape, l.o AS node, l.seq AS listed, path_kind, path, name, description, list_sort(list_distinct(list_concat(coalesce(f.dts, []), coalesce(t.dts, [])))) AS datatypes, coalesce(classes, []) AS classes, node_kind, min_count, max_count, coalesce(v.vs, []) AS vals, coalesce(has, []) AS has_value, pattern, coalesce(z.schemes, []) AS in_scheme, inner_node, severity, coalesce(deactivated, false) AS deactivated,
    CASE WHEN coalesce(min_count, max_count) IS NOT NULL THEN coalesce(min_count, 0) || '..' || coalesce(CAST(max_count AS VARCHAR), '*') END AS cardinality, coalesce(min_count, 0) >= 1 AS required
  FROM q l LEFT JOIN (SELECT release, s AS node, {_ONE.format('name')} AS name, {_ONE.format('description')} AS description, {_SET.format('datatype')} AS dts, {_SET.format('class')} AS classes, {_IRI.format('nodeKind')} AS node_kind, CAST({_ONE.format('minCount')} AS BIGINT) AS min_count, CAST({_ONE.format('maxCount')} AS BIGINT) AS max_count,
      list(CASE o_kind WHEN 'bnode' THEN '_:' || o ELSE o END ORDER BY seq) FILTER (p = '{SH}hasValue') AS has, {_ONE.format('pattern')} AS pattern, {_IRI.format('node')} AS inner_node, {_IRI.format('severity')} AS severity, {_ONE.format('deactivated')} = 'true' AS deactivated FROM q WHERE starts_with(p, '{SH}') GROUP BY ALL) f ON f.release = l.release AND f.node = l.o
  LEFT JOIN pth ON pth.release = l.release AND pth.node = l.o
  LEFT JOIN (SELECT a.release, a.s AS node, list({_MEMBER.format('x.')} ORDER BY a.seq, x.nth) AS vs FROM q a JOIN lst x ON x.release = a.release AND x.head = a.o WHERE a.p = '{SH}in' GROUP BY ALL) v ON v.release = l.release AND v.node = l.o
  LEFT JOIN (SELECT release, node, list_sort(list(scheme)) AS schemes FROM sch GROUP BY ALL) z ON z.release = l.release AND z.node = l.o
  LEFT JOIN (SELECT release, node, list(dt) AS dts FROM ort GROUP BY ALL) t ON t.release = l.release AND t.node = l.o
  WHERE l.p = '{SH}property' AND l.s_kind = 'iri' AND l.o_kind <> 'literal'),
app AS MATERIALIZED (SELECT DISTINCT release, s AS shape, o AS class FROM q WHERE p = '{SH}targetClass' AND s_kind = 'iri' AND o_kind = 'iri'
  UNION SELECT x.release, x.shape, x.shape FROM sset x JOIN q ON q.release = x.release AND q.s = x.shape AND q.p = '{TYPE}' AND q.o IN ('{OWL}Class', '{RDFS}Class')
  UNION SELECT q.release, q.s, unnest(t.domain) FROM q JOIN terms t ON t.release = q.release AND t.iri = q.o WHERE q.p = '{SH}targetSubjectsOf' AND q.s_kind = 'iri'),
nsh AS MATERIALIZED (SELECT x.*, closed, list_sort(coalesce((SELECT list(class) FROM app a WHERE a.release = x.release AND a.shape = x.shape), [])) AS applies_to, (SELECT count(*) FROM con k WHERE k.release = x.release AND k.shape = x.shape) AS n_constraints
  FROM (SELECT sset.release, sset.shape, {', '.join(f"{_SET.format(p)} AS {n}" for n, p in shapes.TARGETS.items())}, CASE {_ONE.format('closed')} WHEN 'true' THEN true WHEN 'false' THEN false END AS closed FROM sset JOIN q ON q.release = sset.release AND q.s = sset.shape GROUP BY ALL) x),
nshape AS (SELECT * FROM nsh WHERE n_constraints > 0 OR len(target_classes) > 0 OR len(target_subjects_of) > 0),
ocon AS (SELECT *, CAST(row_number() OVER (PARTITION BY release, shape ORDER BY NOT required, name NULLS FIRST, path NULLS FIRST, listed) AS INTEGER) AS place FROM con)
"""


def query(name: str, build: Callable, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(model(spark, sf_dir))
    ORACLE[name] = SHAPES + sql


def joined(*names: str) -> list:
    return [F.array_join(n, " ").alias(n) for n in names]


def listed(*names: str) -> str:
    return ", ".join(f"array_to_string({n}, ' ') AS {n}" for n in names)


_LISTS = [SH + "in", SH + "or", SH + "path"]
query("rdf_list", lambda m: shapes.rdf_lists(m, m.quads.filter(c("p").isin(_LISTS) & (c("o_kind") != "literal")).select("release", c("o").alias("head")).distinct()), "SELECT release, head, nth, member, kind AS member_kind FROM lst")
query("shape_subjects", shapes.shape_subjects, "SELECT * FROM sset")
query("shape_path", shapes.paths, "SELECT * FROM pth")
query("or_datatypes", lambda m: shapes.or_datatypes(m).select("release", "node", *joined("or_datatypes")), "SELECT release, node, string_agg(dt, ' ' ORDER BY dt) AS or_datatypes FROM ort GROUP BY ALL")
query("nested_schemes", shapes.nested_schemes, "SELECT * FROM sch")
_FIELDS = ["release", "shape", "node", "path_kind", "path", "name", "description", "node_kind", "min_count", "max_count", "pattern", "severity", "deactivated", "cardinality", "required"]
query(
    "property_shapes",
    lambda m: shapes.constraints(m).withColumnsRenamed({"values": "vals", "inner": "inner_node"}).select(*_FIELDS, "inner_node", *joined("datatypes", "classes", "vals", "has_value", "in_scheme")),
    f"SELECT {', '.join(_FIELDS)}, inner_node, {listed('datatypes', 'classes', 'vals', 'has_value', 'in_scheme')} FROM con",
)
query("constraints_for_property", lambda m: shapes.constraints(m).filter("path_kind = 'predicate'").groupBy("release", "path").agg(F.count("*").alias("n"), F.count_if("required").alias("required")), "SELECT release, path, count(*) AS n, count(*) FILTER (required) AS required FROM con WHERE path_kind = 'predicate' GROUP BY ALL")
query("shape_applies_to", shapes.applies_to, "SELECT * FROM app")
query("node_shapes", lambda m: shapes.node_shapes(m).select("release", "shape", "closed", "n_constraints", *joined(*shapes.TARGETS, "applies_to")), f"SELECT release, shape, closed, n_constraints, {listed(*shapes.TARGETS, 'applies_to')} FROM nshape")
query("shapes_for_class", lambda m: shapes.shapes_for_class(m).select("release", "class", *joined("shapes")), "SELECT release, class, string_agg(shape, ' ' ORDER BY shape) AS shapes FROM (SELECT release, shape, unnest(applies_to) AS class FROM nshape) GROUP BY ALL")
_SHOWN = f"CASE path_kind WHEN 'inverse' THEN 'inverse of ' || {short('path')} WHEN 'predicate' THEN {short('path')} ELSE coalesce(path, '') END"
_EN = "coalesce(list_filter({0}, lambda v: v.lang = 'en')[1].value, list_filter({0}, lambda v: v.lang IS NULL)[1].value, {0}[1].value)"
_KINDS = "CASE nullif(regexp_extract(node_kind, '^(.*[#/])([^#/]+)$', 2), '') WHEN 'BlankNode' THEN 'blank node' WHEN 'Literal' THEN 'literal' WHEN 'IRIOrLiteral' THEN 'IRI or literal' ELSE nullif(regexp_extract(node_kind, '^(.*[#/])([^#/]+)$', 2), '') END"
query(
    "record_template",
    lambda m: shapes.record_template(m).withColumnRenamed("values", "vals").select("release", "shape", "place", "name", "path", "cardinality", "required", "value_type", "pattern", "description", "deactivated", *joined("in_scheme", "vals")),
    f"""SELECT o.release, o.shape, o.place, coalesce(o.name, CASE WHEN path_kind = 'predicate' THEN coalesce({_EN.format('t.labels')}, nullif(regexp_extract(path, '^(.*[#/])([^#/]+)$', 2), ''), path) END, {_SHOWN}) AS name, {_SHOWN} AS path, cardinality, required, coalesce(k.types, {_KINDS}, '') AS value_type, pattern, description, o.deactivated, {listed('in_scheme', 'vals').replace('(in_scheme', '(o.in_scheme')}
  FROM ocon o LEFT JOIN pof n ON n.release = o.release AND n.ns = {ns('path')} LEFT JOIN terms t ON t.release = o.release AND t.iri = o.path
  LEFT JOIN (SELECT x.release, x.shape, x.place, string_agg({short('x.iri')}, ' or ' ORDER BY nth) AS types FROM (SELECT release, shape, place, unnest(list_concat(datatypes, classes)) AS iri, generate_subscripts(list_concat(datatypes, classes), 1) AS nth FROM ocon) x LEFT JOIN pof n ON n.release = x.release AND n.ns = {ns('x.iri')} GROUP BY ALL) k ON k.release = o.release AND k.shape = o.shape AND k.place = o.place""",
)


def _names(column: str) -> str:
    return f"(SELECT list({short('x.iri')} ORDER BY nth) FROM (SELECT unnest({column}) AS iri, generate_subscripts({column}, 1) AS nth) x LEFT JOIN pof n ON n.release = s.release AND n.ns = {ns('x.iri')})"


query(
    "shape_targeting",
    shapes.targeting,
    f"""SELECT release, shape, CASE WHEN len(parts) = 0 THEN 'nothing on its own; it is used by another shape' ELSE array_to_string(parts, '; ') END AS targeting FROM (SELECT release, shape, list_concat(list_concat(CASE WHEN len(target_classes) > 0 THEN ['instances of ' || array_to_string({_names('target_classes')}, ', ')] ELSE [] END, list_transform(coalesce({_names('target_subjects_of')}, []), lambda x: 'anything with a ' || x || ' statement')),
  list_concat(list_transform(coalesce({_names('target_objects_of')}, []), lambda x: 'the values of ' || x), CASE WHEN len(target_nodes) > 0 THEN [len(target_nodes) || ' named nodes'] ELSE [] END)) AS parts FROM nshape s)""",
)
