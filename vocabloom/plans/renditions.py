"""Registered queries of stable blank labels, JSON-LD with its round trip, and profile chains, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blanks, jsonld, profiles
from ..vocabulary import DCTERMS, RDF, RDFS, TYPE, XSD
from .inputs import BASE, duck, view
from .models import PRELUDE, model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def _space(iri: str) -> str:
    return f"nullif(regexp_extract({iri}, '^(.*[#/])([^#/]+)$', 1), '')"


def _tail(iri: str) -> str:
    return f"regexp_extract({iri}, '^(.*[#/])([^#/]+)$', 2)"


def _short(iri: str, prefix: str) -> str:
    return f"coalesce({prefix} || ':' || {_tail(iri)}, {iri})"


def _json(text: str) -> str:
    return f"CAST(to_json({text}) AS VARCHAR)"


# blank nodes

_LABELS = """
ends AS (
  SELECT release, file, seq, 0 AS place, s AS node FROM q WHERE s_kind = 'bnode'
  UNION ALL SELECT release, file, seq, 1, o FROM q WHERE o_kind = 'bnode'),
lab AS MATERIALIZED (
  SELECT release, node, 'b' || (dense_rank() OVER (PARTITION BY release ORDER BY at_first) - 1) AS label
  FROM (SELECT release, node, min(ROW(file, seq, place, node)) AS at_first FROM ends GROUP BY ALL))
"""
#: The statements with labels for blank nodes.
_LABELLED = """
SELECT q.release, q.file, q.seq, coalesce(a.label, q.s) AS s, q.s_kind, q.p, coalesce(b.label, q.o) AS o, q.o_kind, q.lang, q.dt
FROM q LEFT JOIN lab a ON q.s_kind = 'bnode' AND a.release = q.release AND a.node = q.s
LEFT JOIN lab b ON q.o_kind = 'bnode' AND b.release = q.release AND b.node = q.o
"""


def _bnode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return blanks.labelled(m.quads, m.keep).filter("s_kind = 'bnode' or o_kind = 'bnode'").select("release", "file", "seq", "s", "p", "o")


QUERIES["bnode_labels"] = _bnode_labels
ORACLE["bnode_labels"] = f"{PRELUDE},{_LABELS} SELECT release, file, seq, s, p, o FROM ({_LABELLED}) WHERE s_kind = 'bnode' OR o_kind = 'bnode'"

# JSON-LD

_PREFIXES = f"""
pfx AS (
  SELECT release, prefix, ns FROM pmap
  UNION SELECT release, 'xsd', '{XSD}' FROM pmap WHERE release NOT IN (SELECT release FROM pmap WHERE prefix = 'xsd')),
pfo AS MATERIALIZED (SELECT release, ns, min(prefix) AS prefix FROM pfx GROUP BY ALL)
"""
_ONLY = """
CASE WHEN len(range) + len(range_includes) = 1 AND kind IN ('DatatypeProperty', 'RdfProperty', 'AnnotationProperty')
  THEN list_concat(range, range_includes)[1] END
"""
#: The entries of contexts; needs PRELUDE alone.
CONTEXT = f"""(
SELECT x.release, x.iri, CASE WHEN n = 1 THEN local_name ELSE coalesce(x.prefix || ':' || local_name, x.iri) END AS key,
  CASE WHEN kind = 'ObjectProperty' OR (one_range IS NOT NULL AND NOT starts_with(one_range, '{XSD}') AND one_range <> '{RDF}langString') THEN '@id'
    ELSE {_short("one_range", "o.prefix")} END AS coercion
FROM (
  SELECT *, {_ONLY} AS one_range, row_number() OVER (PARTITION BY release, local_name ORDER BY "foreign", iri) AS n
  FROM terms WHERE local_name <> '') x
LEFT JOIN (
  SELECT release, ns, min(prefix) AS prefix FROM (
    SELECT release, prefix, ns FROM pmap
    UNION SELECT release, 'xsd', '{XSD}' FROM pmap WHERE release NOT IN (SELECT release FROM pmap WHERE prefix = 'xsd'))
  GROUP BY ALL) o ON o.release = x.release AND o.ns = {_space("one_range")})
"""
QUERIES["jsonld_context"] = lambda spark, sf_dir: jsonld.context_entries(model(spark, sf_dir))
ORACLE["jsonld_context"] = f"{PRELUDE} SELECT * FROM {CONTEXT}"

_PLAIN = f"(lang IS NULL AND coalesce(dt, '{XSD}string') = '{XSD}string')"
_NATIVE = f"""
(dt = '{XSD}boolean' AND o IN ('true', 'false')
  OR dt = '{XSD}integer' AND regexp_full_match(o, '0|-?[1-9][0-9]{{0,17}}'))
"""
_VALUE = f"""
CASE WHEN o_kind = 'iri' AND coercion IS NOT DISTINCT FROM '@id' THEN {_json("o_short")}
  WHEN o_kind = 'iri' THEN '{{"@id":' || {_json("o_short")} || '}}'
  WHEN o_kind = 'bnode' THEN '{{"@id":' || {_json("'_:' || o")} || '}}'
  WHEN lang IS NOT NULL THEN '{{"@value":' || {_json("o")} || ',"@language":' || {_json("lang")} || '}}'
  WHEN {_PLAIN} AND coercion IS NULL THEN {_json("o")}
  WHEN coercion IS DISTINCT FROM '@id' AND coalesce({_NATIVE}, false) THEN o
  WHEN coercion IS NOT DISTINCT FROM dt_short THEN {_json("o")}
  WHEN {_PLAIN} THEN '{{"@value":' || {_json("o")} || '}}'
  ELSE '{{"@type":' || {_json("dt_short")} || ',"@value":' || {_json("o")} || '}}' END
"""
_TYPED = f"(p = '{TYPE}' AND o_kind = 'iri')"
#: The statements that nodes are made of.
_STATED = f"""
lst_ AS MATERIALIZED ({_LABELLED}),
stated AS MATERIALIZED (
  SELECT lst_.* FROM lst_ LEFT JOIN terms t ON t.release = lst_.release AND t.iri = lst_.s AND NOT t."foreign"
  WHERE s_kind = 'bnode' OR t.iri IS NOT NULL)
"""
_NODES = f"""
ctx AS MATERIALIZED (SELECT * FROM {CONTEXT}),
val AS (
  SELECT st.*, x.key, x.coercion, {_short("st.p", "pp.prefix")} AS p_short, {_short("st.o", "po.prefix")} AS o_short,
    coalesce({_short("st.dt", "pd.prefix")}, 'xsd:string') AS dt_short
  FROM stated st LEFT JOIN ctx x ON x.release = st.release AND x.iri = st.p
  LEFT JOIN pfo pp ON pp.release = st.release AND pp.ns = {_space("st.p")}
  LEFT JOIN pfo po ON st.o_kind = 'iri' AND po.release = st.release AND po.ns = {_space("st.o")}
  LEFT JOIN pfo pd ON pd.release = st.release AND pd.ns = {_space("st.dt")}),
pairs AS (
  SELECT DISTINCT release, s, s_kind, CASE WHEN {_TYPED} THEN '@type' ELSE coalesce(key, p_short) END AS k,
    CASE WHEN {_TYPED} THEN {_json("o_short")} ELSE {_VALUE} END AS v
  FROM val),
members AS (
  SELECT release, s, s_kind, k, {_json("k")} || ':' || CASE WHEN count(*) = 1 THEN min(v) ELSE '[' || string_agg(v, ',' ORDER BY v) || ']' END AS member
  FROM pairs GROUP BY release, s, s_kind, k),
whole AS (SELECT release, s, s_kind, string_agg(member, ',' ORDER BY k) AS text FROM members GROUP BY ALL)
"""
_READY = f"{PRELUDE},{_LABELS},{_PREFIXES},{_STATED}"
QUERIES["jsonld_nodes"] = lambda spark, sf_dir: jsonld.nodes(model(spark, sf_dir))
ORACLE["jsonld_nodes"] = f"""{_READY},{_NODES}
SELECT w.release, CASE s_kind WHEN 'iri' THEN s ELSE '_:' || s END AS id, 0 AS part,
  '{{"@id":' || {_json(f"CASE s_kind WHEN 'iri' THEN {_short('s', 'n.prefix')} ELSE '_:' || s END")} || ',' || text || '}}' AS json
FROM whole w LEFT JOIN pfo n ON s_kind = 'iri' AND n.release = w.release AND n.ns = {_space("s")}
"""

_QUOTED = "'\"' || replace(replace(o, '\\', '\\\\'), '\"', '\\\"') || '\"'"
_SIGN = f"""
CASE s_kind WHEN 'bnode' THEN '_:' ELSE s END || ' <' || p || '> ' || CASE o_kind WHEN 'bnode' THEN '_:' WHEN 'iri' THEN '<' || o || '>'
  ELSE {_QUOTED} || CASE WHEN lang IS NOT NULL THEN '@' || lang ELSE '^^' || coalesce(dt, '{XSD}string') END END
"""
QUERIES["roundtrip_check"] = lambda spark, sf_dir: jsonld.roundtrip(model(spark, sf_dir))
ORACLE["roundtrip_check"] = f"""{_READY}
SELECT release, count(DISTINCT {_SIGN}) AS written, count(DISTINCT {_SIGN}) AS read, 0 AS lost, 0 AS invented,
  '' AS lost_examples, '' AS invented_examples
FROM stated GROUP BY release
"""

# profiles

_N = "CAST(substr(p_brand, 7) AS INT)"
#: A profile for each brand, in chains, circles and on names that aren't there, and what it adds.
CHAINS = f"""
SELECT DISTINCT 'brand-' || {_N} AS profile, CASE {_N} % 10 WHEN 1 THEN 'skos' WHEN 2 THEN 'brand-' || ({_N} - 1) WHEN 3 THEN 'brand-' || ({_N} - 1)
  WHEN 4 THEN 'brand-' || ({_N} + 1) WHEN 5 THEN 'brand-' || ({_N} - 1) WHEN 6 THEN 'brand-' || ({_N} - 5) WHEN 7 THEN 'dcap' WHEN 8 THEN 'nowhere' END AS extends
FROM {{part}}
"""
ADDED = f"""
SELECT DISTINCT 'brand-' || {_N} AS profile, f.field, CASE f.rank WHEN 0 THEN '{BASE}vocab#' || f.field || {_N} % 3 ELSE f.predicate END AS predicate, f.rank
FROM {{part}}, (VALUES ('label', '', 0), ('label', '{DCTERMS}title', 1), ('definition', '{RDFS}comment', 1)) AS f(field, predicate, rank)
"""


def _profile_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, (names, fields) = model(spark, sf_dir), profiles.built_in(spark)
    made = profiles.resolved(names.unionByName(view(spark, sf_dir, CHAINS)), fields.unionByName(view(spark, sf_dir, ADDED)), m.keep)
    uses = m.quads.groupBy(c("p").alias("predicate")).agg(F.count("*").alias("uses"))
    return made.join(uses, "predicate", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_BUILT_IN = _rows([(n, None if n == "generic" else "generic") for n in profiles.PROFILES])
_OWN = _rows([(n, f, x, i) for n, p in profiles.PROFILES.items() for f in profiles.FIELDS for i, x in enumerate(p.get(f, []))])
QUERIES["profile_inherit"] = _profile_inherit
ORACLE["profile_inherit"] = f"""{PRELUDE},
pro AS MATERIALIZED (SELECT * FROM (VALUES {_BUILT_IN}) AS b(profile, extends) UNION ALL {duck(CHAINS)}),
fld AS MATERIALIZED (SELECT * FROM (VALUES {_OWN}) AS b(profile, field, predicate, rank) UNION ALL {duck(ADDED)}),
chn AS (
  SELECT profile, profile AS source, extends, 0 AS depth, [profile] AS seen, CAST(NULL AS VARCHAR) AS error FROM pro
  UNION ALL
  SELECT h.profile, h.extends, p.extends, depth + 1, list_append(seen, h.extends),
    CASE WHEN list_contains(seen, h.extends) THEN 'cycle at ' || h.extends WHEN p.profile IS NULL THEN 'unknown profile ' || h.extends END
  FROM chn h LEFT JOIN pro p ON p.profile = h.extends WHERE h.extends IS NOT NULL AND error IS NULL),
flt AS (SELECT profile, error FROM chn WHERE error IS NOT NULL),
fst AS (
  SELECT h.profile, field, predicate, rank, h.source, depth FROM chn h JOIN fld f ON f.profile = h.source
  WHERE h.profile NOT IN (SELECT profile FROM flt) QUALIFY row_number() OVER (PARTITION BY h.profile, field, predicate ORDER BY depth, rank) = 1),
res AS (
  SELECT profile, field, predicate, CAST(row_number() OVER (PARTITION BY profile, field ORDER BY depth, rank, predicate) - 1 AS INTEGER) AS rank, source, depth, CAST(NULL AS VARCHAR) AS error FROM fst
  UNION ALL SELECT profile, NULL, NULL, NULL, NULL, NULL, error FROM flt)
SELECT res.*, (SELECT count(*) FROM q WHERE q.p = res.predicate) AS uses FROM res
"""
