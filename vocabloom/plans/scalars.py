"""Registered queries of the scalar functions, each over a whole table, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, http, iri, text
from ..vocabulary import FORMAT_ALIASES, MEDIA_TYPES, QUERY_ALIASES, RDF_HINTS, RDF_TYPES, WELL_KNOWN_PREFIXES, XSD
from .inputs import ACCEPTS, BASE, IRIS, LABELS, PATHS, PREFIXES, TEXTS, URLS, duck, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
c = F.col


def scalar(name: str, source: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    """Register k and some columns over a view."""
    QUERIES[name] = lambda spark, sf_dir: view(spark, sf_dir, source).select("k", *(e.alias(n) for n, e in columns().items()))
    ORACLE[name] = f"SELECT k, {sql} FROM ({duck(source)}) AS v"


_NS, _LOCAL = "regexp_extract(iri, '^(.*[#/])([^#/]+)$', 1)", "regexp_extract(iri, '^(.*[#/])([^#/]+)$', 2)"
_KNOWN = "CASE {} " + " ".join(f"WHEN '{ns}' THEN '{p}'" for p, ns in WELL_KNOWN_PREFIXES.items()) + " END"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_NAME = f"coalesce(nullif({_LOCAL}, ''), iri)"

scalar("split_iri", IRIS, lambda: {"ns": iri.namespace_part(c("iri")), "local": iri.local_part(c("iri"))}, f"nullif({_NS}, '') AS ns, nullif({_LOCAL}, '') AS local")
scalar("local_name", IRIS, lambda: {"local": iri.local_name(c("iri"))}, f"{_NAME} AS local")
scalar("humanise", IRIS, lambda: {"words": iri.humanise(c("iri"))}, f"translate(translate(left({_NAME}, 1) || regexp_replace(substr({_NAME}, 2), '([A-Z])', ' \\1', 'g'), {_AZ}), '_-', '  ') AS words")
scalar("flip_first", IRIS, lambda: {"flipped": iri.flip_first(iri.local_name(c("iri")))}, f"CASE WHEN regexp_matches({_NAME}, '^[A-Z]') THEN lower(left({_NAME}, 1)) || substr({_NAME}, 2) WHEN regexp_matches({_NAME}, '^[a-z]') THEN upper(left({_NAME}, 1)) || substr({_NAME}, 2) ELSE {_NAME} END AS flipped")
scalar("licence_label", IRIS, lambda: {"licence": iri.licence_label(c("iri"))}, "CASE WHEN iri LIKE 'https://creativecommons.org/licenses/%' THEN 'CC ' || upper(split_part(iri, '/', 5)) || ' ' || split_part(iri, '/', 6) ELSE iri END AS licence")
scalar("mount_from_iri", IRIS, lambda: {"mount": iri.mount_from_iri(c("iri"))}, "CASE WHEN position('/' IN regexp_replace(iri, '^.*?//', '')) = 0 THEN '' ELSE CASE WHEN rtrim(regexp_replace(regexp_replace(iri, '^.*?//', ''), '^[^/]*/', ''), '#') IN ('') THEN '' ELSE rtrim(rtrim(regexp_replace(regexp_replace(iri, '^.*?//', ''), '^[^/]*/', ''), '#'), '/') || '/' END END AS mount")
scalar("default_base_url", IRIS, lambda: {"root": iri.site_root(c("iri"))}, "regexp_extract(iri, '^(.*?//[^/]*)', 1) || '/' AS root")
scalar("base_path", URLS, lambda: {"base": iri.base_path(c("url"))}, "CASE WHEN trim(regexp_extract(url, '^.*?//[^/]*(/.*)$', 1), '/') = '' THEN '/' ELSE '/' || trim(regexp_extract(url, '^.*?//[^/]*(/.*)$', 1), '/') || '/' END AS base")
scalar("origin_of", URLS, lambda: {"origin": iri.origin_of(c("url"))}, "split_part(url, '//', 1) || '//' || split_part(substr(url, position('//' IN url) + 2), '/', 1) AS origin")
scalar("rehost", URLS, lambda: {"moved": iri.rehost(c("url"), F.lit("https://thther.example.org/"), F.lit("https://staging.example/"))}, "CASE WHEN starts_with(url, 'https://thther.example.org') THEN 'https://staging.example' || substr(url, 27) ELSE url END AS moved")
scalar("redact_url", URLS, lambda: {"shown": iri.redact_url(c("url"))}, "replace(url, 'user:pa:ss@', 'user:***@') AS shown")
scalar("has_userinfo", URLS, lambda: {"has_userinfo": iri.has_userinfo(c("url"))}, "contains(regexp_extract(url, '//([^/?#]*)', 1), '@') AS has_userinfo")
scalar("valid_base_url", URLS, lambda: {"fault": iri.base_url_fault(c("url"))}, "CASE WHEN NOT (url LIKE 'http://%' OR url LIKE 'https://%') THEN 'not absolute' WHEN regexp_extract(url, '//([^/?#]*)', 1) = '' THEN 'no host' WHEN contains(url, ' ') THEN 'white space' WHEN contains(regexp_extract(url, '//([^/?#]*)', 1), '@') THEN 'credentials' END AS fault")
scalar("media_type_of", PATHS, lambda: {"type": iri.media_type_of(c("b"))}, "CASE regexp_extract(b, '\\.([^.]*)$', 1) " + " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in MEDIA_TYPES.items()) + " ELSE 'application/octet-stream' END AS type")
scalar("relative_to", PATHS, lambda: {"ref": iri.relative_to(c("a"), c("b"))}, """(SELECT coalesce(nullif(repeat('../', len(x) - n) || array_to_string(list_transform(y[n + 1:], lambda d: d || '/'), '') || split_part(b, '/', -1), ''), './')
  FROM (SELECT x, y, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])) AS n FROM (SELECT list_filter(string_split(regexp_extract(a, '^(.*)/[^/]*$', 1), '/'), lambda s: s <> '') AS x, list_filter(string_split(regexp_extract(b, '^(.*)/[^/]*$', 1), '/'), lambda s: s <> '') AS y))) AS ref""")
scalar("relative_root", PATHS, lambda: {"root": iri.relative_root(c("a"))}, "repeat('../', len(string_split(a, '/')) - 1) AS root")
scalar("relative_href", URLS, lambda: {"href": iri.relative_href(c("url"), F.lit("https://m.therou.example.com/"), F.lit("../"))}, "CASE WHEN starts_with(url, 'https://m.therou.example.com/') THEN '../' || ltrim(substr(url, 30), '/') ELSE url END AS href")
_LINKS = "SELECT c_custkey AS k, regexp_replace(a, '^/+', '') AS page, CASE c_custkey % 8 WHEN 0 THEN '../' || regexp_replace(b, '^/+', '') WHEN 1 THEN b WHEN 2 THEN 'mailto:x' WHEN 3 THEN '#top' WHEN 4 THEN './x/../y?q=1#z' WHEN 5 THEN 'https://tpch.example.org/vocab' || b WHEN 6 THEN '//other/' ELSE '../../../z' END AS href FROM (" + PATHS.replace("SELECT c_custkey AS k", "SELECT c_custkey") + ") p"
scalar("resolve_internal", _LINKS, lambda: {"target": iri.resolve_internal(c("page"), c("href"), F.lit(BASE), F.lit("/vocab/"))}, """CASE WHEN href IN ('mailto:x', '#top', '//other/') THEN NULL WHEN starts_with(href, 'https:') THEN ltrim(substr(href, 26), '/')
  WHEN starts_with(href, '/') THEN ltrim(CASE WHEN starts_with(href, '/vocab/') THEN substr(href, 8) ELSE href END, '/')
  ELSE array_to_string(list_reduce(list_concat([list_filter(string_split(regexp_extract(page, '^(.*)/[^/]*$', 1), '/'), lambda s: s <> '')], list_transform(string_split(split_part(split_part(href, '#', 1), '?', 1), '/'), lambda s: [s])), lambda x, y: CASE WHEN y[1] IN ('', '.') THEN x WHEN y[1] = '..' THEN x[1:greatest(len(x) - 1, 0)] ELSE list_concat(x, y) END), '/') END AS target""")
scalar("percent_decode", "SELECT p_partkey AS k, '/part/' || replace(p_name, ' ', CASE p_partkey % 4 WHEN 0 THEN '%20' WHEN 1 THEN '+' WHEN 2 THEN '%C3%A9' ELSE '%2B' END) AS path FROM {part}", lambda: {"path": iri.percent_decode(c("path"))}, "url_decode(path) AS path")

scalar("oneline", TEXTS, lambda: {"line": text.oneline(c("text"))}, "trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line")
_LINE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
scalar("summary", TEXTS, lambda: {"summary": text.summary(c("text"))}, f"CASE WHEN contains({_LINE}, '. ') AND strlen(split_part({_LINE}, '. ', 1)) > 40 THEN split_part({_LINE}, '. ', 1) || '.' ELSE {_LINE} END AS summary")
scalar("yaml_scalar", TEXTS, lambda: {"yaml": text.yaml_scalar(c("text"))}, "'\"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\"' AS yaml")
scalar("abstract_paragraphs", "SELECT doc_id AS k, replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) ELSE '  ' END) AS text FROM {documents}", lambda: {"n": F.size(text.paragraphs(c("text"))).cast("long"), "joined": F.array_join(text.paragraphs(c("text")), "|")}, "len(ps) AS n, array_to_string(ps, '|') AS joined".replace("ps", "list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '')"))
_TITLES = "SELECT p_partkey AS k, repeat(p_name || ' ', p_size % 9 + 1) || 'é' AS label, CASE WHEN p_partkey % 3 > 0 THEN 'part:' || p_partkey END AS curie, p_brand AS site FROM {part}"
_HEAD = "CASE WHEN length(coalesce(label || ' (' || curie || ')', label)) <= 70 THEN coalesce(label || ' (' || curie || ')', label) ELSE label END"
scalar("page_title", _TITLES, lambda: {"title": text.page_title(c("label"), c("curie"), c("site"))}, f"CASE WHEN length({_HEAD}) + 3 + length(site) <= 70 THEN {_HEAD} || ' — ' || site WHEN length({_HEAD}) <= 70 THEN {_HEAD} ELSE rtrim(left({_HEAD}, 69)) || '…' END AS title")
scalar("rule_heading", "SELECT p_partkey AS k, lower(p_type) || '.' || replace(p_name, ' ', '-') || '_x' AS rule FROM {part}", lambda: {"heading": text.rule_heading(c("rule"))}, "upper(left(rule, 1)) || substr(regexp_replace(rule, '[-._]', ' ', 'g'), 2) AS heading")
_TAGS = "SELECT doc_id AS k, CASE doc_id % 7 WHEN 0 THEN lang WHEN 1 THEN lang || '-' || upper(lang) WHEN 2 THEN lang || '_x' WHEN 3 THEN '' WHEN 4 THEN lang || '-' WHEN 5 THEN lang || '-123456789' ELSE 'é' END AS tag FROM {documents} WHERE lang IS NOT NULL"
scalar("language_tag_valid", _TAGS, lambda: {"valid": text.language_tag_valid(c("tag"))}, "len(list_filter(string_split(tag, '-'), lambda p: NOT (length(p) BETWEEN 1 AND 8 AND regexp_matches(p, '^[A-Za-z0-9]+$')))) = 0 AS valid")
_VERSIONS = "SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN '1.' || o_orderkey || '.0' WHEN 2 THEN substr(CAST(o_orderdate AS STRING), 1, 10) WHEN 3 THEN 'v1' WHEN 4 THEN '1.0-rc.' || o_orderkey WHEN 5 THEN '1..0' WHEN 6 THEN '-1' WHEN 7 THEN '1.0/' || o_orderkey ELSE '2.0+build_' || o_orderkey END AS version FROM {orders}"
scalar("looks_like_version", _VERSIONS, lambda: {"is_version": text.looks_like_version(c("version"))}, "k % 9 IN (0, 1, 2, 4, 8) AS is_version")
scalar("pdf_timestamp", "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '1969-12-31' WHEN 1 THEN 'soon' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) || 'T10' END AS day FROM {orders}", lambda: {"seconds": text.day_seconds(c("day"))}, "CASE WHEN k % 5 > 1 THEN CAST(epoch(CAST(left(day, 10) AS DATE)) AS BIGINT) END AS seconds")
_COUNTS = "SELECT p_partkey AS k, CASE WHEN p_size % 3 > 0 THEN p_size % 3 - 1 END AS least, CASE WHEN p_size % 5 > 1 THEN p_size % 5 END AS most FROM {part}"
scalar("cardinality", _COUNTS, lambda: {"cardinality": text.cardinality(c("least"), c("most")), "required": text.required(c("least"))}, "CASE WHEN coalesce(least, most) IS NOT NULL THEN coalesce(least, 0) || '..' || coalesce(CAST(most AS VARCHAR), '*') END AS cardinality, coalesce(least, 0) >= 1 AS required")

scalar("format_alias", "SELECT event_id AS k, CASE event_id % 8 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/turtle' WHEN 3 THEN 'application/ld+json' WHEN 4 THEN 'application/rdf+xml' WHEN 5 THEN 'application/n-triples' WHEN 6 THEN 'application/trig' ELSE event_type END AS type FROM {events}", lambda: {"alias": http.format_alias(c("type")), "is_rdf": http.is_rdf(c("type")), "looks_rdf": http.looks_like_rdf(c("type"))}, "CASE type " + " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in FORMAT_ALIASES.items()) + f" ELSE '' END AS alias, type IN {tuple(RDF_TYPES)} AS is_rdf, " + " OR ".join(f"contains(type, '{h}')" for h in RDF_HINTS) + " AS looks_rdf")
scalar("query_alias", "SELECT event_id AS k, CASE event_id % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'markdown' WHEN 2 THEN 'ttl' WHEN 3 THEN 'json' WHEN 4 THEN 'text/' || event_type ELSE event_type END AS value FROM {events}", lambda: {"type": http.query_alias(c("value"))}, "CASE value " + " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in QUERY_ALIASES.items()) + " ELSE CASE WHEN contains(value, '/') THEN value END END AS type")
scalar("parse_accept", ACCEPTS, lambda: {"types": F.array_join(http.parse_accept(c("accept")), " ")}, """(SELECT coalesce(string_agg(type, ' ' ORDER BY q DESC, i), '') FROM (SELECT i, lower(trim(split_part(p, ';', 1))) AS type, coalesce(TRY_CAST(trim(regexp_extract(p, ';\\s*q\\s*=([^;]*)', 1)) AS DOUBLE), 1.0) AS q FROM (SELECT unnest(string_split(accept, ',')) AS p, generate_subscripts(string_split(accept, ','), 1) AS i)) WHERE type <> '' AND q > 0) AS types""")
scalar("query_override", ACCEPTS, lambda: {"value": http.query_override(c("query"))}, "CASE WHEN query = 'format=ttl' THEN 'ttl' WHEN query LIKE 'a=1&%' THEN 'text/turtle' WHEN query = 'x&_profile=' THEN '' END AS value")
scalar("content_type_is", ACCEPTS, lambda: {"is_html": http.content_type_is(c("content_type"), F.lit("text/html")), "is_jsonld": http.content_type_is(c("content_type"), F.lit("application/ld+json"))}, "trim(lower(split_part(content_type, ';', 1))) = 'text/html' AS is_html, trim(lower(split_part(content_type, ';', 1))) = 'application/ld+json' AS is_jsonld")
scalar("varies_on_accept", ACCEPTS, lambda: {"varies": http.varies_on_accept(c("vary"))}, "list_contains(list_transform(string_split(lower(vary), ','), lambda t: trim(t)), 'accept') AS varies")

_COLOURS = "SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN '#12345' ELSE '#' || lower(substr(hex(1000000000 + p_partkey * 7919), 3, 6)) END AS a, '#' || substr(hex(1000000000 + p_partkey * 104729), 3, 6) AS b FROM {part}"


def _luminance(colour: str) -> str:
    part = "(CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END)"
    return " + ".join(f"{w} * " + part.format(f"(CAST(('0x' || substr({colour}, {i}, 2)) AS INTEGER) / 255.0)") for w, i in ((0.2126, 2), (0.7152, 4), (0.0722, 6)))


scalar("parse_srgb", _COLOURS, lambda: {"r": colour.channel(c("a"), 0), "g": colour.channel(c("a"), 1), "b": colour.channel(c("a"), 2)}, ", ".join(f"CASE WHEN regexp_matches(v.a, '^#[0-9A-Fa-f]{{6}}$') THEN CAST(('0x' || substr(v.a, {i}, 2)) AS INTEGER) END AS {n}" for n, i in (("r", 2), ("g", 4), ("b", 6))))
scalar("relative_luminance", _COLOURS, lambda: {"luminance": F.round(colour.relative_luminance(c("b")), 9)}, f"round({_luminance('v.b')}, 9) AS luminance")
_BOTH = f"CASE WHEN length(v.a) = 7 THEN {_luminance('v.a')} END", _luminance("v.b")
scalar("contrast_ratio", _COLOURS, lambda: {"ratio": F.round(colour.contrast_ratio(c("a"), c("b")), 6)}, f"round((CASE WHEN length(v.a) = 7 THEN greatest({_BOTH[0]}, {_BOTH[1]}) END + 0.05) / (least({_BOTH[0]}, {_BOTH[1]}) + 0.05), 6) AS ratio")

_NODES = "SELECT p_partkey AS k, p_name || CASE WHEN p_size = 3 THEN ' \"x\"' ELSE '' END AS o, CASE p_partkey % 4 WHEN 0 THEN 'iri' WHEN 1 THEN 'bnode' ELSE 'literal' END AS o_kind, CASE WHEN p_partkey % 4 = 2 THEN 'en' END AS lang, CASE WHEN p_partkey % 8 = 3 THEN 'http://www.w3.org/2001/XMLSchema#token' END AS dt, CASE WHEN p_partkey % 3 = 0 THEN 'bnode' ELSE 'iri' END AS s_kind FROM {part}"
scalar("term_scalar", _NODES, lambda: {"value": text.term_scalar(c("o"), c("o_kind"))}, "CASE WHEN o_kind <> 'bnode' THEN o END AS value")
scalar("node_key", _NODES, lambda: {"key": text.node_key(c("o"), c("o_kind"))}, "CASE o_kind WHEN 'iri' THEN o WHEN 'bnode' THEN '_:' || o END AS key")
scalar("triple_signature", _NODES, lambda: {"signature": text.triple_signature(F.concat(F.lit("s"), c("k")), c("s_kind"), F.lit("p"), c("o"), c("o_kind"), c("lang"), c("dt"))}, f"""CASE s_kind WHEN 'bnode' THEN '_:' ELSE 's' || k END || ' <p> ' || CASE o_kind WHEN 'bnode' THEN '_:' WHEN 'iri' THEN '<' || o || '>' ELSE '"' || replace(o, '"', '\\"') || '"' || CASE WHEN lang IS NOT NULL THEN '@' || lang ELSE '^^' || coalesce(dt, '{XSD}string') END END AS signature""")
_JSON = f"SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN '0' || p_size WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN 'true' ELSE p_name END AS o, CASE p_partkey % 7 WHEN 3 THEN 'iri' WHEN 4 THEN 'bnode' ELSE 'literal' END AS o_kind, CASE WHEN p_partkey % 7 = 5 THEN 'en' END AS lang, CASE WHEN p_partkey % 7 < 2 THEN '{XSD}integer' WHEN p_partkey % 7 = 2 THEN '{XSD}boolean' END AS dt, CASE p_size % 3 WHEN 0 THEN '@id' WHEN 1 THEN 'xsd:integer' END AS coercion FROM {{part}}"
scalar("jsonld_value", _JSON, lambda: {"json": text.jsonld_value(c("o"), c("o_kind"), c("lang"), c("dt"), c("o"), c("coercion"), F.replace(c("dt"), F.lit(XSD), F.lit("xsd:")))}, f"""CASE WHEN o_kind = 'iri' AND coercion = '@id' THEN '"' || o || '"' WHEN o_kind = 'iri' THEN '{{"@id":"' || o || '"}}' WHEN o_kind = 'bnode' THEN '{{"@id":"_:' || o || '"}}' WHEN lang IS NOT NULL THEN '{{"@value":"' || o || '","@language":"' || lang || '"}}'
  WHEN dt IS NULL AND coercion IS NULL THEN '"' || o || '"' WHEN coalesce(coercion, '') <> '@id' AND k % 7 IN (1, 2) THEN o WHEN coercion = 'xsd:integer' AND k % 7 < 2 THEN '"' || o || '"' WHEN dt IS NULL THEN '{{"@value":"' || o || '"}}' ELSE '{{"@type":"' || replace(dt, '{XSD}', 'xsd:') || '","@value":"' || o || '"}}' END AS json""")


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prefix, in alphabetical order, that a file declares for each namespace."""
    return view(spark, sf_dir, PREFIXES).groupBy("ns").agg(F.min("prefix").alias("declared"))


def curie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, IRIS).withColumn("ns", iri.namespace_part(c("iri")))
    short = iri.curie(c("iri"), c("declared"))
    return rows.join(_declared(spark, sf_dir), "ns", "left").select("k", short.alias("curie"), F.coalesce(short, "iri").alias("short"))


def prefix_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = view(spark, sf_dir, IRIS).select(iri.namespace_part(c("iri")).alias("ns")).dropna().distinct()
    return spaces.join(_declared(spark, sf_dir), "ns", "left").select("ns", F.coalesce("declared", iri.well_known(c("ns"))).alias("prefix"))


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, LABELS).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("seq", "lang", "value"))).alias("labels"))
    return rows.withColumn("picked", text.pick_lang(c("labels"), F.lit("en")))


def pick_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(spark, sf_dir).select("k", c("picked.value").alias("value"), c("picked.lang").alias("lang"))


def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view(spark, sf_dir, "SELECT p_partkey AS k FROM {part}")
    return parts.join(_picked(spark, sf_dir), "k", "left").select("k", F.coalesce("picked.value", c("k").cast("string")).alias("display"))


_DECLARED = f"(SELECT ns, min(prefix) AS declared FROM ({PREFIXES}) AS p GROUP BY ns)"
_PICKED = f"(SELECT k, arg_min(struct_pack(value := value, lang := coalesce(lang, '')), (CASE WHEN lang = 'en' THEN 0 WHEN lang IS NULL THEN 1 ELSE 2 END) * 10 + seq) AS picked FROM ({duck(LABELS)}) AS l GROUP BY k)"
_SHORT = f"coalesce(declared, {_KNOWN.format('ns')}) || ':' || local"
QUERIES |= {f.__name__: f for f in (curie, prefix_for, pick_lang, display)}
ORACLE |= {
    "curie": f"SELECT k, {_SHORT} AS curie, coalesce({_SHORT}, iri) AS short FROM (SELECT k, iri, nullif({_NS}, '') AS ns, {_LOCAL} AS local FROM ({duck(IRIS)}) AS i) LEFT JOIN {_DECLARED} USING (ns)",
    "prefix_for": f"SELECT ns, coalesce(declared, {_KNOWN.format('ns')}) AS prefix FROM (SELECT DISTINCT nullif({_NS}, '') AS ns FROM ({duck(IRIS)}) AS i) LEFT JOIN {_DECLARED} USING (ns) WHERE ns IS NOT NULL",
    "pick_lang": f"SELECT k, picked.value AS value, nullif(picked.lang, '') AS lang FROM {_PICKED}",
    "display": f"SELECT p_partkey AS k, coalesce(picked.value, CAST(p_partkey AS VARCHAR)) AS display FROM part LEFT JOIN {_PICKED} ON k = p_partkey",
}
