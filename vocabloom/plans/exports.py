"""Registered queries of lookups, views and exports of a model and its site, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import http, text
from ..functions import iri as I
from ..operators import compare, describe, profiles, shapes
from ..operators.model import HEADER_IRIS, HEADER_SCALARS, KEY, TERM_KINDS, large
from ..sources import ntriples
from ..sources.tables import shared_path, written
from ..vocabulary import DCTERMS, OWL, RDF, RDFS, TYPE, XSD
from .changes import EVERY_CHANGE
from .inputs import duck, view
from .models import PRELUDE, kept, model
from .publish import REPS, SITE, layout
from .renditions import CONTEXT as _CONTEXT
from .shacl import SHAPES, ns, short

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def on_model(name: str, build: Callable, sql: str, prelude: str = PRELUDE) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(model(spark, sf_dir))
    ORACLE[name] = prelude + sql


def on_site(name: str, build: Callable, sql: str, prelude: str = SITE) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(layout(spark, sf_dir))
    ORACLE[name] = prelude + sql


_EN = "coalesce(list_filter({0}, lambda v: v.lang = 'en')[1].value, list_filter({0}, lambda v: v.lang IS NULL)[1].value, {0}[1].value)"
_LABEL = f"coalesce({_EN.format('t.labels')}, t.local_name)"
_LOCAL = "nullif(regexp_extract({0}, '^(.*[#/])([^#/]+)$', 2), '')"
_LINE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"

# lookups
_USED = "(SELECT DISTINCT release, o AS iri FROM q WHERE o_kind = 'iri' AND p IN ('" + TYPE + "', '" + RDFS + "subClassOf'))"
on_model("short", lambda m: shapes.short_forms(m, m.quads.filter((c("o_kind") == "iri") & c("p").isin(TYPE, RDFS + "subClassOf")).select("release", c("o").alias("iri")).distinct(), "iri").select("release", "iri", "short"), f"SELECT x.release, x.iri, {short('x.iri')} AS short FROM {_USED} x LEFT JOIN pof n ON n.release = x.release AND n.ns = {ns('x.iri')}", SHAPES)
on_model("term_key", lambda m: m.quads.groupBy("release", "o_kind", text.node_key(c("o"), c("o_kind")).alias("key")).agg(F.count("*").alias("n")), "SELECT release, o_kind, CASE o_kind WHEN 'iri' THEN o WHEN 'bnode' THEN '_:' || o END AS key, count(*) AS n FROM q GROUP BY ALL")
on_model("term_iri", lambda m: m.quads.groupBy("release", text.term_iri(c("o"), c("o_kind")).alias("iri")).agg(F.count("*").alias("n")), "SELECT release, CASE o_kind WHEN 'iri' THEN o END AS iri, count(*) AS n FROM q GROUP BY ALL")
on_model("object", lambda m: m.quads.filter(c("p") == RDFS + "comment").groupBy("release", "s").agg(F.min_by("o", "seq").alias("object")), f"SELECT release, s, arg_min(o, seq) AS object FROM q WHERE p = '{RDFS}comment' GROUP BY ALL")
on_model("has_type", lambda m: m.quads.filter((c("p") == TYPE) & (c("o_kind") == "iri")).groupBy("release", "s").agg((F.count_if(c("o") == OWL + "Class") > 0).alias("is_class")), f"SELECT release, s, bool_or(o = '{OWL}Class') AS is_class FROM q WHERE p = '{TYPE}' AND o_kind = 'iri' GROUP BY ALL")
on_model("local_terms", lambda m: m.local.select(*KEY, "kind"), 'SELECT release, iri, kind FROM terms WHERE NOT "foreign"')
on_model("term_lookup", lambda m: m.quads.filter(c("p") == RDFS + "subClassOf").select("release", c("o").alias("iri")).distinct().join(large(m.terms.select(*KEY, "kind", "foreign")), KEY, "left"), f"SELECT x.release, x.iri, kind, \"foreign\" FROM (SELECT DISTINCT release, o AS iri FROM q WHERE p = '{RDFS}subClassOf') x LEFT JOIN terms t ON t.release = x.release AND t.iri = x.iri")
on_model("document_lookup", lambda m: m.placed.groupBy("release", c("defined_in").alias("iri")).agg(F.count("*").alias("n")).join(m.documents.select(*KEY, "document_kind"), KEY, "left"), "SELECT x.release, x.iri, n, document_kind FROM (SELECT release, defined_in AS iri, count(*) AS n FROM placed GROUP BY ALL) x LEFT JOIN docs d ON d.release = x.release AND d.iri = x.iri")
on_model("iri_values", lambda m: m.named.filter((c("o_kind") == "iri") & c("p").isin(RDFS + "isDefinedBy", RDFS + "seeAlso", DCTERMS + "isReplacedBy")).groupBy("release", "s").agg(F.array_join(F.array_sort(F.collect_set("o")), " ").alias("iris")), f"SELECT release, s, string_agg(DISTINCT o, ' ' ORDER BY o) AS iris FROM q WHERE s_kind = 'iri' AND o_kind = 'iri' AND p IN ('{RDFS}isDefinedBy', '{RDFS}seeAlso', '{DCTERMS}isReplacedBy') GROUP BY ALL")
on_model("profile_list", lambda m: profiles.detection(m.spark).select("profile", "title").join(m.document_profiles.groupBy("profile").agg(F.count("*").alias("documents")), "profile", "left"), "SELECT l.profile, l.title, documents FROM (VALUES " + ", ".join(f"('{k}', '{v['title']}')" for k, v in profiles.PROFILES.items()) + ") AS l(profile, title) LEFT JOIN (SELECT profile, count(*) AS documents FROM prof GROUP BY ALL) d USING (profile)")
on_model("namespaces_used_by", describe.prefixes_needed, f"SELECT DISTINCT x.release, x.iri, n.declared AS prefix FROM (SELECT q.release, q.s AS iri, unnest([q.s, CASE WHEN p <> '{TYPE}' THEN p END, CASE o_kind WHEN 'iri' THEN o END, CASE WHEN dt NOT IN ('{XSD}string', '{RDF}langString') THEN dt END]) AS u FROM q JOIN terms t ON t.release = q.release AND t.iri = q.s AND NOT t.\"foreign\") x JOIN pof n ON n.release = x.release AND n.ns = {ns('x.u')}")

# views
on_model("reference_view", lambda m: describe.references(m, m.terms.select("release", F.explode(F.concat("super_terms", "replaced_by", F.array("defined_in"))).alias("iri")).filter("iri is not null")), f"""SELECT x.release, x.iri, coalesce({_LABEL}, CASE WHEN d.iri IS NOT NULL THEN coalesce({_EN.format('v.vs')}, d.iri) END, {_LOCAL.format('x.iri')}, x.iri) AS label, t.prefix || ':' || t.local_name AS curie, CASE WHEN t."foreign" THEN coalesce(t.prefix, 'ext') || '_' || t.local_name ELSE t.local_name END AS anchor, coalesce(t."foreign", d.iri IS NULL) AS "foreign", CASE WHEN t.iri IS NOT NULL THEN 'term' WHEN d.iri IS NOT NULL THEN 'document' ELSE 'external' END AS kind
  FROM (SELECT DISTINCT release, iri FROM (SELECT release, unnest(list_concat(list_concat(super_terms, replaced_by), [defined_in])) AS iri FROM terms) WHERE iri IS NOT NULL) x LEFT JOIN terms t ON t.release = x.release AND t.iri = x.iri LEFT JOIN docs d ON d.release = x.release AND d.iri = x.iri LEFT JOIN vals v ON v.release = d.release AND v.iri = d.iri AND v.field = 'document_title'""")
on_model("hierarchy_tree", describe.hierarchy, f"""SELECT release, document, root, iri, depth, path FROM tree""", PRELUDE.rstrip() + f""",
mem AS (SELECT t.release, defined_in AS document, iri, kind, {_LABEL} AS label, CASE kind WHEN 'Concept' THEN broader ELSE super_terms END AS parents, top_concept_of FROM terms t WHERE NOT "foreign" AND defined_in IS NOT NULL),
pool AS MATERIALIZED (SELECT mem.* FROM mem JOIN (SELECT release, document, CASE WHEN count(*) FILTER (kind = 'Concept') > 0 THEN 'Concept' ELSE 'Class' END AS k FROM mem GROUP BY ALL) USING (release, document) WHERE kind = k),
pup AS MATERIALIZED (SELECT release, document, iri, label, unnest(parents) AS parent FROM pool),
held AS MATERIALIZED (SELECT DISTINCT p.release, p.document, p.iri FROM pup p JOIN mem ON mem.release = p.release AND mem.document = p.document AND mem.iri = p.parent),
tree AS (SELECT release, document, iri AS root, iri, 0 AS depth, label AS path FROM pool WHERE (release, document, iri) NOT IN (SELECT (release, document, iri) FROM held) OR len(parents) = 0 OR kind = 'Concept' AND len(top_concept_of) > 0
  UNION ALL SELECT t.release, t.document, t.root, p.iri, t.depth + 1, t.path || ' / ' || p.label FROM tree t JOIN pup p ON p.release = t.release AND p.document = t.document AND p.parent = t.iri WHERE depth < {describe.TREE_DEPTH})
""")
on_model("bounded_description", describe.bounded_sizes, "SELECT w.release, w.iri, count(*) AS nodes, sum(coalesce(z.n, 0)) + any_value(o.n) AS triples FROM (SELECT DISTINCT release, iri, node FROM reach) w LEFT JOIN sz z ON z.release = w.release AND z.s = w.node JOIN sz o ON o.release = w.release AND o.s = w.iri GROUP BY w.release, w.iri", PRELUDE.rstrip() + """,
sz AS (SELECT release, s, count(*) AS n FROM q GROUP BY ALL),
reach AS (SELECT DISTINCT release, s AS iri, o AS node FROM q WHERE s_kind = 'iri' AND o_kind = 'bnode' UNION SELECT r.release, r.iri, q.o FROM reach r JOIN q ON q.release = r.release AND q.s = r.node AND q.o_kind = 'bnode')
""")
_TITLE = f"(SELECT {_EN.format('v.vs')} FROM vals v WHERE v.release = d.release AND v.iri = d.iri AND v.field = 'document_title')"
_ABOUT = f"(SELECT {_EN.format('v.vs')} FROM vals v WHERE v.release = d.release AND v.iri = d.iri AND v.field = 'document_description')"


def _agents(predicate: str) -> str:
    return f"coalesce((SELECT string_agg(CASE a.o_kind WHEN 'literal' THEN a.o ELSE coalesce(f.foaf, f.label, CASE a.o_kind WHEN 'iri' THEN a.o END) END, ', ' ORDER BY a.seq) FROM q a LEFT JOIN agt f ON f.release = a.release AND f.s = a.o WHERE a.release = d.release AND a.s = d.iri AND a.p = '{predicate}'), '')"


_FOAF = "http://xmlns.com/foaf/0.1/"
_AGT = PRELUDE.rstrip() + f", agt AS MATERIALIZED (SELECT release, s, arg_min(o, seq) FILTER (p = '{_FOAF}name') AS foaf, arg_min(o, seq) FILTER (p = '{RDFS}label') AS label FROM q WHERE p IN ('{_FOAF}name', '{RDFS}label') GROUP BY ALL)\n"
on_model("document_header", lambda m: describe.header_rows(m).select(*KEY, "file", "profile", *HEADER_SCALARS, *(F.array_join(n, " ").alias(n) for n in HEADER_IRIS), "title", "description", *describe.AGENTS), f"SELECT release, iri, file, profile, {', '.join(HEADER_SCALARS)}, {', '.join(f'''array_to_string({n}, ' ') AS {n}''' for n in HEADER_IRIS)}, {_TITLE} AS title, {_ABOUT} AS description, {', '.join(f'{_agents(p)} AS {r}' for r, p in describe.AGENTS.items())} FROM docs d", _AGT)
on_model("removed_terms", lambda m: describe.removed_terms(m, "old", "new"), f"SELECT namespace, iri, {_LABEL} AS label, local_name AS anchor FROM terms t WHERE NOT \"foreign\" AND release = 'old' AND iri NOT IN (SELECT iri FROM terms WHERE NOT \"foreign\" AND release = 'new')")
on_model("changelog_rows", lambda m: describe.changelog(compare.changes(m)).drop("place"), f"SELECT CASE severity WHEN 'breaking' THEN 1 WHEN 'additive' THEN 2 ELSE 3 END AS rank, severity, rule, upper(left(h, 1)) || substr(h, 2) || ' (' || n || ')' AS heading, iri FROM (SELECT *, translate(rule, '.-_', '   ') AS h, count(*) OVER (PARTITION BY severity, rule) AS n FROM {EVERY_CHANGE} AS f)", SHAPES)
on_model("diff_counts", lambda m: compare.changes(m).groupBy(I.namespace_part(c("iri")).alias("namespace"), "rule", "severity").agg(F.count("*").alias("n")), f"SELECT {ns('iri')} AS namespace, rule, severity, count(*) AS n FROM {EVERY_CHANGE} AS f GROUP BY ALL", SHAPES)
on_model("status_banner", describe.status_banners, "SELECT release, iri, trim(lower(regexp_replace(split_part(status, '/', -1), '(.)([A-Z])', '\\1 \\2', 'g'))) AS status, version_info AS version FROM docs WHERE status IS NOT NULL")

on_model("context_subset", describe.context_subset, f"SELECT u.release, u.file, u.iri, x.key FROM (SELECT DISTINCT release, file, unnest([p, CASE WHEN p = '{TYPE}' AND o_kind = 'iri' THEN o END]) AS iri FROM q) u JOIN {_CONTEXT} x ON x.release = u.release AND x.iri = u.iri")
_ABOUT_LOCAL = 'q JOIN terms t ON t.release = q.release AND t.iri = q.s AND NOT t."foreign"'

# exports of a site
_FIRST = f"CASE WHEN contains({_LINE.format('d')}, '. ') AND strlen(split_part({_LINE.format('d')}, '. ', 1)) > 40 THEN split_part({_LINE.format('d')}, '. ', 1) || '.' ELSE {_LINE.format('d')} END"
INDEX = SITE.rstrip() + f""",
tix AS MATERIALIZED (SELECT release, iri, curie, kind, label, {_FIRST} AS definition, deprecated, namespace, html, md, ttl FROM (SELECT t.release, t.iri, t.prefix || ':' || t.local_name AS curie, t.kind, {_LABEL} AS label, {_EN.format('t.definitions')} AS d, t.deprecated, t.namespace, max(rtrim(a.base_url, '/') || a.public) FILTER (a.extension = '.html') AS html, max(rtrim(a.base_url, '/') || a.public) FILTER (a.extension = '.md') AS md, max(rtrim(a.base_url, '/') || a.public) FILTER (a.extension = '.ttl') AS ttl
  FROM terms t JOIN adr a ON a.release = t.release AND a.ns = t.namespace AND a.local = t.local_name AND a.segment = '' WHERE NOT t."foreign" GROUP BY ALL)),
rank AS (SELECT kind, rank FROM (VALUES {', '.join(f"('{k}', {i + 1})" for i, k in enumerate(TERM_KINDS))}) AS r(kind, rank))
"""
on_site("term_index", describe.term_index, "SELECT * FROM tix", INDEX)
on_site("siblings", describe.siblings, "SELECT release, ns, local, media_type, rtrim(base_url, '/') || public AS url, CASE extension WHEN '.md' THEN 'Markdown' WHEN '.ttl' THEN 'Turtle' ELSE 'JSON-LD' END AS label FROM adr WHERE segment = '' AND extension <> '.html'")
on_site("site_summary", describe.site_summary, "SELECT release, ns, coalesce(title, ns) AS title, n_terms, CAST(sum(n_terms) OVER (PARTITION BY release) AS BIGINT) AS of_terms, count(*) OVER (PARTITION BY release) AS of_namespaces FROM man")
on_site("llms_index", lambda s: describe.llms_lines(s, 100), "SELECT release, ns, 0 AS section, CAST(k AS INTEGER) AS line, CASE k WHEN 1 THEN '# ' || coalesce(title, ns) WHEN 2 THEN 'IRI: ' || ns ELSE 'Terms: ' || n_terms END AS text FROM man, (SELECT unnest([1, 2, 3]) AS k) UNION ALL SELECT release, ns, 0, 4, 'See ' || doc_base || 'index.md for all terms.' FROM man WHERE n_terms > 100 UNION ALL SELECT x.release, namespace, rank, CAST(row_number() OVER (PARTITION BY x.release, namespace, x.kind ORDER BY label, x.iri) AS INTEGER), '- [' || label || '](' || md || ')' || coalesce(': ' || definition, '') FROM tix x JOIN rank USING (kind) JOIN man m ON m.release = x.release AND m.ns = x.namespace", INDEX)
on_site("llms_root", describe.llms_root, "SELECT release, CAST(row_number() OVER (PARTITION BY release ORDER BY ns) AS INTEGER) AS line, '- [' || coalesce(title, ns) || '](' || llms || '): ' || n_terms || ' terms' AS text FROM man")
_CARD = f"""(SELECT t.release, t.namespace AS ns, t.local_name AS local, array_to_string(list_concat(list_concat(list_concat(list_concat(list_concat(['# ' || {_LABEL}, '', '- IRI: ' || t.iri, '- Kind: ' || t.kind], list_filter(['- CURIE: ' || t.prefix || ':' || t.local_name, '- Defined in: ' || t.defined_in, CASE WHEN t.deprecated THEN '- Deprecated' END], lambda x: x IS NOT NULL)),
  list_transform(t.definitions, lambda v: '- Definition: ' || {_LINE.format('v.value')})), list_transform(coalesce(n.vs, []), lambda v: '- Note: ' || {_LINE.format('v.value')})), list_transform(t.super_terms, lambda v: '- Parent: ' || v)), list_transform(t.replaced_by, lambda v: '- Replaced by: ' || v)), chr(10)) AS card
  FROM terms t LEFT JOIN vals n ON n.release = t.release AND n.iri = t.iri AND n.field = 'note' AND n.profile = t.profile WHERE NOT t."foreign")"""
on_site("term_cards", describe.term_cards, f"SELECT * FROM {_CARD}")
_CC = "CASE WHEN starts_with(license, 'https://creativecommons.org/licenses/') THEN 'CC ' || upper(split_part(rtrim(substr(license, 38), '/'), '/', 1)) || ' ' || split_part(rtrim(substr(license, 38), '/'), '/', 2) ELSE license END"
_DOCCARD = f"""(SELECT release, iri, array_to_string(list_filter(['# ' || coalesce(title, iri), '', '- IRI: ' || iri, '- Kind: ' || document_kind, '- Version: ' || version_info, '- Status: ' || status, '- Licence: ' || {_CC}, CASE WHEN creator <> '' THEN '- Creators: ' || creator END, '- Terms: ' || own, '- Reused terms: ' || reused, chr(10) || {_LINE.format('description')}], lambda x: x IS NOT NULL), chr(10)) AS card
  FROM (SELECT d.*, {_TITLE} AS title, {_ABOUT} AS description, {_agents(DCTERMS + 'creator')} AS creator, (SELECT count(*) FROM placed p WHERE p.release = d.release AND p.defined_in = d.iri AND NOT "foreign") AS own, (SELECT count(*) FROM placed p WHERE p.release = d.release AND p.defined_in = d.iri AND "foreign") AS reused FROM docs d))"""
CARDS = SITE.rstrip() + _AGT[len(PRELUDE.rstrip()) :]
on_site("document_cards", describe.document_cards, f"SELECT * FROM {_DOCCARD}", CARDS)
_FILES = f"(SELECT x.release, a.file AS path, x.card AS content FROM {_CARD} x JOIN adr a ON a.release = x.release AND a.ns = x.ns AND a.local = x.local AND a.segment = '' AND a.extension = '.md' UNION ALL SELECT x.release, n.mount || 'index.md', x.card FROM {_DOCCARD} x JOIN nsp n ON n.release = x.release AND n.ns = x.iri)"
on_site("artifact_manifest", lambda s: describe.artifacts(s).select("release", "path", F.octet_length("content").cast("long").alias("bytes")), f"SELECT release, path, strlen(content) AS bytes FROM {_FILES}", CARDS)
on_site("front_matter", describe.front_matter, f"SELECT release, namespace AS ns, local_name AS local, CAST(weight AS INTEGER) AS weight, array_to_string(['---', 'title: \"' || replace(label, '\"', '\\\"') || '\"', 'iri: \"' || iri || '\"', 'kind: ' || kind, 'weight: ' || weight, '---'], chr(10)) AS front FROM (SELECT t.*, {_LABEL} AS label, row_number() OVER (PARTITION BY release, namespace ORDER BY iri) AS weight FROM terms t WHERE NOT \"foreign\")")
_STR = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
_NODES = "'{{\"@context\":\"https://schema.org\",\"@graph\":[' || {0} || ']}}'"


def _object(fields: dict[str, str]) -> str:
    """A JSON object in SQL, of fields whose values are JSON; null ones are left out."""
    listed = ", ".join(f"'\"{k}\":' || {v}" for k, v in fields.items())
    return f"'{{' || array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',') || '}}'"


_text = _STR.format
_PAGE = _object({"@type": "'\"WebPage\"'", "name": _text("name"), "url": _text("url"), "inLanguage": "'\"en\"'", "mainEntity": _object({"@id": _text("iri")})})
_TERM = _object({"@type": "'\"DefinedTerm\"'", "@id": _text("iri"), "name": _text("name"), "termCode": _text("local_name"), "url": _text("url"), "description": _text("about"), "inDefinedTermSet": _text("defined_in")})
_DOWNLOAD = _object({"@type": "'\"DataDownload\"'", "encodingFormat": _text("media_type"), "contentUrl": _text("url")})
_SET = _object(
    {"@type": "'[\"DefinedTermSet\",\"Dataset\"]'", "@id": _text("iri"), "name": _text("coalesce(title, iri)"), "url": _text("url"), "inLanguage": "'\"en\"'", "description": _text("about")}
    | {"license": _text("license"), "version": _text("version_info"), "dateModified": _text("modified"), "distribution": "'[' || downloads || ']'"}
)
_DATASET = _object({"@id": _text("ns"), "@type": "'\"Dataset\"'", "name": _text("coalesce(title, ns)"), "url": _text("doc_base")})
_CATALOGUE = _object({"@context": "'\"https://schema.org\"'", "@type": "'\"DataCatalog\"'", "name": "'\"Vocabularies\"'", "url": _text("base_url"), "inLanguage": "'\"en\"'", "dataset": "'[' || datasets || ']'"})
on_site(
    "schema_org_rows",
    describe.schema_org,
    f"""SELECT release, 'term' AS kind, iri, 0 AS part, {_NODES.format(_PAGE + " || ',' || " + _TERM)} AS json
FROM (SELECT t.*, {_LABEL} AS name, {_LINE.format(_EN.format('t.definitions'))} AS about, rtrim(a.base_url, '/') || a.request AS url FROM terms t
  LEFT JOIN adr a ON a.release = t.release AND a.ns = t.namespace AND a.local = t.local_name AND a.segment = '' AND a.extension = '.html' WHERE NOT t."foreign") x
UNION ALL SELECT release, 'set', iri, 0, {_NODES.format(_SET)}
FROM (SELECT d.*, {_TITLE} AS title, {_LINE.format(_ABOUT)} AS about, f.url, f.downloads FROM docs d LEFT JOIN (
  SELECT release, ns, max(url) FILTER (media_type = 'text/html') AS url, string_agg({_DOWNLOAD}, ',' ORDER BY media_type) FILTER (media_type <> 'text/html') AS downloads
  FROM (SELECT release, ns, media_type, base_url || mount || CASE media_type WHEN 'text/html' THEN '' WHEN 'text/markdown' THEN 'index' || extension ELSE stem || extension END AS url FROM nsp, {REPS}) u GROUP BY ALL) f ON f.release = d.release AND f.ns = d.iri) x
UNION ALL SELECT release, 'catalogue', base_url, part, {_CATALOGUE}
FROM (SELECT release, base_url, part, string_agg({_DATASET}, ',' ORDER BY ns) AS datasets
  FROM (SELECT *, CAST((row_number() OVER (PARTITION BY release ORDER BY ns) - 1) // 1000 AS INTEGER) AS part FROM man) m GROUP BY release, base_url, part) x""",
)
_LINKS_TO = f"(SELECT x.release, x.iri, x.target, CASE WHEN a.local IS NOT NULL THEN '[' || {_LABEL} || '](' || rtrim(a.base_url, '/') || a.request || ')' ELSE coalesce(t.prefix || ':' || t.local_name, x.target) END AS link FROM (SELECT DISTINCT release, iri, unnest(list_concat(super_terms, replaced_by)) AS target FROM terms WHERE NOT \"foreign\") x LEFT JOIN terms t ON t.release = x.release AND t.iri = x.target LEFT JOIN adr a ON a.release = x.release AND a.ns = t.namespace AND a.local = t.local_name AND a.segment = '' AND a.extension = '.html' AND NOT t.\"foreign\")"
on_site("link_md", describe.markdown_links_of, f"SELECT * FROM {_LINKS_TO}")

# sinks and sources


def stored_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements, written as N-Triples and read again. The text is what is stored: a table of what is read would take as much disk."""

    def build() -> DataFrame:
        path = shared_path(spark, "ntriples")
        ntriples.write(model(spark, sf_dir).raw, path)
        return ntriples.scan_written(spark, path)

    return kept(spark, sf_dir, "ntriples", build)


_READ = "SELECT release, file, o_kind, count(*) AS n, count(DISTINCT s) AS subjects, count(lang) AS tagged, count(dt) AS typed FROM raw GROUP BY ALL"
QUERIES["scan_triples"] = lambda spark, sf_dir: stored_triples(spark, sf_dir).groupBy("release", "file", "o_kind").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.count("lang").alias("tagged"), F.count("dt").alias("typed"))
ORACLE["scan_triples"] = PRELUDE + _READ
on_model("export_document_triples", lambda m: ntriples.lines(m.raw).groupBy("release", "file").agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("long")).alias("digest")), "SELECT release, file, count(*) AS n, bit_xor(CAST('0x' || substr(sha256(CASE s_kind WHEN 'bnode' THEN '_:' || s ELSE '<' || s || '>' END || ' <' || p || '> ' || CASE o_kind WHEN 'bnode' THEN '_:' || o WHEN 'iri' THEN '<' || o || '>' ELSE '\"' || replace(replace(o, '\\', '\\\\'), '\"', '\\\"') || '\"' || CASE WHEN lang IS NOT NULL THEN '@' || lang WHEN dt IS NOT NULL THEN '^^<' || dt || '>' ELSE '' END END || ' .'), 1, 15) AS BIGINT)) AS digest FROM raw GROUP BY ALL")


def stored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of terms, written as JSON by namespace number and read again."""

    def build() -> DataFrame:
        rows = model(spark, sf_dir).local.select(*KEY, "namespace", "local_name", "kind", "labels", "super_terms")
        path = shared_path(spark, "terms")
        rows.write.partitionBy("release", "kind").json(path)
        return spark.read.schema(rows.schema).json(path)

    return kept(spark, sf_dir, "stored_terms", build)


QUERIES["export_term_rows"] = lambda spark, sf_dir: stored_terms(spark, sf_dir).select(*KEY, "namespace", "local_name", "kind", F.size("labels").alias("n_labels"), F.array_join("super_terms", " ").alias("super_terms"))
ORACLE["export_term_rows"] = PRELUDE + "SELECT release, iri, namespace, local_name, kind, CAST(len(labels) AS INTEGER) AS n_labels, array_to_string(super_terms, ' ') AS super_terms FROM terms WHERE NOT \"foreign\""


def stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a model as JSON lines of one file set: release, table, json."""

    def build() -> DataFrame:
        m, path = model(spark, sf_dir), shared_path(spark, "model")
        tables = {"documents": m.documents.select(*KEY, "document_kind", "version_info"), "namespaces": m.namespaces.select("release", c("ns").alias("iri"), "prefix", "term_count"), "terms": m.local.select(*KEY, "kind", "curie")}
        for name, rows in tables.items():
            rows.select("release", F.lit(name).alias("table"), F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").partitionBy("release", "table").text(path)
        return spark.read.schema("value string, release string, table string").text(path)

    return kept(spark, sf_dir, "stored_model", build)


QUERIES["export_model_json"] = lambda spark, sf_dir: stored_model(spark, sf_dir).select("release", "table", F.get_json_object("value", "$.iri").alias("iri"), F.coalesce(F.get_json_object("value", "$.kind"), F.get_json_object("value", "$.document_kind"), F.get_json_object("value", "$.term_count")).alias("what"))
ORACLE["export_model_json"] = PRELUDE + "SELECT release, 'terms' AS \"table\", iri, kind AS what FROM terms WHERE NOT \"foreign\" UNION ALL SELECT release, 'documents', iri, document_kind FROM docs UNION ALL SELECT m.release, 'namespaces', m.ns, CAST((SELECT count(*) FROM placed p WHERE p.release = m.release AND p.namespace = m.ns AND NOT \"foreign\") AS VARCHAR) FROM minted m"
#: Names of files, some of a format that can be read, some twice and some in a folder below.
_NAMES = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'a/' || p_name WHEN 1 THEN 'a/b/' || p_name ELSE 'a/' || p_type END || CASE p_partkey % 7 WHEN 0 THEN '.ttl' WHEN 1 THEN '.nt' WHEN 2 THEN '.nq' WHEN 3 THEN '.txt' WHEN 4 THEN '.rdf' WHEN 5 THEN '.TTL' ELSE '' END AS path FROM {part}"
QUERIES["expand_inputs"] = lambda spark, sf_dir: ntriples.expanded(view(spark, sf_dir, _NAMES), "a")
ORACLE["expand_inputs"] = f"SELECT DISTINCT path, lower(regexp_extract(path, '\\.([^.]*)$', 1)) AS format FROM ({duck(_NAMES)}) AS f WHERE regexp_full_match(path, 'a/[^/]*\\.(ttl|nt|nq|rdf|trig|jsonld|owl|xml|TTL)')"

# media types

_TYPES = "SELECT event_id AS k, CASE event_id % 8 WHEN 0 THEN 'text/turtle' WHEN 1 THEN 'application/rdf+xml' WHEN 2 THEN 'text/n3' WHEN 3 THEN 'application/ld+json' WHEN 4 THEN 'text/html' WHEN 5 THEN 'application/x-trig' WHEN 6 THEN 'application/json' ELSE event_type END AS media_type FROM {events}"
QUERIES["is_rdf"] = lambda spark, sf_dir: view(spark, sf_dir, _TYPES).select("k", http.is_rdf(c("media_type")).alias("is_rdf"))
ORACLE["is_rdf"] = f"SELECT k, media_type IN ('text/turtle', 'application/ld+json', 'application/rdf+xml', 'application/n-triples', 'application/trig') AS is_rdf FROM ({duck(_TYPES)}) AS f"
QUERIES["looks_like_rdf"] = lambda spark, sf_dir: view(spark, sf_dir, _TYPES).select("k", http.looks_like_rdf(c("media_type")).alias("looks"))
ORACLE["looks_like_rdf"] = f"SELECT k, regexp_matches(media_type, 'rdf|turtle|ld\\+json|n-triples|n3|trig') AS looks FROM ({duck(_TYPES)}) AS f"
_LEAST = "SELECT p_partkey AS k, CASE WHEN p_size % 4 > 0 THEN p_size % 4 - 1 END AS least FROM {part}"
QUERIES["required"] = lambda spark, sf_dir: view(spark, sf_dir, _LEAST).select("k", text.required(c("least")).alias("required"))
ORACLE["required"] = f"SELECT k, coalesce(least, 0) >= 1 AS required FROM ({duck(_LEAST)}) AS f"
