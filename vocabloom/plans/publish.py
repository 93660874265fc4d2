"""Registered queries of the publication tables, of probing and of conformance, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conform, hosts, probe
from ..operators.layout import LATEST_CACHE, REPRESENTATIONS, SNAPSHOT_CACHE, STATUS, Layout
from ..sources.tables import written
from ..vocabulary import DCTERMS, OWL
from .derived import GEO
from .inputs import BASE, duck, view
from .models import KNOWN, PRELUDE, SOURCES, kept, model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col

CONFIG = f"SELECT * FROM (VALUES ('new', '{BASE}', 'version-iri', CAST(NULL AS STRING)), ('old', '{BASE}', 'all', '0.9.1')) AS f(release, base_url, snapshots, configured)"
OVERRIDES = f"SELECT * FROM (VALUES ('new', '{GEO}', 'places', 'dir', CAST(NULL AS STRING), 'p'), ('new', '{BASE}range/2/', '/r/two/', CAST(NULL AS STRING), 'two', CAST(NULL AS STRING))) AS o(release, ns, mount, url_style, stem, resolver_prefix)"
ORIGIN = "https://host.example.net"


def layout(spark: SparkSession, sf_dir: str) -> Layout:
    m = model(spark, sf_dir)
    return kept(spark, sf_dir, "layout", lambda: Layout(m, spark.sql(CONFIG), spark.sql(OVERRIDES)))


_MOUNT = "regexp_replace(regexp_replace(ns, '^.*?//', ''), '^[^/]*/', '')"
_MOUNT = f"CASE WHEN rtrim({_MOUNT}, '#') = '' THEN '' ELSE rtrim(rtrim({_MOUNT}, '#'), '/') || '/' END"
_EN = "coalesce(list_filter({0}, lambda v: v.lang = 'en')[1].value, list_filter({0}, lambda v: v.lang IS NULL)[1].value, {0}[1].value)"
_VERSION = "CASE WHEN length(trim({0})) <= 64 AND regexp_full_match(trim({0}), '[0-9]+(\\.[0-9]+)*([-+][A-Za-z0-9._+-]*)?') THEN struct_pack(segment := trim({0}), source := '{1}') END"
REPS = "(VALUES " + ", ".join(f"('{m}', '{e}', {i})" for i, (_, m, e) in enumerate(REPRESENTATIONS)) + ") AS r(media_type, extension, rep_at)"
_RES = "(SELECT DISTINCT m.release, m.ns, rtrim(substr(d.iri, length(m.ns) + 1), '/') AS segment FROM minted m JOIN (SELECT release, iri FROM doc UNION SELECT release, version_iri FROM docs WHERE version_iri IS NOT NULL) d ON d.release = m.release AND starts_with(d.iri, m.ns))"
_FLIP = "CASE WHEN regexp_matches({0}, '^[A-Z]') THEN lower(left({0}, 1)) || substr({0}, 2) WHEN regexp_matches({0}, '^[a-z]') THEN upper(left({0}, 1)) || substr({0}, 2) ELSE {0} END"


SITE = f"""{PRELUDE},
cfg AS ({CONFIG}), ovr AS ({OVERRIDES}),
nsp AS MATERIALIZED (SELECT m.release, m.ns, coalesce(CASE WHEN ltrim(o.mount, '/') = '' OR o.mount LIKE '%/' THEN ltrim(o.mount, '/') ELSE ltrim(o.mount, '/') || '/' END, {_MOUNT.replace('ns', 'm.ns')}) AS mount, CASE WHEN o.url_style = 'dir' THEN 'dir' ELSE 'flat' END AS style,
  coalesce(o.stem, p.declared, {KNOWN.format('m.ns')}, nullif(split_part(rtrim({_MOUNT.replace('ns', 'm.ns')}, '/'), '/', -1), ''), 'vocabulary') AS stem, coalesce(p.declared, {KNOWN.format('m.ns')}) AS prefix, o.resolver_prefix, d.iri AS document, f.base_url
  FROM minted m JOIN cfg f USING (release) LEFT JOIN ovr o ON o.release = m.release AND o.ns = m.ns LEFT JOIN pof p ON p.release = m.release AND p.ns = m.ns LEFT JOIN doc d ON d.release = m.release AND d.iri = m.ns),
st AS MATERIALIZED (SELECT release, ns, iri, local, folded, local = 'index' OR mount = '' AND local = '404' OR folded AS in_directory, CASE WHEN local = 'index' OR mount = '' AND local = '404' OR folded THEN 'dir' ELSE style END AS style FROM (SELECT t.release, t.namespace AS ns, t.iri, t.local_name AS local, row_number() OVER (PARTITION BY t.release, t.namespace, lower(t.local_name) ORDER BY t.local_name) > 1 AS folded, n.mount, n.style FROM terms t JOIN nsp n ON n.release = t.release AND n.ns = t.namespace WHERE NOT t."foreign")),
ver AS (SELECT release, iri, v.segment, v.source FROM (SELECT d.release, d.iri, coalesce({_VERSION.format('version_info', 'version-info')}, {_VERSION.format('issued', 'issued')}, {_VERSION.format('modified', 'modified')}, {_VERSION.format('configured', 'configured')}) AS v FROM docs d JOIN cfg USING (release)) WHERE v IS NOT NULL),
cand AS MATERIALIZED (SELECT *, CASE WHEN snapshots = 'version-iri' AND NOT resolves THEN CASE WHEN version_iri IS NOT NULL THEN 'other version IRI' ELSE 'no version IRI' END WHEN EXISTS (SELECT 1 FROM st WHERE st.release = x.release AND st.ns = x.ns AND st.local = x.segment) THEN 'term of that name' END AS refused
  FROM (SELECT n.release, n.ns, v.segment, v.source, n.base_url || n.mount || v.segment || '/' AS url, d.version_iri, coalesce(d.version_iri = n.base_url || n.mount || v.segment || '/', false) AS resolves, f.snapshots FROM nsp n JOIN docs d ON d.release = n.release AND d.iri = n.document JOIN ver v ON v.release = n.release AND v.iri = n.document JOIN cfg f ON f.release = n.release AND f.snapshots <> 'none') x),
snap AS (SELECT * FROM cand WHERE refused IS NULL),
man AS MATERIALIZED (SELECT n.release, n.ns, coalesce(n.prefix, replace(rtrim(n.mount, '/'), '/', '-')) AS id, coalesce(lower(d.document_kind), 'document') AS kind, n.base_url || n.mount AS doc_base, '/' || n.mount AS mount, n.style AS layout, n.stem, CASE WHEN d.iri IS NOT NULL THEN coalesce({_EN.format('v.vs')}, d.iri) END AS title, d.version_info AS version, d.version_iri, d.status, d.license AS licence,
  coalesce((SELECT list_sort(list(DISTINCT segment)) FROM (SELECT release, ns, segment FROM {_RES} z WHERE segment <> '' AND NOT contains(segment, '/') UNION ALL SELECT release, ns, segment FROM snap) z WHERE z.release = n.release AND z.ns = n.ns), []) AS reserved, coalesce((SELECT list_sort(list(DISTINCT segment)) FROM snap z WHERE z.release = n.release AND z.ns = n.ns), []) AS versions,
  (SELECT count(*) FROM st WHERE st.release = n.release AND st.ns = n.ns) AS n_terms, (SELECT count(*) FROM st WHERE st.release = n.release AND st.ns = n.ns AND in_directory) AS n_directories, n.base_url || n.mount || 'llms.txt' AS llms, '{LATEST_CACHE}' AS cache, n.base_url
  FROM nsp n LEFT JOIN docs d ON d.release = n.release AND d.iri = n.document LEFT JOIN vals v ON v.release = d.release AND v.iri = d.iri AND v.field = 'document_title'),
ent AS MATERIALIZED (SELECT release, ns, '' AS segment, ns AS iri_base, doc_base, mount, llms, cache, base_url FROM man UNION ALL SELECT s.release, s.ns, s.segment, s.url, s.url, m.mount || s.segment || '/', s.url || 'llms.txt', '{SNAPSHOT_CACHE}', m.base_url FROM snap s JOIN man m USING (release, ns)),
adr AS MATERIALIZED (SELECT e.*, t.local, t.style, r.*, e.mount || t.local || CASE t.style WHEN 'dir' THEN '/' ELSE '' END AS request, CASE WHEN extension = '.html' THEN e.mount || t.local || CASE t.style WHEN 'dir' THEN '/' ELSE '' END ELSE e.mount || t.local || CASE t.style WHEN 'dir' THEN '/index' ELSE '' END || extension END AS public,
  ltrim(e.mount || t.local || CASE t.style WHEN 'dir' THEN '/index' ELSE '' END || extension, '/') AS file FROM ent e JOIN st t USING (release, ns), {REPS}),
lnk2 AS (SELECT a.release, a.ns, a.segment, a.local, a.media_type, '<' || rtrim(base_url, '/') || request || '>; rel="canonical", <' || iri_base || local || '>; rel="cite-as"' || (SELECT string_agg(', <' || CASE WHEN a.style = 'dir' THEN CASE WHEN r.extension = '.html' THEN './' ELSE 'index' || r.extension END ELSE a.local || CASE WHEN r.extension = '.html' THEN '' ELSE r.extension END END || '>; rel="alternate"; type="' || r.media_type || '"', '' ORDER BY r.rep_at) FROM {REPS} WHERE r.media_type <> a.media_type) || ', <' || CASE WHEN a.style = 'dir' THEN '../' ELSE '' END || 'llms.txt>; rel="describedby"; type="text/plain"' AS link FROM adr a)
"""


def query(name: str, build: Callable[[Layout], DataFrame], sql: str, prelude: str = SITE) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(layout(spark, sf_dir))
    ORACLE[name] = prelude + sql


joined = lambda n: F.array_join(n, " ").alias(n)
query("namespace_plan", lambda s: s.namespaces, "SELECT * FROM nsp")
query("term_style", lambda s: s.terms, "SELECT * FROM st")
query("term_paths", lambda s: s.term_paths, "SELECT a.release, a.ns, a.local, a.media_type, a.file AS path, rtrim(base_url, '/') || public AS url, rtrim(base_url, '/') || request AS page_url, request AS request_path FROM adr a WHERE segment = ''")
_DOCUMENT_PATHS = f"(SELECT release, ns, media_type, mount || CASE media_type WHEN 'text/markdown' THEN '_index' WHEN 'text/html' THEN 'index' ELSE stem END || extension AS path, base_url, mount FROM nsp, {REPS})"
query("document_paths", lambda s: s.document_paths("_index"), f"SELECT release, ns, media_type, path, base_url || CASE media_type WHEN 'text/html' THEN mount ELSE path END AS url FROM {_DOCUMENT_PATHS} UNION ALL SELECT release, ns, 'text/plain', mount || 'llms.txt', base_url || mount || 'llms.txt' FROM nsp")
query("version_of", lambda s: s.versions, "SELECT * FROM ver")
query("snapshot_plan", lambda s: s.snapshots.withColumn("refused", F.lit(None).cast("string")).unionByName(s.refusals, allowMissingColumns=True).select("release", "ns", "segment", "source", "url", "refused"), "SELECT release, ns, segment, CASE WHEN refused IS NULL THEN source END AS source, CASE WHEN refused IS NULL THEN url END AS url, refused FROM cand WHERE refused IS DISTINCT FROM 'no version IRI'")
query("snapshot_entries", lambda s: s.snapshot_entries(), "SELECT * FROM ent WHERE segment <> ''")
query("version_links", lambda s: s.version_links(), f"SELECT s.release, x.* FROM (SELECT s.release, unnest([struct_pack(s := m.doc_base, p := '{DCTERMS}hasVersion', o := s.url), struct_pack(s := s.url, p := '{DCTERMS}isVersionOf', o := m.doc_base), struct_pack(s := s.url, p := '{OWL}versionInfo', o := s.segment)]) AS x FROM snap s JOIN man m USING (release, ns)) s")
query("versions_report", lambda s: s.versions_report().withColumn("versions", F.array_join("versions", " ")), f"SELECT m.release, m.ns, f.snapshots AS policy, m.doc_base AS latest, '{LATEST_CACHE}' AS latest_cache, '{SNAPSHOT_CACHE}' AS snapshot_cache, array_to_string(m.versions, ' ') AS versions, (SELECT count(*) FROM cand k WHERE k.release = m.release AND k.ns = m.ns AND k.refused <> 'no version IRI') AS not_written FROM man m JOIN cfg f USING (release)")
query("manifest_entries", lambda s: s.manifest.withColumns({"reserved": F.array_join("reserved", " "), "versions": F.array_join("versions", " ")}), "SELECT * REPLACE (array_to_string(reserved, ' ') AS reserved, array_to_string(versions, ' ') AS versions) FROM man")
query("route_table", lambda s: s.route_table(), f"SELECT release, request, media_type, CASE extension WHEN '.html' THEN 'serve' ELSE 'redirect' END AS action, CASE extension WHEN '.html' THEN file ELSE public END AS target, CASE extension WHEN '.html' THEN 200 ELSE {STATUS} END AS status, cache FROM adr")
#: Five kinds of host. A rule of the second can list 300 names, a fixed value.
HOSTS = """SELECT * FROM (VALUES
  ('edge worker', true, true, 'term', true, true, true, CAST(NULL AS INT)),
  ('rewrite rules', true, false, 'none', true, true, true, 300),
  ('header rules', true, false, 'namespace', true, true, true, CAST(NULL AS INT)),
  ('resolver', true, true, 'term', false, false, false, CAST(NULL AS INT)),
  ('plain files', false, false, 'none', true, true, true, CAST(NULL AS INT))
) AS h(host, negotiates, ranks_quality, links, layouts, suffixes, versions, names)"""
_ODD = "SELECT t.release, t.ns, t.iri, t.local, t.style, '/' || n.mount AS mount FROM st t JOIN nsp n ON n.release = t.release AND n.ns = t.ns WHERE t.style <> n.style"
query(
    "host_limits",
    lambda s: hosts.host_limits(s, s.m.spark.sql(HOSTS)),
    f"""SELECT release, host, x."limit" AS "limit", ns, x.affected AS affected FROM (
  SELECT m.release, h.host, m.ns, unnest([
    struct_pack("limit" := 'no negotiation', affected := CASE WHEN NOT negotiates THEN n_terms END),
    struct_pack("limit" := 'no ranking by quality', affected := CASE WHEN negotiates AND NOT ranks_quality THEN n_terms END),
    struct_pack("limit" := 'no Link headers', affected := CASE WHEN links = 'none' THEN n_terms END),
    struct_pack("limit" := 'Link headers by namespace', affected := CASE WHEN links = 'namespace' THEN n_terms END),
    struct_pack("limit" := 'one layout', affected := CASE WHEN NOT layouts THEN odd END),
    struct_pack("limit" := 'one representation', affected := CASE WHEN NOT suffixes THEN n_terms END),
    struct_pack("limit" := 'no snapshots', affected := CASE WHEN NOT h.versions THEN len(m.versions) END),
    struct_pack("limit" := 'names not listed', affected := CASE WHEN n_terms > names THEN n_terms END)]) AS x
  FROM man m LEFT JOIN (SELECT release, ns, count(*) AS odd FROM ({_ODD}) GROUP BY ALL) o ON o.release = m.release AND o.ns = m.ns CROSS JOIN ({HOSTS}) h) WHERE x.affected > 0""",
)
query(
    "host_exceptions",
    lambda s: hosts.host_exceptions(s, s.m.spark.sql(HOSTS)),
    f"SELECT release, host, ns, iri, mount || local || CASE style WHEN 'dir' THEN '/' ELSE '' END AS request, mount AS instead FROM ({_ODD}), ({HOSTS}) h WHERE NOT layouts",
)
_ESCAPED = "regexp_replace({0}, '([.+*?()\\[\\]{{}}^$|\\\\])', '\\\\\\1', 'g')"
query(
    "term_rules",
    lambda s: hosts.term_rules(s, s.m.spark.sql(HOSTS)),
    f"""SELECT m.release, host, m.ns, n_terms <= names AS listed, CASE
  WHEN n_terms <= names THEN '(' || listed_names || ')'
  WHEN len(reserved) > 0 THEN '(?!(?:' || array_to_string(list_transform(reserved, lambda r: {_ESCAPED.format('r')}), '|') || ')(?:/|$))' || '{hosts.ANY_NAME}'
  ELSE '{hosts.ANY_NAME}' END AS pattern
FROM man m LEFT JOIN (SELECT release, ns, string_agg({_ESCAPED.format('local')}, '|' ORDER BY local) AS listed_names FROM st GROUP BY ALL) l ON l.release = m.release AND l.ns = m.ns CROSS JOIN ({HOSTS}) h WHERE names IS NOT NULL AND n_terms > 0""",
)
query("path_case_collisions", lambda s: s.path_case_collisions().withColumn("paths", F.array_join("paths", " ")), f"SELECT release, lower(path) AS folded, array_to_string(list_sort(list(DISTINCT path)), ' ') AS paths FROM (SELECT release, file AS path FROM adr WHERE segment = '' UNION ALL SELECT release, replace(path, '_index', 'index') FROM {_DOCUMENT_PATHS} UNION ALL SELECT release, mount || 'llms.txt' FROM nsp) GROUP BY ALL HAVING count(DISTINCT path) > 1")
query("link_header", lambda s: s.link_headers(), "SELECT * FROM lnk2")
query("public_url", lambda s: s.addresses.select("release", "ns", "segment", "local", "media_type", "public"), "SELECT release, ns, segment, local, media_type, public FROM adr")
query("term_file", lambda s: s.addresses.select("release", "ns", "segment", "local", "media_type", "file"), "SELECT release, ns, segment, local, media_type, file FROM adr")

# probing

#: What each ask is answered, by the length of its address; the old release's host is down.
RESPONSES = """
SELECT release, url, accept, CASE WHEN n = 0 OR media_type = 'text/plain' AND n > 7 THEN 404 WHEN expect = 'sibling' AND n <> 6 THEN 303 ELSE 200 END AS status,
  CASE WHEN n = 1 THEN 'application/octet-stream' WHEN n = 6 AND expect = 'sibling' THEN 'text/plain' WHEN n = 8 THEN '' ELSE upper(media_type) || '; charset=utf-8' END AS content_type, CASE WHEN n = 2 THEN 'Origin' ELSE 'Origin, ACCEPT' END AS vary,
  CASE WHEN n = 7 THEN 'rel="cite-as"' ELSE 'rel="cite-as" rel="describedby"' END AS link, CASE WHEN n = 5 THEN '' WHEN n = 3 THEN url || '/x' ELSE location || '/' END AS location
FROM (SELECT DISTINCT release, url, accept, expect, media_type, location, length(url) % 11 AS n FROM {asks} WHERE release = 'new') AS f WHERE n <> 4
"""
#: A deadline cut the rest off.
_MADE = "length(url) % 13 <> 5"


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout(spark, sf_dir)
    return kept(spark, sf_dir, "asks", lambda: written(probe.probe_plan(s, ORIGIN), "asks"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks and what each got, stored once: reports go over them several times."""
    plan = asks(spark, sf_dir)
    made = lambda: probe.answered(plan, spark.sql(RESPONSES, asks=plan)).withColumn("made", F.expr(_MADE))
    return kept(spark, sf_dir, "answers", lambda: written(made(), "answers"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).filter("made")
    return probe.with_unreachable_hosts(probe.judge(rows), rows, ORIGIN)


_HOST = f"'{ORIGIN}'"
_ASK = "NULL AS location, {0} AS required"
ASKS = f"""{SITE},
asks AS MATERIALIZED (
  SELECT release, {_HOST} || mount AS url, 'text/html' AS accept, 'page' AS expect, 'text/html' AS media_type, CAST(NULL AS VARCHAR) AS location, false AS required, 'namespace' AS subject, 'the document of ' || iri_base AS context FROM ent WHERE segment = ''
  UNION ALL SELECT release, {_HOST} || mount || 'llms.txt', 'text/plain', 'file', 'text/plain', NULL, false, 'agent index', 'the agent index of ' || iri_base FROM ent WHERE segment = ''
  UNION ALL SELECT release, {_HOST} || mount, 'text/html', 'page', 'text/html', NULL, false, 'release', 'release ' || segment || ' of ' || ns FROM ent WHERE segment <> ''
  UNION ALL SELECT release, {_HOST} || public, media_type, 'page', media_type, NULL, false, 'namespace', iri_base || local FROM adr WHERE extension = '.html'
  UNION ALL SELECT release, {_HOST} || request, media_type, 'sibling', media_type, {_HOST} || public, false, 'namespace', iri_base || local FROM adr WHERE extension <> '.html'
  UNION ALL SELECT release, {_HOST} || public, media_type, 'file', media_type, NULL, true, 'namespace', 'the ' || media_type || ' of ' || iri_base || local FROM adr WHERE extension <> '.html'),
resp AS ({RESPONSES.replace('{asks}', 'asks')}),
ans AS MATERIALIZED (SELECT a.*, coalesce(r.status, 0) AS status, coalesce(r.content_type, '') AS content_type, coalesce(r.vary, '') AS vary, coalesce(r.link, '') AS link, coalesce(r.location, '') AS redirect, length(a.url) % 13 <> 5 AS made FROM asks a LEFT JOIN resp r ON r.release = a.release AND r.url = a.url AND r.accept = a.accept),
j AS (SELECT *, lower(trim(split_part(content_type, ';', 1))) = lower(media_type) AS fit, status BETWEEN 301 AND 308 AS moved, list_contains(list_transform(string_split(vary, ','), lambda v: lower(trim(v))), 'accept') AS varies FROM ans WHERE made),
raw_found AS MATERIALIZED (SELECT release, rule, level, foops, url, accept, subject, context, detail, expect FROM (
  SELECT *, 'probe.unreachable' AS rule, 'error' AS level, 'URI1' AS foops, '' AS detail FROM j WHERE status = 0
  UNION ALL SELECT *, 'probe.no-page', 'error', 'URI1', '' FROM j WHERE status NOT IN (0, 200) AND expect = 'page'
  UNION ALL SELECT *, 'probe.wrong-type', 'error', 'URI1', '' FROM j WHERE status = 200 AND expect = 'page' AND NOT fit
  UNION ALL SELECT *, 'probe.redirect-without-location', 'error', 'CN1', '' FROM j WHERE moved AND expect = 'sibling' AND redirect = ''
  UNION ALL SELECT *, 'probe.wrong-redirect', 'error', 'CN1', '' FROM j WHERE moved AND expect = 'sibling' AND redirect <> '' AND rtrim(redirect, '/') <> rtrim(location, '/')
  UNION ALL SELECT *, 'probe.not-negotiated', 'error', 'CN1', '' FROM j WHERE status = 200 AND expect = 'sibling' AND NOT fit
  UNION ALL SELECT *, 'probe.no-representation', 'error', CASE WHEN contains(media_type, 'markdown') THEN 'CN1' ELSE 'RDF1' END, '' FROM j WHERE expect = 'sibling' AND status NOT IN (0, 200) AND NOT moved
  UNION ALL SELECT *, 'probe.no-vary', 'warning', 'CN1', '' FROM j WHERE expect = 'sibling' AND (moved OR status = 200) AND NOT varies
  UNION ALL SELECT *, 'probe.no-signpost', 'warning', NULL, r FROM (SELECT *, unnest(['cite-as', 'describedby']) AS r FROM j WHERE expect = 'sibling' AND (moved OR status = 200)) WHERE NOT contains(link, r)
  UNION ALL SELECT *, CASE WHEN required THEN 'probe.no-representation' ELSE 'probe.missing-file' END, CASE WHEN required THEN 'error' ELSE 'warning' END, CASE WHEN required THEN 'RDF1' END, '' FROM j WHERE expect = 'file' AND status NOT IN (0, 200)
  UNION ALL SELECT *, 'probe.wrong-type', CASE WHEN required THEN 'error' ELSE 'warning' END, CASE WHEN required THEN 'RDF1' END, '' FROM j WHERE expect = 'file' AND status = 200 AND NOT fit AND content_type <> '')),
dead AS (SELECT release, count(*) AS made, min(accept) AS accept FROM j GROUP BY release HAVING count(*) >= 2 AND count(*) FILTER (status = 0) = count(*)),
found AS MATERIALIZED (SELECT * FROM raw_found WHERE release NOT IN (SELECT release FROM dead) UNION ALL SELECT release, 'probe.host-unreachable', 'error', 'URI1', {_HOST}, accept, 'namespace', 'not one of ' || made || ' requests', '', 'page' FROM dead)
"""
ASKS = ASKS.replace("SELECT *, 'probe.no-signpost', 'warning', NULL, r FROM (SELECT *, unnest(['cite-as', 'describedby']) AS r FROM j", "SELECT * EXCLUDE (r), 'probe.no-signpost', 'warning', NULL, r FROM (SELECT *, unnest(['cite-as', 'describedby']) AS r FROM j")


def on_answers(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE[name] = build, ASKS + sql


on_answers("probe_plan", asks, "SELECT * FROM asks")
on_answers("judge_response", lambda spark, sf_dir: probe.judge(answers(spark, sf_dir).filter("made")).drop("expect"), "SELECT * EXCLUDE (expect) FROM raw_found")
on_answers("probe_host_unreachable", lambda spark, sf_dir: found(spark, sf_dir).filter(c("rule") == "probe.host-unreachable").select("release", "url", "accept", "context"), "SELECT release, url, accept, context FROM found WHERE rule = 'probe.host-unreachable'")
for _rule in ("unreachable", "no-page", "wrong-type", "redirect-without-location", "wrong-redirect", "not-negotiated", "no-representation", "no-vary", "no-signpost", "missing-file"):
    on_answers("probe_" + _rule.replace("-", "_"), lambda spark, sf_dir, rule=f"probe.{_rule}": probe.judge(answers(spark, sf_dir).filter("made")).filter(c("rule") == rule).select("release", "url", "accept", "level", "foops", "detail"), f"SELECT release, url, accept, level, foops, detail FROM raw_found WHERE rule = 'probe.{_rule}'")
on_answers("probe_summary", lambda spark, sf_dir: probe.summary(found(spark, sf_dir)), "SELECT release, rule, level, count(*) AS n, min(context) AS example FROM found GROUP BY ALL")
_REPORT = "(SELECT release, count(*) AS requests, count(*) FILTER (made) AS made, count(*) FILTER (made) < count(*) AS truncated, (SELECT count(*) FROM found f WHERE f.release = a.release AND level = 'error') AS errors, (SELECT count(*) FROM found f WHERE f.release = a.release AND level = 'warning') AS warnings FROM ans a GROUP BY release)"
on_answers("probe_report", lambda spark, sf_dir: probe.report(answers(spark, sf_dir), found(spark, sf_dir)), f"SELECT * FROM {_REPORT}")
on_answers("probe_gate", lambda spark, sf_dir: probe.gate(probe.report(answers(spark, sf_dir), found(spark, sf_dir)), "warning"), f"SELECT release, NOT (errors > 0 OR warnings > 0 OR truncated) AS passed FROM {_REPORT}")
_TESTS = {"URI1": "expect = 'page'", "CN1": "expect = 'sibling'", "RDF1": "expect = 'file' AND required", "VER2": "expect = 'page' AND subject = 'release'"}
on_answers(
    "foops_rollup",
    lambda spark, sf_dir: probe.foops(answers(spark, sf_dir)),
    "SELECT release, test, CASE WHEN bad > 0 THEN 'fail' WHEN n = 0 THEN 'not applicable' WHEN m = 0 THEN 'not measured' ELSE 'pass' END AS outcome FROM ("
    + " UNION ALL ".join(f"SELECT release, '{t}' AS test, count(*) FILTER ({own}) AS n, count(*) FILTER ({own} AND made) AS m, count(*) FILTER ({own} AND made AND (release, url, accept, expect) IN (SELECT (release, url, accept, expect) FROM raw_found WHERE level = 'error')) AS bad FROM ans GROUP BY release" for t, own in _TESTS.items())
    + ")",
)

# conformance

_ENTRY = "SELECT release, ns, '{0}' AS role, {1} AS segment, {2} AS local, {3} AS path, {4} AS iri FROM {5}"
_NONE = "CAST(NULL AS VARCHAR)"
_PAGE = "mount || local || CASE style WHEN 'dir' THEN '/' ELSE '' END"
_TTL = "mount || local || CASE style WHEN 'dir' THEN '/index.ttl' ELSE '.ttl' END"
_CANON = f"rtrim(base_url, '/') || {_PAGE}"
_ABSENT, _GONE = conform.ABSENT_NAME, conform.ABSENT_RELEASE


def _role(name: str, path: str, iri: str, source: str, local: str = _NONE, segment: str = "''") -> str:
    return _ENTRY.format(name, segment, local, path, iri, source)


#: What clients have asked for, by event.
ASKED_FOR = """
SELECT CASE event_id % 5 WHEN 0 THEN 'text/turtle;q=0.' || (event_id % 7 + 1) || ', text/html;q=0.4' WHEN 1 THEN 'application/ld+json'
    WHEN 2 THEN event_type || '/*, */*;q=0.' || (event_id % 3 + 1) WHEN 3 THEN CAST(NULL AS STRING) ELSE 'text/markdown, */*' END AS accept,
  CASE WHEN event_id % 35 = 4 THEN 'format=ttl' WHEN event_id % 55 = 9 THEN '_mediatype=application/ld+json' END AS query
FROM {events}
"""
_CHOSEN = """
CASE WHEN query = 'format=ttl' THEN 'text/turtle' WHEN query IS NOT NULL THEN 'application/ld+json'
  WHEN accept LIKE 'text/turtle;%' THEN CASE WHEN substr(accept, 16, 2) >= '.4' THEN 'text/turtle' ELSE 'text/html' END
  WHEN accept = 'application/ld+json' THEN accept WHEN accept LIKE 'text/markdown%' THEN 'text/markdown' ELSE 'text/html' END
"""
_WANTED = f"SELECT DISTINCT accept, query, {_CHOSEN} AS media_type FROM ({duck(ASKED_FOR)})"
_CONTRACT = f"""
cas AS MATERIALIZED (
  SELECT role || ' ' || coalesce(accept, '-') || ' ' || coalesce(query, '-') AS "case", grp, role, accept, query, expect, media_type
  FROM (
    SELECT 'pages' AS grp, unnest({conform.PAGES}) AS role, accept, query, CASE media_type WHEN 'text/html' THEN 'serve' ELSE 'redirect' END AS expect, media_type FROM ({_WANTED})
    UNION ALL SELECT 'files', unnest({list(conform.FILES)}), NULL, NULL, 'file', unnest({list(conform.FILES.values())})
    UNION ALL SELECT 'absent', unnest({conform.ABSENT}), NULL, NULL, 'absent', NULL))
"""
CASES = f"""{SITE},
nam AS (SELECT release, ns, min(local) AS term, min(local) FILTER (in_directory) AS dir_term FROM st GROUP BY ALL),
rb AS MATERIALIZED (SELECT e.*, n.term, n.dir_term, m.reserved, m.versions FROM ent e LEFT JOIN nam n USING (release, ns) JOIN man m USING (release, ns) WHERE segment = ''),
fs AS (SELECT * FROM ent WHERE segment <> '' QUALIFY row_number() OVER (PARTITION BY release, ns ORDER BY segment) = 1),
vari AS (SELECT release, ns, arg_min(v, local) AS variant FROM (SELECT release, ns, local, {_FLIP.format('local')} AS v FROM st) x WHERE v <> local AND NOT EXISTS (SELECT 1 FROM st WHERE st.release = x.release AND st.ns = x.ns AND st.local = x.v) GROUP BY ALL),
nest AS (SELECT a.release, a.ns, arg_min(b.mount, b.ns) AS m, min(b.ns) AS i FROM ent a JOIN ent b ON b.release = a.release AND b.segment = '' AND b.mount <> a.mount AND starts_with(b.mount, a.mount) WHERE a.segment = '' GROUP BY ALL),
roles AS MATERIALIZED (
  {_role('term', _PAGE, _CANON, 'rb JOIN st USING (release, ns) WHERE local = term', 'local')}
  UNION ALL {_role('dir-term', _PAGE, _CANON, 'rb JOIN st USING (release, ns) WHERE local = dir_term', 'local')}
  UNION ALL {_role('sibling', _TTL, 'iri_base || local', 'rb JOIN st USING (release, ns) WHERE local = term')}
  UNION ALL {_role('namespace', 'mount', 'iri_base', 'rb')}
  UNION ALL {_role('nested-namespace', 'm', 'i', 'nest')}
  UNION ALL {_role('release-term', _PAGE, _CANON, 'fs JOIN nam USING (release, ns) JOIN st USING (release, ns) WHERE local = term', 'local', 'segment')}
  UNION ALL {_role('empty-namespace', f"mount || '{_ABSENT}'", f"iri_base || '{_ABSENT}'", 'rb WHERE term IS NULL')}
  UNION ALL {_role('reserved-segment', "mount || list_filter(reserved, lambda x: NOT list_contains(versions, x))[1] || '.ttl'", "iri_base || list_filter(reserved, lambda x: NOT list_contains(versions, x))[1]", 'rb WHERE len(list_filter(reserved, lambda x: NOT list_contains(versions, x))) > 0')}
  UNION ALL {_role('sub-term-path', "mount || term || '/extra'", "iri_base || term || '/extra'", 'rb WHERE term IS NOT NULL')}
  UNION ALL {_role('absent-name', f"mount || '{_ABSENT}'", f"iri_base || '{_ABSENT}'", 'rb')}
  UNION ALL {_role('absent-release', f"mount || '{_GONE}/' || term", f"iri_base || '{_GONE}/' || term", 'rb WHERE term IS NOT NULL')}
  UNION ALL {_role('case-variant', "mount || variant", "iri_base || variant", 'rb JOIN vari USING (release, ns)')}
  UNION ALL {_role('sibling-unpublished', "mount || term || '.nt'", "iri_base || term", 'rb WHERE term IS NOT NULL')}
  UNION ALL {_role('absent-release-name', f"mount || '{_ABSENT}'", f"iri_base || '{_ABSENT}'", 'fs')}),
{_CONTRACT},
resolved AS MATERIALIZED (SELECT r.release, r.ns, k."case", k.grp, k.role, r.path, k.accept, k.query, k.expect, k.media_type, CASE expect WHEN 'serve' THEN r.iri END AS names, CASE expect WHEN 'redirect' THEN a.public END AS location, CASE expect WHEN 'redirect' THEN {STATUS} END AS status, CASE WHEN expect <> 'absent' THEN e.cache END AS cache, CASE WHEN expect IN ('serve', 'redirect') THEN l.link END AS link
  FROM cas k JOIN roles r USING (role) JOIN ent e ON e.release = r.release AND e.ns = r.ns AND e.segment = r.segment LEFT JOIN adr a ON a.release = r.release AND a.ns = r.ns AND a.segment = r.segment AND a.local = r.local AND a.media_type = k.media_type LEFT JOIN lnk2 l ON l.release = r.release AND l.ns = r.ns AND l.segment = r.segment AND l.local = r.local AND l.media_type = k.media_type
  WHERE expect IN ('file', 'absent') OR l.link IS NOT NULL)
"""
#: What a host answers to each case, by the length of its path and case name; {cases} are the resolved ones.
REPLIES = f"""
SELECT f.*, '{ORIGIN}' || path AS url, CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN 500 WHEN expect = 'absent' THEN CASE WHEN n = 2 THEN 200 WHEN n = 3 THEN 302 ELSE 404 END WHEN expect = 'redirect' THEN CASE WHEN n = 2 THEN 302 ELSE 303 END ELSE 200 END AS got_status,
  CASE WHEN n = 3 THEN 'text/plain' ELSE media_type || '; charset=utf-8' END AS got_type, CASE WHEN n = 4 THEN location ELSE '{ORIGIN}' || location END AS got_location, CASE WHEN n = 5 THEN 'Origin' ELSE 'Accept' END AS got_vary, CASE WHEN n = 6 THEN '' ELSE link END AS got_link,
  CASE WHEN n = 7 THEN 'no-store' ELSE cache END AS got_cache, CASE WHEN n = 8 THEN '' ELSE '*' END AS got_cors, CASE WHEN n = 9 THEN 'none' ELSE 'see href="' || names || '"' END AS body
FROM (SELECT *, (length(path) + length(grp) + length(role)) % 12 AS n FROM {{cases}}) AS f
"""
_VERDICT = f"""CASE WHEN got_status = 0 THEN 'no answer' WHEN expect = 'absent' THEN CASE WHEN got_status = 404 THEN NULL WHEN got_status BETWEEN 200 AND 299 THEN 'a page for a name that isn''t minted' WHEN got_status BETWEEN 300 AND 399 THEN 'a redirect for a name that isn''t minted' ELSE 'not 404 for a name that isn''t minted' END
  WHEN expect = 'serve' AND got_status <> 200 THEN 'does not resolve' WHEN expect = 'serve' AND NOT fit THEN 'another type' WHEN expect = 'serve' AND NOT contains(coalesce(body, ''), 'href="' || names || '"') THEN 'another page'
  WHEN expect = 'redirect' AND coalesce(got_location, '') <> '{ORIGIN}' || location THEN 'redirects elsewhere' WHEN expect = 'redirect' AND got_status <> status THEN 'another status' WHEN expect = 'file' AND (got_status <> 200 OR NOT fit) THEN 'no such file'
  WHEN link IS NOT NULL AND coalesce(got_link, '') <> link THEN 'another Link header' WHEN got_vary <> 'Accept' THEN 'no Vary: Accept' WHEN got_cache <> cache THEN 'another Cache-Control' WHEN got_cors <> '*' THEN 'not open to other origins' END"""
VERDICTS = f"""{CASES},
verdict AS MATERIALIZED (SELECT release, ns, "case", grp, {_VERDICT} IS NULL AS passed, {_VERDICT} AS consequence FROM (SELECT *, split_part(got_type, ';', 1) = media_type AS fit FROM ({REPLIES.replace('{cases}', 'resolved')}))),
gap AS (SELECT release, "case" FROM (SELECT DISTINCT release FROM man), cas WHERE (release, "case") NOT IN (SELECT (release, "case") FROM resolved))
"""


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "contract", lambda: written(conform.contract(view(spark, sf_dir, ASKED_FOR)), "contract"), ("events",))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, asked = layout(spark, sf_dir), contract(spark, sf_dir)
    return kept(spark, sf_dir, "cases", lambda: written(conform.resolve_cases(s, asked), "cases"), (*SOURCES, "events"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.judge_cases(spark.sql(REPLIES, cases=cases(spark, sf_dir)))


query("case_roles", conform.roles, "SELECT * FROM roles", CASES)
for _name in [*conform.PAGES, *conform.FILES, *conform.ABSENT]:
    query("role_" + _name.replace("-", "_"), lambda s, name=_name: conform.roles(s).filter(c("role") == name).drop("role"), f"SELECT * EXCLUDE (role) FROM roles WHERE role = '{_name}'", CASES)
QUERIES["resolve_cases"], ORACLE["resolve_cases"] = cases, CASES + "SELECT * FROM resolved"
QUERIES["judge_case"], ORACLE["judge_case"] = verdicts, VERDICTS + "SELECT * FROM verdict"
QUERIES["conformance_report"] = lambda spark, sf_dir: conform.conformance_report(verdicts(spark, sf_dir), conform.unresolved(layout(spark, sf_dir), contract(spark, sf_dir), cases(spark, sf_dir)))
ORACLE["conformance_report"] = VERDICTS + 'SELECT release, grp, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, (SELECT count(*) FROM gap g WHERE g.release = v.release) AS unresolved, (SELECT count(*) FROM gap g WHERE g.release = v.release) = 0 AND (SELECT count(*) FROM verdict w WHERE w.release = v.release AND NOT passed) = 0 AS conformant FROM verdict v GROUP BY release, grp'
#: A request for each event, and the lines of a response log: some are missing, some are short.
ASKED = "SELECT event_id AS n, '/part/' || user_id AS path FROM {events}"
LOG = "SELECT event_id AS n, CASE WHEN event_id % 11 = 0 THEN 'timeout' WHEN event_id % 13 = 0 THEN '404' ELSE '200' || chr(9) || 'text/turtle' || chr(9) || 'Accept' || chr(9) || event_type || chr(9) || '/part/' || user_id || chr(9) || 'no-store' || CASE WHEN event_id % 2 = 0 THEN chr(9) || '*' ELSE '' END END AS line FROM {events} WHERE event_id % 7 > 0"
QUERIES["scan_responses"] = lambda spark, sf_dir: probe.scan_responses(view(spark, sf_dir, ASKED), view(spark, sf_dir, LOG))
_AT = "coalesce(split_part(line, chr(9), {}), '')"
ORACLE["scan_responses"] = f"SELECT n, path, coalesce(TRY_CAST(split_part(line, chr(9), 1) AS INTEGER), 0) AS status, {', '.join(f'{_AT.format(i + 2)} AS {x}' for i, x in enumerate(('content_type', 'vary', 'link', 'location', 'cache_control', 'cors')))} FROM ({duck(ASKED)}) a LEFT JOIN ({duck(LOG)}) l USING (n)"
