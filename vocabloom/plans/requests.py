"""Registered queries of negotiation and of the colour audit, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contrast, negotiate, probe
from ..streaming import requests as streams
from .inputs import duck, view
from .models import kept
from .publish import ASKS, REPS, SITE, answers, layout
from .scalars import _luminance

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

REQUESTS = """
SELECT event_id AS request_id, 'new' AS release, ts, CASE event_id % 12 WHEN 0 THEN '/places/region-' || (user_id % 7) WHEN 1 THEN '/part/' || user_id || '.ttl' WHEN 2 THEN '/part/' || user_id || '/x' WHEN 3 THEN '/nowhere' WHEN 4 THEN '/part/' WHEN 5 THEN '/part/absent' WHEN 6 THEN '/part/' || user_id || '/' WHEN 7 THEN '/range/' || (user_id % 25 + 1) || '/Item' || (user_id * 4 + 3)
  WHEN 8 THEN '/range/' || (user_id % 25 + 1) || '/1.' || (user_id % 25 + 1) || '/Item' || (user_id * 4 + 3) WHEN 9 THEN '/range/' || (user_id % 25 + 1) || '/index' ELSE '/part/' || user_id END AS path,
  CASE event_type WHEN 'click' THEN 'text/html,application/xml;q=0.9,*/*;q=0.8' WHEN 'view' THEN 'text/turtle' WHEN 'purchase' THEN 'text/html;q=0.1, text/turtle' WHEN 'signup' THEN '*/*;q=1.0, application/n-triples;q=0.1' ELSE CASE WHEN event_id % 2 = 0 THEN 'image/png' ELSE 'application/rdf+xml' END END AS accept,
  CASE WHEN event_id % 19 = 0 THEN 'format=md' WHEN event_id % 23 = 0 THEN '_mediatype=application/ld+json' END AS query
FROM {events}
"""
_TYPE = "CASE WHEN query = 'format=md' THEN 'text/markdown' WHEN query IS NOT NULL THEN 'application/ld+json' WHEN accept LIKE 'text/html,%' THEN 'text/html' WHEN accept LIKE '%text/turtle' THEN 'text/turtle' WHEN accept = 'application/rdf+xml' THEN 'text/turtle' ELSE 'text/html' END"


def resolve_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negotiate.resolve(view(spark, sf_dir, REQUESTS), layout(spark, sf_dir)).drop("path")


def select_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.chosen_types(view(spark, sf_dir, REQUESTS)).select("request_id", "media_type")


def requests_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.counts_by_window(view(spark, sf_dir, REQUESTS)).withColumn("start", F.unix_timestamp("start"))


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout(spark, sf_dir)
    files = s.term_paths.select("release", "path").unionByName(s.document_paths().select("release", "path"))
    return negotiate.answers(view(spark, sf_dir, REQUESTS), s, files)


def stream_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = layout(spark, sf_dir)
    return kept(spark, sf_dir, "stream_resolve", lambda: streams.through(view(spark, sf_dir, REQUESTS), lambda rows: streams.resolved(rows, s), "requests"), ("events", "part")).drop("path")


#: When an ask was answered, and with which of three deliveries that came: the last one brings what was held up.
_TS = "length(url) * 600 + 1700000000"
_DELIVERY = "CASE WHEN length(url) % 7 = 0 THEN 2 WHEN length(url) < 50 THEN 0 ELSE 1 END"
LATE = 600


def stream_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run() -> DataFrame:
        rows = answers(spark, sf_dir).filter("made").withColumn("ts", F.timestamp_seconds(F.expr(_TS)))
        parts = [rows.filter(F.expr(_DELIVERY) == i) for i in range(3)]
        found, late = streams.arrivals(parts, lambda x: streams.findings_by_window(x, "1 hour", f"{LATE} seconds"), "answers")
        return found.withColumns({"start": F.unix_timestamp("start"), "late": F.lit(late)})

    return kept(spark, sf_dir, "stream_windows", run)


def stream_requests_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda rows: streams.counts_by_window(rows, "1 hour", f"{LATE} seconds")
    hours = kept(spark, sf_dir, "stream_hours", lambda: streams.through(view(spark, sf_dir, REQUESTS), made, "hours"), ("events",))
    return hours.withColumn("start", F.unix_timestamp("start"))


def stream_findings_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = probe.judge(answers(spark, sf_dir).filter("made")).select("release", "url", "rule", F.timestamp_seconds(F.length("url")).alias("ts"))
    return kept(spark, sf_dir, "stream_dedup", lambda: streams.through(rows.filter("release = 'new'"), streams.first_findings, "findings")).select("url", "rule")


ROLES = ["text", "text-muted", "link", "link-visited", "focus", "surface", "surface-alt", "surface-code", "border", "badge-fg", "badge-bg", "banner-fg", "banner-bg"]
PALETTE = "SELECT CAST(vec_id AS STRING) AS theme, scheme, role, CASE WHEN vec_id % 17 = 0 AND role_no = 3 THEN '#12' ELSE '#' || lower(substr(hex(268435456 + (vec_id * 7919 + role_no * 1047290 + CASE scheme WHEN 'dark' THEN 5550 ELSE 0 END) % 16777216), 2, 6)) END AS hex FROM {embeddings}, (VALUES " + ", ".join(f"('{r}', {i})" for i, r in enumerate(ROLES)) + ") AS r(role, role_no), (VALUES ('light'), ('dark')) AS s(scheme)"
#: What themes put over the defaults: some colours of roles, some roles that are none.
OVERLAY = f"SELECT theme, scheme, CASE WHEN role = 'focus' AND CAST(theme AS INT) % 5 = 0 THEN 'halo' ELSE role END AS role, '#00' || substr(hex, 4) AS hex FROM ({PALETTE}) AS p WHERE role <> 'border' OR CAST(theme AS INT) % 3 > 0"
SHEETS = "SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, 's' || page_id || '.css' AS path, ':root ' || chr(123) || ' --ink: #000; --t' || page_id % 4 || ': #fff ' || chr(125) || ' a ' || chr(123) || ' color: var(--ink); background: var( --t' || page_id % 6 || ' ) ' || chr(125) || ' b ' || chr(123) || ' color: var(--none, red) ' || chr(125) AS css FROM {pages}"
_PAIRS = "(VALUES " + ", ".join(f"('{a}', '{b}', '{k}', {contrast.LEAST_RATIO[k]})" for k, ps in (("body-text", contrast.BODY_TEXT), ("non-text", contrast.NON_TEXT), ("link-vs-text", contrast.LINK_VS_TEXT)) for a, b in ps) + ") AS w(fg, bg, basis, least)"
_CONTRAST = f"WITH p AS ({duck(PALETTE)}), l AS (SELECT p.*, {_luminance('hex')} AS y FROM p WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.theme = p.theme AND b.scheme = p.scheme AND length(b.hex) <> 7)), x AS (SELECT a.theme, a.scheme, w.fg, w.bg, w.basis, (greatest(a.y, b.y) + 0.05) / (least(a.y, b.y) + 0.05) AS ratio, w.least AS bar FROM l a JOIN {_PAIRS} ON w.fg = a.role JOIN l b ON b.theme = a.theme AND b.scheme = a.scheme AND b.role = w.bg) "


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrast.contrast_pairs(view(spark, sf_dir, PALETTE), contrast.pair_table(spark, underlined=False))


QUERIES |= {
    "resolve_request": resolve_request,
    "select_representation": select_representation,
    "requests_by_hour": requests_by_hour,
    "match_namespace": lambda spark, sf_dir: negotiate.match(view(spark, sf_dir, REQUESTS), layout(spark, sf_dir)),
    "answer_log": answer_log,
    "stream_resolve": stream_resolve,
    "stream_judge": stream_judge,
    "stream_requests_by_hour": stream_requests_by_hour,
    "stream_findings_dedup": stream_findings_dedup,
    "theme_contrast_large_text": lambda spark, sf_dir: contrast.contrast_pairs(view(spark, sf_dir, PALETTE), spark.createDataFrame([("text-muted", bg, "large-text") for bg in contrast.SURFACES], "fg string, bg string, basis string")).filter(~F.col("passed")).select("theme", "scheme", "fg", "bg"),
    "theme_token_schema": lambda spark, sf_dir: contrast.schema_faults(view(spark, sf_dir, OVERLAY)),
    "palette_merge": lambda spark, sf_dir: contrast.merged(view(spark, sf_dir, PALETTE), view(spark, sf_dir, OVERLAY)),
    "published_gate": lambda spark, sf_dir: contrast.published_gate(view(spark, sf_dir, PALETTE), contrast.pair_table(spark, underlined=False)),
    "undefined_tokens": lambda spark, sf_dir: contrast.undefined_tokens(view(spark, sf_dir, SHEETS)),
    "contrast_pairs": lambda spark, sf_dir: _pairs(spark, sf_dir).withColumn("ratio", F.round("ratio", 6)),
    "theme_token_syntax": lambda spark, sf_dir: contrast.malformed(view(spark, sf_dir, PALETTE)).select("theme", "scheme", "role"),
}
MATCHED = SITE.rstrip() + f""",
rq AS ({duck(REQUESTS)}),
owq AS (SELECT r.*, e.ns, e.mount AS m0, rtrim(substr(r.path, length(e.mount) + 1), '/') AS rest FROM rq r JOIN ent e ON e.release = r.release AND e.segment = '' AND starts_with(r.path, e.mount) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY length(e.mount) DESC) = 1),
mat AS (SELECT o.*, coalesce(s.segment, '') AS segment, CASE WHEN s.segment IS NOT NULL THEN substr(rest, length(s.segment) + 2) ELSE rest END AS local FROM owq o LEFT JOIN snap s ON s.release = o.release AND s.ns = o.ns AND contains(rest, '/') AND s.segment = split_part(rest, '/', 1)),
res AS (SELECT request_id, release, path, CASE WHEN media_type IS NULL THEN 'pass-through' WHEN media_type = 'text/html' THEN 'serve' ELSE 'redirect' END AS outcome, media_type, CASE WHEN media_type = 'text/html' THEN file ELSE public END AS target, CASE WHEN media_type = 'text/html' THEN 200 WHEN media_type IS NOT NULL THEN 303 END AS status
  FROM (SELECT r.request_id, r.release, r.path, a.media_type, a.file, a.public FROM (SELECT *, {_TYPE} AS want FROM rq) r LEFT JOIN mat m USING (request_id) LEFT JOIN adr a ON a.release = r.release AND a.ns = m.ns AND a.segment = m.segment AND a.local = m.local AND a.media_type = r.want)),
fil AS (SELECT DISTINCT release, file AS path FROM adr WHERE segment = '' UNION SELECT release, mount || CASE media_type WHEN 'text/markdown' THEN 'index' WHEN 'text/html' THEN 'index' ELSE stem END || extension FROM nsp, {REPS} UNION SELECT release, mount || 'llms.txt' FROM nsp)
"""
ORACLE |= {
    "select_representation": f"SELECT request_id, {_TYPE} AS media_type FROM ({duck(REQUESTS)}) AS r",
    "requests_by_hour": f"SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, {_TYPE} AS media_type, count(*) AS n FROM ({duck(REQUESTS)}) AS r GROUP BY ALL",
    "match_namespace": MATCHED + "SELECT DISTINCT release, path, ns, segment, local FROM mat",
    "resolve_request": MATCHED + "SELECT request_id, release, outcome, media_type, target, status FROM res",
    "stream_resolve": MATCHED + "SELECT request_id, release, outcome, media_type, target, status FROM res",
    "answer_log": MATCHED + f"""SELECT request_id, CASE WHEN outcome <> 'pass-through' THEN outcome WHEN file IS NOT NULL THEN 'file' ELSE 'missing' END AS outcome, CASE WHEN outcome <> 'pass-through' THEN status WHEN file IS NOT NULL THEN 200 ELSE 404 END AS status, CASE WHEN outcome <> 'pass-through' THEN target ELSE file END AS target, CASE WHEN outcome = 'serve' OR outcome = 'pass-through' AND file LIKE '%.html' THEN 'text/html; charset=utf-8' WHEN outcome = 'pass-through' AND file LIKE '%.ttl' THEN 'text/turtle; charset=utf-8' WHEN outcome = 'pass-through' AND file LIKE '%.md' THEN 'text/markdown; charset=utf-8' WHEN outcome = 'pass-through' AND file LIKE '%.txt' THEN 'text/plain; charset=utf-8' WHEN outcome = 'pass-through' AND file LIKE '%.jsonld' THEN 'application/ld+json' END AS content_type
  FROM (SELECT r.*, coalesce(f0.path, f1.path, f2.path) AS file FROM res r LEFT JOIN fil f0 ON f0.release = r.release AND f0.path = ltrim(r.path, '/') LEFT JOIN fil f1 ON f1.release = r.release AND f1.path = ltrim(r.path, '/') || 'index.html' LEFT JOIN fil f2 ON f2.release = r.release AND f2.path = ltrim(r.path, '/') || '/index.html')""",
    # a window comes out once the watermark has passed its end; of the last delivery, what is older than the watermark counts as late
    "stream_judge": ASKS
    + f""", w AS (SELECT max({_TS}) FILTER ({_DELIVERY} < 2) - {LATE} AS before, max({_TS}) - {LATE} AS after FROM ans WHERE made),
d AS (SELECT DISTINCT *, CAST(floor(({_TS}) / 3600) * 3600 AS BIGINT) AS start FROM raw_found, w WHERE {_DELIVERY} < 2 OR {_TS} > before)
SELECT release, start, rule, level, count(*) AS n, min(context) AS example, CAST((SELECT count(*) FROM ans, w WHERE made AND {_DELIVERY} = 2 AND {_TS} <= before) AS INTEGER) AS late
FROM d WHERE start + 3600 <= after GROUP BY ALL""",
    "stream_requests_by_hour": f"""WITH r AS ({duck(REQUESTS)}), w AS (SELECT max(epoch(ts)) - {LATE} AS after FROM r)
SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, {_TYPE} AS media_type, count(*) AS n FROM r, w WHERE floor(epoch(ts) / 3600) * 3600 + 3600 <= after GROUP BY ALL""",
    "stream_findings_dedup": ASKS + "SELECT DISTINCT url, rule FROM raw_found WHERE release = 'new'",
    "theme_contrast_large_text": _CONTRAST.replace(_PAIRS, "(VALUES " + ", ".join(f"('text-muted', '{bg}', 'large-text', 3.0)" for bg in contrast.SURFACES) + ") AS w(fg, bg, basis, least)") + "SELECT theme, scheme, fg, bg FROM x WHERE ratio < bar",
    "theme_token_schema": f"WITH o AS ({duck(OVERLAY)}) SELECT theme, scheme, role, 'unknown' AS fault FROM o WHERE role NOT IN ({', '.join(repr(r) for r in contrast.ROLES)}) UNION ALL SELECT theme, scheme, role, 'missing' FROM (SELECT DISTINCT theme, scheme FROM o), (SELECT unnest({contrast.ROLES}) AS role) WHERE (theme, scheme, role) NOT IN (SELECT (theme, scheme, role) FROM o)",
    "palette_merge": f"SELECT coalesce(o.theme, p.theme) AS theme, coalesce(o.scheme, p.scheme) AS scheme, coalesce(o.role, p.role) AS role, coalesce(o.hex, p.hex) AS hex FROM ({duck(PALETTE)}) p FULL OUTER JOIN ({duck(OVERLAY)}) o ON o.theme = p.theme AND o.scheme = p.scheme AND o.role = p.role",
    "published_gate": _CONTRAST + "SELECT theme, failed, faults, failed + faults = 0 AS publishable FROM (SELECT theme, (SELECT count(*) FROM x WHERE x.theme = t.theme AND ratio < bar) AS failed, (SELECT count(*) FROM p WHERE p.theme = t.theme AND length(hex) <> 7) AS faults FROM (SELECT DISTINCT theme FROM p) t)",
    "undefined_tokens": f"WITH s AS ({duck(SHEETS)}) SELECT DISTINCT site, path, token FROM (SELECT site, path, unnest(regexp_extract_all(css, 'var\\(\\s*(--[A-Za-z0-9_-]+)\\s*\\)', 1)) AS token FROM s) WHERE (site, token) NOT IN (SELECT (site, unnest(regexp_extract_all(css, '(--[A-Za-z0-9_-]+)\\s*:', 1))) FROM s)",
    "contrast_pairs": _CONTRAST + "SELECT theme, scheme, fg, bg, basis, round(ratio, 6) AS ratio, ratio >= bar AS passed FROM x",
    "theme_token_syntax": f"SELECT theme, scheme, role FROM ({duck(PALETTE)}) AS p WHERE length(hex) <> 7",
}
for _basis, _rule in contrast.RULES.items():
    if _basis != "large-text":  # no default pair has that basis
        _name = _rule.replace(".", "_").replace("-", "_")
        QUERIES[_name] = lambda spark, sf_dir, basis=_basis: _pairs(spark, sf_dir).filter((F.col("basis") == basis) & ~F.col("passed")).select("theme", "scheme", "fg", "bg")
        ORACLE[_name] = _CONTRAST + f"SELECT theme, scheme, fg, bg FROM x WHERE basis = '{_basis}' AND ratio < bar"
