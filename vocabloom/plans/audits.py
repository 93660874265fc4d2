"""Registered queries of the page audit over the page table, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from ..sources.tables import written
from .inputs import duck, view
from .models import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The page table with site and path; edits and snippets put in before the end of the article make the rarer rules fire.
PAGES = """
SELECT page, site, path, CASE page % 16
  WHEN 8 THEN regexp_replace(body, '<html lang="[^"]*">', '<html>')
  WHEN 9 THEN regexp_replace(body, '<html lang="[^"]*">', '<html lang="x_y">')
  WHEN 10 THEN regexp_replace(body, '<html lang="[^"]*">', '<body>')
  WHEN 11 THEN replace(replace(replace(body, '<title>', '<titel>'), '<h1>', '<h2>'), '</h1>', '</h2>')
  WHEN 12 THEN replace(body, 'charset', 'chars-t')
  WHEN 13 THEN CASE WHEN page % 32 = 13 THEN '' END
  WHEN 14 THEN CASE WHEN page % 32 = 14 THEN 'only text' ELSE body END
  ELSE body END AS html
FROM (SELECT page_id AS page, site, path, replace(html, '</article>', CASE page_id % 16
  WHEN 0 THEN '<h2 id="a">x</h2><h4 id="a">y</h4><a href="#a">a</a><a href="#b">b</a></article>'
  WHEN 1 THEN '<main id="">m</main><main id="m:1">n</main></article>'
  WHEN 2 THEN '<nav aria-label="x"></nav><h1>again</h1></article>'
  WHEN 3 THEN '<meta name="viewport" content="w"><p id="b c">p</p></article><!-- > open'
  WHEN 4 THEN '<table><tr><td>1<table><caption>in</caption></table></td></tr></table><table><tr><th>h</th><th scope="col">i</th></tr></table></article>'
  WHEN 5 THEN '<a href="/x"> </a><a href="/y" title="t"></a><a href="sub/page"><b>z</b></a></article>'
  WHEN 6 THEN '<p>&lt;code here</p><pre>&lt;span</pre><p>&lt;code &lt;div</p></article>'
  WHEN 7 THEN '<p lang="a_b">x</p><p lang="de">y</p><a href="' || site || '/The">abs</a><a href="' || site || '/gone">abs</a><a href="mailto:x">m</a></article>'
  ELSE '</article>' END) AS body
  FROM (SELECT page_id, html, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, regexp_extract(url, '^https?://[^/?#]*/([^?#]*)', 1) AS path FROM {pages}) AS f) AS g
"""
SITES = f"SELECT page, site, path, site || '/' AS base_url, '/' AS base_path, array('/and') AS external_paths FROM ({PAGES}) AS p"
KNOWN = f"SELECT site, CASE page % 3 WHEN 0 THEN path WHEN 1 THEN path || '.html' ELSE path || '/index.html' END AS path FROM ({PAGES}) AS p UNION SELECT site, x AS path FROM ({PAGES}) AS p, (VALUES ('The'), ('de.html'), ('to/index.html'), ('fr/sub/page')) AS v(x)"
MARKDOWN = f"SELECT site, path, site || '/' AS base_url, '/' AS base_path, 'See [one](' || CASE page % 5 WHEN 0 THEN site || '/The' WHEN 1 THEN '#top' WHEN 2 THEN '/The' WHEN 3 THEN '/gone' ELSE 'mailto:x' END || ') and [two](/de.html), [three](/no/' || page || ').' AS body FROM ({PAGES}) AS p"
_TAGS = f"""
WITH src AS ({duck(PAGES)}),
cut AS (SELECT page, regexp_extract_all(CASE WHEN contains(html, '<!-- > open') THEN split_part(html, '<!-- > open', 1) ELSE html END, '(<!--[\\s\\S]*?-->|<![^>]*>|<[^>]*>|[^<]+)') AS ps FROM src),
raw AS (SELECT page, unnest(ps) AS raw, generate_subscripts(ps, 1) - 1 AS pos FROM (SELECT page, CASE WHEN len(ps) > 0 THEN ps ELSE [''] END AS ps FROM cut)),
t AS (SELECT page, pos, raw, lower(regexp_extract(raw, '^</?([A-Za-z][A-Za-z0-9-]*)', 1)) AS name, starts_with(raw, '</') AS closing FROM raw),
o AS (SELECT * FROM t WHERE NOT closing AND name <> ''),
n AS (SELECT page, count(*) FILTER (name = 'html') AS html, count(*) FILTER (name = 'title') AS title, count(*) FILTER (name = 'header') AS header, count(*) FILTER (name = 'main') AS main, count(*) FILTER (name = 'footer') AS footer, count(*) FILTER (name = 'nav') AS nav, count(*) FILTER (name = 'nav' AND contains(raw, 'aria-label')) AS named, count(*) FILTER (name = 'h1') AS h1, count(*) FILTER (name = 'meta' AND contains(raw, 'name="viewport"')) AS viewport, min(regexp_extract(raw, 'lang="([^"]*)"', 1)) FILTER (name = 'html') AS lang FROM (SELECT page, name, raw FROM o UNION ALL SELECT DISTINCT page, '', '' FROM t) GROUP BY page),
ids AS (SELECT page, pos, regexp_extract(raw, ' id="([^"]*)"', 1) AS id FROM o WHERE contains(raw, ' id="'))
"""
SQL = {
    "a11y.no-html-element": "SELECT page, '' AS subject FROM n WHERE html = 0",
    "a11y.no-lang": "SELECT page, '' AS subject FROM n WHERE html > 0 AND lang = ''",
    "a11y.lang-invalid": "SELECT page, '' AS subject FROM n WHERE lang <> '' AND NOT regexp_matches(lang, '^[A-Za-z0-9]{1,8}(-[A-Za-z0-9]{1,8})*$')",
    "a11y.no-viewport": "SELECT page, '' AS subject FROM n WHERE viewport = 0",
    "a11y.no-title": "SELECT page, '' AS subject FROM n WHERE title = 0",
    "a11y.missing-landmark": "SELECT page, 'header' AS subject FROM n WHERE header = 0 UNION ALL SELECT page, 'main' FROM n WHERE main = 0 UNION ALL SELECT page, 'footer' FROM n WHERE footer = 0",
    "a11y.multiple-main": "SELECT page, '' AS subject FROM n WHERE main > 1",
    "a11y.unnamed-nav": "SELECT page, '' AS subject FROM n WHERE nav > 1 AND named < nav",
    "a11y.no-h1": "SELECT page, '' AS subject FROM n WHERE h1 = 0",
    "a11y.multiple-h1": "SELECT page, '' AS subject FROM n WHERE h1 > 1",
    "a11y.heading-skip": "SELECT page, arg_min(name, pos) AS subject FROM (SELECT page, pos, name, lag(name) OVER (PARTITION BY page ORDER BY pos) AS before FROM o WHERE regexp_matches(name, '^h[1-6]$')) WHERE CAST(substr(name, 2) AS INT) > CAST(substr(before, 2) AS INT) + 1 GROUP BY page",
    "a11y.empty-id": "SELECT page, id AS subject FROM ids WHERE id = ''",
    "a11y.invalid-id": "SELECT page, id AS subject FROM ids WHERE contains(id, ':') OR contains(id, ' ')",
    "a11y.duplicate-id": "SELECT page, id AS subject FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY pos) AS k FROM ids WHERE id <> '') WHERE k > 1",
    "a11y.dangling-fragment": "SELECT DISTINCT page, f AS subject FROM (SELECT page, regexp_extract(raw, ' href=\"#([^\"]+)\"', 1) AS f FROM o WHERE name = 'a') a WHERE f <> '' AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.page = a.page AND ids.id = f)",
    "a11y.empty-link": "SELECT page, CASE WHEN href = '' THEN '(no href)' ELSE href END AS subject FROM (SELECT page, part, max(regexp_extract(raw, ' href=\"([^\"]*)\"', 1)) FILTER (name = 'a' AND NOT closing) AS href, bool_or(name = 'a' AND NOT closing) AS opens, coalesce(bool_or(contains(raw, ' title=\"')) FILTER (name = 'a'), false) AS named, max(CASE WHEN starts_with(raw, '<') THEN 0 ELSE length(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) END) AS n FROM (SELECT *, count(*) FILTER (name = 'a') OVER (PARTITION BY page ORDER BY pos) AS part FROM t) WHERE part > 0 GROUP BY ALL) WHERE opens AND NOT named AND n = 0",
    "a11y.table-no-caption": "SELECT page, subject FROM tab WHERE captions = 0",
    "a11y.table-no-headers": "SELECT page, subject FROM tab WHERE headers = 0",
    "a11y.th-no-scope": "SELECT page, subject FROM tab WHERE headers > 0 AND scoped < headers",
    "html.escaped-markup": f"SELECT DISTINCT page, subject FROM (SELECT page, raw, coalesce(sum(CASE WHEN starts_with(raw, '<pre') THEN 1 WHEN starts_with(raw, '</pre>') THEN -1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM t), (SELECT unnest({pages.ESCAPED}) AS subject) WHERE depth <= 0 AND contains(raw, subject)",
    "a11y.lang-part-invalid": "SELECT page, l AS subject FROM (SELECT page, regexp_extract(raw, ' lang=\"([^\"]*)\"', 1) AS l FROM o WHERE name <> 'html' AND contains(raw, ' lang=\"')) WHERE NOT regexp_matches(l, '^[A-Za-z0-9]{1,8}(-[A-Za-z0-9]{1,8})*$')",
}
LINK_SQL = {
    "html.absolute-nav-link": "SELECT page, href AS subject FROM lin WHERE absolute AND NOT external AND found",
    "a11y.broken-internal-link": "SELECT page, href AS subject FROM lin WHERE NOT external AND NOT found",
}
_CHARSET = "SELECT page, '' AS subject FROM src WHERE NOT contains(lower(left(coalesce(html, ''), 1024)), 'charset')"
_TAGS = _TAGS.rstrip() + f""",
tt AS (SELECT page, pos, closing, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page ORDER BY pos) AS depth FROM t WHERE name = 'table'),
tab AS (SELECT b.page, CAST(b.pos AS VARCHAR) AS subject, count(*) FILTER (x.name = 'caption') AS captions, count(*) FILTER (x.name = 'th') AS headers, count(*) FILTER (x.name = 'th' AND contains(x.raw, ' scope=')) AS scoped
  FROM (SELECT page, pos, (SELECT min(e.pos) FROM tt e WHERE e.page = b.page AND e.closing AND e.depth = b.depth - 1 AND e.pos > b.pos) AS fin FROM tt b WHERE NOT closing) b LEFT JOIN o x ON x.page = b.page AND x.pos > b.pos AND (fin IS NULL OR x.pos < fin) GROUP BY ALL),
sit AS ({duck(SITES).replace("array('/and')", "['/and']")}), known AS ({duck(KNOWN)}), mdp AS ({duck(MARKDOWN)}),
lh AS (SELECT o.page, o.pos, regexp_extract(raw, ' href="([^"]*)"', 1) AS href, site, path, base_url FROM o JOIN sit USING (page) WHERE name = 'a' AND contains(raw, ' href="')),
lt AS (SELECT *, CASE WHEN href = '' OR href LIKE '#%' THEN NULL WHEN starts_with(href, base_url) THEN substr(href, length(base_url) + 1) WHEN contains(href, ':') THEN NULL WHEN starts_with(href, '/') THEN ltrim(href, '/') ELSE CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || href END AS target FROM lh),
lin AS MATERIALIZED (SELECT page, pos, href, target, starts_with(href, base_url) AS absolute, starts_with(target, 'and') AS external, EXISTS (SELECT 1 FROM known k WHERE k.site = lt.site AND k.path IN (target, target || '.html', target || 'index.html', target || '/index.html')) AS found FROM lt WHERE target IS NOT NULL),
mdl AS (SELECT site, path, target, CASE WHEN starts_with(target, base_url) THEN 'markdown.absolute-link' WHEN NOT contains(target, ':') AND NOT EXISTS (SELECT 1 FROM known k WHERE k.site = x.site AND k.path = ltrim(x.target, '/')) THEN 'markdown.broken-link' END AS rule FROM (SELECT *, unnest(regexp_extract_all(body, '\\]\\(([^)]*)\\)', 1)) AS target FROM mdp) x WHERE target NOT LIKE '#%')
"""
c = F.col


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "pages", lambda: written(view(spark, sf_dir, PAGES), "pages"), ("pages",))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag table, made once for all rules."""
    return kept(spark, sf_dir, "tags", lambda: written(pages.tags(source(spark, sf_dir)), "tags"), ("pages",))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(tags(spark, sf_dir), view(spark, sf_dir, SITES), view(spark, sf_dir, KNOWN))


def query(rule: str, build: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    name = rule.replace(".", "_").replace("-", "_")
    QUERIES[name], ORACLE[name] = build, _TAGS + sql


for _rule, (_level, _find) in pages.RULES.items():
    query(_rule, lambda spark, sf_dir, find=_find: find(tags(spark, sf_dir)), SQL[_rule])
for _rule, (_level, _where) in pages.LINK_RULES.items():
    query(_rule, lambda spark, sf_dir, where=_where: links(spark, sf_dir).filter(where).select("page", c("href").alias("subject")), LINK_SQL[_rule])
query("a11y.charset-late", lambda spark, sf_dir: pages.charset_late(source(spark, sf_dir)), _CHARSET)
for _rule in ("markdown.absolute-link", "markdown.broken-link"):
    query(_rule, lambda spark, sf_dir, rule=_rule: pages.markdown_links(view(spark, sf_dir, MARKDOWN), view(spark, sf_dir, KNOWN)).filter(c("rule") == rule).drop("rule"), f"SELECT site, path, target FROM mdl WHERE rule = '{_rule}'")
query("page_links", links, "SELECT page, pos, href, target, absolute, external, found FROM lin")
_LEVELS = {r: x[0] for r, x in pages.RULES.items()} | {r: x[0] for r, x in pages.LINK_RULES.items()} | {"a11y.charset-late": "error"}
_EVERY = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{_LEVELS[r]}' AS level, page, subject FROM ({sql}) AS f" for r, sql in (SQL | LINK_SQL | {"a11y.charset-late": _CHARSET}).items())


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = source(spark, sf_dir)
    return pages.audit_summary(checked, pages.audit(checked, tags(spark, sf_dir), links(spark, sf_dir)))


query("audit_summary", audit_summary, f"""
SELECT rule, level, count(*) AS n, count(DISTINCT page) AS pages, min(page) AS example_page, list(subject ORDER BY page, subject)[1] AS example,
  (SELECT count(*) FROM src) AS checked
FROM ({_EVERY}) AS f GROUP BY rule, level
""")
query("page_tags", lambda spark, sf_dir: tags(spark, sf_dir).groupBy("page", "name", "closing").agg(F.count("*").alias("n")), "SELECT page, name, closing, count(*) AS n FROM t GROUP BY ALL")
