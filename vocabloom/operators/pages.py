"""Audit of web pages: a tag table, and rules over it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iri as I
from ..functions.text import language_tag_valid

c = F.col


def tags(pages: DataFrame, key: str = "page", html: str = "html") -> DataFrame:
    """(page, pos, name, closing, text, raw): the comments, tags and texts of each page in order. What follows an unended comment isn't read.

    A page without any, such as an empty or missing one, has one row of an empty text, so rules judge it too.
    """
    whole = F.regexp_replace(F.coalesce(c(html), F.lit("")), r"(?s)<!--(?:(?!-->).)*$", "")
    pieces = F.regexp_extract_all(whole, F.lit(r"(<!--[\s\S]*?-->|<![^>]*>|<[^>]*>|[^<]+)"), 1)
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    rows = pages.select(c(key).alias("page"), F.posexplode(pieces).alias("pos", "raw"))
    name = F.lower(F.regexp_extract("raw", r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))
    return rows.select("page", "pos", name.alias("name"), c("raw").startswith("</").alias("closing"), F.when(~c("raw").startswith("<"), c("raw")).alias("text"), "raw")


def attribute(name: str) -> Column:
    """An attribute of a tag in any quotes; null where it is missing."""
    pattern = rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return F.when(c("raw").rlike(pattern), F.regexp_replace(F.regexp_extract("raw", pattern, 1), "^[\"']|[\"']$", ""))


def _opening(t: DataFrame, name: str) -> Column:
    return F.count_if((c("name") == name) & ~c("closing"))


def page_counts(t: DataFrame) -> DataFrame:
    """One row a page with what the whole-page rules look at."""
    counted = {n: _opening(t, n).alias(f"n_{n}") for n in ("html", "title", "header", "main", "footer", "nav", "h1")}
    viewport = F.count_if((c("name") == "meta") & attribute("name").eqNullSafe("viewport"))
    named_navs = F.count_if((c("name") == "nav") & ~c("closing") & (attribute("aria-label").isNotNull() | attribute("aria-labelledby").isNotNull()))
    lang = F.min_by(attribute("lang"), F.when((c("name") == "html") & ~c("closing"), c("pos")))
    return t.groupBy("page").agg(*counted.values(), viewport.alias("n_viewport"), named_navs.alias("named_navs"), lang.alias("lang"))


def _whole_page(rule: str) -> Callable[[DataFrame], DataFrame]:
    return lambda t: page_counts(t).filter(PAGE_CONDITIONS[rule]()).select("page", F.lit("").alias("subject"))


def missing_landmark(t: DataFrame) -> DataFrame:
    gone = F.array_compact(F.array(*(F.when(c(f"n_{n}") == 0, F.lit(n)) for n in ("header", "main", "footer"))))
    return page_counts(t).select("page", F.explode(gone).alias("subject"))


def heading_skip(t: DataFrame) -> DataFrame:
    """The first heading of a page that is more than one level below the one before."""
    headings = t.filter(c("name").rlike("^h[1-6]$") & ~c("closing")).withColumn("level", F.substring("name", 2, 1).cast("int"))
    jumps = headings.withColumn("before", F.lag("level").over(Window.partitionBy("page").orderBy("pos"))).filter("level > before + 1")
    return jumps.groupBy("page").agg(F.min_by("name", "pos").alias("subject"))


def _ids(t: DataFrame) -> DataFrame:
    return t.filter(~c("closing") & (c("name") != "")).select("page", "pos", attribute("id").alias("id")).filter("id is not null")


def duplicate_id(t: DataFrame) -> DataFrame:
    """Each repeat of an id after its first."""
    return _ids(t).filter("id <> ''").withColumn("n", F.row_number().over(Window.partitionBy("page", "id").orderBy("pos"))).filter("n > 1").select("page", c("id").alias("subject"))


def dangling_fragment(t: DataFrame) -> DataFrame:
    links = t.filter((c("name") == "a") & ~c("closing")).select("page", F.substring_index(attribute("href"), "#", -1).alias("id"), attribute("href").alias("href")).filter("href like '#_%'")
    return links.select("page", "id").distinct().join(_ids(t).select("page", "id"), ["page", "id"], "left_anti").select("page", c("id").alias("subject"))


def empty_link(t: DataFrame) -> DataFrame:
    """Links without text up to their end, and without a label or title."""
    order = Window.partitionBy("page").orderBy("pos")
    link = (c("name") == "a") & ~c("closing")
    ends = t.withColumn("part", F.count_if(c("name") == "a").over(order.rowsBetween(Window.unboundedPreceding, 0)))  # each tag of a link begins a part
    filled = lambda n: F.length(F.trim(F.coalesce(attribute(n), F.lit("")))) > 0
    named = filled("aria-label") | filled("title") | attribute("aria-labelledby").isNotNull()
    parts = ends.filter("part > 0").groupBy("page", "part").agg(
        F.max(F.when(link, F.struct(F.coalesce(attribute("href"), F.lit("(no href)")).alias("href"), named.alias("named")))).alias("a"),
        F.max(F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))).alias("text"),
    )
    return parts.filter("a is not null and not a.named and text = 0").select("page", c("a.href").alias("subject"))


def tables(t: DataFrame) -> DataFrame:
    """(page, at, captions, headers, scoped): for each table the captions and header cells up to its end, those of tables in it too."""
    order = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = t.filter("name = 'table'").withColumn("depth", F.sum(F.when(c("closing"), -1).otherwise(1)).over(order))
    begun = own.filter(~c("closing")).select("page", c("pos").alias("at"), "depth")
    ended = own.filter("closing").select("page", c("pos").alias("end"), (c("depth") + 1).alias("depth"))
    spans = begun.join(ended, ["page", "depth"], "left").groupBy("page", "at").agg(F.min(F.when(c("end") > c("at"), c("end"))).alias("end"))
    cells = t.filter(c("name").isin("caption", "th") & ~c("closing")).select("page", "pos", "name", attribute("scope").isNotNull().alias("scope"))
    both = spans.join(cells, "page", "left").withColumn("inside", F.coalesce((c("pos") > c("at")) & (c("end").isNull() | (c("pos") < c("end"))), F.lit(False)))
    count = lambda x: F.count_if(c("inside") & x)
    return both.groupBy("page", "at").agg(count(c("name") == "caption").alias("captions"), count(c("name") == "th").alias("headers"), count((c("name") == "th") & c("scope")).alias("scoped"))


def _tables(condition: str) -> Callable[[DataFrame], DataFrame]:
    return lambda t: tables(t).filter(condition).select("page", c("at").cast("string").alias("subject"))


# Beginnings of markup that a page shows as text if a template escaped it.
ESCAPED = ["&lt;a ", "&lt;code", "&lt;span", "&lt;p&gt;", "&lt;div", "&lt;strong"]


def escaped_markup(t: DataFrame) -> DataFrame:
    """Escaped markup outside of pre elements, once for each kind and page."""
    order = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.sum(F.when(c("raw").startswith("<pre"), 1).when(c("raw").startswith("</pre>"), -1).otherwise(0)).over(order)
    hits = F.array_compact(F.array(*(F.when(c("raw").contains(x), F.lit(x)) for x in ESCAPED)))
    found = t.withColumn("depth", F.coalesce(depth, F.lit(0))).filter((c("depth") <= 0) & c("raw").contains("&lt;"))
    return found.select("page", F.explode(hits).alias("subject")).distinct()


def lang_part_invalid(t: DataFrame) -> DataFrame:
    return t.filter(~c("name").isin("html", "") & ~language_tag_valid(attribute("lang"))).select("page", attribute("lang").alias("subject"))


def charset_late(pages: DataFrame, key: str = "page", html: str = "html") -> DataFrame:
    """Pages that don't name their encoding in the first 1024 bytes."""
    head = F.lower(F.decode(F.substring(F.encode(F.coalesce(html, F.lit("")), "UTF-8"), 1, 1024), "ISO-8859-1"))
    return pages.filter(~head.contains("charset")).select(c(key).alias("page"), F.lit("").alias("subject"))


def _is_external(target: Column, paths: Column) -> Column:
    """Whether a site path belongs to another publisher: the root, or what begins with one of the paths."""
    root = F.array_contains(paths, "/") & target.isin("", "index.html")
    return root | F.exists(F.filter(paths, lambda p: p != "/"), lambda p: F.startswith(target, F.regexp_replace(p, "^/+", "")))


def page_links(t: DataFrame, sites: DataFrame, known: DataFrame) -> DataFrame:
    """(page, href, target, absolute, external, found): links of pages resolved in their site.

    sites: page, site, path, base_url, base_path, external_paths (array); known: site, path of the files there are. A target
    is found as a file, as a page without its extension, or as the index of a folder.
    """
    links = t.filter((c("name") == "a") & ~c("closing")).select("page", "pos", attribute("href").alias("href")).filter("href is not null").join(sites, "page")
    target = I.resolve_internal(c("path"), c("href"), c("base_url"), c("base_path"))
    rows = links.withColumn("target", target).filter("target is not null")
    wanted = rows.select("site", "target").distinct()
    ways = F.array("target", F.concat("target", F.lit(".html")), F.concat("target", F.lit("index.html")), F.concat("target", F.lit("/index.html")))
    there = wanted.select("site", "target", F.explode(ways).alias("path")).join(known.select("site", "path").distinct(), ["site", "path"]).select("site", "target").distinct().withColumn("found", F.lit(True))
    absolute = (c("base_url") != "") & F.startswith(c("href"), c("base_url"))
    return rows.join(there, ["site", "target"], "left").select("page", "pos", "href", "target", absolute.alias("absolute"), _is_external(c("target"), c("external_paths")).alias("external"), F.coalesce("found", F.lit(False)).alias("found"))


#: Rules over resolved links.
LINK_RULES: dict[str, tuple[str, str]] = {
    "html.absolute-nav-link": ("error", "absolute and not external and found"),
    "a11y.broken-internal-link": ("warning", "not external and not found"),
}


def markdown_links(bodies: DataFrame, known: DataFrame) -> DataFrame:
    """(site, path, target, rule): faulty links of Markdown files (site, path, body, base_url, base_path)."""
    found = F.regexp_extract_all("body", F.lit(r"\]\(([^)]*)\)"), 1)
    links = bodies.select("site", "path", "base_url", "base_path", F.explode(found).alias("target")).filter("not startswith(target, '#')")
    absolute = (c("base_url") != "") & F.startswith(c("target"), c("base_url"))
    rows = links.withColumn("absolute", absolute).filter(c("absolute") | ~c("target").contains(":"))
    rows = rows.withColumn("at", I.resolve_internal(c("path"), c("target"), c("base_url"), c("base_path")))
    there = known.select("site", c("path").alias("at")).distinct().withColumn("found", F.lit(True))
    marked = rows.join(there, ["site", "at"], "left")
    broken = c("at").isNotNull() & c("found").isNull()
    rule = F.when(c("absolute"), "markdown.absolute-link").when(broken, "markdown.broken-link")
    return marked.select("site", "path", "target", rule.alias("rule")).filter("rule is not null")


#: Rule -> level and query from the tag table to (page, subject).
RULES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "a11y.no-html-element": ("error", _whole_page("a11y.no-html-element")),
    "a11y.no-lang": ("error", _whole_page("a11y.no-lang")),
    "a11y.lang-invalid": ("error", _whole_page("a11y.lang-invalid")),
    "a11y.no-viewport": ("error", _whole_page("a11y.no-viewport")),
    "a11y.no-title": ("error", _whole_page("a11y.no-title")),
    "a11y.missing-landmark": ("error", missing_landmark),
    "a11y.multiple-main": ("error", _whole_page("a11y.multiple-main")),
    "a11y.unnamed-nav": ("error", _whole_page("a11y.unnamed-nav")),
    "a11y.no-h1": ("error", _whole_page("a11y.no-h1")),
    "a11y.multiple-h1": ("warning", _whole_page("a11y.multiple-h1")),
    "a11y.heading-skip": ("error", heading_skip),
    "a11y.empty-id": ("error", lambda t: _ids(t).filter("id = ''").select("page", c("id").alias("subject"))),
    "a11y.invalid-id": ("error", lambda t: _ids(t).filter(c("id").rlike("[: ]")).select("page", c("id").alias("subject"))),
    "a11y.duplicate-id": ("error", duplicate_id),
    "a11y.dangling-fragment": ("error", dangling_fragment),
    "a11y.empty-link": ("error", empty_link),
    "a11y.table-no-caption": ("warning", _tables("captions = 0")),
    "a11y.table-no-headers": ("error", _tables("headers = 0")),
    "a11y.th-no-scope": ("warning", _tables("headers > 0 and scoped < headers")),
    "html.escaped-markup": ("error", escaped_markup),
    "a11y.lang-part-invalid": ("error", lang_part_invalid),
}


#: Rules that look at a page's counts, and those that look at one tag: what the subject is, where there is a finding.
PAGE_CONDITIONS: dict[str, Callable[[], Column]] = {
    "a11y.no-html-element": lambda: c("n_html") == 0,
    "a11y.no-lang": lambda: (c("n_html") > 0) & c("lang").isNull(),
    "a11y.lang-invalid": lambda: c("lang").isNotNull() & ~language_tag_valid(c("lang")),
    "a11y.no-viewport": lambda: c("n_viewport") == 0,
    "a11y.no-title": lambda: c("n_title") == 0,
    "a11y.multiple-main": lambda: c("n_main") > 1,
    "a11y.unnamed-nav": lambda: (c("n_nav") > 1) & (c("named_navs") < c("n_nav")),
    "a11y.no-h1": lambda: c("n_h1") == 0,
    "a11y.multiple-h1": lambda: c("n_h1") > 1,
}


def _finding(rule: str, level: str, met: Column, subject: Column) -> Column:
    return F.when(met, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), subject.alias("subject")))


def page_findings(t: DataFrame) -> DataFrame:
    """(page, rule, level, subject): the findings of all rules over whole pages, from one aggregate of the tag table."""
    whole = [_finding(rule, RULES[rule][0], met(), F.lit("")) for rule, met in PAGE_CONDITIONS.items()]
    marks = [_finding("a11y.missing-landmark", "error", c(f"n_{n}") == 0, F.lit(n)) for n in ("header", "main", "footer")]
    return page_counts(t).select("page", F.inline(F.array_compact(F.array(*whole, *marks))))


def tag_findings(t: DataFrame) -> DataFrame:
    """(page, rule, level, subject): the findings of all rules over single tags, from one pass over the tag table."""
    opening = ~c("closing") & (c("name") != "")
    has_id, lang = opening & attribute("id").isNotNull(), attribute("lang")
    found = [
        _finding("a11y.empty-id", "error", has_id & (attribute("id") == ""), attribute("id")),
        _finding("a11y.invalid-id", "error", has_id & attribute("id").rlike("[: ]"), attribute("id")),
        _finding("a11y.lang-part-invalid", "error", ~c("name").isin("html", "") & ~language_tag_valid(lang), lang),
    ]
    return t.filter("name <> ''").select("page", F.inline(F.array_compact(F.array(*found))))


def audit(pages: DataFrame, t: DataFrame, links: DataFrame) -> DataFrame:
    """(page, rule, level, subject): the findings of all rules on pages, their tag table and their links.

    Rules over whole pages are one aggregate and rules over single tags one pass; the others need the order of tags.
    """
    together = {*PAGE_CONDITIONS, "a11y.missing-landmark", "a11y.empty-id", "a11y.invalid-id", "a11y.lang-part-invalid"}
    parts = [page_findings(t), tag_findings(t)]
    parts += [find(t).select("page", F.lit(rule).alias("rule"), F.lit(level).alias("level"), "subject") for rule, (level, find) in RULES.items() if rule not in together]
    parts.append(charset_late(pages).select("page", F.lit("a11y.charset-late").alias("rule"), F.lit("error").alias("level"), "subject"))
    parts += [links.filter(where).select("page", F.lit(rule).alias("rule"), F.lit(level).alias("level"), c("href").alias("subject")) for rule, (level, where) in LINK_RULES.items()]
    return reduce(DataFrame.unionByName, parts)


def audit_summary(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """(rule, level, n, pages, example_page, example, checked): the findings of each rule, the first of them, and how many pages were checked."""
    rules = findings.groupBy("rule", "level").agg(
        F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.min(F.struct("page", "subject")).alias("first")
    )
    checked = pages.agg(F.count("*").alias("checked"))  # one row
    return rules.crossJoin(checked).select("rule", "level", "n", "pages", c("first.page").alias("example_page"), c("first.subject").alias("example"), "checked")
