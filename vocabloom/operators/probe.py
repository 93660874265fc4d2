"""Probing a published site: what to ask, and what the answers say. Answers are a table or a stream of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http
from ..functions import iri as I
from .layout import DEFAULT_TYPE, NS, Layout

# Rules, their levels and the FAIR test that a failure counts against.
URI, NEGOTIATED, RDF, RELEASED = "URI1", "CN1", "RDF1", "VER2"
ASK = ["release", "url", "accept", "expect", "media_type", "location", "required", "subject", "context"]
c = F.col


def probe_plan(layout: Layout, origin: str, sample: int | None = None) -> DataFrame:
    """Asks (release, url, accept, expect, media_type, location, required, subject, context): pages, siblings and files of every entry and term.

    sample: the first so many terms of each namespace, in order of their names; None for all.
    """
    base = F.regexp_replace(F.lit(origin), "/+$", "")
    moved = lambda url: I.rehost(url, c("base_url"), F.lit(origin))
    none = F.lit(None).cast("string")

    def asks(rows: DataFrame, url: Column, accept: Column, expect: str, kind: Column, location: Column, required: bool, subject: Column, context: Column) -> DataFrame:
        made = zip(ASK, (c("release"), url, accept, F.lit(expect), kind, location, F.lit(required), subject, context), strict=True)
        return rows.select(*(x.alias(n) for n, x in made))

    entries, latest = layout.entries, layout.entries.filter("segment = ''")
    text = F.lit(DEFAULT_TYPE)
    pages = asks(latest, moved(c("doc_base")), text, "page", text, none, False, F.lit("namespace"), F.concat(F.lit("the document of "), "iri_base"))
    index = asks(latest, moved(c("llms")), F.lit("text/plain"), "file", F.lit("text/plain"), none, False, F.lit("agent index"), F.concat(F.lit("the agent index of "), "iri_base"))
    snaps = asks(entries.filter("segment <> ''"), moved(c("doc_base")), text, "page", text, none, False, F.lit("release"), F.concat(F.lit("release "), "segment", F.lit(" of "), "ns"))
    terms = layout.addresses
    if sample is not None:
        first = layout.terms.withColumn("n", F.row_number().over(Window.partitionBy(*NS).orderBy("local"))).filter(c("n") <= sample).select(*NS, "local")
        terms = terms.join(first, [*NS, "local"], "left_semi")
    url, request, name = F.concat(base, "public"), F.concat(base, "request"), F.concat("iri_base", "local")
    own, other = terms.filter(c("media_type") == DEFAULT_TYPE), terms.filter(c("media_type") != DEFAULT_TYPE)
    subject = F.lit("namespace")
    term_pages = asks(own, url, c("media_type"), "page", c("media_type"), none, False, subject, name)
    siblings = asks(other, request, c("media_type"), "sibling", c("media_type"), url, False, subject, name)
    files = asks(other, url, c("media_type"), "file", c("media_type"), none, True, subject, F.concat(F.lit("the "), "media_type", F.lit(" of "), name))
    out = pages
    for more in (index, snaps, term_pages, siblings, files):
        out = out.unionByName(more)
    return out


def scan_responses(asks: DataFrame, log: DataFrame, key: str = "n") -> DataFrame:
    """Asks with the fields of a response log (key, line): status, type, vary, link, location, cache-control and open origins, between tabs.

    An ask without a line, or with one whose first field is no number, has status 0; fields that a line lacks are empty.
    """
    names = ["content_type", "vary", "link", "location", "cache_control", "cors"]
    got = log.select(key, F.split("line", "\t").alias("f"))
    both = asks.join(got, key, "left")
    status = F.coalesce(F.get("f", 0).try_cast("int"), F.lit(0))
    return both.select(*asks.columns, status.alias("status"), *(F.coalesce(F.get("f", i + 1), F.lit("")).alias(n) for i, n in enumerate(names)))


def answered(asks: DataFrame, responses: DataFrame) -> DataFrame:
    """Asks with the response to each (by url and accept, and by release if responses have it): status 0 and empty headers where there is none."""
    headers, keys = ["content_type", "vary", "link", "redirect"], [k for k in ("release", "url", "accept") if k in responses.columns]
    got = responses.withColumnRenamed("location", "redirect").select(*keys, "status", *headers)
    # addresses of a site begin alike, so rows are put in order by a hash of the keys first
    hashed = lambda rows: rows.withColumn("_hash", F.xxhash64(*keys))
    both = hashed(asks).join(hashed(got), ["_hash", *keys], "left")
    return both.select(*asks.columns, F.coalesce("status", F.lit(0)).alias("status"), *(F.coalesce(h, F.lit("")).alias(h) for h in headers))


def _finding(rule: str, level: str | Column, test: str | Column | None, condition: Column, detail: str = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.when(condition, F.array(F.struct(F.lit(rule).alias("rule"), lit(level).alias("level"), lit(test).alias("foops"), F.lit(detail).alias("detail"))))


def judge(rows: DataFrame, *also: str) -> DataFrame:
    """(release, rule, level, foops, url, accept, subject, context, detail, expect): findings on answered asks. Stateless, so rows may be a stream.

    An unreachable address gets no other finding. also: more columns of the asks to keep.
    """
    status, kind = c("status"), c("media_type")
    right = http.content_type_is(c("content_type"), kind)
    reached, page, sibling, file = status != 0, c("expect") == "page", c("expect") == "sibling", c("expect") == "file"
    moved, same = status.between(301, 308), F.rtrim(c("redirect"), F.lit("/")) == F.rtrim(c("location"), F.lit("/"))
    negotiated = reached & sibling & (moved | (status == 200))
    of_file = F.when(c("required"), "error").otherwise("warning")
    file_test = F.when(c("required"), RDF)
    found = [
        _finding("probe.unreachable", "error", URI, ~reached),
        _finding("probe.no-page", "error", URI, reached & page & (status != 200)),
        _finding("probe.wrong-type", "error", URI, page & (status == 200) & ~right),
        _finding("probe.redirect-without-location", "error", NEGOTIATED, sibling & moved & (c("redirect") == "")),
        _finding("probe.wrong-redirect", "error", NEGOTIATED, sibling & moved & (c("redirect") != "") & ~same),
        _finding("probe.not-negotiated", "error", NEGOTIATED, sibling & (status == 200) & ~right),
        _finding("probe.no-representation", "error", F.when(kind.contains("markdown"), NEGOTIATED).otherwise(RDF), reached & sibling & ~moved & (status != 200)),
        _finding("probe.no-vary", "warning", NEGOTIATED, negotiated & ~http.varies_on_accept(c("vary"))),
        _finding("probe.no-representation", "error", RDF, reached & file & c("required") & (status != 200)),
        _finding("probe.missing-file", "warning", None, reached & file & ~c("required") & (status != 200)),
        _finding("probe.wrong-type", of_file, file_test, file & (status == 200) & ~right & (c("content_type") != "") & (kind != "")),
        *(_finding("probe.no-signpost", "warning", None, negotiated & ~F.contains(c("link"), F.lit(r)), r) for r in ("cite-as", "describedby")),
    ]
    none = F.array().cast("array<struct<rule:string,level:string,foops:string,detail:string>>")
    every = F.concat(*(F.coalesce(x, none) for x in found))
    return rows.select("release", I.redact_url(c("url")).alias("url"), "accept", "subject", "context", "expect", *also, F.explode(every).alias("x")).select("release", "x.rule", "x.level", "x.foops", "url", "accept", "subject", "context", "x.detail", "expect", *also)


def with_unreachable_hosts(found: DataFrame, rows: DataFrame, origin: str) -> DataFrame:
    """Findings where a release of which no request got an answer, of two at least, has one finding in place of one for each request."""
    made = rows.groupBy("release").agg(F.count("*").alias("made"), F.count_if(c("status") == 0).alias("lost"), F.min("accept").alias("accept"))
    dead = made.filter("made >= 2 and lost = made")
    one = dead.select(
        "release",
        F.lit("probe.host-unreachable").alias("rule"),
        F.lit("error").alias("level"),
        F.lit(URI).alias("foops"),
        I.redact_url(F.lit(origin)).alias("url"),
        "accept",
        F.lit("namespace").alias("subject"),
        F.concat(F.lit("not one of "), c("made").cast("string"), F.lit(" requests")).alias("context"),
        F.lit("").alias("detail"),
        F.lit("page").alias("expect"),
    )
    return found.join(dead.select("release"), "release", "left_anti").unionByName(one)


def foops(rows: DataFrame) -> DataFrame:
    """(release, test, outcome) of four FAIR tests over answered asks: fail where a relevant ask has an error, not applicable without a relevant ask.

    rows: answered asks with made (boolean), whether the ask was made before a deadline.
    """
    # The asks that each test is about.
    relevant = {URI: c("expect") == "page", NEGOTIATED: c("expect") == "sibling", RDF: (c("expect") == "file") & c("required"), RELEASED: (c("expect") == "page") & (c("subject") == "release")}
    failed = judge(rows.filter("made")).filter("level = 'error'").select("release", "url", "accept", "expect").distinct().withColumn("failed", F.lit(True))
    marked = rows.withColumn("url", I.redact_url(c("url"))).join(failed, ["release", "url", "accept", "expect"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    counts = marked.groupBy("release").agg(*(x.alias(f"{t}_{n}") for t, own in relevant.items() for n, x in (("all", F.count_if(own)), ("made", F.count_if(own & c("made"))), ("bad", F.count_if(own & c("failed"))))))
    outcome = lambda t: F.when(c(f"{t}_bad") > 0, "fail").when(c(f"{t}_all") == 0, "not applicable").when(c(f"{t}_made") == 0, "not measured").otherwise("pass")
    each = F.array(*(F.struct(F.lit(t).alias("test"), outcome(t).alias("outcome")) for t in relevant))
    return counts.select("release", F.explode(each).alias("x")).select("release", "x.*")


def report(asks: DataFrame, found: DataFrame) -> DataFrame:
    """(release, requests, made, truncated, errors, warnings): asks have made."""
    of = found.groupBy("release").agg(F.count_if(c("level") == "error").alias("errors"), F.count_if(c("level") == "warning").alias("warnings"))
    counts = asks.groupBy("release").agg(F.count("*").alias("requests"), F.count_if("made").alias("made"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return counts.join(of, "release", "left").select("release", "requests", "made", (c("made") < c("requests")).alias("truncated"), zero("errors"), zero("warnings"))


def summary(found: DataFrame) -> DataFrame:
    """(release, rule, level, n, example): the example is the least context."""
    return found.groupBy("release", "rule", "level").agg(F.count("*").alias("n"), F.min("context").alias("example"))


def gate(reports: DataFrame, fail_on: str = "error") -> DataFrame:
    """(release, passed). fail_on: error, warning or never; a run that didn't make all requests fails unless it is never."""
    bad = {"error": c("errors") > 0, "warning": (c("errors") > 0) | (c("warnings") > 0), "never": F.lit(False)}[fail_on]
    cut = c("truncated") if fail_on != "never" else F.lit(False)
    return reports.select("release", (~(bad | cut)).alias("passed"))
