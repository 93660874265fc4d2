"""The operators of the vocabulary part on small tables."""

from pyspark.sql import functions as F

from vocabloom.functions import colour, http, iri, text
from vocabloom.operators import compare, conform, lint, negotiate, pages, probe, shapes
from vocabloom.operators.layout import Layout
from vocabloom.operators.model import Model, with_longest_prefix
from vocabloom.sources import ntriples
from vocabloom.sources.tables import written
from vocabloom.streaming import requests
from vocabloom.vocabulary import DCTERMS, OWL, RDF, RDFS, SH, SKOS, TYPE

NS = "https://example.org/v/"


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_paths(spark):
    for start, target, want in [("/a/b", "/a/c", "c"), ("/a/b", "/a/", "./"), ("/a/b/c", "/x", "../../x"), ("/", "/a/b", "a/b"), ("/a/", "/a/b/c", "b/c")]:
        assert one(spark, iri.relative_to(F.lit(start), F.lit(target))) == want
    assert one(spark, iri.redact_url(F.lit("https://me:secret@host/x?y=a@b"))) == "https://me:***@host/x?y=a@b"
    assert one(spark, iri.redact_url(F.lit("https://host/x:y@z"))) == "https://host/x:y@z"


def test_versions(spark):
    good, bad = ["1", "1.0", "2026-04-28", "1.0.0-rc1", "2+b"], ["", "v1", ".1", "1..0", "1/0", "latest", "-1", "1" * 65]
    assert all(one(spark, text.looks_like_version(F.lit(v))) for v in good) and not any(one(spark, text.looks_like_version(F.lit(v))) for v in bad)


def test_accept(spark):
    cases = {"text/html;q=0.1, text/turtle": ["text/turtle", "text/html"], "a/b;q=0, c/d;q=x": ["c/d"], "": [], "A/B , c/d;q=1": ["a/b", "c/d"]}
    for header, want in cases.items():
        assert one(spark, http.parse_accept(F.lit(header))) == want


def test_contrast(spark):
    assert round(one(spark, colour.contrast_ratio(F.lit("#000000"), F.lit("#ffffff"))), 2) == 21.0
    assert one(spark, colour.contrast_ratio(F.lit("#fff"), F.lit("#ffffff"))) is None


def release(name, extra=()):
    rows = [
        (NS, TYPE, OWL + "Ontology", "iri", None),
        (NS, DCTERMS + "title", "V", "literal", "en"),
        (NS + "A", TYPE, OWL + "Class", "iri", None),
        (NS + "A", RDFS + "label", "A", "literal", "en"),
        (NS + "B", TYPE, OWL + "Class", "iri", None),
        (NS + "B", RDFS + "subClassOf", NS + "A", "iri", None),
        (DCTERMS + "title", RDFS + "label", "Title", "literal", None),
        *extra,
    ]
    return [(name, "v.nt", i, s, "iri", p, o, k, lang, None) for i, (s, p, o, k, lang) in enumerate(rows)]


def models(spark):
    rows = release("old") + release("new", [(NS + "C", TYPE, SKOS + "Concept", "iri", None), (NS + "A", RDFS + "comment", "An A.", "literal", "en")])
    quads = spark.createDataFrame(rows, "release string, file string, seq long, s string, s_kind string, p string, o string, o_kind string, lang string, dt string")
    return Model(quads, spark.createDataFrame([("old", "v.nt", "v", NS), ("new", "v.nt", "v", NS)], "release string, file string, prefix string, ns string"), written)


def test_model(spark):
    m = models(spark)
    got = {(r.release, r.local_name): r for r in m.terms.collect()}
    assert got["new", "A"].kind == "Class" and got["new", "C"].kind == "Concept" and got["new", "A"].curie == "v:A"
    assert got["old", "title"].foreign and got["old", "title"].anchor == "dcterms_title" and got["old", "B"].defined_in == NS
    assert {(r.release, r.iri): r.children for r in m.children("super_terms").collect()}["new", NS + "A"] == [NS + "B"]


def test_lint_and_changes(spark):
    m = models(spark)
    found = {(r.release, r.rule, r.subject) for r in lint.findings(m, ("term.",)).collect()}
    assert ("old", "term.no-definition", NS + "A") in found and ("new", "term.no-definition", NS + "A") not in found
    assert {(r.rule, r.iri) for r in compare.changes(m).collect()} == {("term.added", NS + "C"), ("term.defined", NS + "A")}
    assert compare.changes(m, "new", "new").count() == 0


def test_ntriples_round_trip(spark, tmp_path):
    lines = ['<http://a/s> <http://a/p> "x \\"q\\" \\\\ \\n y"@en .', "_:b <http://a/p> <http://a/o> .", '<http://a/s> <http://a/n> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .', "# comment", ""]
    path = tmp_path / "a.nt"
    path.write_text("\n".join(lines))
    quads = ntriples.scan(spark, str(path))
    assert [r.o for r in quads.orderBy("seq").collect()] == ['x "q" \\ \n y', "http://a/o", "1"]
    assert sorted(r.value for r in ntriples.lines(quads).collect()) == sorted(lines[:3])


def test_ntriples_reads_long_literals_and_escapes(spark, tmp_path):
    long = "word \\\"q\\\" " * 100_000
    lines = [f'<http://a/s> <http://a/p> "{long}"@en-GB .', '<http://a/s\\u00E9> <http://a/p> "\\u0041\\U0001F600\\t\\\\u0041\\b\\f\\x" .', '<http://a/s> <http://a/p> "not ended .']
    path = tmp_path / "long.nt"
    path.write_text("\n".join(lines))
    rows = ntriples.scan(spark, str(path)).orderBy("seq").collect()
    assert [r.o for r in rows] == [long.replace('\\"', '"'), "A\U0001F600\t\\u0041\b\f\\x"]
    assert rows[1].s == "http://a/s\u00e9" and rows[0].lang == "en-GB"


QUADS = "release string, file string, seq long, s string, s_kind string, p string, o string, o_kind string, lang string, dt string"


def quads_of(spark, rows):
    kind = lambda x: "bnode" if x.startswith("_") else "iri" if x.startswith("http") else "literal"
    return spark.createDataFrame([("r", "v.nt", i, s, kind(s), p, o, kind(o), None, None) for i, (s, p, o) in enumerate(rows)], QUADS)


def test_shapes(spark):
    s, rows = NS + "S", []
    rows += [(s, TYPE, SH + "NodeShape"), (s, SH + "property", "_c"), (s, SH + "targetClass", NS + "A"), ("_c", SH + "path", NS + "p"), ("_c", SH + "minCount", "1"), ("_c", SH + "in", "_l1"), ("_c", SH + "node", "_n"), ("_n", SH + "property", "_m"), ("_m", SH + "path", SKOS + "inScheme"), ("_m", SH + "hasValue", NS + "scheme")]
    cells = [f"_l{i}" for i in range(1, 12)]
    for i, cell in enumerate(cells):
        rows += [(cell, RDF + "first", f"v{i}"), (cell, RDF + "rest", cells[i + 1] if i + 1 < len(cells) else cells[0])]  # comes back to its start
    rows += [(s, SH + "property", "_d"), ("_d", SH + "path", "_q"), ("_q", RDF + "first", NS + "p"), ("_q", RDF + "rest", "_q2"), ("_q2", RDF + "first", NS + "q"), ("_q2", RDF + "rest", RDF + "nil"), (NS + "T", SH + "targetObjectsOf", NS + "p")]
    m = Model(quads_of(spark, rows), spark.createDataFrame([("r", "v.nt", "v", NS)], "release string, file string, prefix string, ns string"), written)
    got = {r.node.split("|")[1]: r for r in shapes.constraints(m).collect()}
    assert got["_c"]["values"] == [f"v{i}" for i in range(11)] and got["_c"].in_scheme == [NS + "scheme"] and got["_c"].required
    assert got["_d"].path_kind == "complex" and got["_d"].path == f"{NS}p / {NS}q"
    assert {r.shape for r in shapes.node_shapes(m).collect()} == {s}  # T constrains nothing and targets neither classes nor subjects
    assert [r.targeting for r in shapes.targeting(m).collect()] == ["instances of v:A"]


def test_longest_prefix(spark):
    rows = spark.createDataFrame([("r", x) for x in ("http://a/b/c", "http://a/b#c/d", "http://a/bcd", "http://a/b/", "urn:x", "http://a/b/c/d/e")], "release string, iri string")
    spaces = spark.createDataFrame([("r", x) for x in ("http://a/", "http://a/b/", "http://a/b", "http://a/b#", "http://a/b/c/d/")], "release string, ns string")
    got = {r.iri: r.ns for r in with_longest_prefix(rows, ["release"], "iri", spaces, "ns").collect()}
    assert got == {"http://a/b/c": "http://a/b/", "http://a/b#c/d": "http://a/b#", "http://a/bcd": "http://a/b", "http://a/b/": "http://a/b", "urn:x": None, "http://a/b/c/d/e": "http://a/b/c/d/"}


def site(spark):
    rows = [(NS, TYPE, OWL + "Ontology"), (NS, OWL + "versionInfo", "1.0"), (NS, OWL + "versionIRI", NS + "1.0/")]
    rows += [(NS + n, TYPE, OWL + "Class") for n in ("Ab", "AB", "index", "zed")] + [(NS + n, RDFS + "label", n) for n in ("Ab", "AB", "index", "zed")]
    m = Model(quads_of(spark, rows), spark.createDataFrame([("r", "v.nt", "v", NS)], "release string, file string, prefix string, ns string"), written)
    config = spark.createDataFrame([("r", "https://example.org/", "version-iri", None)], "release string, base_url string, snapshots string, configured string")
    return Layout(m, config, spark.createDataFrame([], "release string, ns string, mount string, url_style string, stem string, resolver_prefix string"))


def test_layout_and_requests(spark):
    s = site(spark)
    assert {(r.local, r.style) for r in s.terms.collect()} == {("AB", "flat"), ("Ab", "dir"), ("index", "dir"), ("zed", "flat")}
    assert [r.segment for r in s.snapshots.collect()] == ["1.0"]
    assert {r.path for r in s.term_paths.filter("local = 'Ab'").collect()} == {f"v/Ab/index.{e}" for e in ("html", "md", "ttl", "jsonld")}
    asked = [("/v/zed", "text/html"), ("/v/Ab/", "text/turtle"), ("/v/1.0/zed", "text/turtle"), ("/v/zed.ttl", "text/turtle"), ("/v/zed/x", "*/*"), ("/v/Zed", "*/*"), ("/w", "*/*"), ("/v/1.0/", "*/*")]
    requests_ = spark.createDataFrame([(i, "r", p, a, None) for i, (p, a) in enumerate(asked)], "request_id int, release string, path string, accept string, query string")
    got = [(r.outcome, r.target) for r in negotiate.resolve(requests_, s).orderBy("request_id").collect()]
    assert got == [("serve", "v/zed.html"), ("redirect", "/v/Ab/index.ttl"), ("redirect", "/v/1.0/zed.ttl")] + [("pass-through", None)] * 5
    streamed = requests.through(requests_.filter("request_id <> 2"), lambda rows: requests.resolved(rows, s), "t")
    assert bag(streamed) == bag(negotiate.resolve(requests_.filter("request_id <> 2"), s))
    links = {(r.segment, r.local, r.media_type): r.link for r in s.link_headers().collect()}
    assert links["", "Ab", "text/turtle"].endswith('<../llms.txt>; rel="describedby"; type="text/plain"') and '<./>; rel="alternate"; type="text/html"' in links["", "Ab", "text/turtle"]


def bag(df):
    return sorted(map(repr, df.collect()))


def test_probe(spark):
    s = site(spark)
    plan = probe.probe_plan(s, "https://host.example", sample=2)
    assert plan.count() == 3 + 2 * 2 * 7 and plan.filter("expect = 'sibling' and url = 'https://host.example/v/Ab/'").count() == 3
    good = plan.selectExpr("url", "accept", "IF(expect = 'sibling', 303, 200) AS status", "media_type AS content_type", "'Accept' AS vary", "'rel=cite-as rel=describedby' AS link", "location").distinct()
    rows = probe.answered(plan, good).withColumn("made", F.lit(True))
    assert probe.judge(rows).count() == 0 and {r.outcome for r in probe.foops(rows).collect()} == {"pass"}
    none = probe.answered(plan, good.limit(0)).withColumn("made", F.lit(True))
    found = probe.with_unreachable_hosts(probe.judge(none), none, "https://me:secret@host.example")
    assert [(r.rule, r.url) for r in found.collect()] == [("probe.host-unreachable", "https://me:***@host.example")]
    assert probe.gate(probe.report(none, found)).first().passed is False


def test_conformance(spark):
    s = site(spark)
    asked = [("text/html", None), ("text/turtle", None), ("text/turtle", None), (None, "format=jsonld"), (None, None)]
    cases = conform.contract(spark.createDataFrame(asked, "accept string, query string"))
    assert cases.count() == 4 * len(conform.PAGES) + len(conform.FILES) + len(conform.ABSENT)
    rows = conform.resolve_cases(s, cases)
    kinds = {r.role: r for r in conform.roles(s).collect()}
    assert kinds["dir-term"].path == "/v/Ab/" and kinds["release-term"].path == "/v/1.0/AB" and kinds["case-variant"].path == "/v/aB" and "empty-namespace" not in kinds
    replies = rows.selectExpr("*", "concat('https://h', path) AS url", "CASE expect WHEN 'absent' THEN 404 WHEN 'redirect' THEN 303 ELSE 200 END AS got_status", "media_type AS got_type", "concat('https://h', location) AS got_location", "'accept' AS got_vary", "link AS got_link", "cache AS got_cache", "'*' AS got_cors", "concat('href=\"', names, '\"') AS body")
    verdicts = conform.judge_cases(replies)
    assert verdicts.filter("not passed").count() == 0 and verdicts.count() == rows.count()
    assert {r.consequence for r in conform.judge_cases(replies.withColumn("got_cors", F.lit(None).cast("string"))).filter("not passed").collect()} == {"not open to other origins"}
    assert {r.case for r in conform.unresolved(s, cases, rows).collect()} == {"nested-namespace - -", "reserved-segment - -", "empty-namespace - -"}


def test_pages(spark):
    html = '<!doctype html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="w"><title>t</title></head><body><header></header><main><h1>x</h1><a href="a">a</a></main><footer></footer></body></html>'
    edits = [html, html.replace("<main>", '<main><table><tr><th>h</th></tr></table>'), html.replace(">a</a>", "> </a>"), html.replace("<main>", "<main><pre>&lt;code</pre>&lt;span"), "x" * 1024 + html, html.replace('<h1>', '<h1 lang="e_n">'), None, ""]
    pages_ = spark.createDataFrame(list(enumerate(edits)), "page int, html string")
    t = pages.tags(pages_)
    sites = pages_.selectExpr("page", "'s' AS site", "'p' AS path", "'' AS base_url", "'/' AS base_path", "array('/ext') AS external_paths")
    links = pages.page_links(t, sites, spark.createDataFrame([("s", "a.html")], "site string, path string"))
    findings = pages.audit(pages_, t, links)
    got = {(r.page, r.rule) for r in findings.collect() if r.page < 6}
    bare = {"a11y.no-html-element", "a11y.no-viewport", "a11y.no-title", "a11y.missing-landmark", "a11y.no-h1", "a11y.charset-late"}
    assert all({r.rule for r in findings.filter(F.col("page") == p).collect()} == bare for p in (6, 7))  # without html
    one_by_one = [(r.page, rule, level, r.subject) for rule, (level, find) in pages.RULES.items() for r in find(t).collect()]
    together = pages.audit(pages_.limit(0), t, links.limit(0)).select("page", "rule", "level", "subject").collect()
    assert sorted(one_by_one) == sorted(map(tuple, together))
    told = {r.rule: r for r in pages.audit_summary(pages_, findings).collect()}
    assert told["a11y.no-h1"].n == 2 and told["a11y.no-h1"].example_page == 6 and told["a11y.no-h1"].checked == 8
    assert got == {(1, "a11y.table-no-caption"), (1, "a11y.th-no-scope"), (2, "a11y.empty-link"), (3, "html.escaped-markup"), (4, "a11y.charset-late"), (5, "a11y.lang-part-invalid")}
    bodies = spark.createDataFrame([("s", "p", "[a](a.html) [b](/gone) [c](#x) [d](https://o/) [e](https://s/a)", "https://s/", "/")], "site string, path string, body string, base_url string, base_path string")
    assert {(r.target, r.rule) for r in pages.markdown_links(bodies, spark.createDataFrame([("s", "a.html")], "site string, path string")).collect()} == {("/gone", "markdown.broken-link"), ("https://s/a", "markdown.absolute-link")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:00:00", "/part/1", "text/turtle" if i % 2 else "text/html", None) for i in range(40)]
    batch = spark.createDataFrame(rows, "request_id long, ts string, path string, accept string, query string").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = requests.counts_by_window(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, requests.counts_by_window(batch).collect()))


def test_summary_reads_whole_texts(spark, tmp_path):
    from vocabloom.plans import scalars

    far = "word " * 60 + "end"
    rows = [(1, far + ". Next one. Third"), (2, far), (3, "Short. " + far + ". Rest"), (4, None), (5, "é" * 30 + ".\n Rest"), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.k: r.summary for r in scalars.QUERIES["summary"](spark, str(tmp_path)).collect()}

    def brute(line):
        line = " ".join(line.split())
        at = line.encode().find(b". ")
        return line.encode()[: at + 1].decode() if at > 40 else line

    assert got == {k: None if t is None else brute(t) for k, t in rows}
