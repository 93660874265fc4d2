"""What keeps memory and time in proportion where most subjects are in no namespace that a release makes terms in."""

import pytest
from pyspark.sql import functions as F

from vocabloom.functions import iri
from vocabloom.operators import compare, describe, negotiate, shapes
from vocabloom.operators.layout import Layout
from vocabloom.operators.model import Model
from vocabloom.plans import exports
from vocabloom.sources.tables import written
from vocabloom.vocabulary import OWL, RDFS, SH, TYPE, VANN

NS = "https://example.org/v/"
ODD = "https://example.org/items/x-"


def tables(spark, extra=()):
    rows = [
        (NS, TYPE, OWL + "Ontology", "iri"),
        (NS + "A", TYPE, OWL + "Class", "iri"),
        (NS + "b/C", TYPE, OWL + "Class", "iri"),
        (NS + "d/", RDFS + "subClassOf", NS + "A", "iri"),
        (NS + "index", TYPE, OWL + "Class", "iri"),
        (NS + "shape", TYPE, SH + "NodeShape", "iri"),
        (NS + "shape", SH + "property", "p", "bnode"),
        *((f"https://example.org/items/x-{i}", NS + "of", NS + "A", "iri") for i in range(40)),
        *extra,
    ]
    quads = [("r", "v.ttl", i, s, "iri", p, o, k, None, None) for i, (s, p, o, k) in enumerate(rows)] + [("r", "v.ttl", 999, "p", "bnode", SH + "path", NS + "A", "iri", None, None)]
    quads = spark.createDataFrame(quads, "release string, file string, seq long, s string, s_kind string, p string, o string, o_kind string, lang string, dt string")
    return quads, spark.createDataFrame([("r", "v.ttl", "v", NS)], "release string, file string, prefix string, ns string")


def site(spark, m):
    config = spark.createDataFrame([("r", "https://example.org/", "all", "1.0")], "release string, base_url string, snapshots string, configured string")
    return Layout(m, config, spark.createDataFrame([], "release string, ns string, mount string, url_style string, stem string, resolver_prefix string"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["term_lookup", "residue", "record_template", "link_md"])
def test_terms_are_not_broadcast(spark, query, monkeypatch):
    m = Model(*tables(spark), written)
    if query == "term_lookup":
        monkeypatch.setattr(exports, "model", lambda spark, sf_dir: m)
        df, key = exports.QUERIES[query](spark, ""), "iri"
    else:
        df, key = {"residue": lambda: (m.residue, "iri"), "record_template": lambda: (shapes.record_template(m), "path"), "link_md": lambda: (describe.markdown_links_of(site(spark, m)), "iri")}[query]()
    joins = [line for line in plan_of(df).splitlines() if "Join" in line and f"[release#" in line and f", {key}#" in line]
    assert any("SortMergeJoin" in line for line in joins), joins


def test_local_terms_leave_other_subjects_alone(spark):
    made = []
    m = Model(*tables(spark), lambda df, name: made.append(name) or written(df, name))
    assert {r.iri for r in m.local.collect()} == {NS + x for x in ("A", "b/C", "d/", "index", "shape")}
    assert m.near_statements.filter(F.startswith("s", F.lit(ODD))).count() == 0
    assert not [x for x in made if x.startswith("far")]
    assert m.terms.count() == 45 and m.placed.filter("foreign").count() == 40


def test_namespace_without_delimiter_has_local_terms(spark):
    m = Model(*tables(spark, [(NS, VANN + "preferredNamespaceUri", ODD, "literal")]), written)
    assert {(r.namespace, r.local_name) for r in m.local.filter(F.startswith("iri", F.lit(ODD))).collect()} == {(ODD, str(i)) for i in range(40)}
    assert m.terms.filter("foreign").count() == 0


def test_link_references_are_those_between_the_paths(spark):
    s = site(spark, Model(*tables(spark), written))
    ours = {(r.segment, r.local, r.media_type): r.link for r in s.link_headers().collect()}
    plan = plan_of(s.link_headers())
    ways = s.addresses.alias("a").join(s.addresses.alias("b"), ["release", "ns", "segment", "local"]).filter("a.media_type <> b.media_type")
    ways = ways.select("segment", "local", F.col("a.media_type").alias("asked"), F.col("b.media_type").alias("other"), iri.relative_to(F.col("a.request"), F.col("b.public")).alias("to"))
    rows = ways.collect()
    assert {r.local for r in rows} == {"A", "b/C", "d/", "index", "shape"} and {r.segment for r in rows} == {"", "1.0"}
    for r in rows:
        assert f'<{r.to}>; rel="alternate"; type="{r.other}"' in ours[r.segment, r.local, r.asked]
    index = s.addresses.select("segment", "local", "media_type", iri.relative_to(F.col("request"), F.concat("mount", F.lit("llms.txt"))).alias("to"))
    for r in index.collect():
        assert ours[r.segment, r.local, r.media_type].endswith(f'<{r.to}>; rel="describedby"; type="text/plain"')
    assert "filter(array(" not in plan  # a walk of paths for each row and type


SITE_QUERIES = {
    "breaking_gate": lambda m, s: compare.changes(m, "r", "r"),
    "answer_log": lambda m, s: negotiate.answers(m.spark.sql("SELECT 1L AS request_id, 'r' AS release, '/v/A' AS path, '' AS accept, '' AS query"), s, s.term_paths.select("release", "path")),
    "llms_index": lambda m, s: describe.llms_lines(s, 100),
    "namespaces_used_by": lambda m, s: describe.prefixes_needed(m),
    "schema_org_rows": lambda m, s: describe.schema_org(s),
}


@pytest.mark.parametrize("query", SITE_QUERIES)
def test_statements_of_other_subjects_are_not_stored(spark, query):
    sizes = {}

    def keep(df, name):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    m = Model(*tables(spark), keep)
    SITE_QUERIES[query](m, site(spark, m)).collect()
    assert "picked" in sizes and "quads" not in sizes
    assert max(sizes.values()) < 40, sizes


def test_blank_and_foreign_shapes_keep_their_statements(spark):
    shape = "https://elsewhere.example/s/Shape"
    m = Model(*tables(spark, [(shape, SH + "property", "p", "bnode"), (shape, RDFS + "label", "none", "literal")]), written)
    assert {(r.shape, r.path) for r in shapes.constraints(m).collect()} == {(NS + "shape", NS + "A"), (shape, NS + "A")}
    assert m.shape_statements.filter(F.col("s") == shape).count() == 1 and m.near_statements.filter(F.col("s") == shape).count() == 0
