"""What keeps steps that several queries share in proportion to their input."""

import re

from pyspark.sql import functions as F

from test_growth import NS, ODD, tables
from vocabloom.functions import iri
from vocabloom.operators import describe, jsonld
from vocabloom.operators.model import Model
from vocabloom.plans import derived, publish
from vocabloom.sources.tables import written
from vocabloom.streaming import requests as streams
from vocabloom.vocabulary import OWL, RDFS, TYPE

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statements_of_parts_are_made_by_many_tasks(spark):
    made = derived.quads(spark, SF)
    assert plan_of(made).count("RoundRobinPartitioning(2)") == 1
    parts = made.filter("file = 'part.ttl' and seq >= 10000 and release = 'new'").groupBy(F.spark_partition_id()).count()
    assert parts.count() == 2


def test_answers_are_stored_once(spark, monkeypatch):
    rows = [("new", f"https://host.example.net/a/{'x' * i}", "text/turtle", "sibling", "text/turtle", "https://host.example.net/a", False, "namespace", "x") for i in range(22)]
    plan = spark.createDataFrame(rows, "release string, url string, accept string, expect string, media_type string, location string, required boolean, subject string, context string")
    monkeypatch.setattr(publish, "asks", lambda spark, sf_dir: plan)
    monkeypatch.setattr(publish, "kept", lambda spark, sf_dir, name, build, *tables: build())
    got = publish.answers(spark, SF)
    assert "Join" not in plan_of(got) and got.count() == 22
    assert {r.status for r in got.collect()} == {0, 200, 303, 404}


def test_nodes_leave_terms_of_other_names_alone(spark):
    far = "https://elsewhere.example/"
    extra = [(NS + "A", NS + "of", NS + "d/", "iri"), (NS + "A", far + "of", NS + "d/", "iri"), (far + "of", RDFS + "range", NS + "A", "iri"), (far + "x/rdf:type", TYPE, OWL + "Class", "iri"), (far + "rdfs:subClassOf", TYPE, OWL + "Class", "iri"), (NS + "of", TYPE, OWL + "ObjectProperty", "iri")]
    made = []
    m = Model(*tables(spark, extra), lambda df, name: made.append(name) or written(df, name))
    row = jsonld.roundtrip(m).filter("release = 'r'").first()
    assert row.written > 5
    assert not [x for x in made if x in ("far_terms", "far_placed", "far_subjects")]
    words = jsonld.statements(m).select("release", F.col("p").alias("word")).distinct()
    words = words.unionByName(jsonld.nodes(m).select("release", F.explode(F.json_object_keys("json")).alias("word"))).distinct()
    ours = jsonld.entries_of(m, words)
    known = {r.word for r in words.collect()}
    asked = lambda rows: sorted((tuple(r) for r in rows.collect() if r.iri in known or r.key in known), key=str)
    assert asked(ours) == asked(jsonld.context(m)) and len(asked(ours)) == 2
    assert ours.count() < m.terms.count()


def test_windows_hold_a_digest_of_each_answer(spark):
    row = {"release": "r", "url": "u", "accept": "a", "expect": "page", "media_type": "t", "location": None, "required": False, "subject": "s", "context": "x", "status": 0, "content_type": "", "vary": "", "link": "", "redirect": "", "ts": 1_700_000_000}
    names = ", ".join(f"{n} {'boolean' if n == 'required' else 'long' if n in ('status', 'ts') else 'string'}" for n in row)
    rows = spark.createDataFrame([tuple((row | more).values()) for more in ({}, {}, {"location": ""}, {"location": "x"}, {"link": "x"})], names)
    made = streams.findings_by_window(rows.withColumn("ts", F.timestamp_seconds("ts")))
    assert [(r.rule, r.n) for r in made.collect()] == [("probe.unreachable", 4)]
    keys = re.findall(r"Aggregate\(keys?=\[([^\]]*)\]", plan_of(made))
    assert any("_whole#" in k for k in keys) and not any("link#" in k for k in keys), keys


def test_statements_of_local_terms_and_documents_come_from_one_pass(spark):
    made = []
    m = Model(*tables(spark), lambda df, name: made.append((name, plan_of(df))) or written(df, name))
    assert m.local.count() == 5 and m.documents.count() == 1
    passes = [name for name, plan in made if "/quads" in plan and re.search(r"ReadSchema: struct<[^>]*\bseq:", plan)]
    assert passes == ["picked"], passes


def test_facts_and_texts_of_terms_are_not_broadcast(spark):
    m = Model(*tables(spark, [(NS + "A", RDFS + "label", "a", "literal")]), written)
    made = []
    m.keep = lambda df, name: made.append((name, plan_of(df))) or written(df, name)
    assert [v.value for r in m.local.filter("iri = 'https://example.org/v/A'").collect() for v in r.labels] == ["a"]
    joins = [line for line in dict(made)["near_terms"].splitlines() if "Join" in line and re.search(r"\[release#\d+L?, (iri|s)#", line)]
    assert len(joins) == 3 and all("SortMergeJoin" in line for line in joins), joins


def test_order_lines_are_plain_projections(spark):
    lines = derived.quads(spark, SF).filter("file = 'lineitem.nt'")
    assert not [line for line in plan_of(lines).splitlines() if "Generate" in line and "l_" in line]
    assert lines.count() == 4 * spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_folders_are_those_of_the_pattern(spark):
    iris = ["", "a", "a/", "a//", "/", "//", "#", "/a", "a/b", "a/b/", "a/b#", "a#b/c", "a/b#c", "é/ü", "é/ü/", "x/𝒳", "x/𝒳/", "/#", "#/", None, "urn:x"]
    rows = spark.createDataFrame([(x,) for x in iris], "x string")
    pattern, own = F.nullif(F.regexp_extract("x", r"(?s)^(.*[#/]).", 1), F.lit("")), F.nullif(F.regexp_extract("x", r"(?s)^(.*[#/])[^#/]+$", 1), F.lit(""))
    assert not rows.filter(~pattern.eqNullSafe(iri.folder_of(F.col("x"))) | ~own.eqNullSafe(iri.namespace_part(F.col("x")))).collect()
    assert "regexp" not in plan_of(rows.select(iri.folder_of(F.col("x"))))


def test_documents_that_define_terms_are_found_from_few_foreign_ones(spark):
    far = "https://elsewhere.example/"
    doc = lambda x: (x, TYPE, OWL + "Ontology", "iri")
    for extra in ([], [doc(far), doc(far + "in/"), (far + "in/x", NS + "of", "1", "iri"), (far + "in/y", RDFS + "isDefinedBy", NS, "iri")], [doc(ODD), doc("https://example.org/items/")], [doc("https://example.org/items/x-3"), (far + "a", RDFS + "isDefinedBy", "https://example.org/items/x-3", "iri")]):
        sizes = {}
        m = Model(*tables(spark, extra), lambda df, name: sizes.setdefault(name, written(df, name)))
        m.prefixes = m.prefixes.limit(1)
        ours = {r.iri for r in m.defining.collect()}
        if not extra:
            assert sizes["some_statements"].count() == 1
        assert ours == {r.defined_in for r in m.placed.collect()} - {None}


def test_references_make_only_the_foreign_terms_that_are_asked_for(spark):
    far = "https://elsewhere.example/"
    extra = [(NS + "A", RDFS + "subClassOf", far + "x", "iri"), (NS + "A", RDFS + "subClassOf", "urn:y", "iri"), (NS + "A", RDFS + "subClassOf", far + "none", "iri"), *((s, RDFS + "label", s[-1] * 3, "literal") for s in (far + "x", far + "z", "urn:y", "urn:w"))]
    made = {}
    m = Model(*tables(spark, extra), lambda df, name: made.setdefault(name, written(df, name)))
    asked = m.local.select("release", F.explode("super_terms").alias("iri"))
    ours = describe.references(m, asked)
    rows = {r.iri: (r.label, r.curie, r.foreign, r.kind) for r in ours.collect()}
    assert not [x for x in made if x.startswith("far")] and {r.s for r in made["asked_statements"].collect()} == {far + "x", "urn:y"}
    assert m.terms.count() > 0  # all are there now
    assert rows == {r.iri: (r.label, r.curie, r.foreign, r.kind) for r in describe.references(m, asked).collect()}
    assert rows[far + "x"][0] == "xxx" and rows[far + "none"] == ("none", None, True, "external")
