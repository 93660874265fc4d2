"""What queries return of the whole of their input, and make of no more than it takes."""

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from test_growth import NS, site, tables
from vocabloom.operators import describe, shapes
from vocabloom.operators.model import Model
from vocabloom.plans import exports, models
from vocabloom.sources import ntriples
from vocabloom.sources.tables import written
from vocabloom.vocabulary import RDFS, SH


def test_all_terms_of_a_large_namespace_are_listed(spark):
    s = site(spark, Model(*tables(spark), written))
    rows = {(r.section, r.line): r.text for r in describe.llms_lines(s, 2).collect()}
    names = [(at, text[text.index("[") + 1 : text.index("]")]) for at, text in sorted(rows.items()) if text.startswith("- [")]
    assert names == [((1, 1), "A"), ((1, 2), "b/C"), ((1, 3), "index"), ((10, 1), "shape"), ((13, 1), "d/")]
    assert rows[0, 3] == "Terms: 5" and rows[0, 4].startswith("See https://example.org/v/") and len(rows) == 9
    assert describe.llms_lines(s, 5).count() == 8


def test_fields_of_a_shape_take_labels_of_their_paths_alone(spark):
    far = "https://elsewhere.example/"
    paths = {"q": far + "x", "u": "urn:y", "w": far + "none", "z": "https://nowhere.example/n"}
    extra = [(NS + "shape", SH + "property", node, "bnode") for node in paths] + [(s, RDFS + "label", s[-1] * 3, "literal") for s in (NS + "A", far + "x", far + "z", "urn:y", "urn:w")]
    quads, prefixes = tables(spark, extra)
    quads = quads.unionByName(spark.createDataFrame([("r", "v.ttl", 2000 + i, n, "bnode", SH + "path", p, "iri", None, None) for i, (n, p) in enumerate(paths.items())], quads.schema))
    made = {}

    def keep(df, name):
        made[name] = written(df, name)
        return made[name]

    m = Model(quads, prefixes, keep)
    named = lambda: {r.path: r.name for r in shapes.record_template(m).collect()}
    ours = named()
    assert ours == {"v:A": "AAA", far + "x": "xxx", "urn:y": "yyy", far + "none": "none", "https://nowhere.example/n": "n"}
    assert "quads" not in made and {r.s for r in made["near_of"].collect()} == {NS + "A"} and {r.s for r in made["far_of"].collect()} == {far + "x", "urn:y"}
    asked = spark.createDataFrame([("r", x) for x in (NS + "A", NS + "A", far + "x", far + "none", NS)], "release string, iri string")
    rows = sorted(map(str, m.terms_of(asked).collect()))
    assert m.terms.count() == 49 and rows == sorted(map(str, m.terms_of(asked).collect())) and len(rows) == 2 and ours == named()


def test_written_statements_are_stored_once_and_compressed(spark):
    sf, conf = "/root/testdata/sf0.001", "spark.sql.maxConcurrentOutputFileWriters"
    given = spark.conf.get(conf, None)
    found = exports.stored_triples(spark, sf)
    raw = models.model(spark, sf).raw
    text = ntriples.lines(raw).agg(F.sum(F.octet_length("value") + 1)).first()[0]
    files = found.inputFiles()
    assert files and all(f.endswith(".txt.lz4") for f in files) and sum(os.path.getsize(urlparse(f).path) for f in files) < text / 4
    assert spark.conf.get(conf, None) == given
    names = ["release", "file", "s", "s_kind", "p", "o", "o_kind", "lang", "dt"]
    key = F.xxhash64(*(F.coalesce(x, F.lit("-")) for x in names))
    of = lambda rows: rows.agg(F.count("*"), F.bit_xor(key), F.sum(key.cast("decimal(38,0)"))).first()
    assert of(found) == of(raw)
    assert found.filter("seq is null").count() == 0


def test_lines_in_odd_forms_are_read_by_the_pattern(spark, tmp_path):
    lines = {
        "<a> <b> <c> .": ("a", "iri", "b", "c", "iri", None, None, None),
        "  <a>\t<b>  <c> <g>. # note": ("a", "iri", "b", "c", "iri", None, None, "g"),
        "<a> <b> <c> <> .": ("a", "iri", "b", "c", "iri", None, None, None),
        "<> <b> <> .": ("", "iri", "b", "", "iri", None, None, None),
        "<a> <b c> <d\\u0041 <> .": ("a", "iri", "b c", "dA <", "iri", None, None, None),
        "_:x <b> _:y .": ("x", "bnode", "b", "y", "bnode", None, None, None),
        '<a> <b> "" .': ("a", "iri", "b", "", "literal", None, None, None),
        '<a> <b> "> <c> ."@en-x <g> .': ("a", "iri", "b", "> <c> .", "literal", "en-x", None, "g"),
        '<a> <b> "1"^^<http://www.w3.org/2001/XMLSchema#string> .': ("a", "iri", "b", "1", "literal", None, None, None),
        '<a> <b> "\\"@en\\""^^<t>.': ("a", "iri", "b", '"@en"', "literal", None, "t", None),
    }
    wrong = ["<a> <> <c> .", "<a> <b> <c>", "<a> <b> <c> . .", "a> <b> <c> .", "<a><b> <c> .", "<a> <b> <c> .x", "", " ", "# <a> <b> <c> .", '<a> "b" <c> .', "<a> _:b <c> .", "<a> <b> _:c.", ">>> ."]
    path = tmp_path / "odd.nq"
    path.write_text("\n".join(x for pair in zip([*lines, *[""] * 3], wrong, strict=True) for x in pair))
    rows = ntriples.scan(spark, str(path), "r").orderBy("seq").collect()
    assert [(r.s, r.s_kind, r.p, r.o, r.o_kind, r.lang, r.dt, r.g) for r in rows] == list(lines.values())
