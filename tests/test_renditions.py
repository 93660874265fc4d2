"""Stable blank labels, JSON-LD written and read back, profile chains, links, ordered digests and concatenation."""

import hashlib
import json

from pyspark.sql import functions as F

from vocabloom.operators import blanks, files, jsonld, profiles
from vocabloom.operators.model import Model
from vocabloom.operators.spread import before
from vocabloom.sources.tables import written
from vocabloom.vocabulary import OWL, RDFS, TYPE, XSD

NS, OTHER = "https://example.org/v/", "https://other.example.net/w#"
QUADS = "release string, file string, seq long, s string, s_kind string, p string, o string, o_kind string, lang string, dt string"


def statements(release="r"):
    """A small release with all kinds of values, coerced and not."""
    rows = [
        (NS, "iri", TYPE, OWL + "Ontology", "iri", None, None),
        (NS + "size", "iri", TYPE, OWL + "DatatypeProperty", "iri", None, None),
        (NS + "size", "iri", RDFS + "range", XSD + "integer", "iri", None, None),
        (NS + "note", "iri", TYPE, OWL + "DatatypeProperty", "iri", None, None),
        (NS + "note", "iri", RDFS + "range", XSD + "string", "iri", None, None),
        (NS + "near", "iri", TYPE, OWL + "ObjectProperty", "iri", None, None),
        (NS + "A", "iri", TYPE, OWL + "Class", "iri", None, None),
        (NS + "A", "iri", TYPE, OTHER + "Kind", "iri", None, None),
        (NS + "A", "iri", NS + "size", "7", "literal", None, XSD + "integer"),
        (NS + "A", "iri", NS + "size", "07", "literal", None, XSD + "integer"),
        (NS + "A", "iri", NS + "size", "seven", "literal", "en", None),
        (NS + "A", "iri", NS + "note", "plain", "literal", None, None),
        (NS + "A", "iri", NS + "note", 'quoted "x" \\ and\nline é', "literal", None, XSD + "string"),
        (NS + "A", "iri", NS + "near", NS + "B", "iri", None, None),
        (NS + "A", "iri", NS + "near", "https://elsewhere.example/x", "iri", None, None),
        (NS + "A", "iri", NS + "near", "text:not an iri", "literal", None, None),
        (NS + "A", "iri", NS + "near", "n1", "bnode", None, None),
        (NS + "A", "iri", RDFS + "label", "[1,2]", "literal", None, None),
        (NS + "A", "iri", RDFS + "label", "v:x", "literal", None, None),
        (NS + "A", "iri", RDFS + "seeAlso", OTHER + "z", "iri", None, None),
        (NS + "B", "iri", TYPE, OWL + "Class", "iri", None, None),
        (NS + "B", "iri", OTHER + "flag", "true", "literal", None, XSD + "boolean"),
        (NS + "B", "iri", OTHER + "flag", "1", "literal", None, XSD + "boolean"),
        (NS + "B", "iri", OTHER + "at", "2024-01-02", "literal", None, XSD + "date"),
        (NS + "B", "iri", OTHER + "count", "-12", "literal", None, XSD + "integer"),
        ("n1", "bnode", RDFS + "label", "inner", "literal", "en", None),
        ("n1", "bnode", OTHER + "to", "n2", "bnode", None, None),
        ("n2", "bnode", OTHER + "back", NS + "A", "iri", None, None),
    ]
    return [(release, "a.nt", i, *r) for i, r in enumerate(rows)]


def model(spark, rows=None):
    prefixes = [("r", "a.nt", 0, "v", NS), ("r", "a.nt", 0, "o", OTHER), ("r", "a.nt", 0, "owl", OWL)]
    return Model(spark.createDataFrame(rows or statements(), QUADS).repartition(3), spark.createDataFrame(prefixes, "release string, file string, file_ord int, prefix string, ns string"), written)


def test_blank_labels(spark):
    """Labels follow the first appearance by file, statement and end, in each release, however rows are dealt."""
    rows = [(r, f, i, s, "bnode", "p", o, kind, None, None) for r in ("r", "q") for f in ("b", "a") for i in range(40) for s, o, kind in [(f"{f}|x{i * 7 % 13}", f"{f}|y{i * 5 % 11}", "bnode" if i % 3 else "literal")]]
    seen: dict = {}
    for r, f, i, s, _, _, o, kind, *_ in sorted(rows):
        for node in [s] + [o] * (kind == "bnode"):
            seen.setdefault((r, node), f"b{sum(k[0] == r for k in seen)}")
    want = sorted((r, f, i, seen[r, s], seen[r, o] if kind == "bnode" else o) for r, f, i, s, _, _, o, kind, *_ in rows)
    for parts in (1, 5):
        df = spark.createDataFrame(rows, QUADS).orderBy(F.xxhash64("seq", F.lit(parts))).repartition(parts)
        got = blanks.labelled(df, written).select("release", "file", "seq", "s", "o").collect()
        assert sorted(map(tuple, got)) == want
    assert blanks.labels(spark.createDataFrame([], QUADS), written).count() == 0


def test_nodes(spark):
    m = model(spark)
    made = {r.id: json.loads(r.json) for r in jsonld.nodes(m).collect()}
    a, b = made[NS + "A"], made[NS + "B"]
    assert a["@id"] == "v:A" and sorted(a["@type"]) == ["o:Kind", "owl:Class"]
    assert a["size"] == [7, "07", {"@value": "seven", "@language": "en"}] or sorted(map(str, a["size"])) == sorted(map(str, [7, "07", {"@value": "seven", "@language": "en"}]))
    assert sorted(map(str, a["near"])) == sorted(map(str, ["v:B", "https://elsewhere.example/x", {"@value": "text:not an iri"}, {"@id": "_:b0"}]))
    assert sorted(a["note"]) == ["plain", 'quoted "x" \\ and\nline é']
    assert b["o:count"] == -12 and True in b["o:flag"] and {"@type": "xsd:boolean", "@value": "1"} in b["o:flag"]
    assert made["_:b0"]["o:to"] == {"@id": "_:b1"}


def test_round_trip(spark):
    m = model(spark)
    row = jsonld.roundtrip(m).first()
    assert row.written == row.read > 20 and row.lost == row.invented == 0 and row.lost_examples == ""
    split = jsonld.compared(jsonld.statements(m), jsonld.expanded(m, jsonld.nodes(m, most=2))).first()
    assert (split.lost, split.invented) == (0, 0) and jsonld.nodes(m, most=2).count() > jsonld.nodes(m).count()


def test_round_trip_finds_losses(spark):
    """A datatype dropped from one node, an IRI turned literal and a lost language each show on both sides."""
    m = model(spark)
    nodes = written(jsonld.nodes(m), "nodes")
    for old, new, gone in [
        ('{"@type":"xsd:date","@value":"2024-01-02"}', '"2024-01-02"', f'"2024-01-02"^^<{XSD}date>'.replace("<", "").replace(">", "")),
        ('{"@id":"o:z"}', '"o:z"', f"<{OTHER}z>"),
        (',"@language":"en"', "", "@en"),
    ]:
        broken = nodes.withColumn("json", F.replace("json", F.lit(old), F.lit(new)))
        row = jsonld.compared(jsonld.statements(m), jsonld.expanded(m, broken)).first()
        assert row.lost >= 1 and row.invented >= 1 and gone in row.lost_examples and gone not in row.invented_examples


def plain_links(body, path, base):
    """The same for one text, from left to right."""
    mark, out, n = "](" + base.rstrip("/") + "/", "", 0
    while mark in body:
        head, body = body.split(mark, 1)
        out += head
        if ")" not in body:
            out += mark
            continue
        target, body = body.split(")", 1)
        here, there = path.split("/")[:-1], [x for x in target.split("/")[:-1] if x]  # empty segments don't count
        same = 0
        while same < min(len(here), len(there)) and here[same] == there[same]:
            same += 1
        out += "](" + ("../" * (len(here) - same) + "".join(f"{x}/" for x in there[same:]) + target.split("/")[-1] or "./") + ")"
        n += 1
    return out + body, n


def test_relative_links(spark):
    base = "https://x.example/v/"
    bodies = {
        "a/b.md": f"no links, but {base} itself (and) more",
        "a/c.md": f"[b]({base}a/b.md) then [z]({base}z/y/x.md#f) and [c]({base}a/c.md)\nend",
        "z/y/x.md": f"[up]({base}a/b.md) [open]({base}a/b.md and [next]({base}q) ) rest",
        "d.md": f"text [open]({base}a and ]({base}b",
        "e.md": f"[other](https://y.example/v/a) [it]({base})",
        "f.md": "",
    }
    rows = [("r", p, base.rstrip("/") if p == "a/c.md" else base, b) for p, b in bodies.items()] + [("r", "n.md", None, f"[a]({base}a)"), ("s", "a/b.md", "https://x.(b)/", "[a](https://x.(b)/a/b.md)")]
    got = {(r.release, r.path): r for r in files.relativised(spark.createDataFrame(rows, "release string, path string, base_url string, body string").repartition(3)).collect()}
    for path, body in bodies.items():
        assert (got["r", path].body, got["r", path].n_links) == plain_links(body, path, base), path
    assert got["r", "a/c.md"].n_missing == 0 and got["r", "e.md"].n_missing == 1
    assert got["r", "n.md"].body == f"[a]({base}a)" and got["s", "a/b.md"].body == "[a](b.md)"


def test_ordered_digest(spark):
    rows = [(r, f"p{i:03}", f"content {r} {i}") for r in "ab" for i in range(57)] + [("c", "one", "x")]
    schema = "release string, path string, content string"
    one = {r.release: r for r in files.ordered_digest(spark.createDataFrame(rows, schema), written, leaf=4).collect()}
    two = {r.release: r for r in files.ordered_digest(spark.createDataFrame(rows[::-1], schema).repartition(7), written, leaf=4).collect()}
    assert one == two and one["a"].files == 57 and one["a"].bytes == sum(len(t) for r, _, t in rows if r == "a")
    level = [hashlib.sha256(f"{p}\0{hashlib.sha256(t.encode()).hexdigest()}".encode()).hexdigest() for r, p, t in sorted(rows) if r == "a"]
    while len(level) > 1:
        groups = [level[i : i + 4] for i in range(0, len(level), 4)]
        level = [g[0] if len(g) == 1 else hashlib.sha256(",".join(g).encode()).hexdigest() for g in groups]
    assert one["a"].digest == level[0]
    swapped = [("a", p, f"content a {1 - i}" if i < 2 else t) for i, (r, p, t) in enumerate(rows) if r == "a"]
    assert files.ordered_digest(spark.createDataFrame(swapped, schema), written, leaf=4).first().digest != level[0]


def test_running_sums(spark):
    """Sums before each row, by group, equal those of one window, for any number of partitions and hot groups."""
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 501, i, i % 11) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, id int, w int").repartition(5)
    got = {r.id: r.x for r in before(df, ["g"], ["k", "id"], "x", written, F.col("w")).collect()}
    assert got == {i: sum(w2 for g2, k2, i2, w2 in rows if g2 == g and (k2, i2) < (k, i)) for g, k, i, _ in rows}


def test_kept_tables_follow_every_source(spark, tmp_path):
    """What queries share is made anew when any file of any of its tables has come, changed or gone."""
    from vocabloom.plans.models import SOURCES, kept

    assert {"part", "supplier", "nation", "region", "lineitem"} <= set(SOURCES)
    for name in ("one", "two"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    calls = []
    get = lambda: kept(spark, str(tmp_path), "x", lambda: calls.append(1) or len(calls), ("one", "two"))
    assert (get(), get()) == (1, 1)
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/two.parquet")
    assert (get(), get()) == (2, 2)
    next((tmp_path / "one.parquet").glob("part*")).unlink()
    assert (get(), get()) == (3, 3)


def test_profile_chains(spark):
    """Three levels inherit in order; a circle and an unknown name are errors of every profile that leads there."""
    names = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "z"), ("z", "y"), ("lost", "gone"), ("self", "self")]
    fields = [("a", "label", "p1", 0), ("b", "label", "p2", 0), ("b", "label", "p1", 1), ("c", "label", "p3", 0), ("c", "label", "p2", 1), ("c", "note", "p9", 0), ("x", "label", "p1", 0)]
    got = profiles.resolved(spark.createDataFrame(names, "profile string, extends string"), spark.createDataFrame(fields, "profile string, field string, predicate string, rank int"), written).collect()
    ranked = lambda p, f: [(r.predicate, r.source) for r in sorted((r for r in got if r.profile == p and r.field == f), key=lambda r: r.rank)]
    assert ranked("a", "label") == [("p1", "a"), ("p2", "b"), ("p3", "c")] and ranked("a", "note") == [("p9", "c")]
    assert ranked("b", "label") == [("p2", "b"), ("p1", "b"), ("p3", "c")]
    assert {r.profile: r.error for r in got if r.error} == {"x": "cycle at y", "y": "cycle at y", "z": "cycle at z", "lost": "unknown profile gone", "self": "cycle at self"}
    assert not any(r.field for r in got if r.profile in ("x", "y", "z", "lost", "self"))
    own = {(r.profile, r.field, r.predicate): r.rank for r in profiles.resolved(*profiles.built_in(spark), written).collect()}
    assert own == {(p, f, x): i for p, f, x, i in profiles.predicate_rows()}
