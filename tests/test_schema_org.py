"""schema.org graphs of a small site."""

import json
from types import SimpleNamespace

from vocabloom.operators import describe

TEXTS = "array<struct<value:string,lang:string,source:string>>"


def _site(spark, local, documents):
    local = spark.createDataFrame(local, f"release string, iri string, namespace string, local_name string, labels {TEXTS}, definitions {TEXTS}, defined_in string")
    documents = spark.createDataFrame(documents, f"release string, iri string, title {TEXTS}, description {TEXTS}, license string, version_info string, modified string")
    paths = spark.createDataFrame([("r", "a#", "x", "text/html", "https://h/a/x"), ("r", "a#", "x", "text/turtle", "https://h/a/x")], "release string, ns string, local string, media_type string, page_url string")
    files = [("r", "a#", t, f"https://h/a/{f}") for t, f in (("text/html", ""), ("text/turtle", "a.ttl"), ("text/markdown", "index.md"), ("text/plain", "llms.txt"))]
    files = spark.createDataFrame(files, "release string, ns string, media_type string, url string")
    spaces = [("r", ns, title, f"https://h/{ns}") for ns, title in (("a#", "A"), ("b#", None), ("c#", "C"))]
    manifest = spark.createDataFrame(spaces, "release string, ns string, title string, doc_base string")
    config = spark.createDataFrame([("r", "https://h/")], "release string, base_url string")
    keep = lambda df, name: df.cache()
    return SimpleNamespace(m=SimpleNamespace(local=local, documents=documents, keep=keep), term_paths=paths, manifest=manifest, config=config, document_paths=lambda: files)


def test_schema_org_graphs(spark):
    texts = lambda *vs: [(v, lang, None) for v, lang in vs]
    local = [
        ("r", "a#x", "a#", "x", texts(("Ix", "de"), ('An "x"', "en")), texts(("Two\n lines", "en")), "a#"),
        ("r", "a#y", "a#", "y", [], None, None),
    ]
    documents = [("r", "a#", texts(("A", "en")), None, "lic", "1.0", None), ("r", "z#", None, texts(("About", None)), None, None, "2024-01-01")]
    rows = {(r.kind, r.iri, r.part): json.loads(r.json) for r in describe.schema_org(_site(spark, local, documents), most=2).collect()}
    assert rows["term", "a#x", 0]["@graph"] == [
        {"@type": "WebPage", "name": 'An "x"', "url": "https://h/a/x", "inLanguage": "en", "mainEntity": {"@id": "a#x"}},
        {"@type": "DefinedTerm", "@id": "a#x", "name": 'An "x"', "termCode": "x", "url": "https://h/a/x", "description": "Two lines", "inDefinedTermSet": "a#"},
    ]
    # a term without labels, texts or path has its name only
    assert rows["term", "a#y", 0]["@graph"][1] == {"@type": "DefinedTerm", "@id": "a#y", "name": "y", "termCode": "y"}
    [group] = rows["set", "a#", 0]["@graph"]
    assert group["@type"] == ["DefinedTermSet", "Dataset"] and group["version"] == "1.0" and "description" not in group
    assert [d["contentUrl"] for d in group["distribution"]] == ["https://h/a/index.md", "https://h/a/a.ttl"]
    [other] = rows["set", "z#", 0]["@graph"]
    assert other == {"@type": ["DefinedTermSet", "Dataset"], "@id": "z#", "name": "z#", "inLanguage": "en", "description": "About", "dateModified": "2024-01-01"}
    parts = [rows["catalogue", "https://h/", i] for i in range(2)]
    assert [[d["@id"] for d in p["dataset"]] for p in parts] == [["a#", "b#"], ["c#"]]
    assert parts[0]["dataset"][1] == {"@id": "b#", "@type": "Dataset", "name": "b#", "url": "https://h/b#"} and parts[0]["url"] == "https://h/"
    assert len(rows) == 6
