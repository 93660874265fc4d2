"""Two releases of a vocabulary as statements, derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.iri import folder_of
from ..vocabulary import ADMS, DCTERMS, FOAF, OWL, RDF, RDFS, SH, SKOS, TYPE, VANN, XSD
from .inputs import BASE, view

_PARTS = "(SELECT 'new' AS release, * FROM {part} WHERE p_partkey % 10 <> 0 UNION ALL SELECT 'old' AS release, * FROM {part} WHERE p_partkey % 11 <> 0 OR p_partkey % 10 = 0) AS t"
_BOTH = "(SELECT 'new' AS release UNION ALL SELECT 'old' AS release) AS r"
_LINES = f"{{lineitem}}, {_BOTH}"
_TYPES = f"(SELECT DISTINCT p_type FROM {{part}}) AS t, {_BOTH}"
_BRANDS = f"(SELECT DISTINCT p_brand FROM {{part}}) AS t, {_BOTH}"
_PART, _TYPE_IRI = f"'{BASE}part/' || p_partkey", f"'{BASE}part/' || p_type"
_SUPPLIER, _REGION, _NATION = f"'{BASE}supplier/' || s_suppkey", f"'{BASE}geo/region-' || r_regionkey", f"'{BASE}geo/nation-' || n_nationkey"
_LINE = f"'{BASE}lineitem/' || l_orderkey || '-' || l_linenumber"
_SHAPE = f"'{BASE}part/shapes/' || replace(p_brand, '#', '-')"
_OLD = "release = 'old'"
#: A document for each brand, whose number the rest goes by.
_B = "CAST(substr(p_brand, 7) AS INT)"
_RANGE = f"'{BASE}range/' || {_B} || '/'"

#: One for each kind of statement: source, condition, and the columns file, seq, s, s_kind, p, o, o_kind, lang, dt as SQL.
_branches: list[tuple[str, str, list[str]]] = []
_COLUMNS = ("file", "seq", "s", "s_kind", "p", "o", "o_kind", "lang", "dt")


def _text(x: str) -> str:
    return f"'{x}'" if x else "CAST(NULL AS STRING)"


def _add(file: str, seq: str, s: str, p: str, o: str, kind: str, source: str, where: str = "true", lang: str = "", dt: str = "", s_kind: str = "iri") -> None:
    _branches.append((source, where, [_text(file), f"CAST({seq} AS BIGINT)", s, _text(s_kind), _text(p), o, _text(kind), _text(lang), _text(dt)]))


def _constant(file: str, n: int, s: str, p: str, o: str, kind: str = "iri", lang: str = "", dt: str = "", release: str = "", s_kind: str = "iri") -> None:
    _add(file, str(n), f"'{s}'", p, f"'{o}'", kind, _BOTH, f"release = '{release}'" if release else "true", lang, dt, s_kind)


_n = iter(range(1, 1000))
PARTS, GEO, SHAPES, SUPPLIERS = BASE + "part/", BASE + "geo/", BASE + "part/shapes/", BASE + "supplier/"
for _p, _o, _kind, _lang in (
    (TYPE, OWL + "Ontology", "iri", ""),
    (DCTERMS + "title", "Parts", "literal", "en"),
    (DCTERMS + "description", "Parts in three classes, with DCAT links.", "literal", "en"),
    (OWL + "versionIRI", BASE + "part/1.0/", "iri", ""),
    (DCTERMS + "hasPart", GEO, "iri", ""),
    (VANN + "preferredNamespacePrefix", "part", "literal", ""),
    (DCTERMS + "creator", BASE + "agent/ada", "iri", ""),
    (DCTERMS + "creator", "ben", "bnode", ""),
    (DCTERMS + "creator", "Cleo", "literal", ""),
    (ADMS + "status", "http://purl.org/adms/status/UnderDevelopment", "iri", ""),
    (DCTERMS + "created", "2024-01-31", "literal", ""),
):
    _constant("part.ttl", next(_n), PARTS, _p, _o, _kind, _lang)
_constant("part.ttl", next(_n), PARTS, OWL + "versionInfo", "1.0", "literal", release="new")
_constant("part.ttl", next(_n), PARTS, OWL + "versionInfo", "0.9", "literal", release="old")
_constant("part.ttl", next(_n), BASE + "agent/ada", FOAF + "name", "Ada", "literal")
_constant("part.ttl", next(_n), BASE + "agent/ada", TYPE, FOAF + "Person")
_constant("part.ttl", next(_n), "ben", RDFS + "label", "Ben", "literal", s_kind="bnode")
_constant("geo.ttl", next(_n), GEO, TYPE, SKOS + "ConceptScheme")
_constant("geo.ttl", next(_n), GEO, DCTERMS + "title", "Places", "literal", "en")
_constant("geo.ttl", next(_n), GEO, DCTERMS + "isPartOf", PARTS)
_constant("shapes.ttl", next(_n), SHAPES, TYPE, OWL + "Ontology")
_constant("shapes.ttl", next(_n), SHAPES, DCTERMS + "title", "Part shapes", "literal")
_constant("supplier.nt", next(_n), SUPPLIERS, TYPE, OWL + "Ontology")
_constant("supplier.nt", next(_n), BASE + "zfresh/", TYPE, OWL + "Ontology", release="new")
_constant("supplier.nt", next(_n), BASE + "zlegacy/", TYPE, OWL + "Ontology", release="old")
for _s, _kind in (("hasSize", "DatatypeProperty"), ("madeBy", "ObjectProperty")):
    _constant("part.ttl", next(_n), PARTS + _s, TYPE, OWL + _kind)
    _constant("part.ttl", next(_n), PARTS + _s, RDFS + "label", _s, "literal", "en")
    _constant("part.ttl", next(_n), PARTS + _s, RDFS + "isDefinedBy", PARTS)
_constant("part.ttl", next(_n), PARTS + "hasSize", TYPE, OWL + "FunctionalProperty")
_constant("part.ttl", next(_n), PARTS + "hasSize", RDFS + "range", XSD + "integer")
_constant("part.ttl", next(_n), PARTS + "hasSize", RDFS + "domain", PARTS + "LARGE", release="new")
_constant("part.ttl", next(_n), PARTS + "hasSize", RDFS + "domain", PARTS + "SMALL", release="old")
_constant("part.ttl", next(_n), PARTS + "madeBy", RDFS + "range", SUPPLIERS + "1", release="new")
_constant("part.ttl", next(_n), PARTS + "madeBy", RDFS + "range", SUPPLIERS + "2", release="old")
_constant("part.ttl", next(_n), PARTS + "grade", TYPE, OWL + "Class", release="new")
_constant("part.ttl", next(_n), PARTS + "grade", TYPE, SKOS + "Concept", release="old")
_constant("part.ttl", next(_n), PARTS + "shapes", TYPE, OWL + "Class")
_constant("part.ttl", next(_n), DCTERMS + "title", RDFS + "label", "Title", "literal", "en")
_constant("part.ttl", next(_n), DCTERMS + "title", RDFS + "isDefinedBy", PARTS)
_constant("part.ttl", next(_n), PARTS + "economy", TYPE, OWL + "Class")

_add("part.ttl", "1000 + length(p_type) * 10", _TYPE_IRI, TYPE, f"'{OWL}Class'", "iri", _TYPES)
_add("part.ttl", "1001 + length(p_type) * 10", _TYPE_IRI, RDFS + "label", "lower(p_type)", "literal", _TYPES, lang="en")
_seq = "10000 + p_partkey * 10"
_add("part.ttl", _seq, _PART, TYPE, f"'{OWL}Class'", "iri", _PARTS)
_add("part.ttl", _seq + " + 1", _PART, RDFS + "label", f"p_name || CASE WHEN {_OLD} AND p_size % 11 = 0 THEN ' (old)' ELSE '' END", "literal", _PARTS, "p_partkey % 50 <> 1", lang="en")
_add("part.ttl", _seq + " + 2", _PART, RDFS + "comment", f"'A ' || p_name || ' of ' || p_brand || CASE WHEN {_OLD} AND p_size % 9 = 0 THEN ' once' ELSE '' END", "literal", _PARTS, f"p_partkey % CASE WHEN {_OLD} THEN 8 ELSE 7 END <> 0", lang="en")
_add("part.ttl", _seq + " + 3", _PART, RDFS + "isDefinedBy", f"'{PARTS}'", "iri", _PARTS, "p_partkey % 5 <> 0")
_add("part.ttl", _seq + " + 4", _PART, RDFS + "subClassOf", f"'{PARTS}' || CASE WHEN {_OLD} AND p_size % 13 = 0 THEN CASE p_type WHEN 'PROMO' THEN 'LARGE' ELSE 'PROMO' END ELSE p_type END", "iri", _PARTS)
_add("part.ttl", _seq + " + 5", _PART, OWL + "deprecated", "'true'", "literal", _PARTS, f"(p_size > 45) <> ({_OLD} AND (p_size % 17 = 0 OR p_size = 47))", dt=XSD + "boolean")
_add("part.ttl", _seq + " + 6", _PART, DCTERMS + "isReplacedBy", f"'{PARTS}' || (p_partkey - 1)", "iri", _PARTS, "p_size > 45 AND p_partkey % 2 = 0")
_add("part.ttl", _seq + " + 7", _PART, RDFS + "label", "'Teil ' || p_name", "literal", _PARTS, "p_partkey % 9 = 0")
_add("part.ttl", _seq + " + 8", _PART, SKOS + "closeMatch", f"'http://example.net/p/' || p_size", "iri", _PARTS, "p_partkey % 6 = 0")
_add("part.ttl", _seq + " + 9", _PART, PARTS + "hasSize", "CASE p_partkey % 8 WHEN 1 THEN '0' || p_size ELSE CAST(p_size AS STRING) END", "literal", _PARTS, "p_partkey % 4 = 1", dt=XSD + "integer")
_add("part.ttl", "500000000 + p_partkey * 10", _PART, PARTS + "madeBy", f"'{SUPPLIERS}' || (p_partkey % 10 + 1)", "iri", _PARTS, "p_partkey % 4 = 2")
_add("part.ttl", "500000001 + p_partkey * 10", _PART, BASE + "vocab#size", "CASE p_partkey % 12 WHEN 3 THEN '0' || p_size ELSE CAST(p_size AS STRING) END", "literal", _PARTS, "p_partkey % 6 = 3", dt=XSD + "integer")
_seq = "100000000 + s_suppkey * 10"
_add("supplier.nt", _seq, _SUPPLIER, TYPE, f"'{OWL}NamedIndividual'", "iri", f"{{supplier}}, {_BOTH}")
_add("supplier.nt", _seq + " + 1", _SUPPLIER, RDFS + "label", "s_name", "literal", f"{{supplier}}, {_BOTH}")
_add("supplier.nt", _seq + " + 2", _SUPPLIER, RDFS + "seeAlso", f"'{GEO}nation-' || s_nationkey", "iri", f"{{supplier}}, {_BOTH}")
_seq = "200000000 + r_regionkey * 10"
_add("geo.ttl", _seq, _REGION, TYPE, f"'{SKOS}Concept'", "iri", f"{{region}}, {_BOTH}")
_add("geo.ttl", _seq + " + 1", _REGION, SKOS + "inScheme", f"'{GEO}'", "iri", f"{{region}}, {_BOTH}")
_add("geo.ttl", _seq + " + 2", _REGION, SKOS + "topConceptOf", f"'{GEO}'", "iri", f"{{region}}, {_BOTH}")
_add("geo.ttl", _seq + " + 3", _REGION, SKOS + "prefLabel", "r_name", "literal", f"{{region}}, {_BOTH}", lang="en")
_add("geo.ttl", _seq + " + 4", _REGION, SKOS + "definition", "'The region ' || r_name", "literal", f"{{region}}, {_BOTH}", lang="en")
_seq = "210000000 + n_nationkey * 10"
_add("geo.ttl", _seq, _NATION, TYPE, f"'{SKOS}Concept'", "iri", f"{{nation}}, {_BOTH}")
_add("geo.ttl", _seq + " + 1", _NATION, SKOS + "inScheme", f"'{GEO}'", "iri", f"{{nation}}, {_BOTH}")
_add("geo.ttl", _seq + " + 2", _NATION, SKOS + "broader", f"'{GEO}region-' || n_regionkey", "iri", f"{{nation}}, {_BOTH}")
_add("geo.ttl", _seq + " + 3", _NATION, SKOS + "prefLabel", "n_name", "literal", f"{{nation}}, {_BOTH}", lang="en")
_seq = "1000000000 + l_orderkey * 100 + l_linenumber * 10"
_add("lineitem.nt", _seq, _LINE, BASE + "vocab#part", f"'{PARTS}' || l_partkey", "iri", _LINES)
_add("lineitem.nt", _seq + " + 1", _LINE, BASE + "vocab#supplier", f"'{SUPPLIERS}' || l_suppkey", "iri", _LINES)
_doc = [
    (TYPE, f"'{OWL}Ontology'", "iri", "true"),
    (DCTERMS + "title", "'Range ' || p_brand", "literal", f"{_B} % 6 > 0"),
    (DCTERMS + "isPartOf", f"'{PARTS}'", "iri", f"{_B} % 3 > 0"),
    (OWL + "versionInfo", f"CASE WHEN {_OLD} AND {_B} % 2 = 0 THEN '0.' ELSE '1.' END || {_B}", "literal", f"{_B} % 5 > 0"),
    (DCTERMS + "issued", f"'2024-0' || ({_B} % 9 + 1) || '-15'", "literal", f"{_B} % 4 <> 3"),
    (OWL + "versionIRI", f"{_RANGE} || CASE WHEN {_OLD} AND {_B} % 2 = 0 THEN '0.' ELSE '1.' END || {_B} || CASE WHEN {_B} % 8 = 6 THEN '#' ELSE '/' END", "iri", f"{_B} % 4 <> 3"),
    (ADMS + "status", "'http://purl.org/adms/status/Completed'", "iri", f"{_B} % 5 = 1"),
    (DCTERMS + "license", "'https://creativecommons.org/licenses/by/4.0/'", "iri", f"{_B} % 2 = 1"),
    (DCTERMS + "publisher", "'agent-' || p_brand", "literal", f"{_B} % 7 = 2"),
    (DCTERMS + "description", "'All of ' || p_brand || '.'", "literal", f"{_B} % 3 = 1"),
]
for _i, (_p, _o, _kind, _where) in enumerate(_doc):
    _add("range.ttl", f"300000000 + {_B} * 100 + {_i}", _RANGE, _p, _o, _kind, _BRANDS, _where, lang="en" if _p == DCTERMS + "title" else "")
_add("part.ttl", f"900 + {_B}", f"'{PARTS}'", DCTERMS + "hasPart", _RANGE, "iri", _BRANDS, f"{_B} % 2 = 0")
_seq, _ITEM = "400000000 + p_partkey * 10", f"{_RANGE} || CASE WHEN p_partkey % 60 = 3 THEN 'index' WHEN p_partkey % 60 = 7 THEN 'ITEM' || (p_partkey - 4) WHEN p_partkey % 60 = 19 THEN 'R' || {_B} WHEN p_partkey % 60 = 11 THEN '1.' || {_B} ELSE 'Item' || p_partkey END"
_add("range.ttl", _seq, _ITEM, TYPE, f"'{OWL}NamedIndividual'", "iri", _PARTS, "p_partkey % 4 = 3")
_add("range.ttl", _seq + " + 1", _ITEM, RDFS + "label", "p_name", "literal", _PARTS, "p_partkey % 4 = 3", lang="en")
_add("range.ttl", _seq + " + 2", _ITEM, RDFS + "isDefinedBy", _RANGE, "iri", _PARTS, "p_partkey % 4 = 3")
_add("range.ttl", _seq + " + 3", _ITEM, SKOS + "scopeNote", "'Sold as ' || p_type || '. See also ' || p_brand", "literal", _PARTS, "p_partkey % 16 = 3", lang="en")
_BARE = "{supplier}, (SELECT 'bare' AS release) AS r"
_add("bare.nt", "s_suppkey * 10", _SUPPLIER, RDFS + "label", "s_name", "literal", _BARE)
_add("bare.nt", "s_suppkey * 10 + 1", _SUPPLIER, RDFS + "seeAlso", f"'{GEO}nation-' || s_nationkey", "iri", _BARE)

# shapes: a node shape for each brand with up to four constraints: c on a size, d on who is behind a maker, e on a chain, f on a scheme
_seq = f"5000 + {_B} * 100"
_step = iter(range(100))


def _shape(s: str, p: str, o: str, kind: str, where: str = "true", dt: str = "") -> None:
    _add("shapes.ttl", f"{_seq} + {next(_step)}", s, p, o, kind, _BRANDS, where, dt=dt, s_kind="iri" if s == _SHAPE else "bnode")


def _node(name: str) -> str:
    return f"'{name}' || {_B}"


_shape(_SHAPE, TYPE, f"'{SH}NodeShape'", "iri")
_shape(_SHAPE, TYPE, f"'{OWL}Class'", "iri", f"{_B} % 8 = 7")
_shape(_SHAPE, SH + "targetClass", f"'{PARTS}LARGE'", "iri", f"{_B} % 5 > 1")
_shape(_SHAPE, SH + "targetSubjectsOf", f"'{PARTS}hasSize'", "iri", f"{_B} % 4 = 2")
_shape(_SHAPE, SH + "targetObjectsOf", f"'{PARTS}madeBy'", "iri", f"{_B} % 6 = 2")
_shape(_SHAPE, SH + "targetNode", f"'{PARTS}' || {_B}", "iri", f"{_B} % 9 = 2")
_shape(_SHAPE, SH + "closed", "'false'", "literal", f"{_B} % 3 = 0", XSD + "boolean")
_shape(_SHAPE, SH + "property", _node("c"), "bnode", f"NOT (release = 'new' AND {_B} % 10 = 3) AND NOT ({_OLD} AND {_B} % 10 = 4) AND {_B} <> 21")
_shape(_node("c"), SH + "path", f"'{PARTS}hasSize'", "iri")
_shape(_node("c"), SH + "minCount", f"CAST(CASE WHEN {_OLD} AND {_B} = 19 THEN 0 ELSE {_B} % 3 + CASE WHEN {_OLD} AND {_B} % 4 = 0 THEN 1 ELSE 0 END END AS STRING)", "literal", f"{_B} % 5 > 0", XSD + "integer")
_shape(_node("c"), SH + "maxCount", f"CAST({_B} + CASE WHEN {_OLD} AND {_B} % 6 = 0 THEN 1 ELSE 0 END AS STRING)", "literal", f"{_B} % 2 = 0", XSD + "integer")
_shape(_node("c"), SH + "datatype", f"'{XSD}integer'", "iri", f"NOT ({_OLD} AND {_B} % 7 = 0)")
_shape(_node("c"), SH + "name", "'size of ' || p_brand", "literal", f"{_B} % 11 > 0")
_shape(_node("c"), SH + "description", "'How large ' || p_brand || ' is'", "literal", f"{_B} % 2 = 1")
_shape(_node("c"), SH + "pattern", "'^[0-9]+$'", "literal", f"{_B} % 3 = 2")
_shape(_node("c"), SH + "severity", f"'{SH}Warning'", "iri", f"{_B} % 4 = 3")
_shape(_node("c"), SH + "deactivated", "'true'", "literal", f"{_B} % 12 = 5", XSD + "boolean")
_shape(_node("c"), SH + "in", _node("i1-"), "bnode", f"{_B} % 3 = 0")
_shape(_node("i1-"), RDF + "first", "'small'", "literal", f"{_B} % 3 = 0")
_shape(_node("i1-"), RDF + "rest", _node("i2-"), "bnode", f"{_B} % 3 = 0")
_shape(_node("i2-"), RDF + "first", f"CASE WHEN {_OLD} AND {_B} % 2 = 0 THEN 'big' ELSE 'large' END", "literal", f"{_B} % 3 = 0")
_shape(_node("i2-"), RDF + "rest", f"'{RDF}nil'", "iri", f"{_B} % 3 = 0 AND NOT (release = 'new' AND {_B} % 9 = 0)")
_shape(_node("i2-"), RDF + "rest", _node("i1-"), "bnode", f"release = 'new' AND {_B} % 9 = 0")
_shape(_node("c"), SH + "node", _node("n"), "bnode", f"{_B} % 3 = 1")
_shape(_node("n"), SH + "property", _node("np"), "bnode", f"{_B} % 3 = 1")
_shape(_node("n"), SH + "node", _node("m"), "bnode", f"{_B} % 6 = 1")
_shape(_node("np"), SH + "path", f"'{SKOS}inScheme'", "iri", f"{_B} % 3 = 1")
_shape(_node("np"), SH + "hasValue", f"CASE WHEN {_OLD} AND {_B} % 4 = 1 THEN '{SUPPLIERS}' ELSE '{GEO}' END", "iri", f"{_B} % 3 = 1")
_shape(_node("m"), SH + "property", _node("mp"), "bnode", f"{_B} % 6 = 1")
_shape(_node("mp"), SH + "path", f"'{SKOS}inScheme'", "iri", f"{_B} % 6 = 1")
_shape(_node("mp"), SH + "hasValue", f"'{BASE}deep/'", "iri", f"{_B} % 6 = 1")
_shape(_SHAPE, SH + "property", _node("d"), "bnode", f"{_B} % 4 = 1")
_shape(_node("d"), SH + "path", _node("dp"), "bnode", f"{_B} % 4 = 1")
_shape(_node("dp"), SH + "inversePath", f"'{PARTS}madeBy'", "iri", f"{_B} % 4 = 1")
_shape(_node("d"), SH + "class", f"'{PARTS}SMALL'", "iri", f"{_B} % 4 = 1")
_shape(_node("d"), SH + "or", _node("o1-"), "bnode", f"{_B} % 8 = 1")
_shape(_node("o1-"), RDF + "first", _node("oa"), "bnode", f"{_B} % 8 = 1")
_shape(_node("o1-"), RDF + "rest", _node("o2-"), "bnode", f"{_B} % 8 = 1")
_shape(_node("o2-"), RDF + "first", _node("ob"), "bnode", f"{_B} % 8 = 1")
_shape(_node("o2-"), RDF + "rest", f"'{RDF}nil'", "iri", f"{_B} % 8 = 1")
_shape(_node("oa"), SH + "datatype", f"'{XSD}date'", "iri", f"{_B} % 8 = 1")
_shape(_node("ob"), SH + "datatype", f"'{XSD}gYear'", "iri", f"{_B} % 8 = 1")
_shape(_SHAPE, SH + "property", _node("e"), "bnode", f"{_B} % 4 = 2")
_shape(_node("e"), SH + "path", _node("e1-"), "bnode", f"{_B} % 4 = 2")
_shape(_node("e1-"), RDF + "first", f"'{PARTS}madeBy'", "iri", f"{_B} % 4 = 2")
_shape(_node("e1-"), RDF + "rest", _node("e2-"), "bnode", f"{_B} % 4 = 2")
_shape(_node("e2-"), RDF + "first", f"'{PARTS}hasSize'", "iri", f"{_B} % 4 = 2")
_shape(_node("e2-"), RDF + "rest", f"'{RDF}nil'", "iri", f"{_B} % 4 = 2")
_shape(_node("e"), SH + "nodeKind", f"'{SH}IRIOrLiteral'", "iri", f"{_B} % 4 = 2")
_shape(_SHAPE, SH + "property", _node("f"), "bnode", f"{_B} % 4 = 3")
_shape(_node("f"), SH + "path", _node("fp"), "bnode", f"{_B} % 4 = 3")
_shape(_node("fp"), SH + "zeroOrMorePath", f"'{PARTS}madeBy'", "iri", f"{_B} % 4 = 3")
_shape(_node("f"), SH + "hasValue", "'fixed'", "literal", f"{_B} % 4 = 3")
_shape(_node("f"), SH + "minCount", "'1'", "literal", f"{_B} % 8 = 3", XSD + "integer")

#: release, file, seq, s, s_kind, p, o, o_kind, lang, dt. Blank nodes are scoped by file in the model.
QUADS = "\nUNION ALL ".join(f"SELECT release, {', '.join(f'{e} AS {n}' for e, n in zip(columns, _COLUMNS, strict=True))} FROM {source} WHERE {where}" for source, where, columns in _branches)


def _chosen(name: str, each: list[str]) -> str:
    """SQL for the expression whose place in a list is _k."""
    if len(set(each)) == 1:
        return f"{each[0]} AS {name}"
    if all(x.startswith(("'", "CAST(NULL")) and "||" not in x for x in each):
        return f"array({', '.join(each)})[_k] AS {name}"
    at: dict[str, list[str]] = {}
    for k, x in enumerate(each):
        at.setdefault(x, []).append(str(k))
    return "CASE " + " ".join(f"WHEN _k IN ({', '.join(ks)}) THEN {x}" for x, ks in at.items()) + f" END AS {name}"


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows and, as _folder, the folder of each named subject: each source is read once, and each of its rows exploded into
    the numbers of its statements, which are made after. Order lines are by far the most rows: the subject of a line and its
    folder are made once for its statements in both releases.

    A row of a part becomes some thirty statements, and its table has few bytes for its rows, so its rows are dealt out first: one
    task would make the statements of a whole file. Statements are made in a projection of their own, which Spark compiles.
    """
    by_source: dict[str, list[tuple[str, list[str]]]] = {}
    parts = []
    for source, where, columns in _branches:
        by_source.setdefault(source, []).append((where, columns))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for source, each in by_source.items():
        if source == _LINES:
            lines = view(spark, sf_dir, f"SELECT *, {_LINE} AS _s FROM {{lineitem}}").withColumn("_folder", folder_of(F.col("_s")))
            rows = lines.crossJoin(view(spark, sf_dir, f"SELECT * FROM {_BOTH}"))
            each = [(where, ["_s" if x == _LINE else x for x in columns]) for where, columns in each]
        else:
            rows = view(spark, sf_dir, f"SELECT * FROM {source}")
        numbers = ", ".join(f"CASE WHEN {where} THEN {k} END" for k, (where, _) in enumerate(each))
        numbered = (rows.repartition(tasks) if source == _PARTS else rows).selectExpr("*", f"explode(array({numbers})) AS _k").filter("_k IS NOT NULL")
        made = numbered.selectExpr("release", *(_chosen(n, [columns[i] for _, columns in each]) for i, n in enumerate(_COLUMNS)), *(["_folder"] if source == _LINES else []))
        parts.append(made if source == _LINES else made.withColumn("_folder", F.when(F.col("s_kind") == "iri", folder_of(F.col("s")))))
    return reduce(DataFrame.unionAll, parts)


#: release, file, file_ord, prefix, ns: what each file declares, in the order of file_ord.
PREFIXES = f"""
SELECT release, file, file_ord, prefix, ns FROM (VALUES ('geo.ttl', 0, 'geo', '{GEO}'), ('geo.ttl', 0, 'skos', '{SKOS}'), ('geo.ttl', 0, 'dct', '{DCTERMS}'), ('part.ttl', 1, 'owl', '{OWL}'), ('part.ttl', 1, 'part', '{PARTS}'), ('part.ttl', 1, 'rdfs', '{RDFS}'), ('part.ttl', 1, 'dct', '{BASE}unused#'), ('shapes.ttl', 3, 'sh', '{SH}'), ('shapes.ttl', 3, 'xsd', '{XSD}')) AS f(file, file_ord, prefix, ns), {_BOTH}
UNION ALL SELECT release, CASE WHEN n_nationkey % 2 = 0 THEN 'geo.ttl' ELSE 'part.ttl' END, n_nationkey % 2, 'n' || (n_nationkey - n_nationkey % 2), '{GEO}nation-' || n_nationkey || '#' FROM {{nation}}, {_BOTH}
UNION ALL SELECT release, 'range.ttl', 2, 'r' || {_B}, {_RANGE} FROM {_BRANDS} WHERE {_B} % 3 <> 1
"""
