"""Registered queries of the model, lint and comparison operators over the derived releases, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles
from ..operators.model import CHARACTERISTICS, HEADER_IRIS, HEADER_SCALARS, KIND_OF_TYPE, MAPPING_RELATIONS, STRUCTURAL, TERM_IRIS, Model, case_folds, first_of
from ..sources.tables import written
from ..vocabulary import DCTERMS, FOAF, OWL, RDFS, SKOS, TYPE, VANN, WELL_KNOWN_PREFIXES
from .derived import PREFIXES, QUADS, quads
from .inputs import TABLES, duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col
KEY = ["release", "iri"]


_kept: WeakKeyDictionary = WeakKeyDictionary()


#: The tables that the statements of the releases, and so all that is made of them, are derived from.
SOURCES = tuple(t for t in TABLES if "{" + t + "}" in QUADS + PREFIXES)


def _stamp(spark: SparkSession, paths: list[str]) -> tuple:
    """What tells one state of some files from another: their number, bytes, last change, and names. Nothing of them is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    each = F.xxhash64("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.bit_xor(each)).first())


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object], tables: tuple[str, ...] = SOURCES) -> object:
    """What queries over a folder share in a session; built anew when a file of one of the tables has come, gone or changed."""
    stamps = _stamp(spark, [f"{sf_dir}/{t}.parquet" for t in tables])
    own = _kept.setdefault(spark, {})
    if own.get(name, (None,))[0] != (sf_dir, stamps):
        own[name] = ((sf_dir, stamps), build())
    return own[name][1]


def model(spark: SparkSession, sf_dir: str) -> Model:
    """One model for all queries over a folder; its main tables are written once."""
    return kept(spark, sf_dir, "model", lambda: Model(quads(spark, sf_dir), view(spark, sf_dir, PREFIXES), written))


def _sql(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_RULES = " UNION ALL ".join(f"SELECT '{p}' AS profile, '{f}' AS field, '{x}' AS p, {r} AS rank" for p, f, x, r in profiles.predicate_rows())
KNOWN = "CASE {} " + " ".join(f"WHEN '{ns}' THEN '{p}'" for p, ns in WELL_KNOWN_PREFIXES.items()) + " END"


def _first(p: str) -> str:
    return f"arg_min(CASE WHEN o_kind <> 'bnode' THEN o ELSE chr(0) END, seq) FILTER (p = '{p}')"


def _scalar(p: str) -> str:
    return f"nullif({_first(p)}, chr(0))"


def _set(ps: list[str]) -> str:
    return f"list_sort(coalesce(list(DISTINCT o) FILTER (o_kind = 'iri' AND p IN {_sql(ps)}), []))"


_NS, _LOCAL = "nullif(regexp_extract({0}, '^(.*[#/])([^#/]+)$', 1), '')", "nullif(regexp_extract({0}, '^(.*[#/])([^#/]+)$', 2), '')"
_KIND = "CASE " + " ".join(f"WHEN list_contains(types, '{t}') THEN '{k}'" for t, k in KIND_OF_TYPE) + " WHEN len(domain) + len(range) > 0 THEN 'RdfProperty' WHEN len(types) = 0 THEN 'Other' ELSE 'Individual' END"
PRELUDE = f"""
WITH RECURSIVE raw AS ({duck(QUADS)}),
q AS MATERIALIZED (SELECT release, file, seq, CASE s_kind WHEN 'bnode' THEN file || '|' || s ELSE s END AS s, s_kind, p, CASE o_kind WHEN 'bnode' THEN file || '|' || o ELSE o END AS o, o_kind, lang, dt FROM raw),
pre AS ({duck(PREFIXES)}),
pmap AS (SELECT release, prefix, arg_min(ns, file) AS ns FROM pre GROUP BY ALL),
pof AS (SELECT release, ns, min(prefix) AS declared FROM pmap GROUP BY ALL),
doc AS MATERIALIZED (SELECT DISTINCT release, s AS iri FROM q WHERE s_kind = 'iri' AND o_kind = 'iri' AND p = '{TYPE}' AND o IN ('{OWL}Ontology', '{SKOS}ConceptScheme')),
minted AS (SELECT release, iri AS ns FROM doc WHERE iri LIKE '%/' OR iri LIKE '%#' UNION SELECT release, o FROM q WHERE p = '{VANN}preferredNamespaceUri' AND o_kind <> 'bnode'),
fileof AS (SELECT release, s AS iri, min(file) AS file FROM q GROUP BY ALL),
typ AS (SELECT release, s AS iri, list_sort(list(DISTINCT o)) AS types FROM q WHERE p = '{TYPE}' AND o_kind = 'iri' GROUP BY ALL),
sig AS (SELECT release, file, list_sort(coalesce(list(DISTINCT o) FILTER (p = '{TYPE}' AND o_kind = 'iri'), [])) AS file_types, list_sort(list(DISTINCT p)) AS file_predicates FROM q GROUP BY ALL),
prof AS (SELECT release, iri, file, types, CASE WHEN list_has_any(file_types, {list(profiles.PROFILES['shacl']['file_has_type'])}) THEN 'shacl' WHEN list_contains(types, '{SKOS}ConceptScheme') THEN 'skos' WHEN list_contains(types, '{OWL}Ontology') AND list_has_any(file_types, {list(profiles.PROFILES['dcap']['file_has_type'])}) THEN 'dcap' ELSE 'generic' END AS profile FROM doc JOIN fileof USING (release, iri) JOIN typ USING (release, iri) JOIN sig USING (release, file)),
rules AS ({_RULES}),
docs AS (SELECT release, iri, file, profile, CASE WHEN profile = 'shacl' THEN 'Shapes' WHEN list_contains(types, '{SKOS}ConceptScheme') THEN 'Scheme' WHEN list_contains(types, '{OWL}Ontology') THEN 'Ontology' ELSE 'Document' END AS document_kind, {', '.join(HEADER_SCALARS)}, {', '.join(HEADER_IRIS)} FROM prof JOIN (SELECT release, s AS iri, {', '.join(f'{_scalar(p)} AS {n}' for n, p in HEADER_SCALARS.items())}, {', '.join(f'{_set([p])} AS {n}' for n, p in HEADER_IRIS.items())} FROM q WHERE s_kind = 'iri' GROUP BY ALL) USING (release, iri)),
root AS (SELECT release, arg_min(iri, (CASE document_kind WHEN 'Ontology' THEN '1' WHEN 'Scheme' THEN '2' ELSE '3' END) || iri) AS root FROM docs d WHERE NOT EXISTS (SELECT 1 FROM docs e WHERE e.release = d.release AND list_contains(e.has_part, d.iri)) GROUP BY release),
subj AS MATERIALIZED (SELECT DISTINCT release, s AS iri FROM q WHERE s_kind = 'iri' EXCEPT SELECT release, iri FROM doc),
nsof AS (SELECT release, iri, arg_max(ns, length(ns)) AS ns FROM subj JOIN minted USING (release) WHERE starts_with(iri, ns) AND length(iri) > length(ns) GROUP BY ALL),
lnk AS (SELECT release, s AS iri, min(o) FILTER (p = '{RDFS}isDefinedBy') AS is_defined_by, min(o) FILTER (p = '{SKOS}inScheme') AS scheme FROM q JOIN (SELECT release, iri AS o FROM doc) USING (release, o) WHERE o_kind = 'iri' GROUP BY ALL),
infile AS (SELECT release, file, count(*) AS n_docs, min(iri) AS lone FROM prof GROUP BY ALL),
own AS (SELECT s.release, s.iri, arg_max(d.iri, length(d.iri)) AS in_file FROM subj s JOIN fileof f USING (release, iri) JOIN prof d ON d.release = s.release AND d.file = f.file AND starts_with(s.iri, d.iri) GROUP BY ALL),
nearest AS (SELECT s.release, s.iri, arg_max(d.iri, length(d.iri)) AS nearest FROM subj s JOIN doc d ON d.release = s.release AND starts_with(s.iri, d.iri) GROUP BY ALL),
placed AS MATERIALIZED (SELECT release, iri, file, coalesce(ns, {_NS.format('iri')}, iri) AS namespace, substr(iri, length(coalesce(ns, {_NS.format('iri')}, iri)) + 1) AS local_name, ns IS NULL AS "foreign", is_defined_by, coalesce(is_defined_by, scheme, CASE WHEN n_docs = 1 THEN lone END, in_file, nearest) AS defined_in
  FROM subj JOIN fileof USING (release, iri) LEFT JOIN nsof USING (release, iri) LEFT JOIN lnk USING (release, iri) LEFT JOIN infile USING (release, file) LEFT JOIN own USING (release, iri) LEFT JOIN nearest USING (release, iri)),
tprof AS (SELECT p.release, p.iri, coalesce(d.profile, 'generic') AS profile FROM placed p LEFT JOIN prof d ON d.release = p.release AND d.iri = p.defined_in),
vals AS (SELECT release, s AS iri, v.profile, field, list(struct_pack(value := o, lang := lang, source := p) ORDER BY rank, seq) AS vs FROM q JOIN rules v USING (p) JOIN (SELECT release, iri AS s, profile FROM prof UNION ALL SELECT release, iri, profile FROM tprof) USING (release, s, profile) WHERE o_kind = 'literal' AND s_kind = 'iri' GROUP BY ALL),
facts AS (SELECT release, s AS iri, {_set([TYPE]).replace(f"p IN {_sql([TYPE])}", f"p = '{TYPE}'")} AS types, {', '.join(f'{_set(ps)} AS {n}' for n, ps in TERM_IRIS.items())}, coalesce({_scalar(OWL + 'deprecated')} = 'true', false) AS deprecated FROM q WHERE s_kind = 'iri' GROUP BY ALL),
terms AS MATERIALIZED (SELECT placed.*, tprof.profile, facts.* EXCLUDE (release, iri), {_KIND} AS kind, coalesce(declared, {KNOWN.format('namespace')}) AS prefix,
  coalesce(l.vs, []) AS labels, coalesce(e.vs, []) AS definitions
  FROM placed JOIN tprof USING (release, iri) JOIN facts USING (release, iri) LEFT JOIN pof ON pof.release = placed.release AND pof.ns = namespace
  LEFT JOIN vals l ON l.release = placed.release AND l.iri = placed.iri AND l.field = 'label' LEFT JOIN vals e ON e.release = placed.release AND e.iri = placed.iri AND e.field = 'definition')
"""


def query(name: str, build: Callable[[Model], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(model(spark, sf_dir))
    ORACLE[name] = PRELUDE + sql


joined = lambda column: F.array_join(column, " ").alias(column)
query("file_stats", lambda m: m.quads.groupBy("release", "file").agg(F.count("*").alias("triples")), "SELECT release, file, count(*) AS triples FROM q GROUP BY ALL")
query("prefix_map", lambda m: m.prefix_map, "SELECT * FROM pmap")
query("about", lambda m: m.quads.join(m.quads.filter((c("p") == TYPE) & (c("o") == SKOS + "Concept")).select("release", "s"), ["release", "s"], "left_semi").select("release", "s", "seq", "p", "o"), f"SELECT q.release, q.s, seq, p, o FROM q SEMI JOIN (SELECT release, s FROM q WHERE p = '{TYPE}' AND o = '{SKOS}Concept') x ON x.release = q.release AND x.s = q.s")
query("objects", lambda m: m.quads.filter(c("p") == RDFS + "label").groupBy("release", "s").agg(F.min_by("o", "seq").alias("first"), F.count("*").alias("n")), f"SELECT release, s, arg_min(o, seq) AS first, count(*) AS n FROM q WHERE p = '{RDFS}label' GROUP BY ALL")
query("iri_objects", lambda m: m.quads.filter((c("p") == RDFS + "subClassOf") & (c("o_kind") == "iri")).groupBy("release", "s").agg(F.array_join(F.array_sort(F.collect_set("o")), " ").alias("objects")), f"SELECT release, s, string_agg(DISTINCT o, ' ' ORDER BY o) AS objects FROM q WHERE p = '{RDFS}subClassOf' AND o_kind = 'iri' GROUP BY ALL")
query("subjects_of", lambda m: m.quads.filter(c("p") == OWL + "deprecated").select("release", "s").distinct(), f"SELECT DISTINCT release, s FROM q WHERE p = '{OWL}deprecated'")
query("subjects_with", lambda m: m.quads.filter((c("p") == TYPE) & (c("o") == SKOS + "Concept")).select("release", "s").distinct(), f"SELECT DISTINCT release, s FROM q WHERE p = '{TYPE}' AND o = '{SKOS}Concept'")
query("types", lambda m: m.types.select(*KEY, joined("types")), "SELECT release, iri, array_to_string(types, ' ') AS types FROM typ")
query("file_of", lambda m: m.file_of, "SELECT * FROM fileof")
query("named_subjects", lambda m: m.named.select("release", "s").distinct(), "SELECT DISTINCT release, s FROM q WHERE s_kind = 'iri'")
query("used_namespaces", lambda m: m.used_namespaces, f"SELECT DISTINCT release, {_NS.format('i')} AS ns FROM (SELECT release, unnest([CASE s_kind WHEN 'iri' THEN s END, p, CASE o_kind WHEN 'iri' THEN o END, dt]) AS i FROM q) WHERE {_NS.format('i')} IS NOT NULL")
query("document_set", lambda m: m.document_set, "SELECT * FROM doc")
query("minted_namespaces", lambda m: m.minted, "SELECT * FROM minted")
query("file_signals", lambda m: m.file_signals.select("release", "file", joined("file_types"), joined("file_predicates")), "SELECT release, file, array_to_string(file_types, ' ') AS file_types, array_to_string(file_predicates, ' ') AS file_predicates FROM sig")
query("profile_detect", lambda m: m.document_profiles.select(*KEY, "profile"), "SELECT release, iri, profile FROM prof")
query("document_kind", lambda m: m.documents.select(*KEY, "document_kind"), "SELECT release, iri, document_kind FROM docs")
query("first_scalar", lambda m: m.named.groupBy("release", "s").agg(first_of(c("p") == RDFS + "label").alias("label")).dropna(), f"SELECT release, s, {_scalar(RDFS + 'label')} AS label FROM q WHERE s_kind = 'iri' AND p = '{RDFS}label' GROUP BY ALL")
query("agents", lambda m: m.agents(DCTERMS + "creator"), f"""SELECT q.release, q.s AS iri, q.seq, CASE q.o_kind WHEN 'iri' THEN q.o END AS agent, CASE q.o_kind WHEN 'literal' THEN q.o ELSE coalesce(f.foaf, f.label) END AS name, CASE WHEN q.o_kind <> 'literal' THEN f.kind END AS kind
  FROM q JOIN doc ON doc.release = q.release AND doc.iri = q.s LEFT JOIN (SELECT release, s, {_scalar(FOAF + 'name')} AS foaf, {_scalar(RDFS + 'label')} AS label, min(o) FILTER (p = '{TYPE}') AS kind FROM q GROUP BY ALL) f ON f.release = q.release AND f.s = q.o WHERE q.p = '{DCTERMS}creator'""")
query("root_document", lambda m: m.root, "SELECT * FROM root")
query("namespace_of", lambda m: m.placed.filter("not foreign").select(*KEY, "namespace", "local_name"), "SELECT release, iri, namespace, local_name FROM placed WHERE NOT \"foreign\"")
query("foreign_flag", lambda m: m.placed.groupBy("release", "namespace", "foreign").agg(F.count("*").alias("n")), "SELECT release, namespace, \"foreign\", count(*) AS n FROM placed GROUP BY ALL")
query("defined_in", lambda m: m.placed.select(*KEY, "is_defined_by", "defined_in"), "SELECT release, iri, is_defined_by, defined_in FROM placed")
query("term_kind", lambda m: m.terms.select(*KEY, "kind"), "SELECT release, iri, kind FROM terms")
query("lang_values", lambda m: m.terms.select(*KEY, F.posexplode("labels").alias("at", "v")).select(*KEY, "at", "v.value", "v.lang", "v.source"), "SELECT release, iri, CAST(unnest(range(len(labels))) AS INTEGER) AS at, unnest(labels, recursive := true) FROM terms")
query("build_terms", lambda m: m.local.select(*KEY, "file", "namespace", "local_name", "defined_in", "kind", "deprecated", *(joined(n) for n in ("types", "super_terms", "domain", "range", "replaced_by")), F.size("labels").cast("long").alias("n_labels"), F.size("definitions").cast("long").alias("n_definitions")), "SELECT release, iri, file, namespace, local_name, defined_in, kind, deprecated, " + ", ".join(f"array_to_string({n}, ' ') AS {n}" for n in ("types", "super_terms", "domain", "range", "replaced_by")) + ", len(labels) AS n_labels, len(definitions) AS n_definitions FROM terms WHERE NOT \"foreign\"")
query("property_characteristics", lambda m: m.terms.filter(F.size("characteristics") > 0).select(*KEY, joined("characteristics")), "SELECT release, iri, array_to_string(x, ' ') AS characteristics FROM (SELECT release, iri, list_filter([" + ", ".join(f"CASE WHEN list_contains(types, '{t}') THEN '{n}' END" for t, n in CHARACTERISTICS.items()) + "], lambda v: v IS NOT NULL) AS x FROM terms) WHERE len(x) > 0")
query("mappings", lambda m: m.terms.select(*KEY, F.explode("mappings").alias("m")).select(*KEY, "m.relation", c("m.iri").alias("target")), f"SELECT DISTINCT release, s AS iri, p AS relation, o AS target FROM q JOIN subj ON subj.release = q.release AND subj.iri = q.s WHERE p IN {_sql(MAPPING_RELATIONS)} AND o_kind = 'iri'".replace("DISTINCT release", "DISTINCT q.release"))
query("deprecated_flag", lambda m: m.terms.filter("deprecated").select(*KEY, joined("replaced_by")), "SELECT release, iri, array_to_string(replaced_by, ' ') AS replaced_by FROM terms WHERE deprecated")
_FIXED = [TYPE, RDFS + "isDefinedBy", SKOS + "notation", *MAPPING_RELATIONS, *STRUCTURAL, *(p for ps in TERM_IRIS.values() for p in ps)]
query("residue", lambda m: m.residue.groupBy("release", "p").agg(F.count("*").alias("n"), F.countDistinct("iri").alias("terms")), f"SELECT q.release, q.p, count(*) AS n, count(DISTINCT q.s) AS terms FROM q JOIN tprof t ON t.release = q.release AND t.iri = q.s WHERE q.p NOT IN {_sql(_FIXED)} AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.profile = t.profile AND r.p = q.p AND field NOT LIKE 'document%') GROUP BY ALL")
query("anchor", lambda m: m.terms.select(*KEY, "curie", "anchor"), "SELECT release, iri, prefix || ':' || local_name AS curie, CASE WHEN \"foreign\" THEN coalesce(prefix, 'ext') || '_' || local_name ELSE local_name END AS anchor FROM terms")
query("invert_hierarchy", lambda m: m.children("super_terms").select(*KEY, F.lit("sub").alias("way"), joined("children")).unionByName(m.children("broader").select(*KEY, F.lit("narrower").alias("way"), joined("children"))), "SELECT release, parent AS iri, way, string_agg(iri, ' ' ORDER BY iri) AS children FROM (SELECT release, iri, 'sub' AS way, unnest(super_terms) AS parent FROM terms UNION ALL SELECT release, iri, 'narrower', unnest(broader) FROM terms) x WHERE EXISTS (SELECT 1 FROM subj WHERE subj.release = x.release AND subj.iri = parent) GROUP BY ALL")
query("attach_terms", lambda m: m.terms.groupBy("release", "defined_in").agg(F.count_if(~c("foreign")).alias("local"), F.count_if("foreign").alias("reused")), "SELECT release, defined_in, count(*) FILTER (NOT \"foreign\") AS local, count(*) FILTER (\"foreign\") AS reused FROM placed GROUP BY ALL")
_TAKEN = "(SELECT DISTINCT m.release, m.ns, rtrim(substr(d.iri, length(m.ns) + 1), '/') AS segment FROM minted m JOIN (SELECT release, iri FROM doc UNION SELECT release, version_iri FROM docs WHERE version_iri IS NOT NULL) d ON d.release = m.release AND starts_with(d.iri, m.ns))"
query("reserved_segments", lambda m: m.reserved, f"SELECT * FROM {_TAKEN} WHERE segment <> '' AND NOT contains(segment, '/')")
query("namespace_table", lambda m: m.namespaces.withColumn("reserved", F.array_join("reserved", " ")), f"""SELECT m.release, m.ns, coalesce(declared, {KNOWN.format('m.ns')}) AS prefix, doc.iri AS document, coalesce((SELECT string_agg(segment, ' ' ORDER BY segment) FROM {_TAKEN} t WHERE t.release = m.release AND t.ns = m.ns AND segment <> '' AND NOT contains(segment, '/')), '') AS reserved, (SELECT count(*) FROM placed p WHERE p.release = m.release AND p.namespace = m.ns AND NOT "foreign") AS term_count
  FROM minted m LEFT JOIN pof ON pof.release = m.release AND pof.ns = m.ns LEFT JOIN doc ON doc.release = m.release AND doc.iri = m.ns""")
query("release_stats", lambda m: m.stats, "SELECT release, count(*) FILTER (NOT \"foreign\") AS terms_local, count(*) FILTER (\"foreign\") AS terms_foreign, (SELECT count(*) FROM q WHERE q.release = t.release) AS triples, (SELECT count(DISTINCT file) FROM q WHERE q.release = t.release) AS files, (SELECT count(*) FROM doc WHERE doc.release = t.release) AS documents, (SELECT count(*) FROM minted WHERE minted.release = t.release) AS namespaces FROM placed t GROUP BY release")
query("kind_counts", lambda m: m.local.groupBy("release", "kind").agg(F.count("*").alias("n")), "SELECT release, kind, count(*) AS n FROM terms WHERE NOT \"foreign\" GROUP BY ALL")
query("case_folded_terms", lambda m: case_folds(m.local).select(*KEY, "local_name"), "SELECT release, iri, local_name FROM (SELECT *, row_number() OVER (PARTITION BY release, namespace, lower(local_name) ORDER BY local_name) AS n FROM terms WHERE NOT \"foreign\") WHERE n > 1")
query("document_sections", lambda m: m.local.groupBy("release", "defined_in", "kind").agg(F.count("*").alias("n"), F.min(F.lower(F.coalesce(F.get("labels", 0)["value"], "local_name"))).alias("first")), "SELECT release, defined_in, kind, count(*) AS n, min(lower(coalesce(labels[1].value, local_name))) AS first FROM terms WHERE NOT \"foreign\" GROUP BY ALL")
