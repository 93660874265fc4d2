"""The model of a release: documents, namespaces and terms as DataFrames, from statements and prefix declarations.

Statements have release, file, seq, s, s_kind, p, o, o_kind, lang, dt; prefixes have release, file, prefix, ns. All keys hold
within a release. "First" means the least seq. Blank nodes are scoped by file.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iri as I
from ..functions.text import term_scalar
from ..vocabulary import ADMS, CHARACTERISTICS, DCAM, DCTERMS, FOAF, MAPPING_RELATIONS, OWL, RDF, RDFS, SH, SKOS, TYPE, VANN
from . import profiles

# The order of term kinds, which sections and listings follow.
TERM_KINDS = ["Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "RdfProperty", "Datatype", "EncodingScheme", "Concept", "Collection", "NodeShape", "PropertyShape", "Individual", "Other"]
# Types and the kind that each makes of a term, the strongest first.
KIND_OF_TYPE = [
    (SH + "NodeShape", "NodeShape"),
    (SH + "PropertyShape", "PropertyShape"),
    (SKOS + "Concept", "Concept"),
    (SKOS + "Collection", "Collection"),
    (OWL + "Class", "Class"),
    (RDFS + "Class", "Class"),
    (OWL + "ObjectProperty", "ObjectProperty"),
    (OWL + "DatatypeProperty", "DatatypeProperty"),
    (OWL + "AnnotationProperty", "AnnotationProperty"),
    (RDF + "Property", "RdfProperty"),
    (RDFS + "Datatype", "Datatype"),
    (DCAM + "VocabularyEncodingScheme", "EncodingScheme"),
    (OWL + "NamedIndividual", "Individual"),
]
# Header fields that take the first value of one predicate.
HEADER_SCALARS = {
    "created": DCTERMS + "created",
    "modified": DCTERMS + "modified",
    "issued": DCTERMS + "issued",
    "license": DCTERMS + "license",
    "version_info": OWL + "versionInfo",
    "version_iri": OWL + "versionIRI",
    "prior_version": OWL + "priorVersion",
    "status": ADMS + "status",
    "prefix": VANN + "preferredNamespacePrefix",
    "namespace_uri": VANN + "preferredNamespaceUri",
    "citation": DCTERMS + "bibliographicCitation",
    "identifier": DCTERMS + "identifier",
}
# Header and term fields that are the IRIs of some predicates.
HEADER_IRIS = {"has_part": DCTERMS + "hasPart", "is_part_of": DCTERMS + "isPartOf", "see_also": RDFS + "seeAlso", "imports": OWL + "imports", "source": DCTERMS + "source"}
TERM_IRIS = {
    "super_terms": [RDFS + "subClassOf", RDFS + "subPropertyOf"],
    "equivalent": [OWL + "equivalentClass", OWL + "equivalentProperty"],
    "disjoint_with": [OWL + "disjointWith"],
    "see_also": [RDFS + "seeAlso"],
    "replaced_by": [DCTERMS + "isReplacedBy"],
    "domain": [RDFS + "domain"],
    "range": [RDFS + "range"],
    "domain_includes": [DCAM + "domainIncludes"],
    "range_includes": [DCAM + "rangeIncludes"],
    "inverse_of": [OWL + "inverseOf"],
    "in_scheme": [SKOS + "inScheme"],
    "top_concept_of": [SKOS + "topConceptOf"],
    "broader": [SKOS + "broader"],
    "narrower": [SKOS + "narrower"],
    "related": [SKOS + "related"],
}
#: All fields of a term that are sets of IRIs.
FACT_IRIS = {"types": [TYPE], **TERM_IRIS, "mappings": MAPPING_RELATIONS}
# So many IRIs, a few MB, can be sent to all tasks.
FEW = 20_000
#: Predicates whose statements a term's shape tables show.
STRUCTURAL = [SH + x for x in ("property", "targetClass", "targetSubjectsOf", "targetObjectsOf", "targetNode", "closed")]
KEY = ["release", "iri"]
c = F.col


def iri_set(condition: Column) -> Column:
    """Aggregate: the sorted distinct IRI objects of the statements that meet a condition."""
    return F.array_sort(F.collect_set(F.when(condition & (c("o_kind") == "iri"), c("o"))))


def first_of(condition: Column) -> Column:
    """Aggregate: the first object that meets a condition; null if that one is a blank node."""
    first = F.min_by(F.struct(term_scalar(c("o"), c("o_kind")).alias("v")), F.when(condition, c("seq")))
    return first["v"]


def prefixes_of(namespace: Column) -> Column:
    """The beginnings of an IRI that end with # or /, and are shorter than it."""
    parts = F.split(namespace, "(?<=[#/])")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), ""))
    return F.filter(starts, lambda p: (F.length(p) < F.length(namespace)) & p.rlike("[#/]$"))


def _delimited(namespaces: DataFrame) -> DataFrame:
    return namespaces.filter(c("ns").rlike("[#/]$"))


def _by_length(rows: DataFrame, by: list[str], key: str, namespaces: DataFrame) -> DataFrame:
    """(by, key, ns): pairs with a namespace that ends with neither # nor /, joined on the beginnings of the lengths that such namespaces have."""
    odd = namespaces.filter(~c("ns").rlike("[#/]$"))
    lengths = odd.groupBy(*by).agg(F.collect_set(F.length("ns")).alias("_lengths"))
    cut = rows.select(*by, key).distinct().join(lengths, by).select(*by, key, F.explode("_lengths").alias("_n")).filter(F.length(key) > c("_n"))
    return cut.withColumn("ns", F.left(c(key), c("_n"))).drop("_n").join(odd, [*by, "ns"], "left_semi")


def under(rows: DataFrame, by: list[str], key: str, namespaces: DataFrame) -> DataFrame:
    """(by, key, ns): every pair of an IRI and a namespace (by, ns) that it starts with and is longer than."""
    starts = rows.select(*by, key).distinct().select(*by, key, F.explode(prefixes_of(c(key))).alias("ns"))
    marked = namespaces.select(*by, "ns").distinct()
    return starts.join(_delimited(marked), [*by, "ns"]).unionByName(_by_length(rows, by, key, marked))


def _nearest(rows: DataFrame, by: list[str], namespaces: DataFrame) -> DataFrame:
    """(by, _folder, _near): of the folders of `rows` (by, _folder), the longest namespace (by, ns), ending with # or /, that each is or starts with."""
    folders = rows.select(*by, "_folder").filter("_folder is not null").distinct()
    starts = folders.select(*by, "_folder", F.explode(F.concat(prefixes_of(c("_folder")), F.array("_folder"))).alias("ns"))
    return starts.join(_delimited(namespaces), [*by, "ns"]).groupBy(*by, "_folder").agg(F.max_by("ns", F.length("ns")).alias("_near"))


def with_longest_prefix(rows: DataFrame, by: list[str], key: str, namespaces: DataFrame, out: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """`rows` and, as `out`, the longest of the namespaces (by, ns) that the IRI starts with and is longer than.

    Namespaces that end with # or / depend on an IRI's folder only, so they are found for the few distinct folders, by hash
    join on the folders' own beginnings, and stored: `rows` needn't be dealt out by folder, of which one may hold most of
    them. The others, rare by design, are found by their lengths, if there are any.
    """
    marked = namespaces.select(*by, "ns").distinct()
    rows = rows.withColumn("_folder", I.folder_of(c(key)))
    both = rows.join(keep(_nearest(rows, by, marked), f"folders_{out}"), [*by, "_folder"], "left")
    if marked.filter(~c("ns").rlike("[#/]$")).isEmpty():
        return both.withColumnRenamed("_near", out).drop("_folder")
    odd = _by_length(rows, by, key, marked).groupBy(*by, key).agg(F.max_by("ns", F.length("ns")).alias("_odd"))
    longer = F.when(F.length("_odd") > F.coalesce(F.length("_near"), F.lit(0)), c("_odd")).otherwise(c("_near"))
    return both.join(odd, [*by, key], "left").withColumn(out, longer).drop("_folder", "_near", "_odd")


def large(rows: DataFrame) -> DataFrame:
    """A side of a join that may have a row for each term or statement. Never broadcast: the files of such a table are small for its rows, so their size says little of the memory that it takes."""
    return rows.hint("merge")


class Model:
    """The tables of all releases in `quads`; each is built when first asked for."""

    def __init__(self, quads: DataFrame, prefixes: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> None:
        """quads may have the folder of each named subject as _folder. keep: called with the tables that others build on and their names; it may store them."""
        self.keep = keep
        self.given = quads
        self.raw = quads.drop("_folder")
        self.prefixes = prefixes
        self.spark = quads.sparkSession
        self.made: dict[str, DataFrame] = {}

    # Statements of order lines and the like can be nearly all of a release. What is asked of documents and local terms goes over
    # them as they come, twice, and stores those that it needs; only a query about all statements stores them all.

    @cached_property
    def scoped(self) -> DataFrame:
        """All statements, not stored, with the folder of each named subject; blank nodes are scoped by file."""
        node = lambda name, kind: F.when(c(kind) == "bnode", F.concat_ws("|", "file", name)).otherwise(c(name))
        folder = c("_folder") if "_folder" in self.given.columns else F.when(c("s_kind") == "iri", I.folder_of(c("s")))
        return self.given.withColumns({"s": node("s", "s_kind"), "o": node("o", "o_kind"), "_folder": folder})

    @cached_property
    def stored(self) -> DataFrame:
        """The same, stored."""
        return self.keep(self.scoped, "quads")

    @cached_property
    def quads(self) -> DataFrame:
        return self.stored.drop("_folder")

    @property
    def passing(self) -> DataFrame:
        """All statements for one pass: the stored ones if there are, else as they come."""
        return self.__dict__.get("stored", self.scoped)

    @cached_property
    def outline(self) -> DataFrame:
        """(release, file, s_kind, folder of the subject if named, p, type, document, declared): what statements are like, each once; type is the object of a type, document a subject that is one, declared a namespace. Made in one pass over all."""
        typed = (c("p") == TYPE) & (c("o_kind") == "iri")
        document = typed & (c("s_kind") == "iri") & c("o").isin(OWL + "Ontology", SKOS + "ConceptScheme")
        rows = self.passing.select(
            "release",
            "file",
            "s_kind",
            "_folder",
            "p",
            F.when(typed, c("o")).alias("type"),
            F.when(document, c("s")).alias("document"),
            F.when(c("p") == VANN + "preferredNamespaceUri", term_scalar(c("o"), c("o_kind"))).alias("declared"),
        )
        return self.keep(rows.distinct(), "outline")

    # lookups

    @cached_property
    def named(self) -> DataFrame:
        """Statements of subjects that aren't blank."""
        return self.quads.filter("s_kind = 'iri'")

    @cached_property
    def types(self) -> DataFrame:
        return self.quads.filter((c("p") == TYPE) & (c("o_kind") == "iri")).groupBy("release", c("s").alias("iri")).agg(F.sort_array(F.collect_set("o")).alias("types"))

    @cached_property
    def file_of(self) -> DataFrame:
        """The first file, by name, that mentions each subject."""
        return self.mentions.select(*KEY, "file")

    @cached_property
    def mentions(self) -> DataFrame:
        """(release, iri, file, s_kind) of each subject."""
        return self.keep(self.quads.groupBy("release", c("s").alias("iri")).agg(F.min("file").alias("file"), F.min("s_kind").alias("s_kind")), "mentions")

    @cached_property
    def prefix_map(self) -> DataFrame:
        """Each prefix as the first file declares it."""
        return self.keep(self.prefixes.groupBy("release", "prefix").agg(F.min_by("ns", "file").alias("ns")), "prefix_map")

    @cached_property
    def prefix_of(self) -> DataFrame:
        """The first prefix by name of each declared namespace."""
        return self.prefix_map.groupBy("release", "ns").agg(F.min("prefix").alias("declared"))

    @cached_property
    def file_namespaces(self) -> DataFrame:
        """(release, file, ns, datatype): the namespaces of each file's subjects, predicates and IRI objects, and, marked, of its datatypes."""
        own = F.when((c("s_kind") == "iri") & ~c("s").endswith("#") & ~c("s").endswith("/"), c("_folder"))
        few = self.stored.select("release", "file", "p", "dt", own.alias("s"), F.when(c("o_kind") == "iri", I.namespace_part(c("o"))).alias("o")).distinct()
        used = [(c("s"), False), (I.namespace_part(c("p")), False), (c("o"), False), (I.namespace_part(c("dt")), True)]
        each = F.array(*(F.struct(ns.alias("ns"), F.lit(datatype).alias("datatype")) for ns, datatype in used))
        return self.keep(few.select("release", "file", F.explode(each).alias("x")).select("release", "file", "x.ns", "x.datatype").filter("ns is not null").distinct(), "file_namespaces")

    @cached_property
    def used_namespaces(self) -> DataFrame:
        return self.file_namespaces.select("release", "ns").distinct()

    # documents

    @cached_property
    def document_set(self) -> DataFrame:
        return self.keep(self.outline.select("release", c("document").alias("iri")).dropna().distinct(), "document_set")

    @cached_property
    def minted(self) -> DataFrame:
        """Namespaces that a release makes terms in."""
        declared = self.outline.select("release", c("declared").alias("ns")).dropna()
        return self.keep(self.document_set.filter(c("iri").rlike("[#/]$")).select("release", c("iri").alias("ns")).union(declared).distinct(), "minted")

    @cached_property
    def file_signals(self) -> DataFrame:
        of_file = lambda rows, x, out: rows.select("release", "file", x).distinct().groupBy("release", "file").agg(F.sort_array(F.collect_set(x)).alias(out))
        types = of_file(self.outline.filter("type is not null"), "type", "file_types")
        none = F.array().cast("array<string>")
        return of_file(self.outline, "p", "file_predicates").join(types, ["release", "file"], "left").select("release", "file", F.coalesce("file_types", none).alias("file_types"), "file_predicates")

    @cached_property
    def document_profiles(self) -> DataFrame:
        is_type = (c("p") == TYPE) & (c("o_kind") == "iri")
        types = self.about_documents.groupBy("release", c("s").alias("iri")).agg(F.min("file").alias("file"), F.sort_array(F.collect_set(F.when(is_type, c("o")))).alias("types"))
        found = self.keep(types.join(self.file_signals, ["release", "file"]), "document_signals")
        chosen = profiles.detect(found, self.spark)
        kind = F.when(c("profile") == "shacl", "Shapes").when(F.array_contains("types", SKOS + "ConceptScheme"), "Scheme").when(F.array_contains("types", OWL + "Ontology"), "Ontology").otherwise("Document")
        return self.keep(found.select(*KEY, "file", "types").join(chosen, KEY).withColumn("kind", kind), "document_profiles")

    def lang_values(self, subjects: DataFrame, fields: list[str], statements: DataFrame) -> DataFrame:
        """For subjects (release, iri, profile) of statements, a column for each field: its literals by rank of predicate, then as listed."""
        wanted = F.broadcast(profiles.predicates(self.spark).filter(c("field").isin(fields)))  # the profiles' rows
        known = sorted({p for _, field, p, _ in profiles.predicate_rows() if field in fields})
        literals = statements.filter((c("s_kind") == "iri") & (c("o_kind") == "literal") & c("p").isin(known)).select("release", c("s").alias("iri"), c("p").alias("predicate"), "seq", c("o").alias("value"), "lang")
        found = literals.join(large(subjects.select(*KEY, "profile")), KEY).join(wanted, ["profile", "predicate"])
        value = F.struct("rank", "seq", "value", "lang", c("predicate").alias("source"))
        plain = F.transform(F.sort_array(F.collect_list(value)), lambda v: F.struct(v["value"].alias("value"), v["lang"].alias("lang"), v["source"].alias("source")))
        each = found.groupBy(*KEY, "field").agg(plain.alias("values")).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("of"))
        none = F.array().cast("array<struct<value:string,lang:string,source:string>>")
        return each.select(*KEY, *(F.coalesce(c("of")[f], none).alias(f) for f in fields))

    @cached_property
    def documents(self) -> DataFrame:
        docs = self.document_profiles
        about = self.about_documents.filter("s_kind = 'iri'").withColumnRenamed("s", "iri").join(docs.select(*KEY), KEY)
        scalars = [first_of(c("p") == p).alias(n) for n, p in HEADER_SCALARS.items()]
        sets = [iri_set(c("p") == p).alias(n) for n, p in HEADER_IRIS.items()]
        header = about.groupBy(*KEY).agg(*scalars, *sets)
        texts = self.lang_values(docs, ["document_title", "document_description"], about.withColumnRenamed("iri", "s"))
        none = lambda n: F.coalesce(n, F.array().cast(texts.schema[n].dataType))
        whole = docs.join(header, KEY).join(texts, KEY, "left")
        return self.keep(whole.select(*KEY, "file", "types", "profile", c("kind").alias("document_kind"), *HEADER_SCALARS, *HEADER_IRIS, none("document_title").alias("title"), none("document_description").alias("description")), "documents")

    @cached_property
    def root(self) -> DataFrame:
        """Of each release, the document that no other has as a part: ontologies first, then schemes, shapes and others, by IRI."""
        parts = self.documents.select("release", F.explode("has_part").alias("iri"))
        rank = F.array_position(F.array(*map(F.lit, ("Ontology", "Scheme", "Shapes", "Document"))), c("document_kind"))
        return self.documents.join(parts, KEY, "left_anti").groupBy("release").agg(F.min_by("iri", F.struct(rank, c("iri"))).alias("root"))

    def agents(self, predicate: str) -> DataFrame:
        """(release, iri, seq, agent, name, kind): who a predicate names; a name is a foaf:name, else an rdfs:label."""
        named = self.quads.filter((c("p") == predicate)).join(self.document_set.withColumnRenamed("iri", "s"), ["release", "s"])
        facts = self.quads.filter(c("p").isin(FOAF + "name", RDFS + "label", TYPE)).join(named.select("release", c("o").alias("s")).distinct(), ["release", "s"], "left_semi").groupBy("release", c("s").alias("o")).agg(first_of(c("p") == FOAF + "name").alias("foaf"), first_of(c("p") == RDFS + "label").alias("label"), F.min(F.when((c("p") == TYPE) & (c("o_kind") == "iri"), c("o"))).alias("kind"))
        literal = c("o_kind") == "literal"
        joined = named.select("release", c("s").alias("iri"), "seq", "o", "o_kind").join(facts, ["release", "o"], "left")
        return joined.select(*KEY, "seq", F.when(c("o_kind") == "iri", c("o")).alias("agent"), F.when(literal, c("o")).otherwise(F.coalesce("foaf", "label")).alias("name"), F.when(~literal, c("kind")).alias("kind"))

    # terms

    # Most subjects of a release can be things that its statements are about, in no namespace that it makes terms in. So
    # the statements of local terms are told apart by folder first, and what is asked of local terms reads only these.

    @cached_property
    def subjects(self) -> DataFrame:
        """(release, iri, file) of named subjects that aren't documents."""
        return self.placed.select(*KEY, "file")

    @cached_property
    def local_folders(self) -> DataFrame:
        """(release, _folder, _near): folders in a minted namespace that ends with # or /, and the longest such."""
        return self.keep(_nearest(self.outline, ["release"], self.minted), "local_folders")

    @cached_property
    def _odd_releases(self) -> DataFrame:
        return self.minted.filter(~c("ns").rlike("[#/]$")).select("release").distinct()

    @cached_property
    def picked(self) -> DataFrame:
        """Statements that may be of local terms (_local), those of documents (_about) and those that shapes are made of (_shape), told apart in one pass over all."""
        mark = lambda rows, name: rows.withColumn(name, F.lit(True))
        folder, none = F.coalesce("_folder", F.lit("")).alias("_folder"), F.lit(False)
        # Folders are few: first only statements in a folder that has some, told by the outline, are taken on.
        shape = c("p").startswith(SH) | c("p").isin(RDF + "first", RDF + "rest")
        documents = self.document_set.select("release", F.coalesce(I.folder_of(c("iri")), F.lit("")).alias("_folder"))
        local = self.local_folders.select("release", "_folder").unionByName(self.outline.filter("s_kind = 'iri'").select("release", folder).join(self._odd_releases, "release"))
        folders = local.withColumn("_in", F.lit(True)).unionByName(documents.unionByName(self.outline.filter(shape).select("release", folder)).withColumn("_in", none))
        folders = self.keep(folders.groupBy("release", "_folder").agg(F.bool_or("_in").alias("_in")), "picked_folders")
        near = self.passing.withColumn("_folder", folder).join(folders.select("release", "_folder"), ["release", "_folder"], "left_semi")
        marked = near.join(folders, ["release", "_folder"]).join(mark(self.document_set.withColumnRenamed("iri", "s"), "_about"), ["release", "s"], "left")
        marked = marked.select(*self.raw.columns, ((c("s_kind") == "iri") & c("_in")).alias("_local"), c("_about").isNotNull().alias("_about"), shape.alias("_shape"))
        return self.keep(marked.filter("_local or _about or _shape"), "picked")

    def _picked(self, mark: str) -> DataFrame:
        return self.picked.filter(mark).select(self.raw.columns)

    @cached_property
    def shape_statements(self) -> DataFrame:
        """Statements with a predicate of SHACL or of lists. Shapes are put together from many joins of these, so they are stored apart."""
        return self.keep(self._picked("_shape"), "shape_statements")

    @cached_property
    def about_documents(self) -> DataFrame:
        """Statements of documents."""
        return self._picked("_about")

    @cached_property
    def near_statements(self) -> DataFrame:
        """Statements of all local terms: those of subjects in a folder of a minted namespace, and all named ones of a release that mints a namespace without # or / at its end."""
        return self._picked("_local")

    @cached_property
    def far_statements(self) -> DataFrame:
        """The other statements of named subjects; their terms are all foreign."""
        return self._far.drop("_folder")

    @cached_property
    def _far(self) -> DataFrame:
        return self.stored.filter("s_kind = 'iri'").join(self.local_folders, ["release", "_folder"], "left_anti").join(self._odd_releases, "release", "left_anti")

    @cached_property
    def defining(self) -> DataFrame:
        """(release, iri): documents that a term is defined in.

        Foreign terms of a folder are all defined in one document, if the folder's statements are in one file and link none of
        them to a document, and no document of the release ends with neither # nor /. One term then stands for its folder.
        """
        far = self._far.join(self.document_set.withColumnRenamed("iri", "s"), ["release", "s"], "left_anti")
        one, linked = F.xxhash64("s"), c("p").isin(RDFS + "isDefinedBy", SKOS + "inScheme")
        folders = far.groupBy("release", "_folder", "file").agg(F.min(one).alias("_one"), F.bool_or(linked).alias("_linked"))
        folders = self.keep(folders.groupBy("release", "_folder").agg(F.min("_one").alias("_one"), (F.bool_or("_linked") | (F.count("*") > 1)).alias("_each")), "far_folders")
        odd = self.document_set.filter(~c("iri").rlike("[#/]$")).select("release", F.lit(True).alias("_odd")).distinct()
        some = far.join(folders, ["release", "_folder"], "left").join(odd, "release", "left").filter("_one is null or _each or _odd or xxhash64(s) = _one")
        some = self.keep(some.select(self.quads.columns), "some_statements")
        return self.near_placed.unionByName(self._placed(some, "some", False)).select("release", c("defined_in").alias("iri")).dropna().distinct()

    @cached_property
    def near_placed(self) -> DataFrame:
        return self._placed(self.near_statements, "near", True)

    @property
    def local_placed(self) -> DataFrame:
        """Local terms as far as `placed` goes: what is asked of their names needs none of their facts."""
        return self.near_placed.filter("not foreign")

    @cached_property
    def far_placed(self) -> DataFrame:
        return self._placed(self.far_statements, "far", False)

    @cached_property
    def placed(self) -> DataFrame:
        """Terms with namespace, local name, file and the document that defines each."""
        return self.near_placed.unionByName(self.far_placed)

    def _placed(self, statements: DataFrame, side: str, near: bool) -> DataFrame:
        docs = self.document_profiles.select("release", c("iri").alias("doc"), c("file").alias("doc_file"))
        known = docs.select("release", c("doc").alias("o"), F.lit(True).alias("_doc"))
        link = lambda p: F.min(F.when((c("p") == p) & (c("o_kind") == "iri") & c("_doc"), c("o")))
        subjects = statements.join(known, ["release", "o"], "left").groupBy("release", c("s").alias("iri")).agg(F.min("file").alias("file"), link(RDFS + "isDefinedBy").alias("is_defined_by"), link(SKOS + "inScheme").alias("scheme"))
        subjects = self.keep(subjects.join(self.document_set, KEY, "left_anti"), f"{side}_subjects")
        in_file = docs.groupBy("release", c("doc_file").alias("file")).agg(F.when(F.count("*") == 1, F.min("doc")).alias("lone"), F.count("*").alias("n_docs"))
        terms = subjects.join(in_file, ["release", "file"], "left")
        terms = with_longest_prefix(terms, ["release"], "iri", self.minted, "ns", self.keep) if near else terms.withColumn("ns", F.lit(None).cast("string"))
        terms = with_longest_prefix(terms, ["release", "file"], "iri", docs.select("release", c("doc_file").alias("file"), c("doc").alias("ns")), "in_file", self.keep)
        terms = with_longest_prefix(terms, ["release"], "iri", docs.select("release", c("doc").alias("ns")), "nearest", self.keep)
        namespace = F.coalesce("ns", I.namespace_part(c("iri")), "iri")
        tail = F.substr(c("iri"), F.length(namespace) + 1)
        found = terms.select(
            *KEY,
            "file",
            namespace.alias("namespace"),
            tail.alias("local_name"),
            c("ns").isNull().alias("foreign"),
            "is_defined_by",
            F.coalesce("is_defined_by", "scheme", "lone", "in_file", "nearest").alias("defined_in"),
        )
        return self.keep(found, f"{side}_placed")

    @cached_property
    def near_terms(self) -> DataFrame:
        return self._terms(self.near_placed, self.near_statements, "near")

    @cached_property
    def terms(self) -> DataFrame:
        return self.near_terms.unionByName(self._terms(self.far_placed, self.far_statements, "far"))

    def terms_named(self, names: DataFrame) -> DataFrame:
        """The terms whose local name is one of names (release, local_name). The local name of a foreign term is the last part of its IRI."""
        some = self.far_statements.withColumn("local_name", I.local_part(c("s"))).join(names, ["release", "local_name"], "left_semi").drop("local_name")
        some = self.keep(some, "named_statements")
        near = self.near_terms.join(names, ["release", "local_name"], "left_semi")
        return near.unionByName(self._terms(self._placed(some, "named", False), some, "named"))

    def terms_among(self, iris: DataFrame) -> DataFrame:
        """All local terms, and of the foreign ones at least those of iris (release, iri). Their statements are found by folder first, of which there are few."""
        if "terms" in self.__dict__:
            return self.terms
        folder = F.coalesce("_folder", F.lit("")).alias("_folder")
        asked = self.keep(iris.select(*KEY).distinct(), "asked")
        folders = self.keep(asked.withColumn("_folder", I.folder_of(c("iri"))).select("release", folder).distinct(), "asked_folders")
        some = self._far.withColumn("_folder", folder).join(folders, ["release", "_folder"], "left_semi").drop("_folder")
        some = self.keep(some.join(large(asked.withColumnRenamed("iri", "s")), ["release", "s"], "left_semi").select(self.quads.columns), "asked_statements")
        return self.near_terms.unionByName(self._terms(self._placed(some, "asked", False), some, "asked"))

    def terms_of(self, iris: DataFrame) -> DataFrame:
        """The terms that are among iris (release, iri), local and foreign, made from their own statements alone.

        All statements are gone over for foreign ones only if the outline has a folder of theirs.
        """
        if "terms" in self.__dict__:
            return self.terms.join(large(iris.select(*KEY).distinct()), KEY, "left_semi").select(self.terms.columns)
        folder = F.coalesce("_folder", F.lit("")).alias("_folder")
        asked = self.keep(iris.select(*KEY).distinct(), "asked_of")
        names = asked.withColumnRenamed("iri", "s")
        names = F.broadcast(names) if names.count() <= FEW else large(names)
        near = self.keep(self.near_statements.join(names, ["release", "s"], "left_semi").select(self.raw.columns), "near_of")
        found = self._terms(self._placed(near, "near_of", True), near, "near_of")
        folders = self.outline.filter("s_kind = 'iri'").select("release", folder).distinct()
        folders = folders.join(self.local_folders, ["release", "_folder"], "left_anti").join(self._odd_releases, "release", "left_anti")
        folders = self.keep(folders.join(asked.withColumn("_folder", I.folder_of(c("iri"))).select("release", folder).distinct(), ["release", "_folder"], "left_semi"), "far_folders_of")
        if folders.isEmpty():
            return found
        far = self.passing.filter("s_kind = 'iri'").withColumn("_folder", folder).join(folders, ["release", "_folder"], "left_semi")
        far = self.keep(far.join(names, ["release", "s"], "left_semi").select(self.raw.columns), "far_of")
        return found.unionByName(self._terms(self._placed(far, "far_of", False), far, "far_of"))

    def _terms(self, placed: DataFrame, statements: DataFrame, side: str) -> DataFrame:
        docs = self.document_profiles.select("release", c("iri").alias("defined_in"), "profile")
        placed = placed.join(docs, ["release", "defined_in"], "left").withColumn("profile", F.coalesce("profile", F.lit("generic")))
        # Sets are made for each field of a subject first, and read from a map of its fields then: a filter of all links for each field would be run for each term.
        relation = {p: p for p in MAPPING_RELATIONS}
        field = {SKOS + "notation": "notation", OWL + "deprecated": "deprecated", TYPE: "types", **{p: f for f, ps in TERM_IRIS.items() for p in ps}, **relation}
        field_of = F.create_map(*(F.lit(x) for pair in field.items() for x in pair))
        link = (c("o_kind") == "iri") & ~c("field").isin("notation", "deprecated")
        first = lambda f: F.max(F.when(c("field") == f, c("first"))).alias(f)
        found = statements.filter(c("p").isin(list(field))).select("release", c("s").alias("iri"), field_of[c("p")].alias("field"), "seq", "o", "o_kind").repartition(*KEY)
        found = found.groupBy(*KEY, "field").agg(F.sort_array(F.collect_set(F.when(link, c("o")))).alias("iris"), first_of(c("field").isin("notation", "deprecated")).alias("first"))
        facts = found.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("field", "iris"))).alias("links"), first("notation"), F.coalesce(F.max(F.when(c("field") == "deprecated", c("first"))) == "true", F.lit(False)).alias("deprecated"))
        none = F.array().cast("array<string>")
        sets = [F.coalesce(c("links")[n], none).alias(n) for n in ("types", *TERM_IRIS)]
        pairs = lambda p: F.transform(c("links")[p], lambda x: F.struct(F.lit(p).alias("relation"), x.alias("iri")))
        no_pairs = F.array().cast("array<struct<relation:string,iri:string>>")
        mappings = F.concat(*(F.coalesce(pairs(p), no_pairs) for p in MAPPING_RELATIONS)).alias("mappings")
        fields = ["label", "definition", "alt_label", "comment", "note", "example"]
        texts = self.lang_values(placed, fields, statements)
        empty = lambda n: F.coalesce(n, F.array().cast(texts.schema[n].dataType)).alias(f"{n}s")
        kind = F.coalesce(*(F.when(F.array_contains("types", t), k) for t, k in KIND_OF_TYPE), F.when((F.size("domain") > 0) | (F.size("range") > 0), "RdfProperty"), F.when(F.size("types") == 0, "Other"), F.lit("Individual"))
        facts = placed.join(large(facts), KEY, "left").select(*placed.columns, *sets, mappings, "notation", F.coalesce("deprecated", F.lit(False)).alias("deprecated"))
        whole = facts.join(large(texts), KEY, "left").join(self.prefix_of.withColumnRenamed("ns", "namespace"), ["release", "namespace"], "left")
        prefix = F.coalesce("declared", I.well_known(c("namespace")))
        traits = F.filter(F.array(*(F.when(F.array_contains("types", t), n) for t, n in CHARACTERISTICS.items())), lambda x: x.isNotNull())
        made = whole.select(
            *placed.columns,
            kind.alias("kind"),
            "types",
            *TERM_IRIS,
            "mappings",
            "notation",
            "deprecated",
            traits.alias("characteristics"),
            *(empty(f) for f in fields),
            F.concat(prefix, F.lit(":"), "local_name").alias("curie"),
            F.when(c("foreign"), F.concat(F.coalesce(prefix, F.lit("ext")), F.lit("_"), "local_name")).otherwise(c("local_name")).alias("anchor"),
        )
        return self.keep(made, f"{side}_terms")

    @cached_property
    def local(self) -> DataFrame:
        return self.near_terms.filter("not foreign")

    @cached_property
    def stats(self) -> DataFrame:
        """(release, terms_local, terms_foreign, triples, files, documents, namespaces)."""
        terms = self.placed.groupBy("release").agg(F.count_if(~c("foreign")).alias("terms_local"), F.count_if("foreign").alias("terms_foreign"))
        files = self.quads.groupBy("release", "file").agg(F.count("*").alias("n")).groupBy("release").agg(F.sum("n").alias("triples"), F.count("*").alias("files"))
        documents = self.document_set.groupBy("release").agg(F.count("*").alias("documents"))
        namespaces = self.minted.groupBy("release").agg(F.count("*").alias("namespaces"))
        whole = files.join(terms, "release", "left").join(documents, "release", "left").join(namespaces, "release", "left")
        return whole.select("release", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("terms_local", "terms_foreign", "triples", "files", "documents", "namespaces")))

    def children(self, up: str) -> DataFrame:
        """(release, iri, children): a hierarchy turned over, for parents that are terms."""
        edges = self.terms.select("release", F.explode(up).alias("parent"), "iri")
        return edges.join(large(self.subjects.select("release", c("iri").alias("parent"))), ["release", "parent"], "left_semi").groupBy("release", c("parent").alias("iri")).agg(F.array_sort(F.collect_set(edges["iri"])).alias("children"))

    @cached_property
    def residue(self) -> DataFrame:
        """Statements of terms whose predicate no field shows."""
        fixed = [TYPE, RDFS + "isDefinedBy", SKOS + "notation", *MAPPING_RELATIONS, *STRUCTURAL, *(p for ps in TERM_IRIS.values() for p in ps)]
        shown = F.broadcast(profiles.predicates(self.spark).filter(c("field").isin("label", "alt_label", "definition", "comment", "note", "example", "deprecated", "status")).select("profile", c("predicate").alias("p")).distinct())
        about = self.named.withColumnRenamed("s", "iri").filter(~c("p").isin(fixed)).join(large(self.terms.select(*KEY, "profile")), KEY)
        return about.join(shown, ["profile", "p"], "left_anti").select(*KEY, "seq", "p", "o")

    @cached_property
    def reserved(self) -> DataFrame:
        """(release, ns, segment): single segments under a namespace that documents and versions take."""
        taken = self.document_set.unionByName(self.documents.filter("version_iri is not null").select("release", c("version_iri").alias("iri")))
        tail = F.regexp_replace(F.substr(c("iri"), F.length("ns") + 1), "/+$", "")
        return under(taken, ["release"], "iri", self.minted).select("release", "ns", tail.alias("segment")).filter((c("segment") != "") & ~c("segment").contains("/")).distinct()

    @cached_property
    def namespaces(self) -> DataFrame:
        count = self.local_placed.groupBy("release", c("namespace").alias("ns")).count()
        segments = self.reserved.groupBy("release", "ns").agg(F.array_sort(F.collect_set("segment")).alias("reserved"))
        own = self.document_set.select("release", c("iri").alias("ns"), c("iri").alias("document"))
        whole = self.minted.join(self.prefix_of, ["release", "ns"], "left").join(own, ["release", "ns"], "left").join(segments, ["release", "ns"], "left").join(count, ["release", "ns"], "left")
        return whole.select("release", "ns", F.coalesce("declared", I.well_known(c("ns"))).alias("prefix"), "document", F.coalesce("reserved", F.array().cast("array<string>")).alias("reserved"), F.coalesce("count", F.lit(0)).alias("term_count"))


def case_folds(terms: DataFrame) -> DataFrame:
    """Local terms whose names differ from an earlier one, in byte order, by case only."""
    order = Window.partitionBy("release", "namespace", F.lower("local_name")).orderBy("local_name")
    return terms.withColumn("_n", F.row_number().over(order)).filter("_n > 1").drop("_n")
