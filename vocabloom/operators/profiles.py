"""Profiles: which predicates feed a term's fields, and how a document's profile is found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..vocabulary import ADMS, DCAM, DCTERMS, OWL, RDF, RDFS, SH, SKOS, VANN

_DC11, _VS = "http://purl.org/dc/elements/1.1/", "http://www.w3.org/2003/06/sw-vocab-status/ns#"

# The built-in profiles. Every profile but generic extends generic.
PROFILES: dict[str, dict] = {
    "dcap": {
        "title": "OWL application profile",
        "priority": 30,
        "document_type": [OWL + "Ontology"],
        "file_has_type": [OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty"],
        "label": [RDFS + "label", SKOS + "prefLabel", DCTERMS + "title"],
        "definition": [RDFS + "comment", SKOS + "definition", DCTERMS + "description"],
        "alt_label": [SKOS + "altLabel"],
        "note": [VANN + "usageNote", SKOS + "scopeNote", SKOS + "editorialNote"],
        "example": [VANN + "example", SKOS + "example"],
        "status": [ADMS + "status", _VS + "term_status"],
    },
    "dcmi": {
        "title": "DCMI-style RDFS vocabulary",
        "priority": 20,
        "file_has_type": [RDF + "Property", DCAM + "VocabularyEncodingScheme"],
        "file_has_predicate": [DCAM + "rangeIncludes", DCAM + "domainIncludes", DCAM + "memberOf"],
        "label": [RDFS + "label"],
        "definition": [RDFS + "comment"],
        "comment": [DCTERMS + "description"],
        "note": [DCTERMS + "description"],
    },
    "generic": {
        "title": "Generic RDFS",
        "priority": 0,
        "label": [RDFS + "label", DCTERMS + "title"],
        "definition": [RDFS + "comment", DCTERMS + "description", _DC11 + "description"],
        "document_title": [DCTERMS + "title", RDFS + "label"],
        "document_description": [DCTERMS + "description", _DC11 + "description", RDFS + "comment"],
        "deprecated": [OWL + "deprecated"],
    },
    "shacl": {
        "title": "SHACL shapes",
        "priority": 50,
        "file_has_type": [SH + "NodeShape", SH + "PropertyShape"],
        "label": [RDFS + "label", SH + "name", DCTERMS + "title"],
        "definition": [RDFS + "comment", SH + "description", DCTERMS + "description"],
    },
    "skos": {
        "title": "SKOS concept scheme",
        "priority": 40,
        "document_type": [SKOS + "ConceptScheme"],
        "label": [SKOS + "prefLabel", RDFS + "label"],
        "definition": [SKOS + "definition", RDFS + "comment"],
        "alt_label": [SKOS + "altLabel", SKOS + "hiddenLabel"],
        "note": [SKOS + "scopeNote", SKOS + "historyNote", SKOS + "changeNote", SKOS + "editorialNote"],
        "example": [SKOS + "example"],
    },
}
c = F.col
FIELDS = ("label", "definition", "document_title", "document_description", "comment", "alt_label", "note", "example", "status", "deprecated")


def predicate_rows() -> list[tuple[str, str, str, int]]:
    """(profile, field, predicate, rank): a profile's own predicates, then those of generic that it lacks."""
    out = []
    for name, profile in PROFILES.items():
        for field in FIELDS:
            both = dict.fromkeys(profile.get(field, []) + PROFILES["generic"].get(field, []))
            out += [(name, field, p, i) for i, p in enumerate(both)]
    return out


def predicates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(predicate_rows(), "profile string, field string, predicate string, rank int")


def built_in(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The built-in profiles (profile, extends) and their own fields (profile, field, predicate, rank)."""
    names = [(n, None if n == "generic" else "generic") for n in PROFILES]
    own = [(n, f, x, i) for n, profile in PROFILES.items() for f in FIELDS for i, x in enumerate(profile.get(f, []))]
    return spark.createDataFrame(names, "profile string, extends string"), spark.createDataFrame(own, "profile string, field string, predicate string, rank int")


def resolved(profiles: DataFrame, fields: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(profile, field, predicate, rank, source, depth, error): the fields of profiles with all that they inherit.

    profiles: profile, extends (null at the end of a chain); fields: profile, field, predicate, rank. A profile's own
    predicates come first, then those of the profile that it extends, and so on; a predicate counts where it comes first.
    A chain that comes back to one of its profiles, or that names one that isn't there, makes its profile a row of
    null fields with the error, and no others.
    """
    up = profiles.select(c("profile").alias("source"), "extends", F.lit(True).alias("known"))
    level = profiles.select("profile", c("profile").alias("source"), "extends", F.lit(0).alias("depth"), F.array("profile").alias("seen"), F.lit(None).cast("string").alias("error"))
    level = keep(level, "chain0")
    chains, n = level, 0
    while True:
        n += 1
        more = level.filter("extends is not null and error is null").drop("source").withColumnRenamed("extends", "source")
        error = F.when(F.array_contains("seen", c("source")), F.concat(F.lit("cycle at "), "source")).when(c("known").isNull(), F.concat(F.lit("unknown profile "), "source"))
        stepped = more.join(up, "source", "left").select("profile", "source", "extends", c("depth") + 1, F.concat("seen", F.array("source")), error)
        level = keep(stepped.toDF(*level.columns), f"chain{n}")
        if level.isEmpty():
            break
        chains = chains.unionByName(level)
    faults = chains.filter("error is not null").select("profile", "error")
    sound = chains.join(faults.select("profile"), "profile", "left_anti").select("profile", "source", "depth")
    rows = sound.join(fields.withColumnRenamed("profile", "source"), "source")
    first = rows.groupBy("profile", "field", "predicate").agg(F.min(F.struct("depth", "rank", "source")).alias("x")).select("profile", "field", "predicate", "x.*")
    order = Window.partitionBy("profile", "field").orderBy("depth", "rank", "predicate")
    ranked = first.select("profile", "field", "predicate", (F.row_number().over(order) - 1).alias("rank"), "source", "depth")
    none = F.lit(None)
    failed = faults.select("profile", none.cast("string").alias("field"), none.cast("string").alias("predicate"), none.cast("int").alias("rank"), none.cast("string").alias("source"), none.cast("int").alias("depth"), "error")
    return ranked.withColumn("error", none.cast("string")).unionByName(failed)


def detection(spark: SparkSession) -> DataFrame:
    rows = [(n, p["title"], p["priority"], *(p.get(k, []) for k in ("document_type", "file_has_type", "file_has_predicate"))) for n, p in PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, title string, priority int, document_type array<string>, file_has_type array<string>, file_has_predicate array<string>")


def detect(documents: DataFrame, spark: SparkSession) -> DataFrame:
    """(release, iri, profile) of documents (release, iri, types, file_types, file_predicates): the matching profile of the highest priority, then the last by name."""
    rules = F.broadcast(detection(spark))  # a row for each profile

    def met(wanted: str, present: str):
        return (F.size(wanted) == 0) | F.arrays_overlap(wanted, present)

    matching = documents.join(rules, met("document_type", "types") & met("file_has_type", "file_types") & met("file_has_predicate", "file_predicates"), "left")
    return matching.groupBy("release", "iri").agg(F.coalesce(F.max_by("profile", F.struct("priority", "profile")), F.lit("generic")).alias("profile"))
