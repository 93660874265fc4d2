"""Lint rules over a model. Each returns findings: release, subject; `findings` adds rule and severity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import DCTERMS
from .model import KEY, Model, case_folds, large

# Number words that a description may give, and vocabularies it may name with their namespaces.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
NAMED_VOCABULARIES = {"DOAP": "http://usefulinc.com/ns/doap#", "ADMS": "http://www.w3.org/ns/adms#", "DCAT": "http://www.w3.org/ns/dcat#", "PROV": "http://www.w3.org/ns/prov#"}
# Header fields that a root document should have, and how serious it is if one is missing.
HEADER_FIELDS = {"title": "warning", "description": "warning", "license": "warning", "created": "info", "modified": "info", "issued": "info", "version_info": "info", "version_iri": "info", "status": "info", "prefix": "info", "namespace_uri": "info", "citation": "info", "identifier": "info"}
HEADER_AGENTS = {"creators": DCTERMS + "creator", "contributors": DCTERMS + "contributor"}
c = F.col


def _subjects(rows: DataFrame) -> DataFrame:
    return rows.select("release", c("iri").alias("subject"))


def no_document(m: Model) -> DataFrame:
    return m.quads.select("release").distinct().join(m.document_set, "release", "left_anti").withColumn("subject", F.lit(None).cast("string"))


def prefix_unused(m: Model) -> DataFrame:
    return m.prefixes.join(m.used_namespaces, ["release", "ns"], "left_anti").select("release", F.concat_ws(" ", "file", "prefix").alias("subject"))


def prefix_undeclared(m: Model) -> DataFrame:
    """Namespaces that a file with prefixes uses and others declare; the last prefix by name stands for a namespace."""
    here = m.file_namespaces.filter("not datatype").join(m.prefixes.select("release", "file").distinct(), ["release", "file"], "left_semi").select("release", "file", "ns")
    names = m.prefix_map.groupBy("release", "ns").agg(F.max("prefix").alias("prefix"))
    return here.join(names, ["release", "ns"]).join(m.prefixes.select("release", "file", "prefix"), ["release", "file", "prefix"], "left_anti").select("release", F.concat_ws(" ", "file", "ns").alias("subject"))


def empty_document(m: Model) -> DataFrame:
    return _subjects(m.documents.filter("document_kind = 'Ontology'").join(large(m.defining), KEY, "left_anti"))


def _met(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(release, subject, rule): a row for each condition that a row meets, in one pass."""
    hits = F.array_compact(F.array(*(F.when(x, F.lit(rule)) for rule, x in conditions.items())))
    return rows.select("release", c("iri").alias("subject"), F.explode(hits).alias("rule"))


#: Conditions on local terms, and on documents that aren't the root (with the root's parts as root_parts).
TERM_CONDITIONS: dict[str, Callable[[], Column]] = {
    "term.no-label": lambda: F.size("labels") == 0,
    "term.no-definition": lambda: F.size("definitions") == 0,
    "term.no-is-defined-by": lambda: c("is_defined_by").isNull(),
    "term.deprecated-without-replacement": lambda: c("deprecated") & (F.size("replaced_by") == 0),
    "term.untagged-literal": lambda: F.exists(F.concat("labels", "definitions"), lambda v: v["lang"].isNull()),
}
PART_CONDITIONS: dict[str, Callable[[], Column]] = {
    "release.has-part-missing": lambda: ~F.array_contains("root_parts", c("iri")),
    "release.part-no-is-part-of": lambda: F.size("is_part_of") == 0,
    "release.part-no-version-iri": lambda: c("version_iri").isNull(),
    "release.part-no-status": lambda: c("status").isNull(),
}


def term_findings(m: Model, rules: list[str]) -> DataFrame:
    return _met(m.local, {r: TERM_CONDITIONS[r]() for r in rules})


def part_findings(m: Model, rules: list[str]) -> DataFrame:
    root = m.documents.join(m.root.withColumnRenamed("root", "iri"), KEY).select("release", c("iri").alias("root"), c("has_part").alias("root_parts"))
    return _met(m.documents.join(root, "release").filter("iri <> root"), {r: PART_CONDITIONS[r]() for r in rules})


def header_missing(m: Model) -> DataFrame:
    """Fields of the root document that have no value; a prior version is only missed where there is a version."""
    root = m.documents.join(m.root.withColumnRenamed("root", "iri"), KEY)
    named = m.named.filter(c("p").isin(list(HEADER_AGENTS.values()))).groupBy("release", c("s").alias("iri")).agg(*(F.count_if(c("p") == p).alias(f) for f, p in HEADER_AGENTS.items()))
    root = root.join(named, KEY, "left")
    lists = ("title", "description")
    gone = [F.when((F.size(f) == 0) if f in lists else c(f).isNull(), F.lit(f)) for f in HEADER_FIELDS]
    gone += [F.when(F.coalesce(f, F.lit(0)) == 0, F.lit(f)) for f in HEADER_AGENTS]
    gone.append(F.when(c("prior_version").isNull() & c("version_info").isNotNull(), F.lit("prior_version")))
    return root.select("release", F.explode(F.array_compact(F.array(*gone))).alias("subject"))


def duplicate_label(m: Model) -> DataFrame:
    labels = m.local.select(*KEY, F.explode("labels").alias("v")).select("release", F.lower("v.value").alias("subject"))
    return labels.groupBy("release", "subject").count().filter("count > 1").drop("count")


def reserved_path(m: Model) -> DataFrame:
    return _subjects(m.local.join(m.reserved, (m.local["release"] == m.reserved["release"]) & (m.local["namespace"] == m.reserved["ns"]) & (m.local["local_name"] == m.reserved["segment"]), "left_semi"))


def _root_text(m: Model) -> DataFrame:
    root = m.documents.join(m.root.withColumnRenamed("root", "iri"), KEY)
    return root.select("release", F.array_join(F.transform("description", lambda v: v["value"]), " ").alias("text"))


def count_mismatch(m: Model) -> DataFrame:
    """Number words before "classes" that aren't the number of classes."""
    classes = m.local.groupBy("release").agg(F.count_if(c("kind") == "Class").alias("n"))
    said = F.array_compact(F.array(*(F.when(F.lower("text").contains(f"{w} classes"), F.struct(F.lit(w).alias("word"), F.lit(i + 1).alias("said"))) for i, w in enumerate(NUMBER_WORDS))))
    return _root_text(m).join(classes, "release").select("release", "n", F.explode(said).alias("x")).filter("x.said <> n").select("release", c("x.word").alias("subject"))


def absent_vocabulary(m: Model) -> DataFrame:
    named = F.array_compact(F.array(*(F.when(c("text").contains(k), F.struct(F.lit(k).alias("name"), F.lit(ns).alias("ns"))) for k, ns in NAMED_VOCABULARIES.items())))
    return _root_text(m).select("release", F.explode(named).alias("x")).select("release", "x.name", "x.ns").join(m.prefix_map, ["release", "ns"], "left_anti").select("release", c("name").alias("subject"))


# The rules and how serious each is.
SEVERITY = {
    "release.no-document": "error",
    "release.prefix-unused": "warning",
    "release.prefix-undeclared": "warning",
    "release.has-part-missing": "warning",
    "release.part-no-is-part-of": "warning",
    "release.part-no-version-iri": "warning",
    "release.part-no-status": "warning",
    "release.empty-document": "info",
    "header.missing": "warning",
    "term.no-label": "error",
    "term.no-definition": "error",
    "term.no-is-defined-by": "warning",
    "term.deprecated-without-replacement": "warning",
    "term.duplicate-label": "warning",
    "term.untagged-literal": "info",
    "site.reserved-path-collision": "error",
    "site.case-collision": "warning",
    "text.count-mismatch": "warning",
    "text.mentions-absent-vocab": "warning",
}
#: Rules with a query of their own; the others are conditions.
SINGLE: dict[str, Callable[[Model], DataFrame]] = {
    "release.no-document": no_document,
    "release.prefix-unused": prefix_unused,
    "release.prefix-undeclared": prefix_undeclared,
    "release.empty-document": empty_document,
    "header.missing": header_missing,
    "term.duplicate-label": duplicate_label,
    "site.reserved-path-collision": reserved_path,
    "site.case-collision": lambda m: _subjects(case_folds(m.local)),
    "text.count-mismatch": count_mismatch,
    "text.mentions-absent-vocab": absent_vocabulary,
}


def findings(m: Model, select: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """(release, subject, rule, severity) of all rules whose id starts with a selected beginning (any, if none is given) and with no ignored one.

    Terms and documents are read once for all the conditions on them.
    """
    chosen = [r for r in SEVERITY if (not select or r.startswith(select)) and not (ignore and r.startswith(ignore))]
    parts = [SINGLE[r](m).withColumn("rule", F.lit(r)) for r in chosen if r in SINGLE]
    for conditions, family in ((TERM_CONDITIONS, term_findings), (PART_CONDITIONS, part_findings)):
        own = [r for r in chosen if r in conditions]
        parts += [family(m, own)] if own else []
    severity = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return reduce(DataFrame.unionByName, parts).withColumn("severity", severity[c("rule")])


def quality_gate(found: DataFrame) -> DataFrame:
    """(release, errors, warnings, passed, passed_strictly)."""
    errors, warnings = F.count_if(c("severity") == "error"), F.count_if(c("severity") == "warning")
    return found.groupBy("release").agg(errors.alias("errors"), warnings.alias("warnings"), (errors == 0).alias("passed"), ((errors == 0) & (warnings == 0)).alias("passed_strictly"))
