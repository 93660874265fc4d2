"""Registered queries of the shape tables and of the release comparison, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare
from .models import model
from .shacl import SHAPES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col

_PICK = "coalesce(list_filter({0}, lambda v: v.lang = 'en')[1].value, list_filter({0}, lambda v: v.lang IS NULL)[1].value, {0}[1].value)"
_SHOWN = f"(SELECT *, coalesce({_PICK.format('labels')}, local_name) AS label, {_PICK.format('definitions')} AS definition FROM terms WHERE NOT \"foreign\" AND release = '{{}}')"
_TERMS = f"FROM {_SHOWN.format('old')} o FULL OUTER JOIN {_SHOWN.format('new')} n USING (iri) WHERE "
_DOCS = "FROM (SELECT * FROM docs WHERE release = 'old') o FULL OUTER JOIN (SELECT * FROM docs WHERE release = 'new') n USING (iri) WHERE "
_LAST = "(SELECT * FROM con WHERE path_kind = 'predicate' QUALIFY row_number() OVER (PARTITION BY release, path, shape ORDER BY NOT required DESC, name DESC NULLS LAST, listed DESC) = 1)"
_CONSTRAINTS = f"FROM (SELECT * FROM {_LAST} WHERE release = 'old') o FULL OUTER JOIN (SELECT * FROM {_LAST} WHERE release = 'new') n USING (path, shape) WHERE path IN (SELECT iri FROM terms WHERE NOT \"foreign\") AND "
_BOTH = "o.release IS NOT NULL AND n.release IS NOT NULL AND "
_TIGHT = "CASE WHEN coalesce(n.max_count, 9e18) < coalesce(o.max_count, 9e18) OR coalesce(n.min_count, 0) > coalesce(o.min_count, 0) THEN 'breaking' ELSE 'additive' END"
SQL = {
    "term.removed": ("'breaking'", _TERMS + "n.release IS NULL"),
    "term.added": ("'additive'", _TERMS + "o.release IS NULL"),
    "term.kind-changed": ("'breaking'", _TERMS + _BOTH + "o.kind <> n.kind"),
    "term.deprecated": ("'additive'", _TERMS + _BOTH + "NOT o.deprecated AND n.deprecated"),
    "term.undeprecated": ("'additive'", _TERMS + _BOTH + "o.deprecated AND NOT n.deprecated"),
    "term.relabelled": ("'editorial'", _TERMS + _BOTH + "o.label <> n.label"),
    "term.redefined": ("'editorial'", _TERMS + _BOTH + "o.definition <> n.definition"),
    "term.definition-removed": ("'editorial'", _TERMS + _BOTH + "o.definition IS NOT NULL AND n.definition IS NULL"),
    "term.defined": ("'additive'", _TERMS + _BOTH + "o.definition IS NULL AND n.definition IS NOT NULL"),
    "term.parent-removed": ("'breaking'", _TERMS + _BOTH + "len(list_filter(o.super_terms, lambda x: NOT list_contains(n.super_terms, x))) > 0"),
    "term.parent-added": ("'additive'", _TERMS + _BOTH + "len(list_filter(n.super_terms, lambda x: NOT list_contains(o.super_terms, x))) > 0"),
    "term.domain-changed": ("'breaking'", _TERMS + _BOTH + "o.domain <> n.domain"),
    "term.range-changed": ("'breaking'", _TERMS + _BOTH + "o.range <> n.range"),
    "constraint.removed": ("'additive'", _CONSTRAINTS + "n.release IS NULL"),
    "constraint.added": ("'breaking'", _CONSTRAINTS + "o.release IS NULL"),
    "constraint.now-required": ("'breaking'", _CONSTRAINTS + _BOTH + "NOT o.required AND n.required"),
    "constraint.now-optional": ("'additive'", _CONSTRAINTS + _BOTH + "o.required AND NOT n.required"),
    "constraint.cardinality-changed": (_TIGHT, _CONSTRAINTS + _BOTH + "o.required = n.required AND o.cardinality IS DISTINCT FROM n.cardinality"),
    "constraint.scheme-changed": ("'breaking'", _CONSTRAINTS + _BOTH + "o.in_scheme <> n.in_scheme"),
    "constraint.values-changed": ("CASE WHEN len(n.vals) < len(o.vals) THEN 'breaking' ELSE 'additive' END", _CONSTRAINTS + _BOTH + "o.vals <> n.vals"),
    "constraint.datatype-changed": ("CASE WHEN len(n.datatypes) < len(o.datatypes) THEN 'breaking' ELSE 'additive' END", _CONSTRAINTS + _BOTH + "o.datatypes <> n.datatypes"),
    "document.removed": ("'breaking'", _DOCS + "n.release IS NULL"),
    "document.added": ("'additive'", _DOCS + "o.release IS NULL"),
    "document.version-changed": ("'editorial'", _DOCS + _BOTH + "o.version_info IS DISTINCT FROM n.version_info"),
}
EVERY_CHANGE = "(" + " UNION ALL ".join(f"SELECT '{r}' AS rule, {severity} AS severity, {'path' if r.startswith('constraint') else 'iri'} AS iri {rest}" for r, (severity, rest) in SQL.items()) + ")"


def query(name: str, build: Callable, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(model(spark, sf_dir))
    ORACLE[name] = SHAPES + sql


for _rule, (_severity, _rest) in SQL.items():
    _kind = {"term": compare.term_changes, "constraint": compare.constraint_changes, "document": compare.document_changes}[_rule.split(".")[0]]
    _iri = "path" if _rule.startswith("constraint") else "iri"
    query("diff_" + _rule.replace(".", "_").replace("-", "_"), lambda m, rule=_rule, find=_kind, iri=_iri: find(m, "old", "new", (rule,)).select(c(iri).alias("iri"), "severity"), f"SELECT {_iri} AS iri, {_severity} AS severity {_rest}")
query("breaking_gate", lambda m: compare.changes(m).agg((F.count("*") > 0).alias("changed"), (F.count_if(c("severity") == "breaking") > 0).alias("breaking")), f"SELECT count(*) > 0 AS changed, count(*) FILTER (severity = 'breaking') > 0 AS breaking FROM {EVERY_CHANGE}")
query("diff_sides", lambda m: m.local.groupBy("release").agg(F.count("*").alias("terms")).join(m.documents.groupBy("release").agg(F.count("*").alias("documents"), F.max("version_info").alias("version")), "release"), "SELECT release, (SELECT count(*) FROM terms t WHERE t.release = d.release AND NOT \"foreign\") AS terms, count(*) AS documents, max(version_info) AS version FROM docs d GROUP BY release")
