"""Registered queries of the lint rules, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lint
from .models import PRELUDE, model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_NS = "nullif(regexp_extract({0}, '^(.*[#/])([^#/]+)$', 1), '')"
_USED = f"(SELECT DISTINCT release, {_NS.format('i')} AS ns FROM (SELECT release, unnest([CASE s_kind WHEN 'iri' THEN s END, p, CASE o_kind WHEN 'iri' THEN o END, dt]) AS i FROM q))"
_HERE = f"(SELECT DISTINCT release, file, {_NS.format('i')} AS ns FROM (SELECT release, file, unnest([CASE s_kind WHEN 'iri' THEN s END, p, CASE o_kind WHEN 'iri' THEN o END]) AS i FROM q WHERE file LIKE '%.ttl'))"
_PARTS = "SELECT d.release, d.iri AS subject FROM docs d JOIN root r ON r.release = d.release AND r.root <> d.iri WHERE "
_LOCAL = 'SELECT release, iri AS subject FROM terms WHERE NOT "foreign" AND '
_TAKEN = "(SELECT DISTINCT m.release, m.ns, rtrim(substr(d.iri, length(m.ns) + 1), '/') AS segment FROM minted m JOIN (SELECT release, iri FROM doc UNION SELECT release, version_iri FROM docs WHERE version_iri IS NOT NULL) d ON d.release = m.release AND starts_with(d.iri, m.ns))"
_TEXT = "(SELECT d.release, coalesce(array_to_string(list_transform(v.vs, lambda x: x.value), ' '), '') AS text FROM root d LEFT JOIN vals v ON v.release = d.release AND v.iri = d.root AND v.field = 'document_description')"
_HEAD = ", ".join(f"CASE WHEN NOT EXISTS (SELECT 1 FROM vals v WHERE v.release = d.release AND v.iri = d.iri AND v.field = 'document_{f}') THEN '{f}' END" if f in ("title", "description") else f"CASE WHEN d.{f} IS NULL THEN '{f}' END" for f in lint.HEADER_FIELDS)
_HEAD += "".join(f", CASE WHEN NOT EXISTS (SELECT 1 FROM q WHERE q.release = d.release AND q.s = d.iri AND q.p = '{p}') THEN '{f}' END" for f, p in lint.HEADER_AGENTS.items())
_HEAD += ", CASE WHEN d.prior_version IS NULL AND d.version_info IS NOT NULL THEN 'prior_version' END"

SQL = {
    "release.no-document": "SELECT DISTINCT release, CAST(NULL AS VARCHAR) AS subject FROM q WHERE release NOT IN (SELECT release FROM doc)",
    "release.prefix-unused": f"SELECT p.release, p.file || ' ' || p.prefix AS subject FROM pre p WHERE NOT EXISTS (SELECT 1 FROM {_USED} u WHERE u.release = p.release AND u.ns = p.ns)",
    "release.prefix-undeclared": f"SELECT h.release, h.file || ' ' || h.ns AS subject FROM {_HERE} h JOIN (SELECT release, ns, max(prefix) AS prefix FROM pmap GROUP BY ALL) n ON n.release = h.release AND n.ns = h.ns WHERE NOT EXISTS (SELECT 1 FROM pre p WHERE p.release = h.release AND p.file = h.file AND p.prefix = n.prefix)",
    "release.has-part-missing": _PARTS + "NOT list_contains((SELECT e.has_part FROM docs e WHERE e.release = r.release AND e.iri = r.root), d.iri)",
    "release.part-no-is-part-of": _PARTS + "len(d.is_part_of) = 0",
    "release.part-no-version-iri": _PARTS + "d.version_iri IS NULL",
    "release.part-no-status": _PARTS + "d.status IS NULL",
    "release.empty-document": "SELECT release, iri AS subject FROM docs d WHERE document_kind = 'Ontology' AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.release = d.release AND p.defined_in = d.iri)",
    "header.missing": f"SELECT release, subject FROM (SELECT d.release, unnest([{_HEAD}]) AS subject FROM docs d JOIN root r ON r.release = d.release AND r.root = d.iri) WHERE subject IS NOT NULL",
    "term.no-label": _LOCAL + "len(labels) = 0",
    "term.no-definition": _LOCAL + "len(definitions) = 0",
    "term.no-is-defined-by": _LOCAL + "is_defined_by IS NULL",
    "term.deprecated-without-replacement": _LOCAL + "deprecated AND len(replaced_by) = 0",
    "term.duplicate-label": 'SELECT release, subject FROM (SELECT release, lower(unnest(list_transform(labels, lambda v: v.value))) AS subject FROM terms WHERE NOT "foreign") GROUP BY ALL HAVING count(*) > 1',
    "term.untagged-literal": _LOCAL + "len(list_filter(list_concat(labels, definitions), lambda v: v.lang IS NULL)) > 0",
    "site.reserved-path-collision": f'SELECT DISTINCT t.release, t.iri AS subject FROM terms t JOIN {_TAKEN} x ON x.release = t.release AND x.ns = t.namespace AND x.segment = t.local_name WHERE NOT t."foreign"',
    "site.case-collision": "SELECT release, iri AS subject FROM (SELECT *, row_number() OVER (PARTITION BY release, namespace, lower(local_name) ORDER BY local_name) AS n FROM terms WHERE NOT \"foreign\") WHERE n > 1",
    "text.count-mismatch": f"SELECT release, w AS subject FROM (SELECT release, text, unnest({lint.NUMBER_WORDS}) AS w, unnest(range(1, 11)) AS n FROM {_TEXT}) x WHERE contains(lower(text), w || ' classes') AND n <> (SELECT count(*) FROM terms t WHERE t.release = x.release AND kind = 'Class' AND NOT \"foreign\")",
    "text.mentions-absent-vocab": f"SELECT release, k AS subject FROM (SELECT release, text, unnest({list(lint.NAMED_VOCABULARIES)}) AS k, unnest({list(lint.NAMED_VOCABULARIES.values())}) AS ns FROM {_TEXT}) x WHERE contains(text, k) AND NOT EXISTS (SELECT 1 FROM pmap p WHERE p.release = x.release AND p.ns = x.ns)",
}
for _rule in lint.SEVERITY:
    _name = _rule.replace(".", "_").replace("-", "_")
    QUERIES[_name] = lambda spark, sf_dir, rule=_rule: lint.findings(model(spark, sf_dir), (rule,)).select("release", "subject")
    ORACLE[_name] = PRELUDE + SQL[_rule]
_ALL = "(" + " UNION ALL ".join(f"SELECT release, subject, '{r}' AS rule, '{lint.SEVERITY[r]}' AS severity FROM ({sql}) AS f" for r, sql in SQL.items()) + ")"
QUERIES["lint_summary"] = lambda spark, sf_dir: lint.findings(model(spark, sf_dir)).groupBy("release", "severity", "rule").agg(F.count("*").alias("n"))
ORACLE["lint_summary"] = PRELUDE + f"SELECT release, severity, rule, count(*) AS n FROM {_ALL} GROUP BY ALL"
QUERIES["rule_filter"] = lambda spark, sf_dir: lint.findings(model(spark, sf_dir), ("term.", "site."), ("term.no-",)).select("release", "rule", "subject")
ORACLE["rule_filter"] = PRELUDE + f"SELECT release, rule, subject FROM {_ALL} WHERE (starts_with(rule, 'term.') OR starts_with(rule, 'site.')) AND NOT starts_with(rule, 'term.no-')"
QUERIES["quality_gate"] = lambda spark, sf_dir: lint.quality_gate(lint.findings(model(spark, sf_dir)))
ORACLE["quality_gate"] = PRELUDE + f"SELECT release, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS passed, count(*) FILTER (severity <> 'info') = 0 AS passed_strictly FROM {_ALL} GROUP BY release"
