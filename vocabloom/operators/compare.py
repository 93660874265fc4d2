"""What changed between two releases of a model, and whether it breaks consumers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pick_lang
from .model import Model, large
from .shapes import constraints

c = F.col


def _change(rule: str, severity: str | Column, condition: Column, detail: Column | None = None) -> Column:
    kind = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), kind.alias("severity"), (detail if detail is not None else F.lit("")).alias("detail")))


def _exploded(rows: DataFrame, keys: list[str], changes: list[tuple], rules: tuple[str, ...]) -> DataFrame:
    """A row for each change; only those of `rules`, if there are any."""
    changes = [_change(*x) for x in changes if not rules or x[0] in rules]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*changes))).alias("x")).select(*keys, "x.rule", "x.severity", "x.detail")


def _sides(rows: DataFrame, old: str, new: str, keys: list[str]) -> DataFrame:
    """Rows of two releases side by side, as the structs o and n, by full outer join."""
    values = F.struct(*(x for x in rows.columns if x != "release"))
    side = lambda release, name: rows.filter(c("release") == release).select(*keys, values.alias(name))
    return side(old, "o").join(side(new, "n"), keys, "full_outer")


def term_changes(m: Model, old: str, new: str, rules: tuple[str, ...] = ()) -> DataFrame:
    shown = m.local.select(
        "release",
        "iri",
        "kind",
        "deprecated",
        F.coalesce(pick_lang(c("labels"), F.lit("en"))["value"], c("local_name")).alias("label"),
        pick_lang(c("definitions"), F.lit("en"))["value"].alias("definition"),
        "super_terms",
        "domain",
        "range",
        F.array_join("replaced_by", " ").alias("replaced_by"),
    )
    both = c("o").isNotNull() & c("n").isNotNull()
    o, n = (lambda f: c(f"o.{f}")), (lambda f: c(f"n.{f}"))
    lost, gained = F.array_except("o.super_terms", "n.super_terms"), F.array_except("n.super_terms", "o.super_terms")
    return _exploded(
        _sides(shown, old, new, ["iri"]),
        ["iri"],
        [
            ("term.removed", "breaking", c("n").isNull()),
            ("term.added", "additive", c("o").isNull()),
            ("term.kind-changed", "breaking", both & (o("kind") != n("kind")), F.concat_ws(" -> ", o("kind"), n("kind"))),
            ("term.deprecated", "additive", both & ~o("deprecated") & n("deprecated"), n("replaced_by")),
            ("term.undeprecated", "additive", both & o("deprecated") & ~n("deprecated")),
            ("term.relabelled", "editorial", both & (o("label") != n("label")), F.concat_ws(" -> ", o("label"), n("label"))),
            ("term.redefined", "editorial", both & (o("definition") != n("definition"))),
            ("term.definition-removed", "editorial", both & o("definition").isNotNull() & n("definition").isNull()),
            ("term.defined", "additive", both & o("definition").isNull() & n("definition").isNotNull()),
            ("term.parent-removed", "breaking", both & (F.size(lost) > 0), F.array_join(lost, " ")),
            ("term.parent-added", "additive", both & (F.size(gained) > 0), F.array_join(gained, " ")),
            ("term.domain-changed", "breaking", both & (o("domain") != n("domain"))),
            ("term.range-changed", "breaking", both & (o("range") != n("range"))),
        ],
        rules,
    )


def constraint_changes(m: Model, old: str, new: str, rules: tuple[str, ...] = ()) -> DataFrame:
    """Constraints on local terms of either release; of several by one shape on one property the last in order counts."""
    local = m.local_placed.filter(c("release").isin(old, new)).select(c("iri").alias("path")).distinct()
    order = F.struct(~c("required"), "name", "path", "listed")
    fields = F.struct("min_count", "max_count", "datatypes", "in_scheme", "values", "cardinality", "required")
    latest = constraints(m).filter("path_kind = 'predicate'").join(large(local), "path", "left_semi").groupBy("release", "path", "shape").agg(F.max_by(fields, order).alias("x")).select("release", "path", "shape", "x.*")
    both = c("o").isNotNull() & c("n").isNotNull()
    o, n = (lambda f: c(f"o.{f}")), (lambda f: c(f"n.{f}"))
    top = lambda x: F.coalesce(x, F.lit(2**63 - 1))
    least = lambda x: F.coalesce(x, F.lit(0))
    tighter = (top(n("max_count")) < top(o("max_count"))) | (least(n("min_count")) > least(o("min_count")))
    worse = lambda bad: F.when(bad, "breaking").otherwise("additive")
    return _exploded(
        _sides(latest, old, new, ["path", "shape"]),
        ["path", "shape"],
        [
            ("constraint.removed", "additive", c("n").isNull()),
            ("constraint.added", "breaking", c("o").isNull()),
            ("constraint.now-required", "breaking", both & ~o("required") & n("required")),
            ("constraint.now-optional", "additive", both & o("required") & ~n("required")),
            ("constraint.cardinality-changed", worse(tighter), both & (o("required") == n("required")) & ~o("cardinality").eqNullSafe(n("cardinality"))),
            ("constraint.scheme-changed", "breaking", both & (o("in_scheme") != n("in_scheme"))),
            ("constraint.values-changed", worse(F.size(n("values")) < F.size(o("values"))), both & (o("values") != n("values"))),
            ("constraint.datatype-changed", worse(F.size(n("datatypes")) < F.size(o("datatypes"))), both & (o("datatypes") != n("datatypes"))),
        ],
        rules,
    )


def document_changes(m: Model, old: str, new: str, rules: tuple[str, ...] = ()) -> DataFrame:
    shown = m.documents.select("release", "iri", "version_info")
    both = c("o").isNotNull() & c("n").isNotNull()
    return _exploded(
        _sides(shown, old, new, ["iri"]),
        ["iri"],
        [
            ("document.removed", "breaking", c("n").isNull()),
            ("document.added", "additive", c("o").isNull()),
            ("document.version-changed", "editorial", both & ~c("o.version_info").eqNullSafe(c("n.version_info"))),
        ],
        rules,
    )


def changes(m: Model, old: str = "old", new: str = "new") -> DataFrame:
    """(rule, severity, iri, detail) of everything that changed."""
    own = constraint_changes(m, old, new).select(c("path").alias("iri"), "rule", "severity", F.concat_ws(" ", "shape", "detail").alias("detail"))
    return term_changes(m, old, new).unionByName(own).unionByName(document_changes(m, old, new)).select("rule", "severity", "iri", "detail")
