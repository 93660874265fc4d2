"""Stable labels of blank nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import before

c = F.col


def labels(quads: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(release, node, label): b0, b1, … for the blank nodes of each release by their first appearance.

    Statements are in the order of file and seq, and a statement's subject comes before its object. Nodes are scoped by
    file already. No task ranks a whole release, see `spread.before`.
    """
    ends = F.array(*(F.when(c(f"{x}_kind") == "bnode", F.struct(c(x).alias("node"), F.lit(i).alias("at"))) for i, x in enumerate("so")))
    each = quads.filter("s_kind = 'bnode' or o_kind = 'bnode'").select("release", "file", "seq", F.inline(F.array_compact(ends)))
    firsts = each.groupBy("release", "node").agg(F.min(F.struct("file", "seq", "at")).alias("first")).select("release", "node", "first.*")
    ranked = before(firsts, ["release"], ["file", "seq", "at", "node"], "nth", keep)
    return ranked.select("release", "node", F.concat(F.lit("b"), c("nth").cast("string")).alias("label"))


def labelled(quads: DataFrame, keep: Callable[[DataFrame, str], DataFrame], some: DataFrame | None = None) -> DataFrame:
    """The statements, or some of them, with labels in place of blank nodes, at both ends. Only statements with a blank end are joined."""
    names = keep(labels(quads, keep), "blank_labels")
    quads = quads if some is None else some
    for end in ("s", "o"):
        is_blank = c(f"{end}_kind") == "bnode"
        renamed = quads.filter(is_blank).join(names.withColumnRenamed("node", end), ["release", end]).withColumn(end, c("label")).select(quads.columns)
        quads = renamed.unionByName(quads.filter(~is_blank))
    return quads
