"""Contrast of colour pairs over a palette table (theme, scheme, role, hex)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colour import contrast_ratio, valid_srgb

# Roles whose colours must stand out from the colours of others, and the least ratio by basis.
SURFACES = ["surface", "surface-alt", "surface-code", "banner-bg"]
BODY_TEXT = [(fg, bg) for fg in ("text", "text-muted", "link", "link-visited") for bg in SURFACES] + [("badge-fg", "badge-bg"), ("banner-fg", "banner-bg")]
NON_TEXT = [(fg, bg) for fg in ("focus", "border") for bg in (*SURFACES, "badge-bg")]
LINK_VS_TEXT = [("link", "text"), ("link-visited", "text")]
LEAST_RATIO = {"body-text": 4.5, "non-text": 3.0, "large-text": 3.0, "link-vs-text": 3.0}
RULES = {"body-text": "theme.contrast-text", "non-text": "theme.contrast-non-text", "large-text": "theme.contrast-large-text", "link-vs-text": "theme.contrast-link-vs-text"}
c = F.col


def pair_table(spark: SparkSession, underlined: bool = True) -> DataFrame:
    """(fg, bg, basis): the pairs that must contrast; links that aren't underlined must do so with text too."""
    rows = [(*p, "body-text") for p in BODY_TEXT] + [(*p, "non-text") for p in NON_TEXT] + ([] if underlined else [(*p, "link-vs-text") for p in LINK_VS_TEXT])
    return spark.createDataFrame(rows, "fg string, bg string, basis string")


def malformed(palette: DataFrame) -> DataFrame:
    return palette.filter(~valid_srgb(c("hex")))


def contrast_pairs(palette: DataFrame, pairs: DataFrame) -> DataFrame:
    """(theme, scheme, fg, bg, basis, ratio, passed). A scheme with a malformed colour has no pairs."""
    good = palette.join(malformed(palette).select("theme", "scheme").distinct(), ["theme", "scheme"], "left_anti")
    front = good.select("theme", "scheme", c("role").alias("fg"), c("hex").alias("a"))
    back = good.select("theme", "scheme", c("role").alias("bg"), c("hex").alias("b"))
    least = F.create_map(*(F.lit(x) for pair in LEAST_RATIO.items() for x in pair))
    ratio = contrast_ratio(c("a"), c("b"))
    joined = front.join(F.broadcast(pairs), "fg").join(back, ["theme", "scheme", "bg"])  # thirty pairs
    return joined.select("theme", "scheme", "fg", "bg", "basis", ratio.alias("ratio"), (ratio >= least[c("basis")]).alias("passed"))


def merged(defaults: DataFrame, overlay: DataFrame) -> DataFrame:
    """A palette where the overlay's colours win."""
    keys = ["theme", "scheme", "role"]
    return defaults.withColumnRenamed("hex", "_old").join(overlay.withColumnRenamed("hex", "_new"), keys, "full_outer").select(*keys, F.coalesce("_new", "_old").alias("hex"))


# The roles that a palette has.
ROLES = ["text", "text-muted", "link", "link-visited", "focus", "surface", "surface-alt", "surface-code", "border", "badge-fg", "badge-bg", "banner-fg", "banner-bg"]


def schema_faults(palette: DataFrame) -> DataFrame:
    """(theme, scheme, role, fault): roles that a palette lacks, and roles that are none."""
    unknown = palette.filter(~c("role").isin(ROLES)).select("theme", "scheme", "role", F.lit("unknown").alias("fault"))
    held = palette.groupBy("theme", "scheme").agg(F.collect_set(F.when(c("role").isin(ROLES), c("role"))).alias("roles"))
    missing = held.select("theme", "scheme", F.explode(F.array_except(F.array(*map(F.lit, ROLES)), "roles")).alias("role"), F.lit("missing").alias("fault"))
    return unknown.unionByName(missing)


def published_gate(palette: DataFrame, pairs: DataFrame) -> DataFrame:
    """(theme, failed, faults, publishable): whether all pairs of a theme pass and its tokens are sound."""
    failed = contrast_pairs(palette, pairs).filter(~c("passed")).groupBy("theme").agg(F.count("*").alias("failed"))
    faults = malformed(palette).select("theme").unionByName(schema_faults(palette).select("theme")).groupBy("theme").agg(F.count("*").alias("faults"))
    rows = palette.select("theme").distinct().join(failed, "theme", "left").join(faults, "theme", "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return rows.select("theme", zero("failed").alias("failed"), zero("faults").alias("faults"), ((zero("failed") == 0) & (zero("faults") == 0)).alias("publishable"))


def undefined_tokens(sheets: DataFrame) -> DataFrame:
    """(site, path, token): custom properties that a style sheet (site, path, css) reads and no sheet of its site sets; one with a fallback is no fault."""
    read = sheets.select("site", "path", F.explode(F.array_distinct(F.regexp_extract_all("css", F.lit(r"var\(\s*(--[A-Za-z0-9_-]+)\s*\)"), 1))).alias("token"))
    made = sheets.select("site", F.explode(F.regexp_extract_all("css", F.lit(r"(--[A-Za-z0-9_-]+)\s*:"), 1)).alias("token")).distinct()
    return read.join(made, ["site", "token"], "left_anti").select("site", "path", "token")
