"""The text files of a site at scale: links made relative, an ordered digest, and one ordered text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iri as I
from .describe import label, term_cards
from .layout import NS, Layout
from .model import KEY, large
from .spread import before

#: Files, and then digests, that one digest of the next level covers.
LEAF = 1000
#: What stands before each text of the one ordered text.
RULE = "\n---\n\n"
c = F.col


def linked_cards(layout: Layout) -> DataFrame:
    """(release, ns, local, path, base_url, body): the card of each local term with a list of its parents and replacements.

    Those that have a card of their own are links to it, in full; the others are IRIs.
    """
    paths = layout.term_paths.filter("media_type = 'text/markdown'").select(*NS, "local", "path", "url")
    terms = layout.terms.select(*NS, "local", "iri").join(paths, [*NS, "local"])
    labels = layout.m.local.select(*KEY, F.coalesce(label(), "local_name").alias("label"))
    to = terms.join(large(labels), KEY).select("release", c("iri").alias("target"), "label", "url")
    each = layout.m.local.select(*KEY, F.posexplode(F.concat("super_terms", "replaced_by")).alias("at", "target")).join(large(to), ["release", "target"], "left")
    line = F.concat(F.lit("- "), F.coalesce(F.concat(F.lit("["), "label", F.lit("]("), "url", F.lit(")")), c("target")))
    lines = each.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    bases = layout.namespaces.select(*NS, "base_url")
    whole = terms.join(lines, KEY, "left").join(large(term_cards(layout)), [*NS, "local"]).join(bases, NS)
    return whole.select(*NS, "local", "path", "base_url", F.concat("card", F.lit("\n\n"), F.coalesce("lines", F.lit("")), F.lit("\n")).alias("body"))


def relativised(bodies: DataFrame) -> DataFrame:
    """(release, path, body, n_links, n_missing): texts (release, path, base_url, body) whose links into the site are relative.

    A link is `](`, the base URL and what follows up to the next `)`; without one it isn't a link and stays as it is, as
    does the base URL anywhere else. A text is cut at links, its pieces are rows, and targets are joined with the paths
    of all texts of the release, so n_missing counts links to files that aren't there (without fragments and queries).
    A text without a body has none; one without a base URL stays.
    """
    base = F.concat(F.lit("]("), F.regexp_replace("base_url", "/+$", ""), F.lit("/"))
    rows = bodies.withColumn("_mark", F.when(F.coalesce("base_url", F.lit("")) != "", base))
    cut = F.when(c("_mark").isNotNull(), F.split("body", F.concat(F.lit("\\Q"), "_mark", F.lit("\\E")), -1)).otherwise(F.array("body"))
    pieces = rows.select("release", "path", "_mark", F.posexplode(cut).alias("at", "piece"))
    # a piece without an end goes on with the next one, as the mark between them is part of its target
    ends = F.count(F.when((c("at") == 0) | c("piece").contains(")"), 1)).over(Window.partitionBy("release", "path").orderBy(F.desc("at")))
    groups = pieces.withColumn("_group", F.when(c("at") == 0, -1).otherwise(ends))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])
    joined = groups.groupBy("release", "path", "_mark", "_group").agg(F.min("at").alias("at"), F.array_join(texts, "\0").alias("text"))
    joined = joined.withColumn("text", F.replace("text", F.lit("\0"), F.coalesce("_mark", F.lit(""))))
    close = F.instr("text", ")")
    target = F.when((c("at") > 0) & (close > 0), F.concat(F.lit("/"), F.substring("text", F.lit(1), close - 1)))
    links = joined.withColumn("target", target).withColumn("_file", F.regexp_extract("target", "^/([^#?]*)", 1))
    known = bodies.select("release", c("path").alias("_file")).distinct().withColumn("_known", F.lit(True))
    links = links.join(known, ["release", "_file"], "left")
    start = F.concat(F.lit("/"), F.ltrim(c("path"), F.lit("/")))
    shown = (
        F.when(c("at") == 0, c("text"))
        .when(c("target").isNull(), F.concat("_mark", "text"))
        .otherwise(F.concat(F.lit("]("), I.relative_to(start, c("target")), F.substring(c("text"), close, F.length("text"))))
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("shown")))), lambda x: x["shown"])
    counts = [F.count("target").alias("n_links"), F.count_if(c("target").isNotNull() & c("_known").isNull()).alias("n_missing")]
    return links.groupBy("release", "path").agg(F.array_join(parts, "").alias("body"), *counts)


def ordered_digest(files: DataFrame, keep: Callable[[DataFrame, str], DataFrame], leaf: int = LEAF) -> DataFrame:
    """(release, files, bytes, digest): a SHA-256 of all files (release, path, content) of a release in the order of their paths.

    It is a hash tree: a file is its path and the hash of its content, `leaf` of them in path order make a digest, `leaf` of
    these another, until one is left. It doesn't depend on how rows are dealt to tasks, and a task has `leaf` hashes.
    """
    hashed = files.select("release", "path", F.octet_length("content").alias("bytes"), F.sha2(F.concat_ws("\0", "path", F.sha2("content", 256)), 256).alias("digest"))
    level = before(hashed, ["release"], ["path"], "at", keep).select("release", "at", "digest", "bytes", F.lit(1).cast("long").alias("files"))
    n = 0
    while True:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        whole = F.when(F.count("*") == 1, F.min("digest")).otherwise(F.sha2(F.array_join(texts, ","), 256))
        folded = level.groupBy("release", F.floor(c("at") / leaf).alias("node")).agg(whole.alias("digest"), F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))
        level = keep(folded.withColumnRenamed("node", "at"), f"digests{n}")
        n += 1
        if level.filter("at > 0").isEmpty():
            return level.select("release", "files", "bytes", "digest")


def concatenated(layout: Layout) -> DataFrame:
    """(release, ns, local, start, length, text): the cards of a release as one text, by namespace and then term.

    A row is a chunk, its place in bytes, and what stands there; chunks put end to end are the text. Offsets are running
    sums in two levels, so no task has a release, and chunks can be written by any number of tasks.
    """
    cards = term_cards(layout).select(*NS, "local", F.concat(F.lit(RULE), "card", F.lit("\n")).alias("text"))
    sized = cards.withColumn("length", F.octet_length("text").cast("long"))
    return before(sized, ["release"], ["ns", "local"], "start", layout.m.keep, c("length")).select(*NS, "local", "start", "length", "text")
