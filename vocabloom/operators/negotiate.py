"""Content negotiation over a table or a stream of requests (path, accept, query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http
from ..functions import iri as I
from .layout import STATUS, Layout, public_path, term_path
from .model import large, prefixes_of

#: Media types of a term's representations with their suffixes; the first is the default and has none in its address.
REPRESENTATIONS = {"text/html": ".html", "text/markdown": ".md", "text/turtle": ".ttl", "application/ld+json": ".jsonld"}
DEFAULT = "text/html"
c = F.col


def _one_of(types: Column) -> Column:
    """The first of some media types that is published."""
    return F.get(F.filter(types, lambda t: t.isin(list(REPRESENTATIONS))), 0)


def select_representation(accept: Column, query: Column) -> Column:
    """The media type that a request gets: what its query names, else its best published type, else the default for a
    wildcard, else RDF for a request for other RDF, else the default."""
    types = http.parse_accept(F.coalesce(accept, F.lit("")))
    named = http.query_alias(http.query_override(F.coalesce(query, F.lit(""))))
    rdf = next(t for t in REPRESENTATIONS if t in ("text/turtle", "application/ld+json"))
    return F.coalesce(
        F.when(named.isin(list(REPRESENTATIONS)), named),
        _one_of(types),
        F.when(F.exists(types, http.is_wildcard), DEFAULT),
        F.when(F.exists(types, http.looks_like_rdf), rdf),
        F.lit(DEFAULT),
    )


def match(requests: DataFrame, layout: Layout) -> DataFrame:
    """(release, path, ns, segment, local): for each path of requests (release, path) the namespace with the longest mount that it starts with.

    A first segment that is a snapshot's, with more after it, belongs to that snapshot. Paths under no mount are left out.
    """
    paths = requests.select("release", "path").distinct()
    starts = paths.select("release", "path", F.explode(F.concat(prefixes_of(c("path")), F.filter(F.array("path"), lambda p: p.endswith("/")))).alias("mount"))
    latest = layout.entries.filter("segment = ''").select("release", "mount", "ns")
    owner = starts.join(latest, ["release", "mount"]).groupBy("release", "path").agg(F.max_by(F.struct("mount", "ns"), F.length("mount")).alias("o"))
    rest = F.regexp_replace(F.substr(c("path"), F.length("o.mount") + 1), "/+$", "")
    rows = owner.select("release", "path", c("o.ns").alias("ns"), rest.alias("rest")).withColumn("segment", F.when(c("rest").contains("/"), F.substring_index("rest", "/", 1)))
    snaps = layout.snapshots.select("release", "ns", "segment", F.lit(True).alias("known"))
    both = rows.join(snaps, ["release", "ns", "segment"], "left")
    within = F.coalesce("known", F.lit(False))
    return both.select("release", "path", "ns", F.when(within, c("segment")).otherwise("").alias("segment"), F.when(within, F.substr(c("rest"), F.length("segment") + 2)).otherwise(c("rest")).alias("local"))


def resolve(requests: DataFrame, layout: Layout, key: str = "request_id") -> DataFrame:
    """(key, release, path, outcome, media_type, target, status) of requests (key, release, path, accept, query).

    A term is served in the default type, or redirected to the chosen one. What is no published term passes through: paths
    that go deeper, have the suffix of a representation or a name that isn't a term.
    """
    found = match(requests, layout).join(large(layout.terms.select("release", "ns", "local", "style")), ["release", "ns", "local"]).join(layout.entries.select("release", "ns", "segment", "mount"), ["release", "ns", "segment"])
    return outcomes(requests.join(found, ["release", "path"], "left"), key)


def outcomes(rows: DataFrame, key: str) -> DataFrame:
    """The outcomes of requests with the term of each (mount, local, style; null without one). Stateless, so rows may be a stream."""
    suffix = F.create_map(*(F.lit(x) for pair in REPRESENTATIONS.items() for x in pair))
    negotiated = c("mount").isNotNull() & ~F.exists(F.array(*(F.lit(s) for t, s in REPRESENTATIONS.items() if t != DEFAULT)), lambda s: F.endswith(c("local"), s))
    chosen = rows.withColumn("media_type", F.when(negotiated, select_representation(c("accept"), c("query"))))
    serve = c("media_type") == DEFAULT
    file = F.regexp_replace(term_path(c("mount"), c("local"), c("style"), suffix[c("media_type")]), "^/+", "")
    public = public_path(c("mount"), c("local"), c("style"), suffix[c("media_type")])
    outcome = F.when(c("media_type").isNull(), "pass-through").when(serve, "serve").otherwise("redirect")
    return chosen.select(key, "release", "path", outcome.alias("outcome"), "media_type", F.when(serve, file).otherwise(public).alias("target"), F.when(serve, 200).when(c("media_type").isNotNull(), STATUS).alias("status"))


def answers(requests: DataFrame, layout: Layout, files: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, outcome, status, target, content_type): what a host answers; what isn't negotiated is looked up, to the letter, in files (release, path): as it is, as a folder's index with or without a slash, else it is missing."""
    resolved = resolve(requests, layout, key)
    plain = F.regexp_replace("path", "^/+", "")
    ways = F.array(*(F.struct(F.lit(i).alias("at"), F.concat(plain, F.lit(end)).alias("file")) for i, end in enumerate(("", "index.html", "/index.html"))))
    asked = resolved.filter("outcome = 'pass-through'").select("release", "path").distinct().select("release", "path", F.explode(ways).alias("x")).select("release", "path", "x.*")
    there = asked.join(files.select("release", c("path").alias("file")).distinct(), ["release", "file"]).groupBy("release", "path").agg(F.min_by("file", "at").alias("file"))
    rows = resolved.join(there, ["release", "path"], "left")
    passed = c("outcome") == "pass-through"
    outcome = F.when(passed & c("file").isNotNull(), "file").when(passed, "missing").otherwise(c("outcome"))
    kind = F.when(c("outcome") == "serve", I.media_type_of(c("target"))).when(passed & c("file").isNotNull(), I.media_type_of(c("file")))
    return rows.select(key, outcome.alias("outcome"), F.when(passed, F.when(c("file").isNotNull(), 200).otherwise(404)).otherwise(c("status")).alias("status"), F.when(passed, c("file")).otherwise(c("target")).alias("target"), kind.alias("content_type"))
