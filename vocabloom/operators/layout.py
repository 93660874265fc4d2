"""Where a release is published: mounts, paths and addresses of terms and documents, snapshots, routes.

Terms stay rows throughout: a namespace with millions of terms has one row, and its terms have theirs. `config` has a row for
each release: release, base_url (ends in /), snapshots (version-iri, all or none), configured (a version, or null). `overrides`
has release, ns, mount, url_style, stem and resolver_prefix, null where the default holds.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iri as I
from ..functions.text import looks_like_version, pick_lang
from ..vocabulary import DCTERMS, OWL
from .model import Model, large

# Representations in order: name, media type, extension.
REPRESENTATIONS = [("html", "text/html", ".html"), ("markdown", "text/markdown", ".md"), ("turtle", "text/turtle", ".ttl"), ("jsonld", "application/ld+json", ".jsonld")]
DEFAULT_TYPE = "text/html"
# How long answers may be kept.
SNAPSHOT_CACHE, LATEST_CACHE = "public, max-age=31536000, immutable", "public, max-age=300, must-revalidate"
STATUS = 303
NS = ["release", "ns"]
c = F.col


def representations(spark) -> DataFrame:
    """(rep, media_type, extension, rep_at)."""
    return F.broadcast(spark.createDataFrame([(*r, i) for i, r in enumerate(REPRESENTATIONS)], "rep string, media_type string, extension string, rep_at int"))


def term_path(mount: Column, local: Column, style: Column, extension: Column) -> Column:
    return F.concat(mount, local, F.when(style == "dir", "/index").otherwise(""), extension)


def request_path(mount: Column, local: Column, style: Column) -> Column:
    return F.concat(mount, local, F.when(style == "dir", "/").otherwise(""))


def public_path(mount: Column, local: Column, style: Column, extension: Column) -> Column:
    """The address path of a representation; the default one is the term's own."""
    return F.when(extension == ".html", request_path(mount, local, style)).otherwise(term_path(mount, local, style, extension))


class Layout:
    """The publication tables of all releases of a model; each is built when first asked for."""

    def __init__(self, m: Model, config: DataFrame, overrides: DataFrame) -> None:
        self.m, self.config, self.overrides, self.keep = m, config, overrides, m.keep

    # namespaces and terms

    @cached_property
    def namespaces(self) -> DataFrame:
        """(release, ns, mount, style, stem, prefix, resolver_prefix, document, base_url): mount is empty or ends in /."""
        given = F.regexp_replace("o.mount", "^/+", "")
        mount = F.coalesce(F.when((given == "") | given.endswith("/"), given).otherwise(F.concat(given, F.lit("/"))), I.mount_from_iri(c("ns")))
        last = F.nullif(F.element_at(F.split(F.regexp_replace(I.mount_from_iri(c("ns")), "/+$", ""), "/"), -1), F.lit(""))
        rows = self.m.namespaces.drop("reserved").join(self.overrides.withColumnsRenamed({n: f"o_{n}" for n in ("mount", "stem")}), NS, "left").withColumn("o", F.struct(c("o_mount").alias("mount"), c("o_stem").alias("stem")))
        return self.keep(
            rows.join(self.config, "release").select(
                *NS,
                mount.alias("mount"),
                F.when(c("url_style") == "dir", "dir").otherwise("flat").alias("style"),
                F.coalesce("o.stem", "prefix", last, F.lit("vocabulary")).alias("stem"),
                "prefix",
                "resolver_prefix",
                "document",
                "base_url",
            ),
            "plan",
        )

    @cached_property
    def terms(self) -> DataFrame:
        """(release, ns, iri, local, folded, style): local terms; those whose name the site owns, or differs from an earlier one by case only, live in a directory."""
        order = Window.partitionBy("release", "namespace", F.lower("local_name")).orderBy("local_name")
        named = self.m.local_placed.select("release", c("namespace").alias("ns"), "iri", c("local_name").alias("local"), (F.row_number().over(order) > 1).alias("folded"))
        rows = named.join(self.namespaces.select(*NS, "mount", c("style").alias("ns_style")), NS)
        owned = (c("local") == "index") | ((c("mount") == "") & (c("local") == "404"))
        return self.keep(rows.select(*NS, "iri", "local", "folded", (owned | c("folded")).alias("in_directory"), F.when(owned | c("folded"), "dir").otherwise(c("ns_style")).alias("style")), "site_terms")

    @cached_property
    def term_paths(self) -> DataFrame:
        """(release, ns, local, media_type, path, url, page_url, request_path): a row for each representation of each term."""
        rows = self.terms.join(self.namespaces.select(*NS, "mount", "base_url"), NS).crossJoin(representations(self.m.spark))
        file = term_path(c("mount"), c("local"), c("style"), c("extension"))
        url = F.concat("base_url", public_path(c("mount"), c("local"), c("style"), c("extension")))
        page = F.concat("base_url", request_path(c("mount"), c("local"), c("style")))
        return rows.select(*NS, "local", "media_type", file.alias("path"), url.alias("url"), page.alias("page_url"), F.concat(F.lit("/"), request_path(c("mount"), c("local"), c("style"))).alias("request_path"))

    def document_paths(self, index: str = "index") -> DataFrame:
        """(release, ns, media_type, path, url) of each namespace's own files, and of its index for agents."""
        name = F.when(c("media_type") == "text/markdown", index).when(c("media_type") == "text/html", "index").otherwise(c("stem"))
        rows = self.namespaces.crossJoin(representations(self.m.spark)).withColumn("path", F.concat("mount", name, "extension"))
        own = rows.select(*NS, "media_type", "path", F.concat("base_url", F.when(c("media_type") == DEFAULT_TYPE, c("mount")).otherwise(c("path"))).alias("url"))
        llms = self.namespaces.select(*NS, F.lit("text/plain").alias("media_type"), F.concat("mount", F.lit("llms.txt")).alias("path")).join(self.namespaces.select(*NS, "base_url"), NS)
        return own.unionByName(llms.select(*NS, "media_type", "path", F.concat("base_url", "path").alias("url")))

    # versions

    @cached_property
    def versions(self) -> DataFrame:
        """(release, iri, segment, source): of each document the first usable of its version, issue date, change date and the configured version."""
        found = []
        for name, source in (("version_info", "version-info"), ("issued", "issued"), ("modified", "modified"), ("configured", "configured")):
            value = F.trim(name)
            found.append(F.when(looks_like_version(value), F.struct(value.alias("segment"), F.lit(source).alias("source"))))
        rows = self.m.documents.join(self.config.select("release", "configured"), "release").withColumn("v", F.coalesce(*found))
        return rows.filter("v is not null").select("release", "iri", "v.segment", "v.source")

    @cached_property
    def _candidates(self) -> DataFrame:
        docs = self.m.documents.select("release", c("iri").alias("document"), "version_iri").join(self.versions.withColumnRenamed("iri", "document"), ["release", "document"])
        rows = self.namespaces.join(docs, ["release", "document"]).join(self.config.select("release", "snapshots"), "release").filter("snapshots <> 'none'")
        rows = rows.withColumn("url", F.concat("base_url", "mount", "segment", F.lit("/"))).withColumn("resolves", F.coalesce(c("version_iri") == c("url"), F.lit(False)))
        taken = self.terms.select(*NS, c("local").alias("segment"), F.lit(True).alias("taken")).distinct()
        rows = rows.join(large(taken), [*NS, "segment"], "left")
        refused = F.when((c("snapshots") == "version-iri") & ~c("resolves"), F.when(c("version_iri").isNotNull(), "other version IRI").otherwise("no version IRI")).when(c("taken"), "term of that name")
        return self.keep(rows.select(*NS, "segment", "source", "url", "version_iri", "resolves", refused.alias("refused")), "snapshot_candidates")

    @cached_property
    def snapshots(self) -> DataFrame:
        return self._candidates.filter("refused is null").drop("refused")

    @cached_property
    def refusals(self) -> DataFrame:
        """(release, ns, segment, refused): versions that get no snapshot although they ask for one."""
        return self._candidates.filter("refused <> 'no version IRI'").select(*NS, "segment", "refused")

    def version_links(self) -> DataFrame:
        """(release, s, p, o): what ties a namespace to its snapshots."""
        base = self.snapshots.join(self.namespaces.select(*NS, F.concat("base_url", "mount").alias("base")), NS)
        links = F.array(
            F.struct(c("base").alias("s"), F.lit(DCTERMS + "hasVersion").alias("p"), c("url").alias("o")),
            F.struct(c("url").alias("s"), F.lit(DCTERMS + "isVersionOf").alias("p"), c("base").alias("o")),
            F.struct(c("url").alias("s"), F.lit(OWL + "versionInfo").alias("p"), c("segment").alias("o")),
        )
        return base.select("release", F.explode(links).alias("x")).select("release", "x.*")

    def versions_report(self) -> DataFrame:
        """(release, ns, policy, latest, latest_cache, snapshot_cache, versions, not_written)."""
        written = self.snapshots.groupBy(*NS).agg(F.array_sort(F.collect_set("segment")).alias("versions"))
        refused = self.refusals.groupBy(*NS).agg(F.count("*").alias("not_written"))
        rows = self.namespaces.join(self.config.select("release", c("snapshots").alias("policy")), "release").join(written, NS, "left").join(refused, NS, "left")
        return rows.select(*NS, "policy", F.concat("base_url", "mount").alias("latest"), F.lit(LATEST_CACHE).alias("latest_cache"), F.lit(SNAPSHOT_CACHE).alias("snapshot_cache"), F.coalesce("versions", F.array().cast("array<string>")).alias("versions"), F.coalesce("not_written", F.lit(0)).alias("not_written"))

    # manifest and routes

    @cached_property
    def manifest(self) -> DataFrame:
        """(release, ns, id, kind, doc_base, mount, layout, title, version, status, licence, reserved, versions, n_terms, n_directories, llms, cache, base_url): a row for each namespace; mount starts with /."""
        docs = self.m.documents.select("release", c("iri").alias("document"), F.lower("document_kind").alias("kind"), F.coalesce(pick_lang(c("title"), F.lit("en"))["value"], c("iri")).alias("title"), c("version_info").alias("version"), "version_iri", "status", c("license").alias("licence"))
        reserved = self.m.reserved.unionByName(self.snapshots.select(*NS, "segment")).groupBy(*NS).agg(F.array_sort(F.collect_set("segment")).alias("reserved"))
        versions = self.snapshots.groupBy(*NS).agg(F.array_sort(F.collect_set("segment")).alias("versions"))
        counts = self.terms.groupBy(*NS).agg(F.count("*").alias("n_terms"), F.count_if("in_directory").alias("n_directories"))
        rows = self.namespaces.join(docs, ["release", "document"], "left").join(reserved, NS, "left").join(versions, NS, "left").join(counts, NS, "left")
        none = F.array().cast("array<string>")
        return self.keep(
            rows.select(
                *NS,
                F.coalesce("prefix", F.replace(F.regexp_replace("mount", "/+$", ""), F.lit("/"), F.lit("-"))).alias("id"),
                F.coalesce("kind", F.lit("document")).alias("kind"),
                F.concat("base_url", "mount").alias("doc_base"),
                F.concat(F.lit("/"), "mount").alias("mount"),
                c("style").alias("layout"),
                "stem",
                "title",
                "version",
                "version_iri",
                "status",
                "licence",
                F.coalesce("reserved", none).alias("reserved"),
                F.coalesce("versions", none).alias("versions"),
                F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
                F.coalesce("n_directories", F.lit(0)).alias("n_directories"),
                F.concat("base_url", "mount", F.lit("llms.txt")).alias("llms"),
                F.lit(LATEST_CACHE).alias("cache"),
                "base_url",
            ),
            "manifest",
        )

    @cached_property
    def entries(self) -> DataFrame:
        """(release, ns, segment, iri_base, doc_base, mount, llms, cache, base_url): each namespace (segment '') and, mounted below it, each of its snapshots."""
        latest = self.manifest.select(*NS, F.lit("").alias("segment"), c("ns").alias("iri_base"), "doc_base", "mount", "llms", "cache", "base_url")
        snaps = self.snapshots.select(*NS, "segment", "url").join(self.manifest.select(*NS, "mount", "base_url"), NS)
        again = snaps.select(*NS, "segment", c("url").alias("iri_base"), c("url").alias("doc_base"), F.concat("mount", "segment", F.lit("/")).alias("mount"), F.concat("url", F.lit("llms.txt")).alias("llms"), F.lit(SNAPSHOT_CACHE).alias("cache"), "base_url")
        return self.keep(latest.unionByName(again), "entries")

    def snapshot_entries(self) -> DataFrame:
        return self.entries.filter("segment <> ''")

    @cached_property
    def addresses(self) -> DataFrame:
        """(release, ns, segment, local, media_type, rep_at, request, public, file, canonical, cache, style, mount, iri_base, llms, base_url): each representation of each term in each entry."""
        rows = self.entries.join(self.terms.select(*NS, "local", "style"), NS).crossJoin(representations(self.m.spark))
        request = request_path(c("mount"), c("local"), c("style"))
        public = public_path(c("mount"), c("local"), c("style"), c("extension"))
        file = F.regexp_replace(term_path(c("mount"), c("local"), c("style"), c("extension")), "^/+", "")
        origin = F.regexp_replace("base_url", "/+$", "")
        return rows.select(*NS, "segment", "local", "media_type", "rep_at", request.alias("request"), public.alias("public"), file.alias("file"), F.concat(origin, request).alias("canonical"), "cache", "style", "mount", "iri_base", "llms", "base_url")

    def route_table(self) -> DataFrame:
        """(release, request, media_type, action, target, status, cache): what each request for a term gets, by the type it asks for."""
        serve = c("media_type") == DEFAULT_TYPE
        return self.addresses.select("release", "request", "media_type", F.when(serve, "serve").otherwise("redirect").alias("action"), F.when(serve, c("file")).otherwise(c("public")).alias("target"), F.when(serve, 200).otherwise(STATUS).alias("status"), "cache")

    def path_case_collisions(self) -> DataFrame:
        """(release, folded, paths): files of a site whose paths differ by case only."""
        files = self.term_paths.select("release", "path").unionByName(self.document_paths().select("release", "path"))
        return files.groupBy("release", F.lower("path").alias("folded")).agg(F.array_sort(F.collect_set("path")).alias("paths")).filter(F.size("paths") > 1)

    def link_headers(self) -> DataFrame:
        """(release, ns, segment, local, media_type, link): the Link header of each representation: canonical, cite-as, alternates, describedby."""
        return self.linked().select(*NS, "segment", "local", "media_type", "link")

    def linked(self) -> DataFrame:
        """`addresses` with the Link header of each.

        References are relative to the request. The files of a term lie beside its page, and the index lies at the mount, so
        these references follow from the local name alone.
        """
        rows, in_dir = self.addresses, c("style") == "dir"
        origin = F.regexp_replace("base_url", "/+$", "")
        llms = F.when(F.startswith(c("llms"), origin), F.substr(c("llms"), F.length(origin) + 1)).otherwise(c("llms"))
        last = F.substring_index("local", "/", -1)
        own = F.when(in_dir | (last == ""), "./").otherwise(last)
        beside = lambda e: own if e == ".html" else F.concat(F.when(in_dir, "index").otherwise(last), F.lit(e))
        alternates = [F.when(c("media_type") != t, F.concat(F.lit("<"), beside(e), F.lit(f'>; rel="alternate"; type="{t}"'))) for _, t, e in REPRESENTATIONS]
        depth = F.regexp_count(F.when(in_dir, F.concat("local", F.lit("/"))).otherwise(c("local")), F.lit("[^/]+/"))
        index = F.when(c("llms_path") == F.concat("mount", F.lit("llms.txt")), F.concat(F.repeat(F.lit("../"), depth), F.lit("llms.txt"))).otherwise(I.relative_to(c("request"), c("llms_path")))
        parts = [
            F.concat(F.lit("<"), "canonical", F.lit('>; rel="canonical"')),
            F.concat(F.lit("<"), "iri_base", "local", F.lit('>; rel="cite-as"')),
            *alternates,
            F.concat(F.lit("<"), index, F.lit('>; rel="describedby"; type="text/plain"')),
        ]
        return rows.withColumn("llms_path", llms).withColumn("link", F.concat_ws(", ", *parts)).drop("llms_path")
