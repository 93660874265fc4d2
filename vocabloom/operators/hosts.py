"""What hosts of different kinds can serve of a site, as rows for each namespace.

`hosts` has a row for each kind of host, few of them: host; negotiates, does it look at Accept; ranks_quality, does it rank by q;
links, for what it sends Link headers (term, namespace or none); layouts, can terms of a namespace differ in layout; suffixes,
does each representation of a term have an address; versions, can snapshots be mounted; names, how many names a rule can list, null
where terms are looked up one by one. A null boolean is false. Without terms or hosts there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import NS, Layout, request_path

c = F.col
HOSTS = "host string, negotiates boolean, ranks_quality boolean, links string, layouts boolean, suffixes boolean, versions boolean, names int"
#: The path segments of a term below its mount, in a rule that lists no names.
ANY_NAME = "([^/?#.]+)"


def _can(name: str) -> Column:
    return F.coalesce(c(name), F.lit(False))


def _exceptions(layout: Layout) -> DataFrame:
    """Terms (release, ns, mount, iri, local, style) whose layout isn't their namespace's."""
    own = layout.manifest.select(*NS, "mount", "layout")
    return layout.terms.join(own, NS).filter(c("style") != c("layout")).drop("layout")


def host_limits(layout: Layout, hosts: DataFrame) -> DataFrame:
    """(release, host, limit, ns, affected): what a host can't do of what a namespace needs, and how many terms or snapshots that is about.

    A limit that is about nothing in a namespace has no row: a host with one layout serves a namespace of flat terms whole.
    """
    odd = _exceptions(layout).groupBy(*NS).agg(F.count("*").alias("odd"))
    needs = layout.manifest.select(*NS, "n_terms", F.size("versions").cast("long").alias("n_versions")).join(odd, NS, "left")
    # few hosts, and a row a namespace
    both = needs.crossJoin(hosts)
    limits = {
        "no negotiation": (~_can("negotiates"), c("n_terms")),
        "no ranking by quality": (_can("negotiates") & ~_can("ranks_quality"), c("n_terms")),
        "no Link headers": (c("links") == "none", c("n_terms")),
        "Link headers by namespace": (c("links") == "namespace", c("n_terms")),
        "one layout": (~_can("layouts"), c("odd")),
        "one representation": (~_can("suffixes"), c("n_terms")),
        "no snapshots": (~_can("versions"), c("n_versions")),
        "names not listed": (c("n_terms") > c("names"), c("n_terms")),
    }
    each = F.array(*(F.struct(F.lit(name).alias("limit"), F.when(holds, n).alias("affected")) for name, (holds, n) in limits.items()))
    return both.select("release", "host", "ns", F.explode(each).alias("x")).filter("x.affected > 0").select("release", "host", "x.limit", "ns", "x.affected")


def host_exceptions(layout: Layout, hosts: DataFrame) -> DataFrame:
    """(release, host, ns, iri, request, instead): the terms that a host with one layout sends to their namespace's document instead of their own path."""
    single = hosts.filter(~_can("layouts")).select("host")
    rows = _exceptions(layout).crossJoin(single)
    return rows.select("release", "host", "ns", "iri", request_path(c("mount"), c("local"), c("style")).alias("request"), c("mount").alias("instead"))


def term_rules(layout: Layout, hosts: DataFrame) -> DataFrame:
    """(release, host, ns, listed, pattern): the one rule for the terms of a namespace, of hosts whose rules are patterns.

    A namespace of at most `names` terms has them listed, and nothing else matches; a larger one has an open pattern that leaves
    out the reserved names and all that has an extension. So no rule has more than `names` names of terms, and larger
    namespaces are counted, never gathered.
    """
    ruled = hosts.filter("names is not null").select("host", "names")
    escape = lambda x: F.regexp_replace(x, r"([.+*?()\[\]{}^$|\\])", r"\\$1")
    sized = layout.manifest.filter("n_terms > 0").select(*NS, "n_terms", "reserved").crossJoin(ruled).withColumn("listed", c("n_terms") <= c("names"))
    small = sized.filter("listed").select(*NS).distinct()
    names = layout.terms.join(small, NS, "left_semi").groupBy(*NS).agg(F.array_sort(F.collect_list("local")).alias("locals"))
    among = lambda xs: F.array_join(F.transform(xs, escape), "|")
    left_out = F.when(F.size("reserved") > 0, F.concat(F.lit("(?!(?:"), among(c("reserved")), F.lit(")(?:/|$))"))).otherwise("")
    pattern = F.when(c("listed"), F.concat(F.lit("("), among(c("locals")), F.lit(")"))).otherwise(F.concat(left_out, F.lit(ANY_NAME)))
    return sized.join(names, NS, "left").select("release", "host", "ns", "listed", pattern.alias("pattern"))
