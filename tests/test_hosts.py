"""What hosts can serve of a small site."""

import re
from types import SimpleNamespace

from vocabloom.operators import hosts

KINDS = [("all", True, True, "term", True, True, True, None), ("rules", True, False, "namespace", True, True, True, 2), ("single", True, True, "term", False, None, False, None), ("files", False, False, "none", True, True, True, None)]


def _site(spark, terms, manifest):
    terms = spark.createDataFrame(terms, "release string, ns string, iri string, local string, style string")
    manifest = spark.createDataFrame(manifest, "release string, ns string, mount string, layout string, reserved array<string>, versions array<string>, n_terms long")
    return SimpleNamespace(terms=terms, manifest=manifest)


def test_hosts_over_a_small_site(spark):
    terms = [("r", "a#", "a#x.y", "x.y", "flat"), ("r", "a#", "a#index", "index", "dir"), ("r", "d/", "d/1", "1", "dir")]
    terms += [("r", "b/", f"b/{i}", str(i), "flat") for i in range(3)]
    site = _site(spark, terms, [("r", "a#", "/a/", "flat", [], [], 2), ("r", "b/", "/b/", "flat", ["1.0", "old"], ["1.0"], 3), ("r", "d/", "/d/", "dir", [], [], 1), ("r", "e/", "/e/", "flat", [], [], 0)])
    kinds = spark.createDataFrame(KINDS, hosts.HOSTS)
    got = {(r.host, r.limit, r.ns): r.affected for r in hosts.host_limits(site, kinds).collect()}
    assert not [k for k in got if k[0] == "all" or k[2] == "e/"]
    assert {k: n for k, n in got.items() if k[0] == "single"} == {("single", "one layout", "a#"): 1, **{("single", "one representation", ns): n for ns, n in (("a#", 2), ("b/", 3), ("d/", 1))}, ("single", "no snapshots", "b/"): 1}
    assert {k[1] for k in got if k[0] == "rules"} == {"no ranking by quality", "Link headers by namespace", "names not listed"}
    assert [k[2] for k in got if k[1] == "names not listed"] == ["b/"]
    assert {k[1] for k in got if k[0] == "files"} == {"no negotiation", "no Link headers"}
    # a term in a directory is no exception where all are
    assert list(map(tuple, hosts.host_exceptions(site, kinds).collect())) == [("r", "single", "a#", "a#index", "/a/index/", "/a/")]

    rules = {r.ns: r for r in hosts.term_rules(site, kinds).collect()}
    assert {ns: (r.host, r.listed) for ns, r in rules.items()} == {"a#": ("rules", True), "b/": ("rules", False), "d/": ("rules", True)}
    fits = lambda ns, name: bool(re.fullmatch(rules[ns].pattern, name))
    assert fits("a#", "x.y") and fits("a#", "index") and not fits("a#", "xzy") and not fits("a#", "x")
    assert fits("b/", "7") and fits("b/", "older") and not fits("b/", "old") and not fits("b/", "1.0") and not fits("b/", "7.ttl")


def test_hosts_of_nothing(spark):
    kinds = spark.createDataFrame(KINDS, hosts.HOSTS)
    empty, one = _site(spark, [], []), _site(spark, [("r", "a#", "a#x", "x", "flat")], [("r", "a#", "/a/", "flat", [], [], 1)])
    for find in (hosts.host_limits, hosts.host_exceptions, hosts.term_rules):
        assert find(empty, kinds).count() == 0 and find(one, kinds.limit(0)).count() == 0
