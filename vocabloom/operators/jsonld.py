"""JSON-LD: contexts, nodes written with them, and what is read back from the written text alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iri as I
from ..functions.text import jsonld_value, triple_signature
from ..vocabulary import RDF, TYPE, XSD
from .blanks import labelled
from .model import KEY, Model, large

#: Statements of a node beyond so many go into further objects of the same @id.
MOST_VALUES = 10_000
EXAMPLES = 3
_PLAIN = XSD + "string"
c = F.col


def prefixes(m: Model) -> DataFrame:
    """(release, prefix, ns): the prefixes of a release's context: declared ones, and xsd if none has that name."""
    if "jsonld_prefixes" not in m.made:
        m.made["jsonld_prefixes"] = m.keep(_prefixes(m), "jsonld_prefixes")
    return m.made["jsonld_prefixes"]


def _prefixes(m: Model) -> DataFrame:
    releases = m.prefix_map.select("release").distinct()
    lacking = releases.join(m.prefix_map.filter("prefix = 'xsd'").select("release"), "release", "left_anti")
    return m.prefix_map.select("release", "prefix", "ns").unionByName(lacking.select("release", F.lit("xsd").alias("prefix"), F.lit(XSD).alias("ns")))


def shortened(m: Model, rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` with each IRI column's prefix:local in a column `<name>_short`; IRIs without a prefix stay whole."""
    names = prefixes(m).groupBy("release", "ns").agg(F.min("prefix").alias("_prefix"))
    for name in columns:
        known = names.withColumnRenamed("ns", "_ns")
        rows = rows.withColumn("_ns", I.namespace_part(c(name))).join(known, ["release", "_ns"], "left")
        rows = rows.withColumn(f"{name}_short", F.coalesce(F.concat("_prefix", F.lit(":"), I.local_part(c(name))), c(name))).drop("_ns", "_prefix")
    return rows


def context(m: Model, terms: DataFrame | None = None) -> DataFrame:
    """(release, iri, key, coercion): the name of each term in its release's context, and how its values are read.

    terms: some of the terms, all of one local name or none of them; all terms unless given.

    A term's key is its local name, if no other has it first (local terms do, then by IRI), else its short form. Only a
    declared range earns a coercion: @id for object properties, and for other properties of one range that datatype's
    short form, or @id where it isn't a datatype.
    """
    order = Window.partitionBy("release", "local_name").orderBy("foreign", "iri")
    rows = (m.terms if terms is None else terms).filter("local_name <> ''").withColumn("n", F.row_number().over(order))
    ranges = F.concat("range", "range_includes")
    rows = rows.withColumn("only", F.when((F.size(ranges) == 1) & c("kind").isin("DatatypeProperty", "RdfProperty", "AnnotationProperty"), F.get(ranges, 0)))
    rows = shortened(m, rows, "only")
    datatype = c("only").startswith(XSD) | (c("only") == RDF + "langString")
    coercion = F.when((c("kind") == "ObjectProperty") | (c("only").isNotNull() & ~datatype), "@id").otherwise(c("only_short"))
    return rows.select(*KEY, F.when(c("n") == 1, c("local_name")).otherwise(F.coalesce("curie", "iri")).alias("key"), coercion.alias("coercion"))


def context_entries(m: Model) -> DataFrame:
    """`context`, stored once for a model."""
    if "jsonld_context" not in m.made:
        m.made["jsonld_context"] = m.keep(context(m), "jsonld_context")
    return m.made["jsonld_context"]


def entries_of(m: Model, words: DataFrame) -> DataFrame:
    """The entries of `context`, and maybe others, whose IRI or key is one of words (release, word).

    The local name of such an entry is an end of its IRI and of its key, and which of the terms of a local name has it as its
    key depends on these alone. So the other terms, most of them things that statements are about, aren't made.
    """
    if "jsonld_context" in m.made:
        return m.made["jsonld_context"]
    ends = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring("word", i, F.length("word")))
    names = m.keep(words.distinct().select("release", F.explode(ends).alias("local_name")).distinct(), "jsonld_names")
    return m.keep(context(m, m.terms_named(names)), "jsonld_entries")


def statements(m: Model) -> DataFrame:
    """The statements of local terms and of blank nodes, whose labels are stable."""
    if "jsonld_statements" not in m.made:
        own = m.near_statements.join(large(m.local.select("release", c("iri").alias("s"))), ["release", "s"], "left_semi")
        some = own.unionByName(m.quads.filter("s_kind = 'bnode'"))
        m.made["jsonld_statements"] = m.keep(labelled(m.quads, m.keep, some), "jsonld_statements")
    return m.made["jsonld_statements"]


def _text(value: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _folded(pairs: Column) -> Column:
    """Sorted (key, value) pairs as members of a JSON object; several values of one key are an array."""

    def member(key: Column) -> Column:
        own = F.transform(F.filter(pairs, lambda x: x["key"] == key), lambda x: x["value"])
        return F.concat(_text(key), F.lit(":"), F.when(F.size(own) == 1, F.get(own, 0)).otherwise(F.concat(F.lit("["), F.array_join(own, ","), F.lit("]"))))

    return F.array_join(F.transform(F.array_distinct(F.transform(pairs, lambda x: x["key"])), member), ",")


def nodes(m: Model, most: int = MOST_VALUES) -> DataFrame:
    """(release, id, part, json): a JSON object for each local term and blank node, keyed by the context of its release.

    Values take the shortest form that the context makes safe: numbers and booleans as such, IRIs and typed values as
    strings where the key is coerced so, else objects with @id, @language or @type. Keys and values are in order, and equal
    statements are one. A node of more than `most` statements is dealt to several objects by the hash of its statements.
    """
    entries = entries_of(m, statements(m).select("release", c("p").alias("word")))
    rows = statements(m).join(entries.withColumnRenamed("iri", "p"), ["release", "p"], "left")
    rows = shortened(m, rows.withColumn("_iri", F.when(c("o_kind") == "iri", c("o"))), "p", "_iri", "dt")
    value = jsonld_value(c("o"), c("o_kind"), c("lang"), c("dt"), c("_iri_short"), c("coercion"), F.coalesce("dt_short", F.lit("xsd:string")))
    is_type = (c("p") == TYPE) & (c("o_kind") == "iri")
    pair = F.struct(F.when(is_type, "@type").otherwise(F.coalesce("key", "p_short")).alias("key"), F.when(is_type, _text(c("_iri_short"))).otherwise(value).alias("value"))
    rows = rows.select("release", "s", "s_kind", pair.alias("pair"))
    large = m.keep(statements(m).groupBy("release", "s").count().filter(c("count") > most), "large_nodes")
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        dealt = rows.join(large, ["release", "s"], "left").withColumn("_parts", F.coalesce(F.ceil(c("count") / most), F.lit(1)))
        rows = dealt.withColumn("part", F.pmod(F.xxhash64("pair"), c("_parts")).cast("int"))
    made = rows.groupBy("release", "s", "s_kind", "part").agg(F.array_sort(F.collect_set("pair")).alias("pairs"))
    made = shortened(m, made.withColumn("_id", F.when(c("s_kind") == "iri", c("s"))), "_id")
    name = F.coalesce("_id_short", F.concat(F.lit("_:"), "s"))
    return made.select("release", F.coalesce("_id", F.concat(F.lit("_:"), "s")).alias("id"), "part", F.concat(F.lit('{"@id":'), _text(name), F.lit(","), _folded(c("pairs")), F.lit("}")).alias("json"))


def _lengthened(m: Model, rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` with prefix:local in place of its IRI, where a context has the prefix."""
    names = prefixes(m).withColumnsRenamed({"prefix": "_prefix", "ns": "_ns"})
    for name in columns:
        head = F.regexp_extract(c(name), "^([^:/]*):(?!//)", 1)
        rows = rows.withColumn("_prefix", F.when(c(name).rlike("^[^:/]*:(?!//)") & (head != "_"), head)).join(names, ["release", "_prefix"], "left")
        tail = F.substring(c(name), F.length("_prefix") + 2, F.length(name))
        rows = rows.withColumn(name, F.coalesce(F.concat("_ns", tail), c(name))).drop("_prefix", "_ns")
    return rows


def expanded(m: Model, written: DataFrame) -> DataFrame:
    """(release, s, s_kind, p, o, o_kind, lang, dt): the statements that nodes (release, json) state, read from their text and the context."""
    spark = written.sparkSession
    members = spark.sql("SELECT release, x.key, x.value, v FROM (SELECT release, parse_json(json) AS v FROM {nodes}), LATERAL variant_explode(v) AS x", nodes=written)
    members = members.select("release", F.expr("variant_get(v, '$[\"@id\"]', 'string')").alias("s"), "key", "value").filter("key <> '@id'")
    as_list = F.expr("CASE WHEN schema_of_variant(value) LIKE 'ARRAY%' THEN value ELSE parse_json('[' || to_json(value) || ']') END")
    each = spark.sql("SELECT release, s, name AS key, x.value FROM {members}, LATERAL variant_explode(list) AS x", members=members.select("release", "s", c("key").alias("name"), as_list.alias("list")))
    inner = lambda name: F.expr(f"try_variant_get(value, '$[\"{name}\"]', 'string')")
    entries = entries_of(m, written.select("release", F.explode(F.json_object_keys("json")).alias("word")))
    each = each.withColumn("_kind", F.expr("schema_of_variant(value)")).join(entries.select("release", "key", c("iri").alias("_p"), "coercion"), ["release", "key"], "left")
    text, native = F.expr("variant_get(value, '$', 'string')"), F.when(c("_kind") == "BOOLEAN", XSD + "boolean").when(~c("_kind").isin("STRING", "BOOLEAN") & ~c("_kind").startswith("OBJECT"), XSD + "integer")
    is_object, is_type = c("_kind").startswith("OBJECT"), c("key") == "@type"
    points = is_type | (is_object & inner("@id").isNotNull()) | ((c("_kind") == "STRING") & c("coercion").eqNullSafe("@id"))
    typed = F.when(is_object, inner("@type")).otherwise(F.coalesce(F.when(c("coercion") != "@id", c("coercion")), native))
    each = each.select(
        "release",
        "s",
        F.when(is_type, TYPE).otherwise(F.coalesce("_p", "key")).alias("p"),
        F.when(is_object, F.coalesce(inner("@id"), inner("@value"))).otherwise(text).alias("o"),
        points.alias("_points"),
        F.when(is_object, inner("@language")).alias("lang"),
        F.when(~points, typed).alias("dt"),
    )
    own = _lengthened(m, each, "p", "dt", "s")
    links = _lengthened(m, own.filter("_points"), "o")
    kind = lambda x: F.when(c(x).startswith("_:"), "bnode").otherwise("iri")
    whole = links.withColumn("o_kind", kind("o")).unionByName(own.filter("not _points").withColumn("o_kind", F.lit("literal")))
    bare = lambda x, blank: F.when(blank, F.substring(c(x), 3, F.length(x))).otherwise(c(x))
    whole = whole.withColumn("s_kind", kind("s"))
    return whole.select("release", bare("s", c("s_kind") == "bnode").alias("s"), "s_kind", "p", bare("o", c("o_kind") == "bnode").alias("o"), "o_kind", "lang", "dt")


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(release, written, read, lost, invented, lost_examples, invented_examples): two sets of statements by their signatures.

    A signature has kind, datatype and language of its object, and blank nodes without labels. Up to EXAMPLES of what is
    lost or invented are given, the least ones; they are found by bucket first, so no task has all of a release.
    """
    sign = triple_signature(*(c(x) for x in ("s", "s_kind", "p", "o", "o_kind", "lang", "dt")))
    both = ours.select("release", sign.alias("sign"), F.lit(1).alias("w"), F.lit(0).alias("r")).unionByName(theirs.select("release", sign.alias("sign"), F.lit(0).alias("w"), F.lit(1).alias("r")))
    one = both.groupBy("release", "sign").agg(F.max("w").alias("w"), F.max("r").alias("r"))
    counts = one.groupBy("release").agg(F.sum("w").cast("long").alias("written"), F.sum("r").cast("long").alias("read"), F.count_if(c("r") == 0).alias("lost"), F.count_if(c("w") == 0).alias("invented"))
    odd = one.filter("w <> r").withColumn("_bucket", F.pmod(F.xxhash64("sign"), F.lit(64)))
    first = lambda by: Window.partitionBy(*by).orderBy("sign")
    odd = odd.withColumn("_nth", F.row_number().over(first(["release", "w", "_bucket"]))).filter(c("_nth") <= EXAMPLES)
    odd = odd.withColumn("_nth", F.row_number().over(first(["release", "w"]))).filter(c("_nth") <= EXAMPLES)
    told = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(c("w") == side, c("sign")))), "; ")
    examples = odd.groupBy("release").agg(told(1).alias("lost_examples"), told(0).alias("invented_examples"))
    return counts.join(examples, "release", "left").fillna("", ["lost_examples", "invented_examples"])


def roundtrip(m: Model) -> DataFrame:
    """`compared` of the statements of local terms and blank nodes and what is read back from the text of their nodes."""
    return compared(statements(m), expanded(m, m.keep(nodes(m), "jsonld_nodes")))
