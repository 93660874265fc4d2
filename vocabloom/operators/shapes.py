"""SHACL shapes as tables: a row for each constraint that a shape puts on a property. Shapes are described here, nothing is validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iri as I
from ..functions import text
from ..vocabulary import OWL, RDF, RDFS, SH, SKOS, TYPE
from .model import Model, iri_set, large

# How many nodes deep schemes are looked for.
SCHEME_DEPTH = 4
c = F.col


def _first_literal(name: str) -> Column:
    """Aggregate: the first literal of a predicate."""
    return F.min_by("o", F.when((c("p") == SH + name) & (c("o_kind") == "literal"), c("seq")))


def _count(name: str) -> Column:
    return _first_literal(name).try_cast("long")


def rdf_lists(m: Model, heads: DataFrame, most_rounds: int = 1_000) -> DataFrame:
    """(release, head, nth, member, member_kind): the members of the collections that start at `heads` (release, head), in order.

    All lists are walked together, two steps' length more each round: links are doubled, so a list of n members takes
    log2(n) rounds of joins. A list that comes back to a node ends there.
    """
    facts = m.shape_statements.filter(c("p").isin(RDF + "first", RDF + "rest"))
    links = facts.groupBy("release", c("s").alias("node")).agg(
        F.min_by(F.struct("o", "o_kind"), F.when(c("p") == RDF + "first", c("seq"))).alias("first"),
        F.min_by(F.when(c("o_kind") != "literal", c("o")), F.when(c("p") == RDF + "rest", c("seq"))).alias("next"),
    )
    cells = m.keep(links, "list_cells")
    jump = cells.filter(c("next").isNotNull() & (c("next") != RDF + "nil")).select("release", "node", c("next").alias("to"))
    reached = heads.select("release", "head", c("head").alias("node"), F.lit(0).cast("long").alias("nth"))
    span = 1
    for n in range(most_rounds):
        more = reached.join(jump, ["release", "node"]).select("release", "head", c("to").alias("node"), (c("nth") + span).alias("nth"))
        both = reached.unionByName(more).groupBy("release", "head", "node").agg(F.min("nth").alias("nth"))
        both = m.keep(both, f"list_nodes{n}")
        if both.count() == reached.count():
            break
        reached, span = both, span * 2
        twice = jump.withColumnRenamed("to", "via").join(jump.select("release", c("node").alias("via"), "to"), ["release", "via"])
        jump = m.keep(twice.select("release", "node", "to"), f"list_jumps{n}")
    found = reached.join(cells, ["release", "node"]).filter("first is not null")
    return found.select("release", "head", "nth", c("first.o").alias("member"), c("first.o_kind").alias("member_kind"))


def members_of(m: Model, predicate: str) -> DataFrame:
    """(release, node, head_at, nth, member, member_kind): for each subject the lists that a predicate of SHACL names, in order."""
    links = m.shape_statements.filter((c("p") == predicate) & (c("o_kind") != "literal")).select("release", c("s").alias("node"), c("o").alias("head"), c("seq").alias("head_at"))
    return links.join(rdf_lists(m, links.select("release", "head").distinct()), ["release", "head"]).select("release", "node", "head_at", "nth", "member", "member_kind")


def shape_subjects(m: Model) -> DataFrame:
    """(release, shape): named subjects that are node shapes, or constrain or target something."""
    declared = (c("p") == TYPE) & (c("o") == SH + "NodeShape") & (c("o_kind") == "iri")
    return m.named.filter(declared | c("p").isin([SH + x for x in ("property", "targetClass", "targetSubjectsOf", "targetObjectsOf")])).select("release", c("s").alias("shape")).distinct()


def paths(m: Model) -> DataFrame:
    """(release, node, path_kind, path): what each constraint is on: a predicate, an inverse, or the text of a chain."""
    first = m.shape_statements.filter(c("p") == SH + "path").groupBy("release", c("s").alias("node")).agg(F.min_by(F.struct("o", "o_kind"), "seq").alias("x")).select("release", "node", "x.*")
    blank = first.filter("o_kind = 'bnode'")
    inverse = m.shape_statements.filter((c("p") == SH + "inversePath") & (c("o_kind") == "iri")).groupBy("release", "s").agg(F.min("o").alias("inverse")).withColumnRenamed("s", "o")
    chain = rdf_lists(m, blank.select("release", c("o").alias("head")).distinct()).withColumn("name", F.when(c("member_kind") == "literal", "?").when(c("member_kind") == "bnode", F.concat(F.lit("_:"), "member")).otherwise(c("member")))
    chain = chain.groupBy("release", c("head").alias("o")).agg(F.array_sort(F.collect_list(F.struct("nth", "name"))).alias("names"))
    joined = first.join(inverse, ["release", "o"], "left").join(chain, ["release", "o"], "left")
    kind = F.when(c("o_kind") == "iri", "predicate").when(c("o_kind") == "bnode", F.when(c("inverse").isNotNull(), "inverse").otherwise("complex"))
    words = F.array_join(F.transform("names", lambda x: x["name"]), " / ")
    path = F.when(kind == "predicate", c("o")).when(kind == "inverse", c("inverse")).when(kind == "complex", F.coalesce(words, F.lit("a path expression")))
    return joined.select("release", "node", kind.alias("path_kind"), path.alias("path"))


def nested_schemes(m: Model) -> DataFrame:
    """(release, node, scheme): schemes that the inner shapes of a node require, up to SCHEME_DEPTH nodes deep."""
    inner = m.shape_statements.filter(c("p") == SH + "property").select("release", "s", c("o").alias("node"))
    on_scheme = paths(m).filter((c("path_kind") == "predicate") & (c("path") == SKOS + "inScheme")).select("release", "node")
    values = m.shape_statements.filter((c("p") == SH + "hasValue") & (c("o_kind") == "iri")).select("release", c("s").alias("node"), c("o").alias("scheme"))
    asked = m.keep(inner.join(on_scheme, ["release", "node"]).join(values, ["release", "node"]).select("release", c("s").alias("at"), "scheme").distinct(), "asked_schemes")
    steps = m.shape_statements.filter((c("p") == SH + "node") & (c("o_kind") != "literal")).select("release", c("s").alias("at"), c("o").alias("to"))
    here = steps.select("release", c("at").alias("node"), c("to").alias("at")).distinct()
    found = here.join(asked, ["release", "at"]).select("release", "node", "scheme")
    for _ in range(SCHEME_DEPTH - 1):
        here = here.join(steps, ["release", "at"]).select("release", "node", c("to").alias("at")).distinct()
        found = found.unionByName(here.join(asked, ["release", "at"]).select("release", "node", "scheme"))
    return found.distinct()


def or_datatypes(m: Model) -> DataFrame:
    """(release, node, datatypes): those of the alternatives of each constraint."""
    parts = members_of(m, SH + "or").filter("member_kind <> 'literal'").select("release", "node", c("member").alias("s"))
    kinds = m.shape_statements.filter((c("p") == SH + "datatype") & (c("o_kind") == "iri")).select("release", "s", "o")
    return parts.join(kinds, ["release", "s"]).groupBy("release", "node").agg(F.array_sort(F.collect_set("o")).alias("or_datatypes"))


def constraints(m: Model) -> DataFrame:
    """The constraints of a model, made when first asked for."""
    if "constraints" not in m.made:
        m.made["constraints"] = m.keep(_constraints(m), "constraints")
    return m.made["constraints"]


def _constraints(m: Model) -> DataFrame:
    """A row for each constraint of a named shape: release, shape, node, path_kind, path, name, description, datatypes, classes,
    node_kind, min_count, max_count, values (sh:in, in order), has_value, pattern, in_scheme, inner (sh:node), severity,
    deactivated, cardinality, required."""
    links = m.shape_statements.filter((c("s_kind") == "iri") & (c("p") == SH + "property") & (c("o_kind") != "literal")).select("release", c("s").alias("shape"), c("o").alias("node"), c("seq").alias("listed"))
    first_iri = lambda name: F.min(F.when((c("p") == SH + name) & (c("o_kind") == "iri"), c("o")))
    facts = m.shape_statements.filter(c("p").startswith(SH)).join(links.select("release", c("node").alias("s")).distinct(), ["release", "s"], "left_semi").groupBy("release", c("s").alias("node")).agg(
        _first_literal("name").alias("name"),
        _first_literal("description").alias("description"),
        iri_set(c("p") == SH + "datatype").alias("own_datatypes"),
        iri_set(c("p") == SH + "class").alias("classes"),
        first_iri("nodeKind").alias("node_kind"),
        _count("minCount").alias("min_count"),
        _count("maxCount").alias("max_count"),
        F.array_sort(F.collect_list(F.when(c("p") == SH + "hasValue", F.struct("seq", F.when(c("o_kind") == "bnode", F.concat(F.lit("_:"), "o")).otherwise(c("o")).alias("v"))))).alias("has"),
        _first_literal("pattern").alias("pattern"),
        first_iri("node").alias("inner"),
        first_iri("severity").alias("severity"),
        F.coalesce(_first_literal("deactivated") == "true", F.lit(False)).alias("deactivated"),
    )
    listed = members_of(m, SH + "in").withColumn("v", F.when(c("member_kind") == "bnode", F.concat(F.lit("_:"), "member")).otherwise(c("member")))
    listed = listed.groupBy("release", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("head_at", "nth", "v"))), lambda x: x["v"]).alias("values"))
    schemes = nested_schemes(m).groupBy("release", "node").agg(F.array_sort(F.collect_set("scheme")).alias("in_scheme"))
    none = F.array().cast("array<string>")
    whole = links.join(facts, ["release", "node"], "left")
    for part in (paths(m), listed, schemes, or_datatypes(m)):
        whole = whole.join(part, ["release", "node"], "left")
    full = lambda name: F.coalesce(name, none)
    out = whole.select(
        "release", "shape", "node", "listed", "path_kind", "path", "name", "description",
        F.array_sort(F.array_union(full("own_datatypes"), full("or_datatypes"))).alias("datatypes"), full("classes").alias("classes"), "node_kind", "min_count", "max_count", full("values").alias("values"),
        F.coalesce(F.transform("has", lambda x: x["v"]), none).alias("has_value"), "pattern", full("in_scheme").alias("in_scheme"), "inner", "severity", F.coalesce("deactivated", F.lit(False)).alias("deactivated"),
        text.cardinality(c("min_count"), c("max_count")).alias("cardinality"), text.required(c("min_count")).alias("required"),
    )
    return out


def applies_to(m: Model) -> DataFrame:
    """(release, shape, class): target classes, shapes that are classes themselves, and domains of the properties whose subjects are targets."""
    direct = m.named.filter((c("p") == SH + "targetClass") & (c("o_kind") == "iri")).select("release", c("s").alias("shape"), c("o").alias("class"))
    classes = m.named.filter((c("p") == TYPE) & c("o").isin(OWL + "Class", RDFS + "Class")).select("release", c("s").alias("shape"))
    implicit = shape_subjects(m).join(classes, ["release", "shape"], "left_semi").select("release", "shape", c("shape").alias("class"))
    targets = m.named.filter((c("p") == SH + "targetSubjectsOf") & (c("o_kind") == "iri")).select("release", c("s").alias("shape"), c("o").alias("iri"))
    domains = targets.join(m.terms.select("release", "iri", F.explode("domain").alias("class")), ["release", "iri"]).select("release", "shape", "class")
    return direct.unionByName(implicit).unionByName(domains).distinct()


def node_shapes(m: Model) -> DataFrame:
    """(release, shape, targets by kind, closed, applies_to, n_constraints): shapes that constrain something, or target classes or subjects."""
    own = m.named.join(shape_subjects(m).withColumnRenamed("shape", "s"), ["release", "s"], "left_semi").groupBy("release", c("s").alias("shape")).agg(
        *(iri_set(c("p") == SH + p).alias(n) for n, p in TARGETS.items()),
        F.min_by("o", F.when((c("p") == SH + "closed") & (c("o_kind") == "literal"), c("seq"))).alias("closed"),
    )
    counts = constraints(m).groupBy("release", "shape").agg(F.count("*").alias("n_constraints"))
    classes = applies_to(m).groupBy("release", "shape").agg(F.array_sort(F.collect_set("class")).alias("applies_to"))
    whole = own.join(counts, ["release", "shape"], "left").join(classes, ["release", "shape"], "left")
    kept = whole.filter((F.coalesce("n_constraints", F.lit(0)) > 0) | (F.size("target_classes") > 0) | (F.size("target_subjects_of") > 0))
    closed = F.when(c("closed") == "true", True).when(c("closed") == "false", False)
    return kept.select("release", "shape", *TARGETS, closed.alias("closed"), F.coalesce("applies_to", F.array().cast("array<string>")).alias("applies_to"), F.coalesce("n_constraints", F.lit(0)).alias("n_constraints"))


# How a shape finds what it is about.
TARGETS = {"target_classes": "targetClass", "target_subjects_of": "targetSubjectsOf", "target_objects_of": "targetObjectsOf", "target_nodes": "targetNode"}


def ordered(rows: DataFrame) -> DataFrame:
    """Constraints with their place in their shape: required ones first, then by name and path."""
    order = Window.partitionBy("release", "shape").orderBy(~c("required"), c("name").asc_nulls_first(), c("path").asc_nulls_first(), "listed")
    return rows.withColumn("place", F.row_number().over(order))


def short_forms(m: Model, rows: DataFrame, column: str) -> DataFrame:
    """(…, short): an IRI column's prefix:local, else the IRI."""
    names = m.prefix_of.select("release", c("ns").alias("_ns"), "declared")
    known = rows.withColumn("_ns", I.namespace_part(c(column))).join(names, ["release", "_ns"], "left")
    return known.withColumn("short", F.coalesce(I.curie(c(column), c("declared")), c(column))).drop("_ns", "declared")


def record_template(m: Model) -> DataFrame:
    """(release, shape, place, name, path, cardinality, required, value_type, in_scheme, values, pattern, description, deactivated): a row for each field of a shape."""
    rows = m.keep(ordered(constraints(m)), "ordered_constraints")
    key = ["release", "shape", "place"]
    each = rows.select(*key, F.posexplode(F.concat("datatypes", "classes")).alias("at", "iri"))
    types = short_forms(m, each, "iri").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "short"))), lambda x: x["short"]), " or ").alias("types"))
    path = short_forms(m, rows.filter("path_kind in ('predicate', 'inverse')").select(*key, "path"), "path").select(*key, "short")
    named = m.terms_of(rows.filter("path_kind = 'predicate'").select("release", c("path").alias("iri")).dropna())  # no other path is shown by its label
    labels = large(named.select("release", c("iri").alias("path"), text.pick_lang(c("labels"), F.lit("en"))["value"].alias("label")))
    whole = rows.join(types, key, "left").join(path, key, "left").join(labels, ["release", "path"], "left")
    kind = I.local_name(c("node_kind"))
    # Node kinds in words.
    words = {"IRI": "IRI", "Literal": "literal", "BlankNode": "blank node", "IRIOrLiteral": "IRI or literal"}
    in_words = F.coalesce(F.create_map(*(F.lit(x) for pair in words.items() for x in pair))[kind], kind)
    shown = F.when(c("path_kind") == "inverse", F.concat(F.lit("inverse of "), "short")).otherwise(F.coalesce("short", "path", F.lit("")))
    name = F.coalesce("name", F.when(c("path_kind") == "predicate", F.coalesce("label", I.local_name(c("path")))), shown)
    return whole.select(*key, name.alias("name"), shown.alias("path"), "cardinality", "required", F.coalesce("types", in_words, F.lit("")).alias("value_type"), "in_scheme", "values", "pattern", "description", "deactivated")


def targeting(m: Model) -> DataFrame:
    """(release, shape, targeting): what each shape is about, in words."""
    shapes = m.keep(node_shapes(m), "node_shapes")
    marked = lambda kind: F.transform(kind, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("iri")))
    each = shapes.select("release", "shape", F.explode(F.concat(*map(marked, list(TARGETS)[:3]))).alias("x")).select("release", "shape", "x.*")
    named = short_forms(m, each, "iri").groupBy("release", "shape").agg(F.array_sort(F.collect_list(F.struct("kind", "at", "short"))).alias("all"))
    of = lambda kind: F.transform(F.filter("all", lambda x: x["kind"] == kind), lambda x: x["short"])
    classes = F.when(F.size("target_classes") > 0, F.concat(F.lit("instances of "), F.array_join(of("target_classes"), ", ")))
    subjects = F.transform(of("target_subjects_of"), lambda x: F.concat(F.lit("anything with a "), x, F.lit(" statement")))
    objects = F.transform(of("target_objects_of"), lambda x: F.concat(F.lit("the values of "), x))
    nodes = F.when(F.size("target_nodes") > 0, F.concat(F.size("target_nodes").cast("string"), F.lit(" named nodes")))
    none = F.array().cast("array<string>")
    parts = F.array_compact(F.concat(F.array(classes), F.coalesce(subjects, none), F.coalesce(objects, none), F.array(nodes)))
    words = F.when(F.size(parts) == 0, "nothing on its own; it is used by another shape").otherwise(F.array_join(parts, "; "))
    return shapes.join(named, ["release", "shape"], "left").select("release", "shape", words.alias("targeting"))


def shapes_for_class(m: Model) -> DataFrame:
    """(release, class, shapes): the shapes that describe each class, by name."""
    return node_shapes(m).select("release", "shape", F.explode("applies_to").alias("class")).groupBy("release", "class").agg(F.array_sort(F.collect_set("shape")).alias("shapes"))

