"""Views of a model: references, hierarchies, bounded descriptions, and what a page or an agent is told of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iri as I
from ..functions.text import oneline, pick_lang, rule_heading, summary, yaml_scalar
from ..vocabulary import DCTERMS, RDF, TYPE, XSD
from .jsonld import context_entries
from .layout import DEFAULT_TYPE, NS, Layout
from .model import KEY, TERM_KINDS, Model, large
from .spread import before

# No tree is deeper.
TREE_DEPTH = 9
# The names of representations.
LABELS = {"text/markdown": "Markdown", "text/turtle": "Turtle", "application/ld+json": "JSON-LD"}
AGENTS = {"creator": DCTERMS + "creator", "publisher": DCTERMS + "publisher", "contributor": DCTERMS + "contributor"}
c = F.col


def label(terms_labels: str = "labels"):
    return pick_lang(c(terms_labels), F.lit("en"))["value"]


def shown(m: Model, terms: DataFrame) -> DataFrame:
    """(release, iri, label, curie, anchor, foreign, kind) of terms and documents."""
    terms = terms.select(*KEY, F.coalesce(label(), "local_name").alias("label"), "curie", "anchor", "foreign", F.lit("term").alias("kind"))
    none = F.lit(None).cast("string")
    docs = m.documents.select(*KEY, F.coalesce(pick_lang(c("title"), F.lit("en"))["value"], c("iri")).alias("label"), none.alias("curie"), none.alias("anchor"), F.lit(False).alias("foreign"), F.lit("document").alias("kind"))
    return terms.unionByName(docs)


def references(m: Model, iris: DataFrame) -> DataFrame:
    """(release, iri, label, curie, anchor, foreign, kind) of any IRIs: a term's, else a document's, else the IRI's own."""
    found = iris.select(*KEY).distinct().join(large(shown(m, m.terms_among(iris))), KEY, "left")
    return found.select(*KEY, F.coalesce("label", I.local_name(c("iri"))).alias("label"), "curie", "anchor", F.coalesce("foreign", F.lit(True)).alias("foreign"), F.coalesce("kind", F.lit("external")).alias("kind"))


def hierarchy(m: Model) -> DataFrame:
    """(release, document, root, iri, depth, path): the concept tree, else the class tree, of each document; path has the labels from the root down."""
    members = m.local.filter("defined_in is not null").select("release", c("defined_in").alias("document"), "iri", "kind", F.coalesce(label(), "local_name").alias("label"), F.when(c("kind") == "Concept", c("broader")).otherwise(c("super_terms")).alias("parents"), "top_concept_of")
    kinds = members.groupBy("release", "document").agg(F.when(F.count_if(c("kind") == "Concept") > 0, "Concept").otherwise("Class").alias("pool"))
    pool = m.keep(members.join(kinds, ["release", "document"]).filter("kind = pool"), "tree_pool")
    inside = members.select("release", "document", c("iri").alias("parent"))
    links = pool.select("release", "document", "iri", "label", F.explode("parents").alias("parent"))
    held = links.join(inside, ["release", "document", "parent"], "left_semi").select("release", "document", "iri").distinct().withColumn("held", F.lit(True))
    free = (F.size("parents") == 0) | ((c("kind") == "Concept") & (F.size("top_concept_of") > 0))
    roots = pool.join(held, ["release", "document", "iri"], "left").filter(c("held").isNull() | free)
    level = roots.select("release", "document", c("iri").alias("root"), "iri", F.lit(0).alias("depth"), c("label").alias("path"))
    edges = links.join(pool.select("release", "document", c("iri").alias("parent")), ["release", "document", "parent"], "left_semi")
    found = [level]
    for depth in range(1, TREE_DEPTH + 1):
        up = level.select("release", "document", "root", c("iri").alias("parent"), c("path").alias("above"))
        level = m.keep(up.join(edges, ["release", "document", "parent"]).select("release", "document", "root", "iri", F.lit(depth).alias("depth"), F.concat("above", F.lit(" / "), "label").alias("path")), f"tree{depth}")
        if level.isEmpty():
            break
        found.append(level)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def bounded(m: Model) -> DataFrame:
    """(release, iri, node): for each named subject the blank nodes that its description reaches, each once."""
    blank = m.quads.filter("o_kind = 'bnode'")
    step = blank.filter("s_kind = 'bnode'").select("release", c("s").alias("node"), c("o").alias("to"))
    new = m.keep(blank.filter("s_kind = 'iri'").select("release", c("s").alias("iri"), c("o").alias("node")).distinct(), "bounded0")
    reached, n = new, 0
    while not new.isEmpty():
        n += 1
        more = new.join(step, ["release", "node"]).select("release", "iri", c("to").alias("node")).distinct()
        new = m.keep(more.join(reached, ["release", "iri", "node"], "left_anti"), f"bounded{n}")
        reached = reached.unionByName(new)
    return reached


def bounded_sizes(m: Model) -> DataFrame:
    """(release, iri, nodes, triples): how much describes each named subject that has blank nodes."""
    sizes = m.quads.groupBy("release", "s").agg(F.count("*").alias("n"))
    inner = bounded(m).join(sizes.withColumnRenamed("s", "node"), ["release", "node"], "left").groupBy(*KEY).agg(F.count("*").alias("nodes"), F.sum(F.coalesce("n", F.lit(0))).alias("inner"))
    return inner.join(sizes.withColumnRenamed("s", "iri"), KEY).select(*KEY, "nodes", (c("inner") + c("n")).alias("triples"))


def prefixes_needed(m: Model) -> DataFrame:
    """(release, iri, prefix): the prefixes that the statements of each local term need."""
    about = m.near_statements.join(large(m.local_placed.select("release", c("iri").alias("s"))), ["release", "s"], "left_semi")
    used = (c("s"), F.when(c("p") != TYPE, c("p")), F.when(c("o_kind") == "iri", c("o")), F.when(~c("dt").isin(XSD + "string", RDF + "langString"), c("dt")))
    spaces = about.select("release", c("s").alias("iri"), F.explode(F.array(*map(I.namespace_part, used))).alias("ns")).filter("ns is not null")
    return spaces.join(m.prefix_of, ["release", "ns"]).select(*KEY, c("declared").alias("prefix")).distinct()


def removed_terms(m: Model, old: str, new: str) -> DataFrame:
    """(namespace, iri, label, anchor): local terms of the old release that the new one lacks."""
    was = m.local.filter(c("release") == old).select("namespace", "iri", F.coalesce(label(), "local_name").alias("label"), "anchor")
    return was.join(large(m.local.filter(c("release") == new).select("iri")), "iri", "left_anti")


def changelog(changes: DataFrame) -> DataFrame:
    """(place, severity, rule, heading, iri): changes in the order of a change log."""
    rank = F.array_position(F.array(*map(F.lit, ("breaking", "additive", "editorial"))), c("severity"))
    sized = changes.groupBy("severity", "rule").agg(F.count("*").alias("n"))
    order = Window.partitionBy("severity", "rule").orderBy("iri", "detail")
    rows = changes.withColumn("place", F.row_number().over(order)).join(F.broadcast(sized), ["severity", "rule"])  # a row for each rule
    heading = F.concat(rule_heading(c("rule")), F.lit(" ("), c("n").cast("string"), F.lit(")"))
    return rows.select(rank.alias("rank"), "severity", "rule", heading.alias("heading"), "place", "iri")


def header_rows(m: Model) -> DataFrame:
    """Documents with the names of their agents by role, and their title and description in English, else as they come."""
    agents = None
    for role, predicate in AGENTS.items():
        own = m.agents(predicate).withColumn("role", F.lit(role))
        agents = own if agents is None else agents.unionByName(own)
    named = agents.groupBy(*KEY).agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("role") == r, F.struct("seq", F.coalesce("name", "agent").alias("n"))))), lambda x: x["n"]), ", ").alias(r) for r in AGENTS))
    first = lambda f: pick_lang(c(f), F.lit("en"))["value"]
    return m.documents.join(named, KEY, "left").withColumns({"title": first("title"), "description": first("description"), **{r: F.coalesce(r, F.lit("")) for r in AGENTS}})


def siblings(layout: Layout) -> DataFrame:
    """(release, ns, local, media_type, url, label): the other representations of each term."""
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return layout.term_paths.filter(c("media_type") != DEFAULT_TYPE).select(*NS, "local", "media_type", "url", names[c("media_type")].alias("label"))


def site_summary(layout: Layout) -> DataFrame:
    """(release, ns, title, n_terms, share): each namespace and its share of the release's terms."""
    whole = Window.partitionBy("release")
    return layout.manifest.select(*NS, F.coalesce("title", "ns").alias("title"), "n_terms", F.sum("n_terms").over(whole).alias("of_terms"), F.count("*").over(whole).alias("of_namespaces"))


def term_index(layout: Layout) -> DataFrame:
    """(release, iri, curie, kind, label, definition, deprecated, namespace, html, md, ttl): the flat index of local terms."""
    url = lambda kind: F.max(F.when(c("media_type") == kind, c("url")))
    urls = layout.term_paths.groupBy("release", c("ns").alias("namespace"), c("local").alias("local_name")).agg(url("text/html").alias("html"), url("text/markdown").alias("md"), url("text/turtle").alias("ttl"))
    terms = layout.m.local.select(*KEY, "curie", "kind", F.coalesce(label(), "local_name").alias("label"), summary(label("definitions")).alias("definition"), "deprecated", "namespace", "local_name")
    return large(terms).join(urls, ["release", "namespace", "local_name"]).drop("local_name")


def llms_lines(layout: Layout, max_terms: int = 500) -> DataFrame:
    """(release, ns, section, line, text): the index of each namespace for agents, line by line: title, IRI, number of terms, then all terms by kind.

    A namespace of more than `max_terms` terms also has a pointer to its page, before its terms.
    """
    head = layout.manifest.select(*NS, "title", "n_terms", "doc_base")
    lines = F.array(F.struct(F.lit(1).alias("line"), F.concat(F.lit("# "), F.coalesce("title", "ns")).alias("text")), F.struct(F.lit(2).alias("line"), F.concat(F.lit("IRI: "), "ns").alias("text")), F.struct(F.lit(3).alias("line"), F.concat(F.lit("Terms: "), c("n_terms").cast("string")).alias("text")))
    top = head.select(*NS, F.lit(0).alias("section"), F.explode(lines).alias("x")).select(*NS, "section", "x.line", "x.text")
    pointer = head.filter(c("n_terms") > max_terms).select(*NS, F.lit(0).alias("section"), F.lit(4).alias("line"), F.concat(F.lit("See "), "doc_base", F.lit("index.md for all terms.")).alias("text"))
    rank = F.array_position(F.array(*map(F.lit, TERM_KINDS)), c("kind")).cast("int")
    text = F.concat(F.lit("- ["), "label", F.lit("]("), "md", F.lit(")"), F.coalesce(F.concat(F.lit(": "), "definition"), F.lit("")))
    index = term_index(layout).withColumnRenamed("namespace", "ns").join(head.select(*NS), NS).select(*NS, rank.alias("section"), "label", "iri", text.alias("text"))
    body = before(index, [*NS, "section"], ["label", "iri"], "line", layout.m.keep)  # one kind of one namespace may hold nearly all terms
    return top.unionByName(pointer).unionByName(body.select(*NS, "section", (c("line") + 1).cast("int").alias("line"), "text"))


def llms_root(layout: Layout) -> DataFrame:
    """(release, line, text): the index of a site for agents, a line for each namespace in order."""
    order = Window.partitionBy("release").orderBy("ns")
    return layout.manifest.select("release", F.row_number().over(order).alias("line"), F.concat(F.lit("- ["), F.coalesce("title", "ns"), F.lit("]("), "llms", F.lit("): "), c("n_terms").cast("string"), F.lit(" terms")).alias("text"))


def term_cards(layout: Layout) -> DataFrame:
    """(release, ns, local, card): a Markdown card for each local term: label, IRI, kind, definitions, parents and status."""
    m = layout.m
    each = lambda name, title: F.transform(c(name), lambda v: F.concat(F.lit(title), oneline(v["value"])))
    listed = lambda name, title: F.transform(c(name), lambda v: F.concat(F.lit(title), v))
    lines = F.concat(
        F.array(F.concat(F.lit("# "), F.coalesce(label(), "local_name")), F.lit(""), F.concat(F.lit("- IRI: "), "iri"), F.concat(F.lit("- Kind: "), "kind")),
        F.array_compact(F.array(F.concat(F.lit("- CURIE: "), "curie"), F.concat(F.lit("- Defined in: "), "defined_in"), F.when(c("deprecated"), "- Deprecated"))),
        each("definitions", "- Definition: "),
        each("notes", "- Note: "),
        listed("super_terms", "- Parent: "),
        listed("replaced_by", "- Replaced by: "),
    )
    return m.local.select("release", c("namespace").alias("ns"), c("local_name").alias("local"), F.array_join(lines, "\n").alias("card"))


def document_cards(layout: Layout) -> DataFrame:
    """(release, iri, card): a Markdown card for each document."""
    m = layout.m
    counts = m.placed.groupBy("release", c("defined_in").alias("iri")).agg(F.count_if(~c("foreign")).alias("own"), F.count_if("foreign").alias("reused"))
    field = lambda title, value: F.concat(F.lit(f"- {title}: "), value)
    rows = header_rows(m).join(counts, KEY, "left")
    lines = F.array_compact(F.array(
        F.concat(F.lit("# "), F.coalesce("title", "iri")), F.lit(""), field("IRI", c("iri")), field("Kind", c("document_kind")), field("Version", c("version_info")), field("Status", c("status")), field("Licence", I.licence_label(c("license"))),
        F.when(c("creator") != "", field("Creators", c("creator"))), field("Terms", F.coalesce("own", F.lit(0)).cast("string")), field("Reused terms", F.coalesce("reused", F.lit(0)).cast("string")), F.when(c("description").isNotNull(), F.concat(F.lit("\n"), oneline(c("description")))),
    ))
    return rows.select(*KEY, F.array_join(lines, "\n").alias("card"))


def front_matter(layout: Layout) -> DataFrame:
    """(release, ns, local, weight, front): the front matter of each term's Markdown file; weight is its place in its namespace."""
    order = Window.partitionBy("release", "namespace").orderBy("iri")
    rows = layout.m.local.select("release", c("namespace").alias("ns"), c("local_name").alias("local"), "iri", "kind", F.coalesce(label(), "local_name").alias("title"), F.row_number().over(order).alias("weight"))
    front = F.array_join(F.array(F.lit("---"), F.concat(F.lit("title: "), yaml_scalar(c("title"))), F.concat(F.lit("iri: "), yaml_scalar(c("iri"))), F.concat(F.lit("kind: "), "kind"), F.concat(F.lit("weight: "), c("weight").cast("string")), F.lit("---")), "\n")
    return rows.select(*NS, "local", "weight", front.alias("front"))


def status_banners(m: Model) -> DataFrame:
    """(release, iri, status, version): what a banner says of documents that have a status."""
    return m.documents.filter("status is not null").select(*KEY, I.humanise(c("status")).alias("status"), c("version_info").alias("version"))


def schema_org(layout: Layout, title: str = "Vocabularies", lang: str = "en", most: int = 1000) -> DataFrame:
    """(release, kind, iri, part, json): schema.org data of terms, documents and the site of each release.

    A term has a page and the term that it is about, which names its set; a document is a set of terms and a dataset, with a
    download for each other representation of its namespace; a site is a catalogue of the datasets of its namespaces, in
    objects of `most` of them at most, all with the site's address and numbered by part. What is null is left out.
    """
    m, context = layout.m, F.lit("https://schema.org").alias("@context")
    null = F.lit(None).cast("string")
    url = layout.term_paths.filter(c("media_type") == DEFAULT_TYPE).select(*NS, "local", c("page_url").alias("url"))
    terms = m.local.select(*KEY, c("namespace").alias("ns"), c("local_name").alias("local"), F.coalesce(label(), "local_name").alias("name"), oneline(label("definitions")).alias("about"), "defined_in").join(url, [*NS, "local"], "left")
    node = lambda kind, iri, code, about, of, spoken, main: F.struct(F.lit(kind).alias("@type"), iri.alias("@id"), c("name"), code.alias("termCode"), c("url"), about.alias("description"), of.alias("inDefinedTermSet"), spoken.alias("inLanguage"), main.alias("mainEntity"))
    subject = F.struct(c("iri").alias("@id"))
    page = node("WebPage", null, null, null, null, F.lit(lang), subject)
    term = node("DefinedTerm", c("iri"), c("local"), c("about"), c("defined_in"), null, F.when(F.lit(False), subject))
    of_terms = terms.select("release", F.lit("term").alias("kind"), "iri", F.lit(0).alias("part"), F.to_json(F.struct(context, F.array(page, term).alias("@graph"))).alias("json"))

    files = layout.document_paths().filter("media_type <> 'text/plain'").withColumnRenamed("ns", "iri")
    other = F.when(c("media_type") != DEFAULT_TYPE, F.struct(F.lit("DataDownload").alias("@type"), c("media_type").alias("encodingFormat"), c("url").alias("contentUrl")))
    downloads = files.groupBy(*KEY).agg(F.max(F.when(c("media_type") == DEFAULT_TYPE, c("url"))).alias("url"), F.array_sort(F.collect_list(other)).alias("distribution"))
    own = pick_lang(c("title"), F.lit("en"))["value"]
    docs = m.documents.join(downloads, KEY, "left")
    group = F.struct(
        F.array(F.lit("DefinedTermSet"), F.lit("Dataset")).alias("@type"),
        c("iri").alias("@id"),
        F.coalesce(own, c("iri")).alias("name"),
        c("url"),
        F.lit(lang).alias("inLanguage"),
        oneline(pick_lang(c("description"), F.lit("en"))["value"]).alias("description"),
        c("license"),
        c("version_info").alias("version"),
        c("modified").alias("dateModified"),
        c("distribution"),
    )
    of_sets = docs.select("release", F.lit("set").alias("kind"), "iri", F.lit(0).alias("part"), F.to_json(F.struct(context, F.array(group).alias("@graph"))).alias("json"))

    spaces = before(layout.manifest.select(*NS, F.coalesce("title", "ns").alias("name"), c("doc_base").alias("url")), ["release"], ["ns"], "at", m.keep)
    dataset = F.struct(c("ns").alias("@id"), F.lit("Dataset").alias("@type"), c("name"), c("url"))
    parts = spaces.groupBy("release", F.floor(c("at") / most).cast("int").alias("part")).agg(F.array_sort(F.collect_list(dataset)).alias("dataset")).join(layout.config.select("release", "base_url"), "release")
    catalogue = F.struct(context, F.lit("DataCatalog").alias("@type"), F.lit(title).alias("name"), c("base_url").alias("url"), F.lit(lang).alias("inLanguage"), c("dataset"))
    of_site = parts.select("release", F.lit("catalogue").alias("kind"), c("base_url").alias("iri"), "part", F.to_json(catalogue).alias("json"))
    return of_terms.unionByName(of_sets).unionByName(of_site)


def context_subset(m: Model) -> DataFrame:
    """(release, file, iri, key): the entries of the context that each file's statements use."""
    used = m.quads.select("release", "file", F.explode(F.array(c("p"), F.when((c("p") == TYPE) & (c("o_kind") == "iri"), c("o")))).alias("iri")).filter("iri is not null").distinct()
    return used.join(large(context_entries(m).select(*KEY, "key")), KEY).select("release", "file", "iri", "key")


def markdown_links_of(layout: Layout) -> DataFrame:
    """(release, iri, target, link): links from local terms to their parents: to the page of a local term, else the short form."""
    m = layout.m
    pages = layout.term_paths.filter(c("media_type") == DEFAULT_TYPE).join(large(layout.terms.select(*NS, "local", c("iri").alias("target"))), [*NS, "local"]).select("release", "target", "page_url")
    rows = m.local.select(*KEY, F.explode(F.concat("super_terms", "replaced_by")).alias("target")).distinct()
    named = references(m, rows.select("release", c("target").alias("iri"))).select("release", c("iri").alias("target"), "label", "curie")
    both = large(rows).join(named, ["release", "target"]).join(pages, ["release", "target"], "left")
    link = F.when(c("page_url").isNotNull(), F.concat(F.lit("["), "label", F.lit("]("), "page_url", F.lit(")"))).otherwise(F.coalesce("curie", "target"))
    return both.select(*KEY, "target", link.alias("link"))


def artifacts(layout: Layout) -> DataFrame:
    """(release, path, content): the Markdown files of a site."""
    cards = large(term_cards(layout)).join(layout.term_paths.filter("media_type = 'text/markdown'").select(*NS, "local", "path"), [*NS, "local"])
    docs = document_cards(layout).withColumnRenamed("iri", "ns").join(layout.document_paths().filter("media_type = 'text/markdown'").select(*NS, "path"), NS)
    return cards.select("release", "path", c("card").alias("content")).unionByName(docs.select("release", "path", c("card").alias("content")))
