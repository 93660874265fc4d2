"""Column expressions over labels, literals and other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import XSD


def oneline(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pick_lang(values: Column, lang: Column) -> Column:
    """Of an array of (value, lang, ...): the first in the language, else the first without one, else the first."""
    own = F.filter(values, lambda v: v["lang"] == lang)
    bare = F.filter(values, lambda v: v["lang"].isNull())
    return F.coalesce(F.get(own, 0), F.get(bare, 0), F.get(values, 0))


def summary(definition: Column) -> Column:
    """One line, cut after the first sentence that ends past the 41st byte."""
    line = oneline(definition)
    head = F.substring_index(line, ". ", 1)
    return F.when(line.contains(". ") & (F.octet_length(head) > 40), F.concat(head, F.lit("."))).otherwise(line)


def page_title(label: Column, curie: Column, site: Column) -> Column:
    """Label, CURIE and site in 70 characters, leaving out what doesn't fit."""
    named = F.when(curie.isNotNull(), F.concat(label, F.lit(" ("), curie, F.lit(")"))).otherwise(label)
    head = F.when(F.char_length(named) <= 70, named).otherwise(label)
    full = F.concat(head, F.lit(" — "), site)
    cut = F.concat(F.rtrim(F.substring(head, 1, 69)), F.lit("…"))
    return F.when(F.char_length(full) <= 70, full).when(F.char_length(head) <= 70, head).otherwise(cut)


def yaml_scalar(text: Column) -> Column:
    """A quoted YAML string on one line."""
    out = text
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    for code in [c for c in range(32) if chr(c) not in "\n\r\t"]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def rule_heading(rule: Column) -> Column:
    words = F.translate(rule, ".-_", "   ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.regexp_replace(words, r"(?s)^.", ""))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), oneline), lambda p: p != "")


def language_tag_valid(tag: Column) -> Column:
    return tag.rlike(r"^[A-Za-z0-9]{1,8}(-[A-Za-z0-9]{1,8})*$")


def looks_like_version(text: Column) -> Column:
    return (F.length(text) <= 64) & text.rlike(r"^[0-9]+(\.[0-9]+)*([-+][A-Za-z0-9._+-]*)?$")


def cardinality(least: Column, most: Column) -> Column:
    text = F.concat(F.coalesce(least, F.lit(0)).cast("string"), F.lit(".."), F.coalesce(most.cast("string"), F.lit("*")))
    return F.when(least.isNotNull() | most.isNotNull(), text)


def required(least: Column) -> Column:
    return F.coalesce(least, F.lit(0)) >= 1


def term_scalar(value: Column, kind: Column) -> Column:
    """A literal's text or an IRI; null for a blank node."""
    return F.when(kind != "bnode", value)


def node_key(value: Column, kind: Column) -> Column:
    """An index key: blank nodes are marked, literals have none."""
    return F.when(kind == "iri", value).when(kind == "bnode", F.concat(F.lit("_:"), value))


def term_iri(value: Column, kind: Column) -> Column:
    """The IRI of a named node; null for others."""
    return F.when(kind == "iri", value)


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def triple_signature(s: Column, s_kind: Column, p: Column, o: Column, o_kind: Column, lang: Column, dt: Column) -> Column:
    """A triple as text that doesn't depend on blank-node labels."""
    subject = F.when(s_kind == "bnode", "_:").otherwise(s)
    literal = F.when(lang.isNotNull(), F.concat(quoted(o), F.lit("@"), lang)).otherwise(F.concat(quoted(o), F.lit("^^"), F.coalesce(dt, F.lit(XSD + "string"))))
    target = F.when(o_kind == "bnode", "_:").when(o_kind == "iri", F.concat(F.lit("<"), o, F.lit(">"))).otherwise(literal)
    return F.concat(subject, F.lit(" <"), p, F.lit("> "), target)


def jsonld_value(o: Column, o_kind: Column, lang: Column, dt: Column, short: Column, coercion: Column, dt_short: Column) -> Column:
    """The shortest JSON text that reads back as the same object. `short` is the object's compact form, `dt_short` its datatype's."""
    js = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    node = F.concat(F.lit('{"@id":'), js(short), F.lit("}"))
    plain = lang.isNull() & F.coalesce(dt, F.lit(XSD + "string")).eqNullSafe(XSD + "string")
    tagged = F.concat(F.lit('{"@value":'), js(o), F.lit(',"@language":'), js(lang), F.lit("}"))
    canonical = ((dt == XSD + "boolean") & o.isin("true", "false")) | ((dt == XSD + "integer") & o.rlike("^(0|-?[1-9][0-9]{0,17})$"))
    native = ~coercion.eqNullSafe("@id") & canonical
    typed = F.concat(F.lit('{"@type":'), js(dt_short), F.lit(',"@value":'), js(o), F.lit("}"))
    wrapped = F.when(plain, F.concat(F.lit('{"@value":'), js(o), F.lit("}"))).otherwise(typed)
    return (
        F.when((o_kind == "iri") & coercion.eqNullSafe("@id"), js(short))
        .when(o_kind == "iri", node)
        .when(o_kind == "bnode", F.concat(F.lit('{"@id":'), js(F.concat(F.lit("_:"), o)), F.lit("}")))
        .when(lang.isNotNull(), tagged)
        .when(plain & coercion.isNull(), js(o))
        .when(F.coalesce(native, F.lit(False)), o)
        .when(coercion.eqNullSafe(dt_short), js(o))
        .otherwise(wrapped)
    )


def day_seconds(date: Column) -> Column:
    """Seconds from 1970 to a date that starts with YYYY-MM-DD; null for other text and earlier dates."""
    seconds = F.unix_timestamp(F.try_to_timestamp(F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(date, 1, 10)), F.lit("yyyy-MM-dd")))
    return F.when(seconds >= 0, seconds)
