"""Column expressions over HTTP headers and media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import FORMAT_ALIASES, QUERY_ALIASES, RDF_HINTS, RDF_TYPES
from .iri import ascii_lower


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def format_alias(media_type: Column) -> Column:
    return F.coalesce(_map(FORMAT_ALIASES)[media_type], F.lit(""))


def query_alias(value: Column) -> Column:
    """The media type that a query value asks for; a value with a slash is one."""
    return F.coalesce(_map(QUERY_ALIASES)[value], F.when(value.contains("/"), value))


def is_rdf(media_type: Column) -> Column:
    return media_type.isin(RDF_TYPES)


def looks_like_rdf(media_type: Column) -> Column:
    return media_type.rlike("|".join(h.replace("+", "\\+") for h in RDF_HINTS))


def is_wildcard(media_type: Column) -> Column:
    return media_type.endswith("/*")


def parse_accept(header: Column) -> Column:
    """The media types of an Accept header, best first: by falling q, then as listed. Types with a q of 0 or less go; a q that isn't a number is 1."""

    def part(text: Column, at: Column) -> Column:
        pieces = F.split(F.trim(text), ";")
        q = F.transform(F.filter(F.slice(pieces, 2, 99), lambda p: F.trim(F.substring_index(p, "=", 1)) == "q"), lambda p: F.trim(F.regexp_replace(p, "^[^=]*=?", "")))
        number = F.filter(F.transform(q, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
        return F.struct((-F.coalesce(F.try_element_at(number, F.lit(-1)), F.lit(1.0))).alias("q"), at.alias("at"), ascii_lower(F.trim(F.get(pieces, 0))).alias("type"))

    parts = F.filter(F.transform(F.split(header, ","), part), lambda p: (p["type"] != "") & (p["q"] < 0))
    return F.transform(F.array_sort(parts), lambda p: p["type"])


def query_override(query: Column) -> Column:
    """The first value of format, _mediatype or _profile in a query string."""
    found = F.filter(F.split(query, "&"), lambda p: p.rlike("^(format|_mediatype|_profile)="))
    return F.regexp_replace(F.get(found, 0), "^[^=]*=", "")


def content_type_is(header: Column, media_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(header, ";", 1))) == F.lower(media_type)


def varies_on_accept(header: Column) -> Column:
    return header.rlike(r"(?:^|,) *[Aa][Cc][Cc][Ee][Pp][Tt] *(?:,|\z)")
