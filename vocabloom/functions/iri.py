"""Column expressions over IRIs, CURIEs and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import MEDIA_TYPES, WELL_KNOWN_PREFIXES


def _tail(iri: Column) -> Column:
    """What follows the last # or /; the whole without one."""
    return F.substring_index(F.substring_index(iri, "/", -1), "#", -1)


def _before(iri: Column, tail: Column) -> Column:
    """The IRI without this end, by bytes: counting the characters of every IRI takes longer than all else here."""
    return F.substring(iri.cast("binary"), F.lit(1), F.octet_length(iri) - F.octet_length(tail)).cast("string")


def namespace_part(iri: Column) -> Column:
    """The IRI up to its last # or /, null where nothing follows."""
    return F.when((_tail(iri) != "") & (_tail(iri) != iri), _before(iri, _tail(iri)))


def local_part(iri: Column) -> Column:
    return F.when((_tail(iri) != "") & (F.length(_tail(iri)) < F.length(iri)), _tail(iri))


def folder_of(iri: Column) -> Column:
    """The longest beginning of an IRI that ends with # or / and is shorter than it; null without one."""
    plain, rest = _tail(iri), F.left(iri, F.length(iri) - 1)
    return F.when(plain == iri, None).when(plain != "", _before(iri, plain)).when(_tail(rest) != rest, _before(rest, _tail(rest)))


def local_name(iri: Column) -> Column:
    return F.coalesce(local_part(iri), iri)


def well_known(namespace: Column) -> Column:
    """The well-known prefix of a namespace."""
    return F.create_map(*(F.lit(x) for p, ns in WELL_KNOWN_PREFIXES.items() for x in (ns, p)))[namespace]


def curie(iri: Column, declared: Column) -> Column:
    """prefix:local, where `declared` is the prefix that files declare for the namespace, or null."""
    return F.concat(F.coalesce(declared, well_known(namespace_part(iri))), F.lit(":"), local_part(iri))


def humanise(iri: Column) -> Column:
    spaced = F.regexp_replace(local_name(iri), r"(?<!^)(\p{Lu})", " $1")
    return F.translate(ascii_lower(spaced), "_-", "  ")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def flip_first(local: Column) -> Column:
    first, rest = F.substring(local, 1, 1), F.regexp_replace(local, r"(?s)^.", "")
    return F.when(first.rlike(r"^\p{Lu}"), F.concat(F.lower(first), rest)).when(first.rlike(r"^\p{Ll}"), F.concat(F.upper(first), rest)).otherwise(local)


def licence_label(iri: Column) -> Column:
    name = local_name(F.regexp_replace(iri, "/+$", ""))
    rest = F.regexp_replace(F.regexp_extract(iri, r"^https://creativecommons\.org/licenses/(.*)$", 1), "/+$", "")
    cc = F.concat(F.lit("CC "), F.upper(F.element_at(F.split(rest, "/"), 1)), F.lit(" "), F.coalesce(F.get(F.split(rest, "/"), 1), F.lit("")))
    return F.when(name.isin("zero", "1.0") & iri.contains("publicdomain/zero"), "CC0 1.0").when(iri.startswith("https://creativecommons.org/licenses/"), F.trim(cc)).otherwise(iri)


def mount_from_iri(iri: Column) -> Column:
    """The path of an IRI as a directory, without a trailing #."""
    path = F.regexp_replace(F.regexp_extract(F.regexp_replace(iri, r"^.*?//", ""), r"^[^/]*/(.*)$", 1), "#+$", "")
    return F.when(path == "", "").when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def base_path(base_url: Column) -> Column:
    path = F.btrim(F.regexp_extract(base_url, r"^.*?//[^/]*(/.*)$", 1), F.lit("/"))
    return F.when(path == "", "/").otherwise(F.concat(F.lit("/"), path, F.lit("/")))


def origin_of(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, r"^((?:.*?//)?[^/]*)", 1)


def rehost(url: Column, origin: Column, to: Column) -> Column:
    """Move a URL from one origin to another."""
    plain = F.regexp_replace(origin, "/+$", "")
    return F.when(F.startswith(url, plain), F.concat(F.regexp_replace(to, "/+$", ""), F.substr(url, F.length(plain) + 1))).otherwise(url)


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^(.*?://[^/?#:]*?):[^/?#]*@([^/?#@]*(?:[/?#]|$))", "$1:***@$2")


def has_userinfo(url: Column) -> Column:
    return url.rlike(r"^.*?//[^/?#]*@")


def base_url_fault(url: Column) -> Column:
    """Why a base URL can't be used; null for a good one."""
    rest = F.regexp_extract(url, r"(?s)^https?://(.*)$", 1)
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return (
        F.when(~url.rlike(r"^https?://"), "not absolute")
        .when(authority == "", "no host")
        .when(rest.rlike(r"\s"), "white space")
        .when(authority.contains("@"), "credentials")
    )


def site_root(iri: Column) -> Column:
    """The origin of an IRI with a final slash."""
    return F.concat(F.regexp_extract(iri, r"^(.*?//[^/]*)", 1), F.lit("/"))


def _dirs(path: Column) -> Column:
    return F.array_remove(F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/"), "")


def relative_to(start: Column, target: Column) -> Column:
    """A relative reference from one absolute path to another."""
    ours, theirs = _dirs(start), _dirs(target)
    same = F.zip_with(ours, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first_other = F.array_position(same, False)
    shared = F.when(first_other == 0, F.least(F.size(ours), F.size(theirs))).otherwise(first_other - 1).cast("int")
    rest = F.slice(theirs, shared + 1, F.greatest(F.size(theirs) - shared, F.lit(0)))
    tail = F.concat(F.array_join(F.transform(rest, lambda d: F.concat(d, F.lit("/"))), ""), F.regexp_extract(target, r"([^/]*)$", 1))
    out = F.concat(F.repeat(F.lit("../"), F.size(ours) - shared), tail)
    return F.when(out == "", "./").otherwise(out)


def relative_root(page: Column) -> Column:
    return F.repeat(F.lit("../"), F.size(F.split(page, "/")) - 1)


def relative_href(value: Column, base_url: Column, root: Column) -> Column:
    """An absolute URL inside the site, rewritten from a page."""
    href = F.concat(root, F.regexp_replace(F.substr(value, F.length(base_url) + 1), "^/+", ""))
    inside = (base_url != "") & F.startswith(value, base_url)
    return F.when(inside, F.when(href == "", "./").otherwise(href)).otherwise(value)


def resolve_internal(page: Column, href: Column, base_url: Column, prefix: Column) -> Column:
    """The site path that a link leads to; null for links that leave the site or name a fragment only."""
    plain = F.regexp_extract(href, r"^([^#?]*)", 1)
    stripped = lambda c: F.regexp_replace(c, "^/+", "")
    rooted = F.when(~prefix.isin("/", "") & F.startswith(plain, prefix), F.substr(plain, F.length(prefix) + 1)).otherwise(plain)
    folder = F.array_remove(F.split(F.regexp_extract(page, r"^(.*)/[^/]*$", 1), "/"), "")
    steps = F.split(plain, "/")
    walked = F.aggregate(
        steps,
        folder,
        lambda at, s: F.when(s.isin("", "."), at).when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s))),
    )
    return (
        F.when(plain == "", None)
        .when((base_url != "") & F.startswith(plain, base_url), stripped(F.substr(plain, F.length(base_url) + 1)))
        .when(plain.contains(":") | plain.startswith("//"), None)
        .when(plain.startswith("/"), stripped(rooted))
        .otherwise(F.array_join(walked, "/"))
    )


def media_type_of(path: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(kinds[F.regexp_extract(path, r"\.([^.]*)$", 1)], F.lit("application/octet-stream"))


def percent_decode(path: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
