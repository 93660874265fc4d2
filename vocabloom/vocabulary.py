"""Namespaces and lookup tables that published vocabularies share. All values here are fixed by public specifications or formats."""

from __future__ import annotations

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DCTERMS = "http://purl.org/dc/terms/"
SH = "http://www.w3.org/ns/shacl#"
VANN = "http://purl.org/vocab/vann/"
ADMS = "http://www.w3.org/ns/adms#"
FOAF = "http://xmlns.com/foaf/0.1/"
DCAM = "http://purl.org/dc/dcam/"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = RDF + "type"

# Prefixes that stand for a namespace where no file declares one.
WELL_KNOWN_PREFIXES = {
    "rdf": RDF,
    "rdfs": RDFS,
    "owl": OWL,
    "skos": SKOS,
    "dcterms": DCTERMS,
    "dc": "http://purl.org/dc/elements/1.1/",
    "sh": SH,
    "vann": VANN,
    "adms": ADMS,
    "foaf": FOAF,
    "schema": "https://schema.org/",
    "dcat": "http://www.w3.org/ns/dcat#",
    "dcam": DCAM,
    "prov": "http://www.w3.org/ns/prov#",
    "xsd": XSD,
    "vs": "http://www.w3.org/2003/06/sw-vocab-status/ns#",
}

# Property types and the characteristic each stands for.
CHARACTERISTICS = {
    OWL + "SymmetricProperty": "symmetric",
    OWL + "AsymmetricProperty": "asymmetric",
    OWL + "TransitiveProperty": "transitive",
    OWL + "FunctionalProperty": "functional",
    OWL + "InverseFunctionalProperty": "inverse functional",
    OWL + "ReflexiveProperty": "reflexive",
    OWL + "IrreflexiveProperty": "irreflexive",
}

# Mapping relations, in order.
MAPPING_RELATIONS = [SKOS + x for x in ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")]

# The content type of a file by its extension.
MEDIA_TYPES = {
    "html": "text/html; charset=utf-8",
    "md": "text/markdown; charset=utf-8",
    "ttl": "text/turtle; charset=utf-8",
    "jsonld": "application/ld+json",
    "json": "application/json",
    "nt": "application/n-triples",
    "rdf": "application/rdf+xml; charset=utf-8",
    "xml": "application/rdf+xml; charset=utf-8",
    "css": "text/css; charset=utf-8",
    "js": "text/javascript; charset=utf-8",
    "txt": "text/plain; charset=utf-8",
    "svg": "image/svg+xml",
    "png": "image/png",
    "toml": "text/plain; charset=utf-8",
}

# The short name of a media type, and the names a query string may use.
FORMAT_ALIASES = {
    "text/html": "html",
    "text/markdown": "md",
    "text/turtle": "ttl",
    "application/ld+json": "jsonld",
    "application/rdf+xml": "rdf",
    "application/n-triples": "nt",
}
QUERY_ALIASES = {
    "html": "text/html",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "ttl": "text/turtle",
    "turtle": "text/turtle",
    "jsonld": "application/ld+json",
    "json": "application/ld+json",
    "rdf": "application/rdf+xml",
    "xml": "application/rdf+xml",
    "nt": "application/n-triples",
}
RDF_TYPES = ["text/turtle", "application/ld+json", "application/rdf+xml", "application/n-triples", "application/trig"]
RDF_HINTS = ["rdf", "turtle", "ld+json", "n-triples", "n3", "trig"]
