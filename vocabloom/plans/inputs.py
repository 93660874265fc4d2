"""Input views for the registered queries, as SQL text that Spark and DuckDB both run over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "https://tpch.example.org/"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a view over the tables of a folder. Tables stand in braces in the text, as {part}."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """The same view for DuckDB, where the tables are known by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


IRIS = f"""
SELECT p_partkey AS k, CASE p_partkey % 8
  WHEN 0 THEN '{BASE}part/' || p_partkey
  WHEN 1 THEN '{BASE}geo#' || p_name
  WHEN 2 THEN 'http://www.w3.org/2004/02/skos/core#' || p_type
  WHEN 3 THEN '{BASE}part/' || p_brand || '/'
  WHEN 4 THEN 'urn:part:' || p_partkey
  WHEN 5 THEN 'https://creativecommons.org/licenses/by-sa/' || (p_size % 4 + 1) || '.0/'
  WHEN 6 THEN 'http://purl.org/adms/status/Under' || p_type || 'Development_' || p_brand || '-x'
  ELSE '{BASE}vocab/' || p_type || '#' END AS iri FROM {{part}}
"""

PREFIXES = f"""
SELECT 'part.nt' AS file, 0 AS file_ord, 'part' AS prefix, '{BASE}part/' AS ns
UNION ALL SELECT 'part.nt', 0, 'geo', '{BASE}geo#'
UNION ALL SELECT 'geo.nt', 1, 'geo', '{BASE}geo/'
UNION ALL SELECT 'geo.nt', 1, 'place', '{BASE}geo#'
UNION ALL SELECT 'geo.nt', 1, 'item', '{BASE}part/'
"""

LABELS = """
SELECT p_partkey AS k, 'en' AS lang, p_name || ' part' AS value, 1 AS seq FROM {part} WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 'de', 'Teil ' || p_name, 2 FROM {part} WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, CAST(NULL AS STRING), upper(p_name), 3 FROM {part} WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'fr', 'pièce ' || p_name, 4 FROM {part} WHERE p_partkey % 7 = 0
"""

TEXTS = "SELECT doc_id AS k, text FROM {documents}"

PATHS = """
SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN '/vocab/part/' || c_custkey WHEN 1 THEN '/' WHEN 2 THEN '/vocab/' || c_mktsegment || '/x/y' WHEN 3 THEN '/vocab/part/' || c_custkey || '/index.md' WHEN 4 THEN '/a' ELSE '/vocab/part/' END AS a,
  CASE c_custkey % 7 WHEN 0 THEN '/vocab/part/' || c_custkey || '.ttl' WHEN 1 THEN '/' WHEN 2 THEN '/vocab/' || c_mktsegment || '/x/' WHEN 3 THEN '/vocab/llms.txt' WHEN 4 THEN '/b/c.json' WHEN 5 THEN '/vocab/part/' ELSE '/a' END AS b
FROM {customer}
"""

ACCEPTS = """
SELECT event_id AS k, CASE event_type
  WHEN 'click' THEN 'text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8'
  WHEN 'view' THEN 'text/turtle'
  WHEN 'purchase' THEN 'text/html;q=0.' || (user_id % 10) || ', TEXT/turtle'
  WHEN 'signup' THEN '*/*;q=1.0, text/turtle;q=0.1, , application/ld+json; Q=0.3; q = 0.' || (event_id % 10)
  ELSE 'image/png;q=bad, text/*;q=0' END AS accept,
  CASE event_id % 5 WHEN 0 THEN 'format=ttl' WHEN 1 THEN 'a=1&_mediatype=text/turtle&format=md' WHEN 2 THEN 'x&_profile=' WHEN 3 THEN 'q=format=1' ELSE '' END AS query,
  CASE event_id % 4 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'text/turtle' WHEN 2 THEN '' ELSE ' application/ld+json ;x' END AS content_type,
  CASE event_id % 5 WHEN 0 THEN 'Accept-Encoding' WHEN 1 THEN 'Accept-Encoding, ACCEPT' WHEN 2 THEN 'accept' WHEN 3 THEN '' ELSE 'Origin,Accept-Language' END AS vary
FROM {events}
"""

URLS = """
SELECT page_id AS k, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pa:ss@') WHEN 2 THEN replace(url, '://', '://user@') WHEN 3 THEN 'ftp://x/' || page_id WHEN 4 THEN 'https:///' || page_id
  WHEN 5 THEN 'https://no space.example/' ELSE url || '@b:c' END AS url FROM {pages}
"""
