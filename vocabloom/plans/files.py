"""Registered queries of a site's files: relative links, the ordered digest and the ordered text, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import describe, files
from .exports import _CARD, _FILES, _LABEL, CARDS
from .publish import SITE, layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _relative(start: str, target: str) -> str:
    """SQL for the reference from one absolute path to another; lists of folders are bound once."""
    folders = "list_filter(string_split(regexp_extract({0}, '^(.*)/[^/]*$', 1), '/'), lambda s: s <> '')"
    return f"""(
SELECT coalesce(nullif(repeat('../', len(x) - n) || array_to_string(list_transform(y[n + 1:], lambda d: d || '/'), '') || split_part(b, '/', -1), ''), './')
FROM (SELECT x, y, b, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])) AS n
  FROM (SELECT {folders.format(start)} AS x, {folders.format(target)} AS y, {target} AS b)))"""


_MD = "SELECT release, ns, local, file, rtrim(base_url, '/') || public AS url, base_url FROM adr WHERE segment = '' AND extension = '.md'"
#: Bodies with full links: each card and a line for each parent and replacement.
_BODIES = f"""
md AS MATERIALIZED ({_MD}),
tgt AS (
  SELECT t.release, t.iri, {_LABEL} AS label, md.url FROM terms t
  JOIN md ON md.release = t.release AND md.ns = t.namespace AND md.local = t.local_name WHERE NOT t."foreign"),
lin AS (
  SELECT x.release, x.namespace, x.local_name, string_agg('- ' || coalesce('[' || g.label || '](' || g.url || ')', x.target), chr(10) ORDER BY x.k) AS lines
  FROM (
    SELECT release, namespace, local_name, unnest(list_concat(super_terms, replaced_by)) AS target,
      generate_subscripts(list_concat(super_terms, replaced_by), 1) AS k
    FROM terms WHERE NOT "foreign") x
  LEFT JOIN tgt g ON g.release = x.release AND g.iri = x.target GROUP BY ALL),
bod AS MATERIALIZED (
  SELECT md.release, md.file, md.base_url, k.card || chr(10) || chr(10) || coalesce(l.lines, '') || chr(10) AS body
  FROM md JOIN {_CARD} k ON k.release = md.release AND k.ns = md.ns AND k.local = md.local
  LEFT JOIN lin l ON l.release = md.release AND l.namespace = md.ns AND l.local_name = md.local),
pcs AS MATERIALIZED (
  SELECT release, file, unnest(string_split(body, '](' || rtrim(base_url, '/') || '/')) AS piece,
    generate_subscripts(string_split(body, '](' || rtrim(base_url, '/') || '/'), 1) AS k
  FROM bod),
mov AS (
  SELECT release, file, k, CASE WHEN k = 1 THEN piece ELSE '](' || {_relative("'/' || file", "'/' || split_part(piece, ')', 1)")} || substr(piece, instr(piece, ')')) END AS text,
    CASE WHEN k > 1 THEN split_part(piece, ')', 1) END AS target
  FROM pcs)
"""
QUERIES["relativise_links"] = lambda spark, sf_dir: files.relativised(files.linked_cards(layout(spark, sf_dir)))
ORACLE["relativise_links"] = f"""{SITE.rstrip()},{_BODIES}
SELECT m.release, m.file AS path, string_agg(text, '' ORDER BY k) AS body, count(target) AS n_links, count(*) FILTER (target IS NOT NULL AND b.file IS NULL) AS n_missing
FROM mov m LEFT JOIN bod b ON b.release = m.release AND b.file = m.target GROUP BY m.release, m.file
"""

def _fold(rows: str, by: str) -> str:
    digest = "CASE WHEN count(*) = 1 THEN min(digest) ELSE sha256(string_agg(digest, ',' ORDER BY pos)) END"
    return f"SELECT release, {by} AS node, {digest} AS digest, sum(bytes) AS bytes, sum(files) AS files FROM {rows} GROUP BY release, {by}"


QUERIES["tree_digest"] = lambda spark, sf_dir: files.ordered_digest(describe.artifacts(layout(spark, sf_dir)), layout(spark, sf_dir).m.keep)
ORACLE["tree_digest"] = f"""{CARDS.rstrip()},
fil AS (
  SELECT release, row_number() OVER (PARTITION BY release ORDER BY path) - 1 AS pos, sha256(path || chr(0) || sha256(content)) AS digest,
    strlen(content) AS bytes, 1 AS files
  FROM {_FILES}),
lvs AS (SELECT release, node AS pos, digest, bytes, files FROM ({_fold("fil", f"pos // {files.LEAF}")}))
SELECT release, CAST(files AS BIGINT) AS files, CAST(bytes AS BIGINT) AS bytes, digest FROM ({_fold("lvs", "pos * 0")})
"""

QUERIES["corpus_concat"] = lambda spark, sf_dir: files.concatenated(layout(spark, sf_dir))
ORACLE["corpus_concat"] = f"""{SITE.rstrip()},
txt AS (SELECT release, ns, local, chr(10) || '---' || chr(10) || chr(10) || card || chr(10) AS text FROM {_CARD})
SELECT release, ns, local, CAST(coalesce(sum(strlen(text)) OVER (
    PARTITION BY release ORDER BY ns, local ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  strlen(text) AS length, text
FROM txt
"""
