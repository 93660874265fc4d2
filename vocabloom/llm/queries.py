"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, credentials, decontaminate, language, lines, neardup, packing, pii, quality, sharding, spotsigs, substrings, whitening
from .shared import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.held_out("doc_id")
    model = language.train(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language.held_out("doc_id", 5, 0)
    model = quality.train(docs, labels.filter(~held_out))
    scored = quality.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = spotsigs.compared_with_next(table(spark, sf_dir, "documents"))
    edited = F.sha2("edited_text", 256).alias("edited_sha256")
    return signed.select("doc_id", "n_chars", edited, spotsigs.text_of("signatures").alias("fingerprint"), spotsigs.text_of("edited_signatures").alias("edited_fingerprint"), "near_edited", "near_next")


def op9_spotsigs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.near_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.expr(f"CAST(size(filter(base_spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.KINDS]
    joined = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",") for c in ("base_spans", "spans")}
    return found.select("doc_id", *count, F.sha2(joined["base_spans"], 256).alias("base_sha256"), joined["spans"].alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in credentials.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*credentials.BASE))
    return found.select("doc_id", *count, F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    made = alignment.align(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return alignment.with_pair_counts(made.withColumn("groups_sha256", digest).drop("groups"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_decontamination,
        op2_packing,
        op3_line_dedup,
        op4_language_id,
        op5_sharding,
        op6_substring_dedup,
        op7_minhash_near_dedup,
        op8_quality_classifier,
        op9_spotsigs,
        op9_spotsigs_pairs,
        op10_pii,
        op11_credential_linking,
        op12_token_alignment,
        op13_embedding_whitening,
    )
    return {f.__name__: f for f in made}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


_OP1 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS x FROM p),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_lower("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
q AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
x AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS x FROM q),
m AS (SELECT doc_id, n, s, item FROM x JOIN windows USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS k FROM (SELECT DISTINCT doc_id, n, s FROM m)) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

_OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, line, {_lower("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM x),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


_SPACES = "[^\\x20\\x09-\\x0D]+"

_OP5 = """
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([CAST(b AS BIGINT)], [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
b AS (SELECT doc_id, coalesce(source, 'null') AS source, octet_length(encode(coalesce(text, ''))) + 16 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, source, size, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
x AS (SELECT c.* EXCLUDE (source), coalesce('=' || d.source, 'null') AS source, md5(coalesce(d.text, '')) AS t, md5('7:' || c.doc_id) AS o FROM c JOIN documents d USING (doc_id)),
g AS (SELECT t, size, count(*) AS k, min(o) AS o, arg_min(source, o) AS source FROM x GROUP BY t, size),
h AS (SELECT k, sum(k) AS r FROM g GROUP BY k),
m AS (SELECT coalesce(max(k), 1) AS most FROM h a WHERE k > 1 AND coalesce((SELECT sum(r) FROM h b WHERE b.k > a.k OR b.k = 1), 0) >= k * 40),
w AS (SELECT * FROM g, m WHERE k > 1 AND k <= most),
wr AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, t, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS total FROM w),
wp AS (SELECT *, coalesce(sum(k) OVER (ORDER BY (rank + CAST(CAST('0x' || substr(md5('7:' || source), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0) / total, source, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, sum(k) OVER () AS heavy FROM wr),
ws AS (SELECT t, size, k, place, CAST(place * 40 // heavy AS INTEGER) AS shard FROM wp),
wo AS (SELECT *, place - min(place) OVER (PARTITION BY shard) AS start FROM ws),
one AS (SELECT x.doc_id, x.size, text_crc32, shard, start + row_number() OVER (PARTITION BY x.t, x.size ORDER BY x.o, x.source, x.doc_id) - 1 AS slot, true AS whole FROM x JOIN wo ON wo.t = x.t AND wo.size = x.size),
e AS (SELECT i, coalesce((SELECT sum(k) FROM ws WHERE shard = i), 0) AS own, sum(((i + 1) * n + 39) // 40 - (i * n + 39) // 40 - coalesce((SELECT sum(k) FROM ws WHERE shard = i), 0)) OVER (ORDER BY i) AS last FROM (SELECT unnest(range(40)) AS i), (SELECT count(*) AS n FROM x)),
l AS (SELECT x.*, g.k = 1 AS whole FROM x JOIN g ON g.t = x.t AND g.size = x.size, m WHERE g.k = 1 OR g.k > m.most),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, t, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS total FROM l),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + CAST(CAST('0x' || substr(md5('7:' || source), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0) / total, source, rank) - 1 AS place FROM r),
s AS (SELECT *, (SELECT count(*) FROM e WHERE last <= place) AS shard FROM p),
two AS (SELECT s.doc_id, s.size, text_crc32, CAST(s.shard AS INTEGER) AS shard, e.own + place - coalesce(f.last, 0) AS slot, whole FROM s JOIN e ON e.i = s.shard LEFT JOIN e f ON f.i = s.shard - 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, shard, CAST(slot AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, whole FROM (SELECT * FROM one UNION ALL SELECT * FROM two)
"""

_OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_SPACES}'), []) AS w FROM documents),
q AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35),
x AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS x FROM q),
r AS (SELECT x FROM x GROUP BY x HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM x JOIN r USING (x)),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
m AS (SELECT k.*, c.i IS NOT NULL AS gone FROM k LEFT JOIN c USING (doc_id, i)),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_lower("text")}, '{_SPACES}'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0),
x AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s : s + 4], ' ')) AS x FROM p),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a),
g AS (SELECT a AS doc_id, min(root) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM g LEFT JOIN n USING (doc_id)
"""


def _op11() -> str:
    """Parts of each text with their places, scopes and neighbours in both directions, as in `find_secrets`."""
    c = credentials
    quoted = [p.replace("'", "''") for p in (c.ASSIGN, c.ACCESS, c.HEX, c.SECRET, c.IDENTIFIER, c.ENDPOINT, c.BREAK)]
    each = "\nUNION ALL\n".join(
        f"SELECT r, {i} AS kind, unnest(regexp_extract_all(t, '{p}', 0)) AS m, unnest(string_split_regex(t, '{p}')[:-2]) AS gap, "
        f"unnest(range(len(regexp_extract_all(t, '{p}', 0)))) AS nth FROM d WHERE regexp_matches(t, '{p}')"
        for i, p in enumerate(quoted)
    )
    mixed = "(regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]'))"
    named, user = c._NAMED.replace("'", "''"), c._USER.replace("'", "''")
    sides, near = [], {}
    for role, at in {"access": "role = 1", "identifier": "role = 4", "endpoint": "role = 5", "secret": "role IN (0, 2, 3)"}.items():
        sides.append(f"max(e) FILTER ({at}) OVER (PARTITION BY r, scope ORDER BY s, (role = 3), kind, nth) AS {role}_before")
        sides.append(f"min(s) FILTER ({at}) OVER (PARTITION BY r, scope ORDER BY s DESC, (role <> 3), kind DESC, nth DESC) AS {role}_after")
        near[role] = f"(coalesce(s - {role}_before <= 200, false) OR coalesce({role}_after - e <= 200, false))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({each}),
p AS (
  SELECT r, kind, nth, m, sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY nth) AS e,
    CASE kind WHEN 0 THEN length(regexp_extract(m, '{quoted[0]}', 2)) >= 8 WHEN 3 THEN regexp_matches(m, '^(?:{named})$') OR {mixed} ELSE true END AS counts,
    kind = 5 AND regexp_matches(m, '{user}') AS whole
  FROM x),
q AS (SELECT r, kind, nth, e, e - length(m) AS s, whole, CASE WHEN counts THEN kind END AS role FROM p),
b AS (
  SELECT *, count(*) FILTER (role = 6) OVER (PARTITION BY r ORDER BY s, (role = 3), kind, nth) AS scope,
    max(e) FILTER (role NOT IN (3, 6)) OVER (PARTITION BY r ORDER BY s, (role = 3), kind, nth) AS ended,
    min(s) FILTER (role NOT IN (3, 6)) OVER (PARTITION BY r ORDER BY s DESC, (role <> 3), kind DESC, nth DESC) AS next
  FROM q),
a AS (SELECT r, kind, nth, s, e, scope, whole, CASE WHEN role <> 3 OR (coalesce(ended <= s, true) AND coalesce(next >= e, true)) THEN role END AS role FROM b),
n AS (SELECT *, {", ".join(sides)} FROM a),
t AS (
  SELECT r, s, kind, ['assign', 'access', 'hex', 'secret', 'identifier', 'endpoint'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM n
  WHERE role IN (0, 1, 2) OR (role = 3 AND ({near["access"]} OR ({near["identifier"]} AND {near["endpoint"]})))
    OR (role = 4 AND {near["secret"]} AND {near["endpoint"]}) OR (role = 5 AND whole)),
g AS (
  SELECT r, count(*) AS n_spans, string_agg(span, ',' ORDER BY s, kind) AS spans, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
    count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex
  FROM t GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN g USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1, "op3_line_dedup": _OP3, "op5_sharding": _OP5, "op6_substring_dedup": _OP6, "op7_minhash_near_dedup": _OP7, "op11_credential_linking": _op11()}
