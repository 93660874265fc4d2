"""Line deduplication: drop lines that many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import counted, flagged, free_names, row_keys, with_columns, written

_EDGE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and of each its key: stripped of ASCII white space, A-Z in lower case."""
    lines = (text or b"").split(b"\n")
    return lines, [x.strip(_EDGE).lower() for x in lines]


@free_names
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop from every document all lines whose key is found in at least `min_docs` documents.

    Returns the columns of `docs` and n_lines, n_dropped (long) and kept_text (string).

    - The lines of each document are exploded, normalised and hashed (128 bits); a document counts once for each hash.
    - A null or empty text is one empty line. Keys shorter than `min_chars` code points never go.
    - Rows of one id are one document when documents are counted, and so are all rows without an id; each row is returned.
    - Columns of `docs` named as a result column are replaced; other columns pass through.
    - An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    keyed = docs.select(*row_keys(id_col, text_col, docs), F.col(id_col).isNull().alias("_none"), "*")

    def hashes():
        from xxhash import xxh3_128_digest

        def work(batch):
            out = []
            for text in batch.column("_text"):
                keys = line_keys(text.as_py())[1]
                out.append(list({xxh3_128_digest(k) for k in set(keys) if _long_enough(k, min_chars)}))
            return [out]

        return work

    texts = keyed.select("_k1", "_k2", "_none", F.col(text_col).cast("binary").alias("_text"))
    pairs, n = counted(with_columns(texts, [T.StructField("_h", T.ArrayType(T.BinaryType()))], hashes, ["_text"]).select("_k1", "_k2", "_none", F.explode("_h").alias("_h")), "lines")
    common = written(pairs.groupBy("_h").count().filter(F.col("count") >= min_docs), "common")
    hits = flagged(pairs, common, ["_h"], n).filter("_hit").select("_k1", "_k2", "_none", "_h")
    if keyed.groupBy("_k1", "_none").count().filter("count > 1").limit(1).count():
        hits = written(hits, "hits")
        few = hits.select("_h", "_k1", "_none").distinct().groupBy("_h").count().filter(F.col("count") < min_docs)
        hits = hits.join(few, "_h", "left_anti")
    doomed = hits.groupBy("_k1", "_k2").agg(F.collect_set("_h").alias("_doomed"))

    def kept():
        from xxhash import xxh3_128_digest

        def work(batch):
            totals, drops, texts = [], [], []
            for text, doomed in zip(batch.column(text_col), batch.column("_doomed"), strict=True):
                text = text.as_py()
                raw = None if text is None else text.encode()
                lines, keys = line_keys(raw)
                totals.append(len(lines))
                if doomed.is_valid:
                    gone = set(doomed.as_py())
                    lines = [x for x, k in zip(lines, keys, strict=True) if not (_long_enough(k, min_chars) and xxh3_128_digest(k) in gone)]
                    text = b"\n".join(lines).decode()
                drops.append(totals[-1] - len(lines))
                texts.append(text or "")
            return [totals, drops, texts]

        return work

    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
    return with_columns(keyed.join(doomed, ["_k1", "_k2"], "left"), fields, kept, ["_k1", "_k2", "_none", "_doomed"])


def _long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has so many code points."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)
