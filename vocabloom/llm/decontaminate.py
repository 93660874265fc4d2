"""Benchmark decontamination: a prefix-filtered containment join of item windows and documents."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_names, slices, with_columns, written

#: ASCII letters and digits and everything beyond ASCII are word bytes, A-Z are lower-cased; the rest separates words.
_WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
_P = np.uint64(0x9E3779B97F4A7C15)

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("item_ids", T.ArrayType(T.StringType()))]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The distinct (window, item id) pairs: windows of `width` consecutive words, or all words of a shorter item."""

    def make():
        def work(batch):
            out = []
            for text in batch.column("_text"):
                words = words_of(text.as_py())
                n = max(1, len(words) - width + 1) if words else 0
                out.append(list({b" ".join(words[i : i + width]) for i in range(n)}))
            return [out]

        return work

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_item"), F.col(text_col).cast("binary").alias("_text"))
    made = with_columns(items, [T.StructField("_windows", T.ArrayType(T.BinaryType()))], make, ["_text"])
    return made.select(F.explode("_windows").alias("window"), F.col("_item").alias("item")).distinct()


class WindowIndex:
    """One block of windows, ready to be matched: vocabulary, shingles of each window, and the window list of each necessary shingle."""

    def __init__(self, rows: list[tuple[bytes, str]], shingle: int) -> None:
        items: dict[bytes, list[str]] = defaultdict(list)
        for window, item in rows:
            items[window].append(item)
        self.items = [sorted(x) for x in items.values()]
        self.vocabulary: dict[bytes, int] = {}
        self.windows = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in x.split(b" ")] for x in items]
        self.widths = sorted({min(shingle, len(w)) for w in self.windows})
        self.shingles = [[self.key(w[i : i + s]) for i in range(len(w) - s + 1)] for w in self.windows for s in [min(shingle, len(w))]]
        self.all = {s: np.unique(np.array([k for w, ks in zip(self.windows, self.shingles, strict=True) if min(shingle, len(w)) == s for k in ks], np.uint64)) for s in self.widths}
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}

    @staticmethod
    def key(ids: list[int]) -> int:
        out = 0
        for x in ids:
            out = (out * int(_P) + x) & 0xFFFFFFFFFFFFFFFF
        return out

    def order_by_rarity(self, counts: dict[int, int], shingle: int) -> None:
        """Containment needs every shingle of a window, so its prefix is one shingle: the rarest among all documents."""
        self.prefix = {s: defaultdict(list) for s in self.widths}
        for n, (window, keys) in enumerate(zip(self.windows, self.shingles, strict=True)):
            at = min(range(len(keys)), key=lambda i: (counts.get(keys[i], 0), keys[i]))
            self.prefix[min(shingle, len(window))][keys[at]].append((n, at))
        self.rare = {s: np.array(sorted(x), np.uint64) for s, x in self.prefix.items()}

    def ids(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The word ids of some texts (0: no benchmark word), with a 0 after each text, and where each text starts."""
        get, parts, starts = self.vocabulary.get, [], [0]
        for text in texts:
            words = words_of(text)
            part = np.zeros(len(words) + 1, np.int64)
            part[:-1] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            parts.append(part)
            starts.append(starts[-1] + len(part))
        return np.concatenate(parts), np.array(starts)

    def found(self, ids: np.ndarray, width: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a shingle of `wanted` starts, and which."""
        if len(ids) < width or not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        at = np.flatnonzero(gaps[width:] == gaps[:-width])
        keys = np.zeros(len(at), np.uint64)
        for i in range(width):
            keys = keys * _P + ids[at + i].astype(np.uint64)
        hit = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
        return at[hit], keys[hit]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


@free_names
def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    width: int = 10,
    shingle: int = 5,
    block_pairs: int = 200_000,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Find windows of benchmark items in documents.

    Returns the columns of `docs` and n_words (long), hit_spans (array of start and end, in words, merged), item_ids
    (array of strings, sorted) and contaminated (boolean).

    - Shingles of `shingle` words are ordered by their count over all documents. A contained window needs all of its
      shingles, so the rarest one is its prefix and the only one joined; the place of the window then follows, must lie
      inside the document, and is compared word by word.
    - The benchmark is joined in blocks of at most `block_pairs` (window, item) pairs and about `block_bytes`, each
      broadcast: a larger benchmark makes more blocks, not larger ones. Each block reads the documents and writes what it
      finds in which text; the blocks' findings are joined to the documents once.
    - Null and empty texts have no words and are not contaminated; items without words match nothing; an item with a
      null id is called "null". Repeated rows are each returned. Empty tables give empty or clean results.
    - Columns of `docs` named as a result column are replaced.
    """
    spark = docs.sparkSession
    pairs = written(item_windows(benchmark, id_col, text_col, width), "windows")
    n, size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + 16), F.lit(0))).first()
    blocks = max(1, -(-n // block_pairs), -(-size // block_bytes))
    out = docs.drop("n_words", "hit_spans", "item_ids", "contaminated")
    texts = out.select("text") if blocks == 1 else out.select(F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2"), "text")
    found = []
    for block in range(blocks):
        rows = [(bytes(r.window), r.item) for r in pairs.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block).collect()]
        index = WindowIndex(rows, shingle)
        asked = spark.sparkContext.broadcast(index)
        counts = {r._key & 0xFFFFFFFFFFFFFFFF: r.n for r in _shingle_counts(texts.select(F.col("text").cast("binary").alias("_text")), asked).collect()}
        asked.destroy()
        index.order_by_rarity(counts, shingle)
        ready = spark.sparkContext.broadcast(index)
        if blocks == 1:
            out = _matched(out, ready)
        else:
            found.append(written(_matched(texts, ready, drop=["text", "n_words"]).filter(F.size("hit_spans") > 0).distinct(), f"block{block}"))
            ready.destroy()
    if blocks > 1:
        out = _joined(out, reduce(DataFrame.unionByName, found))
    return out.withColumn("contaminated", F.size("hit_spans") > 0)


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Add n_words, and of what the blocks found for each text (_k1, _k2, hit_spans, item_ids) the union."""
    per_text = found.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("hit_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    keyed = docs.select("*", F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")).join(per_text, ["_k1", "_k2"], "left")

    def make():
        def work(batch):
            spans = [[(x["start"], x["end"]) for x in own or ()] for own in batch.column("_spans").to_pylist()]
            n_words = [len(words_of(t.as_py().encode() if t.is_valid else None)) for t in batch.column("text")]
            return [n_words, [[{"start": a, "end": b} for a, b in merged(x)] for x in spans], [x or [] for x in batch.column("item_ids").to_pylist()]]

        return work

    return with_columns(keyed, FIELDS, make, ["_k1", "_k2", "_spans"])


def _shingle_counts(texts: DataFrame, shared) -> DataFrame:
    """How often each benchmark shingle occurs in all documents; at most as many rows as the block has shingles."""

    def run(batches):
        index = shared.value
        totals = {s: np.zeros(len(index.all[s]), np.int64) for s in index.widths}
        for batch in batches:
            for _, texts in slices(batch.column(0), 4 << 20):
                ids, _ = index.ids(texts)
                for s in index.widths:
                    at = np.searchsorted(index.all[s], index.found(ids, s, index.all[s])[1])
                    totals[s] += np.bincount(at, minlength=len(totals[s]))
        for s, counts in totals.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(index.all[s][some].view(np.int64)), pa.array(counts[some])], names=["_key", "n"])

    return texts.mapInArrow(run, "_key long, n long").groupBy("_key").agg(F.sum("n").alias("n"))


def _matched(docs: DataFrame, shared, drop: Sequence[str] = ()) -> DataFrame:
    """Add n_words, and one block's hit_spans and item_ids."""

    def make():
        index = shared.value
        arrays = [np.array(w, np.int64) for w in index.windows]

        def work(batch):
            n_words, spans, items = [], [], []
            for _, texts in slices(batch.column("text"), 4 << 20):
                ids, starts = index.ids(texts)
                hits: dict[int, tuple[list, set]] = {}
                for s in index.widths:
                    for at, key in zip(*(x.tolist() for x in index.found(ids, s, index.rare[s])), strict=True):
                        doc = bisect.bisect_right(starts, at) - 1
                        low, high = starts[doc], starts[doc + 1] - 1
                        for n, offset in index.prefix[s][key]:
                            start, window = at - offset, arrays[n]
                            if low <= start and start + len(window) <= high and np.array_equal(ids[start : start + len(window)], window):
                                own = hits.setdefault(doc, ([], set()))
                                own[0].append((int(start - low), int(start - low) + len(window)))
                                own[1].update(index.items[n])
                for i in range(len(texts)):
                    n_words.append(int(starts[i + 1] - starts[i] - 1))
                    own = hits.get(i, ([], set()))
                    spans.append(own[0])
                    items.append(own[1])
            return [n_words, [[{"start": a, "end": b} for a, b in merged(x)] for x in spans], [sorted(x) for x in items]]

        return work

    return with_columns(docs, FIELDS, make).drop(*drop)
