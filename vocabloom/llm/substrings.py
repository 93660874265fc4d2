"""Substring deduplication: remove words covered by word windows that also start elsewhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .neardup import WordHashes, mixed
from .shared import flagged, free_names, row_keys, slices, with_columns, written

_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_COUNT = (1 << 24) - 1


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


class Rolling:
    """Hashes of word sequences of some texts: a text's words follow each other, the next text's come after."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes) -> None:
        parts = [np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w in map(words_of, texts)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        n = len(self.ids)
        self.sums, self.inverse = [], []
        for base in _BASES:
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.ids * _powers(base, n)[:-1], dtype=np.uint64)]))
            self.inverse.append(_powers(pow(base, -1, 1 << 64), n))

    def spans(self, start: np.ndarray, size: np.ndarray | int, which: int) -> np.ndarray:
        sums = self.sums[which]
        return mixed((sums[start + size] - sums[start]) * self.inverse[which][start] + np.uint64(0x5851F42D4C957F2D) * np.asarray(size).astype(np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i from 0 to n."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(roll: Rolling, window: int, minimizer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of consecutive windows with one minimizer: its text, first window (in that text), number of windows, and its minimizer's place."""
    sizes, n = roll.sizes, len(roll.ids)
    if n < window:
        return (np.zeros(0, np.int64),) * 4
    grams = roll.spans(np.arange(n - minimizer + 1), minimizer, 0)
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal grams
    width, span = window - minimizer + 1, 1
    least = packed
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(packed) - width + 1], least[width - span : width - span + len(packed) - width + 1])
    places = (least & low).astype(np.int64)
    counts = np.maximum(sizes - window + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(roll.starts, counts)
    at = places[first]
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    return text[cut], first[cut] - roll.starts[text[cut]], np.diff(np.concatenate([cut, [len(at)]])), at[cut]


def windows_to_spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Sorted window starts as merged word spans."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + window]))
    return list(zip(starts[cut].tolist(), (starts[np.concatenate([cut[1:], [len(starts)]]) - 1] + window).tolist(), strict=True))


@free_names
def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, minimizer: int = 8) -> DataFrame:
    """Remove each word that a repeated window covers: `window` consecutive words whose sequence also starts anywhere else.

    Returns the columns of `docs` and n_words, n_removed (long) and kept_text (kept words joined by single spaces).

    - The windows are the edges of a De Bruijn graph of words. Within a text, consecutive edges with one minimizer (the
      least hash of `minimizer` words) form one path segment. Segments of a minimizer that occurs once cannot repeat.
    - Joins compact the rest: a segment that repeats whole does not branch, and all its edges repeat.
    - What is left branches. Its edges are hashed one by one from the source text, with one copy of each whole repeat of
      the same minimizer, and counted. All sequence hashes have 128 bits.
    - Windows are judged on the input. Null texts have no words. Every row counts as a text, so the rows that repeat
      another lose everything a window covers; each is returned. Null ids are allowed. An empty table gives an empty
      result. Columns of `docs` named as a result column are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    keyed = docs.select(*row_keys(id_col, text_col, docs), "*")

    def segment_rows(batches):
        from pyspark import TaskContext

        hashes, row = WordHashes(), TaskContext.get().partitionId() << 34
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for start, texts in slices(batch.column(2), 2 << 20):
                roll = Rolling(texts, hashes)
                text, first, count, place = runs(roll, window, minimizer)
                begin = roll.starts[text] + first
                made = [row + start + text, keys[0][start + text], keys[1][start + text], (first << 24) | count]
                made += [x.view(np.int64) for x in (roll.spans(place, minimizer, 1), roll.spans(begin, count + window - 1, 0))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["_row", "_k1", "_k2", "_at", "_min", "_seg"])
            row += batch.num_rows

    texts = keyed.select("_k1", "_k2", F.col(text_col).cast("binary").alias("_text"))
    segments = written(texts.mapInArrow(segment_rows, "_row long, _k1 long, _k2 long, _at long, _min long, _seg long"), "segments")
    thin = segments.select("_row", "_at", "_min", "_seg")
    twice = written(thin.groupBy("_min").count().filter("count > 1"), "minimizers")
    some = written(flagged(thin, twice, ["_min"], segments.count()).filter("_hit").drop("_hit"), "repeated")
    n = some.count()
    one = some.groupBy("_min", "_seg").agg(F.count("*").alias("count"), F.min(F.struct("_row", "_at")).alias("_one"))
    kinds = written(one, "kinds")
    solid = kinds.filter("count > 1")
    mixed_minimizers = written(kinds.groupBy("_min").agg(F.sum("count").alias("count"), F.min("count").alias("_least")).filter("_least = 1").select("_min", "count"), "branching")
    judged = flagged(some, solid.select("_min", "_seg", "count"), ["_min", "_seg"], n, "_solid")
    copies = flagged(solid.select("_min", F.col("_one._row").alias("_row"), F.col("_one._at").alias("_at")), mixed_minimizers, ["_min"], n).filter("_hit").select("_row", "_at", F.lit(2).alias("_kind"))
    marks = judged.select("_row", "_at", F.when(F.col("_solid"), 1).otherwise(0).alias("_kind")).unionByName(copies)
    keys = segments.select("_row", "_k1", "_k2").distinct()
    per_row = marks.groupBy("_row").agg(F.collect_list(F.struct("_at", "_kind")).alias("_marks")).join(keys, "_row")
    per_text = written(per_row.groupBy("_k1", "_k2").agg(F.max_by("_marks", F.size("_marks")).alias("_marks"), F.count("*").alias("_times")), "marks")
    wide = written(keyed.select("_k1", "_k2", F.col(text_col).alias("_text")).join(per_text.filter(F.exists("_marks", lambda x: x["_kind"] != 1)), ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]), "sources")

    def edge_rows(batches):
        hashes = WordHashes()
        for batch in batches:
            for start, texts in slices(batch.column("_text"), 2 << 20):
                roll = Rolling(texts, hashes)
                marks = batch.column("_marks").slice(start, len(texts))
                sizes = np.diff(marks.offsets.to_numpy())
                flat = marks.flatten()
                at, kind = flat.field("_at").to_numpy(), flat.field("_kind").to_numpy()
                text = np.repeat(np.arange(len(texts)), sizes)
                text, at = text[kind != 1], at[kind != 1]
                first, count = at >> 24, at & _COUNT
                which = np.repeat(np.arange(len(at)), count)
                begin = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                text = text[which]
                k1, k2 = (batch.column(c).to_numpy()[start + text] for c in ("_k1", "_k2"))
                w1, w2 = (roll.spans(roll.starts[text] + begin, window, i).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, begin, w1, w2)], names=["_k1", "_k2", "_start", "_w1", "_w2"])

    edges = written(wide.mapInArrow(edge_rows, "_k1 long, _k2 long, _start long, _w1 long, _w2 long"), "edges")
    again = written(edges.groupBy("_w1", "_w2").count().filter("count > 1"), "edges_again")
    found = flagged(edges, again, ["_w1", "_w2"], edges.count()).filter("_hit").groupBy("_k1", "_k2").agg(F.collect_list("_start").alias("_starts"))
    solid_only = per_text.select("_k1", "_k2", F.expr("transform(filter(_marks, x -> x._kind = 1), x -> x._at)").alias("_solid"))
    plan = written(solid_only.join(found, ["_k1", "_k2"], "left"), "plan")

    def kept():
        def work(batch):
            totals, removed, out = [], [], []
            for text, solid, starts in zip(batch.column(text_col), batch.column("_solid"), batch.column("_starts"), strict=True):
                words = words_of(text.as_py().encode() if text.is_valid else None)
                totals.append(len(words))
                parts = []
                if solid.is_valid:
                    at = np.array(solid.as_py(), np.int64)
                    first, count = at >> 24, at & _COUNT
                    parts = [np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
                if starts.is_valid:
                    parts.append(np.array(starts.as_py(), np.int64))
                for low, high in reversed(windows_to_spans(np.unique(np.concatenate(parts)), window) if parts else []):
                    del words[low:high]
                removed.append(totals[-1] - len(words))
                out.append(b" ".join(words).decode())
            return [totals, removed, out]

        return work

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return with_columns(keyed.join(plan, ["_k1", "_k2"], "left"), fields, kept, ["_k1", "_k2", "_solid", "_starts"])
