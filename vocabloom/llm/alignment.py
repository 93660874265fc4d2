"""Alignment of the tokens that two tokenizers make of the same texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import Encoder
from .shared import looked_up, slices, written

#: So many pairs of ids at most are looked up through a broadcast, the most frequent ones.
MOST_PAIRS = 200_000
#: Larger groups are multiplied by id and number of occurrences.
_LARGE = 4096
_TEXT_BYTES = 1 << 20

ALIGNED = "doc_id {}, _row long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, links array<long>"


class ByteTokens:
    """A byte-level vocabulary file of `tokenizers`: ids of a space and a text, and the bytes of each id. Strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        encoder = Encoder(path)
        self.ids, self.bytes = encoder.ids, encoder.token_bytes

    def encode(self, text: str) -> list[int]:
        return self.ids(" " + text)


class PieceTokens:
    """A `sentencepiece` model, which puts a space before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = lambda text: model.encode(text, num_threads=1)
        own = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(own)]


class _Texts(dict):
    """Ids as text with an ending, made once for each id of a vocabulary."""

    def __init__(self, end: str) -> None:
        self.end = end

    def __missing__(self, i: int) -> str:
        self[i] = f"{i}{self.end}"
        return self[i]


_FIRST, _SECOND, _PLAIN = _Texts("|"), _Texts(";"), _Texts("")


def stretches(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Cut two rising lists of token ends with the same last end where both end: (start, end) in `a`, then in `b`.

    As many tokens of both that are one to one come as one stretch. Its length is found by exponential probing: slices at the current
    shift between the indexes are compared, twice as long each time, and the last one by halves. What follows it is one group
    in which ends meet only at its end; the shift is another after it.
    """
    i, j, n = 0, 0, len(a)
    while i < n:
        at, length = i, 4
        while at < n and a[at : at + length] == b[at - i + j : at - i + j + length]:
            at += length
            length += length
        at = min(at, n)
        while at < n and length > 1:
            length //= 2
            if a[at : at + length] == b[at - i + j : at - i + j + length]:
                at = min(at + length, n)
        if at > i:
            yield i, at, j, at - i + j
            i, j = at, at - i + j
        if i < n:
            p, q = i, j
            while a[p] != b[q]:
                if a[p] < b[q]:
                    p += 1
                else:
                    q += 1
            yield i, p + 1, j, q + 1
            i, j = p + 1, q + 1


def aligned(ids_a: list[int], ids_b: list[int], ends_a: list[int], ends_b: list[int]) -> tuple[int, int, str, Counter]:
    """Number of groups, number of links, the groups as text, and how often each pair of ids is linked."""
    firsts, seconds, left, right = [], [], [], []
    more: Counter = Counter()
    n_groups = n_links = 0
    for i, p, j, q in stretches(ends_a, ends_b):
        own, other = ids_a[i:p], ids_b[j:q]
        if len(own) == len(other) and ends_a[i] == ends_b[j]:
            n_groups += len(own)
            n_links += len(own)
            firsts += own
            seconds += other
            left += [_FIRST[x] for x in own]
            right += [_SECOND[y] for y in other]
            continue
        n_groups += 1
        n_links += len(own) * len(other)
        left.append(",".join([_PLAIN[x] for x in own]) + "|")
        right.append(",".join([_PLAIN[y] for y in other]) + ";")
        if len(own) == 1:
            firsts += own * len(other)
            seconds += other
        elif len(own) * len(other) <= _LARGE:
            for x in own:
                firsts += [x] * len(other)
                seconds += other
        else:
            for (x, k), (y, m) in product(Counter(own).items(), Counter(other).items()):
                more[x, y] += k * m
    pairs = Counter(zip(firsts, seconds, strict=True))
    if more:
        pairs.update(more)
    texts = [""] * (2 * n_groups)
    texts[::2], texts[1::2] = left, right
    return n_groups, n_links, "".join(texts)[:-1], pairs


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize each text with a byte-level vocabulary (A, of a space and the text) and a piece model (B), and align the tokens.

    Returns doc_id, _row (a number of the row, stable only once it is written), n_a, n_b (tokens), n_groups, n_links (long),
    groups (`a1,a2|b1;a3|b2,b3`), and the distinct pairs of linked ids as arrays a, b and links (their occurrences).

    - Byte offsets where tokens of both end cut them into groups, and tokens of one group are linked.
    - A text that is null or empty, or whose tokens of either kind aren't the bytes of a space and the text, has no tokens:
      zeros, no pairs and an empty `groups`.
    - Null ids stay null; repeated rows are each returned. An empty table gives no rows. Other columns are not used. A text
      is aligned whole, in the memory of one task.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, first, second = TaskContext.get().partitionId() << 34, ByteTokens(path_a), PieceTokens(path_b)
        sizes = [list(map(len, x.bytes)) for x in (first, second)]
        for batch in batches:
            for start, texts in slices(batch.column("_text"), _TEXT_BYTES):
                counts, groups, pairs = [], [], []
                for raw in texts:
                    made = _of_text(raw, first, second, sizes) if raw else None
                    counts.append(made[0] if made else (0, 0, 0, 0))
                    groups.append(made[1] if made else "")
                    pairs.append(made[2] if made else {})
                at = pa.array(np.cumsum([0] + [len(x) for x in pairs]), pa.int32())
                keys = np.array([k for x in pairs for k in x], np.int32).reshape(-1, 2)
                times = np.array([n for x in pairs for n in x.values()], np.int64)
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), times)]
                numbers = [pa.array(x) for x in np.array(counts, np.int64).reshape(-1, 4).T.copy()]
                rows = pa.array(np.arange(row, row + len(texts)))
                row += len(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), rows, *numbers, pa.array(groups, pa.string()), *lists], names=["doc_id", "_row", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "links"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    return texts.mapInArrow(run, ALIGNED.format(kind))


def _of_text(raw: bytes, first: ByteTokens, second: PieceTokens, sizes: list[list[int]]) -> tuple | None:
    """Counts, groups and pairs of a text; null if its tokens aren't its bytes."""
    text, whole = raw.decode(), b" " + raw
    a, b = first.encode(text), second.encode(text)
    if b"".join([first.bytes[i] for i in a]) != whole or b"".join([second.bytes[i] for i in b]) != whole:
        return None
    ends = [list(accumulate([own[i] for i in ids])) for ids, own in zip((a, b), sizes, strict=True)]
    n_groups, n_links, groups, pairs = aligned(a, b, *ends)
    return (len(a), len(b), n_groups, n_links), groups, pairs


def with_pair_counts(rows: DataFrame) -> DataFrame:
    """Rows of `align`, of which `groups` may be missing or others added, with what the whole table says of their links.

    Returns the columns but for _row, a, b and links, and n_best and count_sum (long): the count of a pair of ids is the
    number of rows that hold it linked; n_best counts the links whose count is the highest of their A id (ties included),
    and count_sum is the sum of counts over links.

    - Pairs are counted with partial sums before the shuffle. The most frequent ones, MOST_PAIRS at most, are then looked up by broadcast,
      and the others, of which none is in many rows, by a join.
    - Other columns pass through, and clashing names of these two are replaced.
    """
    rows = written(rows.drop("n_best", "count_sum"), "aligned")
    each = rows.select("_row", F.explode(F.arrays_zip("a", "b", "links")).alias("_pair")).select("_row", "_pair.*")
    counted = each.groupBy("a", "b").agg(F.count("*").alias("count"))
    pairs = written(counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a"))), "pairs")
    sizes = pairs.groupBy(F.floor(F.log2("count")).cast("int").alias("bits")).count().orderBy(F.desc("bits")).collect()  # 64 rows at most
    total, bar = 0, 2.0**63
    for size in sizes:
        total += size["count"]
        if total > MOST_PAIRS:
            break
        bar = 2.0**size.bits - 0.5
    looked = looked_up(each, pairs, ["a", "b"], ["count", "best"], bar)
    sums = looked.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    own = rows.drop("a", "b", "links").join(sums, "_row", "left")
    return own.select(*(c for c in own.columns if c not in ("_row", "n_best", "count_sum")), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))
