"""Best-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted, written

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BIN = pa.schema([("bin", pa.int64()), ("fill", pa.int64()), ("pieces", pa.list_(PIECE))])
BIN_DDL = "bin long, fill long, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"

#: Byte-level vocabularies write each byte as a printable character: those that print stand for themselves, the others follow from U+0100.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The public pattern without its look-ahead, which matters only where white space stands next to white space.
_SIMPLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
_DOUBLE_SPACE = re.compile(r"\s\s")


class Encoder:
    """The ids of a byte-level BPE vocabulary file of the `tokenizers` library.

    special: strings of added tokens in a text are those tokens, as the library has it, or else ordinary text.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary, added = model["model"]["vocab"], {x["content"]: x for x in model["added_tokens"]}
        if special and any(x[k] for x in added.values() for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with rules of their own can't be split off")
        self.added = {content: x["id"] for content, x in added.items()} if special else {}
        self.cuts = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        rest = [b for b in range(256) if b not in _PRINTED]
        byte_of = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and not token.startswith("<|")}
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.token_bytes[i] = token
        simple, whole = (tiktoken.Encoding("file", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (_SIMPLE, public_tokenizers.PATTERN))
        self.simple, self.whole = simple.encode_ordinary, whole.encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.cuts and self.cuts.search(text):
            out, at = [], 0
            for found in self.cuts.finditer(text):
                out += [*self.plain(text[at : found.start()]), self.added[found.group()]]
                at = found.end()
            return out + self.plain(text[at:])
        return self.plain(text)

    def plain(self, text: str) -> list[int]:
        return self.whole(text) if _DOUBLE_SPACE.search(text) else self.simple(text)


def best_fit(fills: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: groups of indexes whose fills sum up to `capacity` at most."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for i in np.argsort(-fills, kind="stable").tolist():
        size = int(fills[i])
        rooms = open_rooms >> size
        if rooms:
            room = size + (rooms & -rooms).bit_length() - 1
            n = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, n = capacity, len(bins)
            bins.append([])
        bins[n].append(i)
        room -= size
        if room:
            by_room[room].append(n)
            open_rooms |= 1 << room
    return bins


def _batch(bins: list[tuple[int, int, list[tuple]]]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(b[2]) for b in bins])
    columns = list(zip(*(p for b in bins for p in b[2]), strict=True)) or [[]] * 5
    pieces = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], fields=list(PIECE))
    return pa.RecordBatch.from_arrays([pa.array([b[0] for b in bins], pa.int64()), pa.array([b[1] for b in bins], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)], schema=BIN)


def repacked(items: list[tuple[int, int, list[tuple]]], capacity: int) -> list[tuple[int, int, list[tuple]]]:
    """Put underfull bins (number, fill, pieces) together; a new bin has the least number of its parts."""
    groups = best_fit(np.array([x[1] for x in items], np.int64), capacity)
    return [(min(items[i][0] for i in g), sum(items[i][1] for i in g), [p for i in g for p in items[i][2]]) for g in groups]


def pieces_of(doc_id: int | None, ids: list[int], capacity: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc32 of the ids): whole, or cut into full pieces after a first one of what is over."""
    packed = np.array(ids, "<u4")
    first = len(ids) % capacity or capacity
    for n, start in enumerate([0, *range(first, len(ids), capacity)]):
        end = first if n == 0 else start + capacity
        yield doc_id, n, start, end - start, zlib.crc32(packed[start:end].tobytes())


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    slack: int = 2,
    fan_in: int = 8,
    most_items: int = 100_000,
) -> DataFrame:
    """Tokenize documents and pack them into few sequences of at most `capacity` tokens.

    Returns doc_id, piece (int), start, length, ids_crc32, sequence_id and offset (long), a row for each piece.

    - A document is its ids and then `end_id`; only longer ones than `capacity` are cut, the first piece being the short
      one. Null texts count as empty: one token.
    - Round 0 packs each input partition by best-fit decreasing, at most `most_items` items at a time. Bins with at most
      `slack` free tokens are done. The underfull ones become the items of the next round, dealt anew to `fan_in` times
      fewer groups, until one group of at most `most_items` has been packed. With more items than that the groups keep
      that size, and rounds go on until one no longer lowers the number of sequences.
    - A null id stays null; repeated rows are packed each. An empty table gives no rows. Other columns are not used.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, first = Encoder(tokenizer_path, special=True), TaskContext.get().partitionId() << 34
        items, made = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in pieces_of(doc_id, [*encoder.ids(text.as_py()), end_id], capacity):
                    items.append((first + made, piece[3], [piece]))
                    made += 1
                if len(items) >= most_items:
                    bins = repacked(items, capacity)
                    done = [b for b in bins if b[1] >= capacity - slack]
                    items = [b for b in bins if b[1] < capacity - slack]
                    if len(items) > most_items // 2:
                        done, items = bins, []
                    yield _batch(done)
        for i in range(0, len(bins := repacked(items, capacity)), 10_000):
            yield _batch(bins[i : i + 10_000])

    bins = written(texts.mapInArrow(local, BIN_DDL), "round0")
    done = [bins.filter(F.col("fill") >= capacity - slack)]
    under = bins.filter(F.col("fill") < capacity - slack)
    groups = max(2, docs.rdd.getNumPartitions())

    def merge(group: pa.Table) -> pa.Table:
        columns = [group.column(n).to_pylist() for n in BIN.names]
        items = sorted(((b, f, [tuple(p.values()) for p in ps]) for b, f, ps in zip(*columns, strict=True)), key=lambda x: x[0])
        return pa.Table.from_batches([_batch(repacked(items, capacity))])

    for turn in itertools.count():
        n = under.count()
        least = max(1, -(-n // most_items))
        groups = max(least, groups // fan_in)
        dealt = under.withColumn("_group", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
        bins, left = counted(dealt.groupBy("_group").applyInArrow(merge, BIN_DDL), f"round{turn + 1}")
        done.append(bins.filter(F.col("fill") >= capacity - slack))
        under = bins.filter(F.col("fill") < capacity - slack)
        if groups == 1 or (groups == least and left == n):
            break
    whole = under
    for part in done:
        whole = whole.unionByName(part)

    def unfold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pieces")
            pieces = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            lengths = pieces.field("length").to_numpy(zero_copy_only=False)
            before = np.cumsum(lengths) - lengths
            starts = np.cumsum(sizes) - sizes
            offsets = before - np.repeat(before[np.minimum(starts, max(0, len(before) - 1))], sizes) if len(before) else before
            columns = [*pieces.flatten(), pa.array(np.repeat(batch.column("bin").to_numpy(), sizes)), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in PIECE), "sequence_id", "offset"])

    return whole.mapInArrow(unfold, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
