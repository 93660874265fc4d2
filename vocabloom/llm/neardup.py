"""MinHash near-duplicate detection with tensored banding and verified links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import HEAVY_SHARE, counted, flagged, free_names, looked_up, row_keys, slices, with_columns, written

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)
_LOWER = bytes(range(256)).lower()
_KEPT_WORDS = 300_000
#: Counts by which shingles are put in order; more shingles share counts, no more counts are kept.
RARITY = 1 << 17
#: A pair of sets is left out at a shingle if they share one of so many before it.
LOOK_BACK = 12


class WordHashes(dict):
    """64-bit hashes of words; at most _KEPT_WORDS are kept."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = xxh3_64_intdigest(word)
        if len(self) < _KEPT_WORDS:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def shingle_sets(texts: list[bytes | None], hashes: WordHashes, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text: of `width` words, or of all words where there are fewer."""
    out = []
    for text in texts:
        words = (text or b"").translate(_LOWER).split()
        n = len(words)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        own = min(width, n)
        keys = np.full(n - own + 1, own, np.uint64)
        for i in range(own):
            keys = mixed(keys + ids[i : n - own + 1 + i])
        out.append(np.unique(keys))
    return out


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_011).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def half_keys(sets: list[np.ndarray], rows: int, collections: int) -> np.ndarray:
    """For each set 2 * collections keys, each of `rows` minhashes. The first half of them are the left collections."""
    n_hashes = 2 * rows * collections
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), 2 * collections), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.concatenate([sets[i] for i in some])
    starts = np.cumsum(sizes[some]) - sizes[some]
    for j, m in enumerate(_multipliers(n_hashes)):
        low = np.minimum.reduceat(flat * m >> np.uint64(8), starts)  # an odd multiplier permutes; the top bits are the best mixed
        k = j // rows
        out[some, k] = mixed(out[some, k] * np.uint64(31) + low + np.uint64(k + 1))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int, collections: int) -> DataFrame:
    """doc_id, _k2 (a hash of the text), n_shingles, _set (a hash of the whole set; null for an empty one), _keys (2 * collections)."""

    def make():
        from xxhash import xxh3_128_digest

        hashes = WordHashes()

        def work(batch):
            sizes, sums, keys = [], [], []
            for _, texts in slices(batch.column("_text"), 2 << 20):
                sets = shingle_sets(texts, hashes, width)
                sizes += [len(s) for s in sets]
                sums += [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                keys += half_keys(sets, rows, collections).view(np.int64).tolist()
            return [sizes, sums, keys]

        return work

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("_set", T.BinaryType()), T.StructField("_keys", T.ArrayType(T.LongType()))]
    return with_columns(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("_k2"), F.col(text_col).alias("_text")), fields, make, ["_text"])


def collisions(classes: DataFrame, collections: int) -> DataFrame:
    """(_table, _id): the classes that share a table key with another. A table key pairs a left key with a right one.

    Only keys that a class shares with another are paired, as a pair of keys cannot be shared otherwise.
    """
    halves, n = counted(classes.select("_id", "n_shingles", F.posexplode("_keys").alias("_at", "_key")), "halves")
    shared_halves = written(halves.groupBy("_at", "_key").count().filter("count > 1"), "shared_halves")
    both = flagged(halves, shared_halves, ["_at", "_key"], n).filter("_hit")
    sides = both.groupBy("_id").agg(F.collect_list(F.when(F.col("_at") < collections, F.struct("_at", "_key"))).alias("_left"), F.collect_list(F.when(F.col("_at") >= collections, F.struct("_at", "_key"))).alias("_right"), F.first("n_shingles").alias("_size"))
    pairs = sides.select("_id", "_size", F.explode("_left").alias("_l"), "_right").select("_id", "_size", "_l", F.explode("_right").alias("_r"))
    return written(pairs.select(F.xxhash64("_l._at", "_l._key", "_r._at", "_r._key").alias("_table"), "_id", "_size"), "tables")


def _possible(a: str, b: str, percent: int):
    """Whether two set sizes allow the likeness."""
    return F.expr(f"100L * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text) of some classes, one row each: the text of the row that stands for it. Both sides grow with the corpus, so neither is broadcast at any size."""
    texts = docs.select(F.col(id_col).cast("long").alias("_name"), F.xxhash64(text_col).alias("_k2"), F.col(text_col).alias("_text"))
    wanted = classes.select("_id", "_name", "_k2").join(nodes.select("_id").distinct().hint("merge"), "_id")
    return written(texts.join(wanted.hint("merge"), ["_name", "_k2"]).select("_id", "_text").dropDuplicates(["_id"]), "texts")


def verified(edges: DataFrame, texts: DataFrame, width: int, percent: int, per_task: int = 64) -> DataFrame:
    """The (_id, _pivot) edges whose whole shingle sets are alike enough.

    A pivot with many edges (over `per_task`, and at least 1 / HEAVY_SHARE of all) is dealt to several tasks, each of
    about `per_task` texts and the pivot's. Texts pass through a task one by one.
    """
    edges, n = counted(edges, "edges")
    bar = max(per_task, n / HEAVY_SHARE)
    degrees = edges.groupBy("_pivot").count().withColumn("_parts", F.when(F.col("count") > bar, F.ceil(F.col("count") / per_task).cast("int")).otherwise(1))
    heavy = F.broadcast(degrees.filter("_parts > 1").select("_pivot", "_parts"))  # at most HEAVY_SHARE rows
    dealt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).otherwise(0)
    members = edges.join(heavy, "_pivot", "left").select("_pivot", dealt.alias("_part"), F.lit(1).alias("_role"), "_id")
    pivots = degrees.select("_pivot", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_role"), F.col("_pivot").alias("_id"))
    rows = members.unionByName(pivots).hint("merge").join(texts, "_id").select("_pivot", "_part", "_role", "_id", "_text")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pivot, own = WordHashes(), None, np.zeros(0, np.uint64)
        for batch in batches:
            ids, to = [], []
            for p, role, i, text in zip(*(batch.column(n).to_pylist() for n in (0, 2, 3)), batch.column(4).cast(pa.large_binary()), strict=True):
                one = shingle_sets([text.as_py()], hashes, width)[0]
                if role == 0:
                    pivot, own = p, one
                elif p == pivot:
                    common = len(np.intersect1d(one, own, assume_unique=True))
                    if 100 * common >= percent * (len(one) + len(own) - common):
                        ids.append(i)
                        to.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(to, pa.int64())], names=["_id", "_pivot"])

    return written(rows.repartition("_pivot", "_part").sortWithinPartitions("_pivot", "_part", "_role").mapInArrow(check, "_id long, _pivot long"), "links")


def prefix_pairs(nodes: DataFrame, texts: DataFrame, width: int, percent: int, per_task: int = 500) -> DataFrame:
    """Pairs (_id, _pivot) of nodes (_id, _root) of different roots that can be alike enough; none that is can be missing.

    All sets are put in one order, rarest shingles first by a table of RARITY counts. Of two sets alike enough, what they
    share is at least percent / (100 + percent) of both sizes together, so the first shingle that they share is among the
    first n - ceil(n * 2 * percent / (100 + percent)) + 1 of the smaller, n being its size, and among the first
    n - ceil(n * percent / 100) + 1 of the larger; sizes and the places of that shingle bound the rest. A shingle with many
    smaller sets, over `per_task`, has them dealt to several tasks, and the larger ones sent to each of those.
    """
    texts = written(texts.join(nodes.hint("merge"), "_id").select("_id", "_root", "_text"), "undecided")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, totals = WordHashes(), np.zeros(RARITY, np.int64)
        for batch in batches:
            for _, some in slices(batch.column(0), 2 << 20):
                for one in shingle_sets(some, hashes, width):
                    np.add.at(totals, (one % np.uint64(RARITY)).astype(np.int64), 1)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["bucket", "n"])

    rarity = np.zeros(RARITY, np.int64)
    for r in texts.select("_text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # RARITY rows at most
        rarity[r.bucket] = r.n
    shared = nodes.sparkSession.sparkContext.broadcast(rarity)

    def make():
        hashes, rarity = WordHashes(), shared.value

        def work(batch):
            sizes, tokens = [], []
            for _, some in slices(batch.column("_text"), 2 << 20):
                for one in shingle_sets(some, hashes, width):
                    n = len(one) + (-len(one) * percent // 100) + 1
                    first = np.lexsort((one, rarity[(one % np.uint64(RARITY)).astype(np.int64)]))[:n]
                    sizes.append(len(one))
                    tokens.append(one[first].view(np.int64).tolist())
            return [sizes, tokens]

        return work

    fields = [T.StructField("_size", T.LongType()), T.StructField("_tokens", T.ArrayType(T.LongType()))]
    listed = with_columns(texts, fields, make, ["_text"]).select("_id", "_root", "_size", "_tokens", F.posexplode("_tokens").alias("_at", "_token"))
    before = F.slice("_tokens", F.greatest(F.col("_at") + 1 - LOOK_BACK, F.lit(1)), F.least(F.col("_at"), F.lit(LOOK_BACK)))
    tokens = written(listed.select("_id", "_root", "_size", "_at", "_token", before.alias("_before")), "prefixes")
    own = F.expr(f"_at <= _size - CAST(ceil(_size * {2 * percent}L / {100 + percent}) AS BIGINT)")
    counts = written(tokens.groupBy("_token").agg(F.count_if(own).alias("_small"), F.count("*").alias("count")).filter("count > 1 and _small > 0").select("_token", F.ceil(F.col("_small") / per_task).cast("int").alias("_parts"), "count"), "tokens")
    b = looked_up(tokens.filter(own), counts, ["_token"], ["_parts"]).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).alias("b")
    a = looked_up(tokens, counts, ["_token"], ["_parts"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).alias("a")
    most = "least(a._size - a._at, b._size - b._at)"  # shingles that both can have, if this is the first common one
    alike = F.expr(f"100L * ({most}) >= {percent} * (a._size + b._size - ({most}))")
    larger = F.expr("a._size > b._size or (a._size = b._size and a._id > b._id)")
    first = F.expr("not arrays_overlap(a._before, b._before)")  # else the pair is found at that earlier shingle
    met = a.join(b.hint("merge"), F.expr("a._token = b._token and a._part = b._part and a._root <> b._root")).filter(larger & _possible("a._size", "b._size", percent) & alike & first)
    return met.select(F.col("a._id").alias("_id"), F.col("b._id").alias("_pivot")).distinct()


def components(edges: DataFrame, much: int = 50_000) -> DataFrame:
    """(_id, _root): the least id that each id of the (_id, _pivot) edges reaches. Alternates large-star and small-star rounds.

    The number of edges never grows. Ends with more than `much` edges, and at least 1 / HEAVY_SHARE of all, are looked up by
    broadcast; with fewer edges in all there are none.
    """

    def star(e: DataFrame, large: bool, name: str) -> tuple[DataFrame, tuple]:
        ends = e.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v"))
        if large:
            ends = ends.unionByName(ends.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = ends.groupBy("_u").agg(F.least(F.col("_u"), F.min("_v")).alias("_m"), F.count("*").alias("count"))
        both = looked_up(ends, least, ["_u"], ["_m"], bar) if n > much else ends.join(least, "_u")
        new = both.filter("_v > _u" if large else "true").select(F.col("_v").alias("_a"), F.col("_m").alias("_b"))
        if not large:
            new = new.unionByName(least.select(F.col("_u").alias("_a"), F.col("_m").alias("_b")))
        seen = Observation()
        sums = F.count("*").alias("n"), F.bit_xor(F.xxhash64("_a", "_b")).alias("x"), F.sum(F.pmod(F.xxhash64("_b", "_a"), F.lit(1 << 31))).alias("s")
        made = written(new.filter("_a <> _b").distinct().observe(seen, *sums), name)
        return made, tuple(seen.get[k] for k in "nxs")

    edges, n = counted(edges.filter("_id <> _pivot").select(F.greatest("_id", "_pivot").alias("_a"), F.least("_id", "_pivot").alias("_b")).distinct(), "graph")
    bar, mark = max(much, n / HEAVY_SHARE), None
    while True:
        edges, now = star(star(edges, True, "large")[0], False, "small")
        if now == mark or not now[0]:
            return edges.select(F.col("_a").alias("_id"), F.col("_b").alias("_root"))
        mark = now


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, rows: int, collections: int) -> DataFrame:
    """doc_id, _k2, n_shingles and _group of each row: rows with one group hold near-duplicates; null for empty sets and null ids.

    A node is a set of shingles, so rows that share an id but not a set are nodes of their own.
    """
    signs = written(signatures(docs, id_col, text_col, width, rows, collections), "signatures")
    stands = F.min(F.struct(F.col("doc_id").alias("_name"), "_k2"))
    classes = signs.filter("_set is not null and doc_id is not null").groupBy("_set").agg(stands.alias("_one"), F.first("n_shingles").alias("n_shingles"), F.first("_keys").alias("_keys"), F.count("*").alias("count"))
    classes = written(classes.select("_set", F.monotonically_increasing_id().alias("_id"), "_one.*", "n_shingles", "_keys", "count"), "classes")
    tables = collisions(classes, collections)
    keys = written(tables.groupBy("_table").agg(F.min(F.struct("_id", "_size")).alias("_first"), F.count("*").alias("count")).filter("count > 1").select("_table", F.col("_first._id").alias("_pivot"), F.col("_first._size").alias("_p_size")), "keys")
    met = written(tables.join(keys, "_table"), "met")
    stars = met.filter("_id <> _pivot").filter(_possible("_size", "_p_size", percent)).select("_id", "_pivot").distinct()
    texts = texts_of(met, classes, docs, id_col, text_col)
    links = verified(stars, texts, width, percent)
    roots = components(links)

    own = F.coalesce("_root", "_id")
    placed = met.select("_table", "_id").join(roots, "_id", "left").withColumn("_root", own)
    split = placed.groupBy("_table").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high")).filter("_low <> _high").select("_table")
    undecided = placed.join(split, "_table").select("_id", "_root").distinct()
    more = verified(prefix_pairs(undecided, texts, width, percent), texts, width, percent)

    roots = components(links.unionByName(more))
    groups = written(classes.select("_set", "_id", "count").join(roots, "_id", "left").select("_set", "count", own.alias("_group")), "groups")
    with_set = signs.filter("_set is not null and doc_id is not null")
    placed = looked_up(with_set, groups, ["_set"], ["_group"]).select("doc_id", "_k2", "n_shingles", "_group")
    rest = signs.filter("_set is null or doc_id is null").select("doc_id", "_k2", "n_shingles", F.lit(None).cast("long").alias("_group"))
    return written(placed.unionByName(rest), "grouped")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    rows: int = 2,
    collections: int = 12,
) -> DataFrame:
    """Group documents linked by 100 * intersection >= percent * union of their distinct word shingles.

    Returns doc_id, n_shingles (long), component_id (the least id reachable) and kept (doc_id = component_id).

    - Tensored banding: 2 * `collections` keys of `rows` minhashes each are computed, in a left and a right half, and
      the collections**2 tables are keyed by a left and a right key together. A pair of likeness s shares no table with
      probability 1 - (1 - (1 - s**rows)**collections)**2: below 1e-4 at 0.75, 1e-5 at 0.81.
    - Documents with equal shingle sets are one class. In each table the classes with one key are linked to the least of
      them, checked on full sets. Where a key still holds several components, its documents are joined once more across
      components by an exact prefix filter, and the pairs are checked: every pair that shares a key is decided or already
      connected, without listing the pairs of a key.
    - Empty sets link with nothing. Each row is returned; rows that share an id but not a text are compared each, and
      don't link each other's texts. A row with a null id is kept alone, with a null component_id. An empty table gives
      an empty result. Columns of `docs` other than the two are not used.
    """
    found = grouped(docs, id_col, text_col, width, percent, rows, collections)
    least = written(found.filter("_group is not null").groupBy("_group").agg(F.min("doc_id").alias("_least"), F.count("*").alias("count")), "least")
    named = looked_up(found.filter("_group is not null"), least, ["_group"], ["_least"]).select("doc_id", "n_shingles", "_least")
    alone = found.filter("_group is null").select("doc_id", "n_shingles", F.col("doc_id").alias("_least"))
    out = named.unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("_least").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("_least"), F.lit(True)).alias("kept"))


@free_names
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, rows: int = 2, collections: int = 12) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: that with the least id, then with the least hash of its text.

    Rows without words or id are in no group and stay.
    """
    found = grouped(docs, id_col, text_col, width, percent, rows, collections)
    chosen = found.filter("_group is not null").groupBy("_group").agg(F.min(F.struct("doc_id", "_k2")).alias("_one")).select("_one.*")
    keys = lambda rows: rows.select(F.coalesce("doc_id", F.lit(-1)).alias("_k1"), "_k2").distinct()
    keyed = docs.select(*row_keys(id_col, text_col, docs), "*")
    named = keyed.filter(F.col(id_col).isNotNull()).join(keys(chosen).hint("merge"), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    alone = found.filter("_group is null and doc_id is not null")
    rest = keyed.filter(F.col(id_col).isNotNull()).join(keys(alone).hint("merge"), ["_k1", "_k2"], "left_semi")
    return named.unionByName(rest).unionByName(keyed.filter(F.col(id_col).isNull())).drop("_k1", "_k2")
