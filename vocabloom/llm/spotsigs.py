"""SpotSigs document fingerprints, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import row_keys, written

#: Common words of English, French, German and Spanish that start a chain.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which who will with you "
    "au aux avec ce ces dans des du elle en est et il je la le les mais ne ou par pas pour qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einen einer er es für ich im ist mit nicht sich sie sind und von war wie wir zu zum zur "
    "al con de del el ella esta este ha las lo los más no nos para pero por que si sin sobre su sus te y ya"
).split()


#: Bytes of a signature.
_BYTES = 5


def _signed(df: DataFrame, text_col: str, name: str, chain: int, anchors: list[str], few: int = 5) -> DataFrame:
    """Add the sorted distinct signatures of a text column, as 40-bit numbers, in the array column `name`."""
    words, content, places = f"{name}_words", f"{name}_content", f"{name}_places"
    anchored = sorted(set(anchors))
    df = df.withColumn(words, F.array_remove(F.split(F.lower(text_col), "[^\\p{L}\\p{N}]+"), ""))
    df = df.withColumn(content, F.filter(words, lambda w: ~w.isin(anchored))).withColumn(places, F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchored), i).otherwise(-1)), lambda i: i >= 0))
    spots = F.transform(places, lambda p, j: F.when(p - j + chain <= F.size(content), F.xxhash64(F.get(words, p), F.slice(content, p - j + 1, chain))))
    df = df.withColumn(places, F.array_compact(spots))
    single = F.transform(F.when(F.size(content) > 0, F.col(content)).otherwise(F.col(words)), lambda w: F.xxhash64(w))
    rest = F.when(F.size(words) > 0, F.concat(places, single)).when(F.length(text_col) > 0, F.array(F.xxhash64(text_col))).otherwise(F.array().cast("array<long>"))
    chosen = F.when(F.size(places) >= few, F.col(places)).otherwise(rest)
    return df.withColumn(name, F.array_sort(F.array_distinct(F.transform(chosen, lambda x: x.bitwiseAND(F.lit((1 << 8 * _BYTES) - 1)))))).drop(words, content, places)


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "signatures", chain: int = 2, anchors: list[str] = ANCHORS) -> DataFrame:
    """`docs` with an array column of the SpotSigs signatures of whole texts (null counts as empty).

    A signature is an anchor and the `chain` content words that follow it, where content words are those that are no
    anchors. A text with fewer than five chains is signed by its content words too (by its words, if it has no content
    words), one without words by itself, and an empty one has no signature. A column of the same name is replaced.
    """
    plain = docs.drop(name).withColumn("_signed", F.coalesce(F.col(text_col), F.lit("")))
    return _signed(plain, "_signed", name, chain, anchors).drop("_signed")


def length_class(length: Column, threshold: float) -> Column:
    """The partition of sets of this length: sets of likeness `threshold` or more are in the same or in adjoining ones."""
    return F.floor(F.log(F.greatest(length, F.lit(1))) / F.lit(-1.0) / F.log(F.lit(threshold))).cast("int")


def jaccard(a: str, b: str, threshold: float = 0.0) -> Column:
    """Likeness of two sets; 1 for two empty ones, and 0 where the lengths alone rule the threshold out."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(most == 0, 1.0).when((least == 0) | (least < most * threshold - 1e-9), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def packed(signatures: str) -> Column:
    """Signatures as bytes, five each: what is written or shuffled is then a third smaller than an array of longs."""
    return F.unhex(F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x), 2 * _BYTES, "0")), ""))


def unpacked(name: str) -> Column:
    """The array of signatures that `packed` made bytes of."""
    places = F.sequence(F.lit(0), (F.octet_length(name) / _BYTES).cast("int") - 1)
    each = F.transform(places, lambda i: F.conv(F.hex(F.substring(F.col(name), i * _BYTES + 1, F.lit(_BYTES))), 16, 10).cast("long"))
    return F.when(F.octet_length(name) > 0, each).otherwise(F.array().cast("array<long>"))


def text_of(signatures: str) -> Column:
    """A fingerprint as a string: its signatures in lower-case hexadecimal, comma-joined."""
    return F.lower(F.array_join(F.transform(signatures, lambda x: F.hex(x)), ","))


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = 2, anchors: list[str] = ANCHORS) -> DataFrame:
    """Fingerprint each document, its edited text and the next document, and compare.

    Returns doc_id, n_chars, edited_text, signatures, edited_signatures (arrays), near_edited and near_next.

    - The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document by
      ascending id (of the first one after the last). Null ids come first; rows of one id follow a hash of their texts.
    - Texts are found by the pair of id and hash, so only narrow rows are sorted: they are range-partitioned, and each
      partition's last row gets the first row of the next partition, from a table of one row a partition.
    - Null texts count as empty; repeated rows are each returned; a lone document is its own next. An empty table gives
      no rows. Other columns are not used.
    """
    spark = docs.sparkSession
    texts = docs.select(*row_keys(id_col, text_col, docs), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ids = written(docs.select(*row_keys(id_col, text_col, docs), F.col(id_col).alias("doc_id"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars")), "ids")
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ids.count() // 1_000_000)
    ranged = written(ids.repartitionByRange(n_parts, "doc_id", "_k2").withColumn("_part", F.spark_partition_id()), "ranged")
    one = F.struct(F.col("_k1"), F.col("_k2"))
    firsts = ranged.groupBy("_part").agg(F.min_by(one, F.struct("doc_id", "_k2")).alias("_first"))
    order = Window.orderBy("_part")
    nexts = firsts.select("_part", F.coalesce(F.lead("_first").over(order), F.first("_first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_first"))
    follows = ranged.withColumn("_then", F.lead(one).over(Window.partitionBy("_part").orderBy("doc_id", "_k2"))).join(F.broadcast(nexts), "_part")
    then = F.coalesce("_then", "_first")
    pairs = written(follows.select("_k1", "_k2", "doc_id", "n_chars", then["_k1"].alias("_n1"), then["_k2"].alias("_n2")), "pairs")
    if pairs.groupBy("_k1", "_k2").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["_k1", "_k2"])
    texts = texts.repartition("_k1", "_k2")

    heads = texts.join(pairs.select(F.col("_k1").alias("_p1"), F.col("_k2").alias("_p2"), "doc_id", "n_chars", F.col("_n1").alias("_k1"), F.col("_n2").alias("_k2")), ["_k1", "_k2"])
    heads = _signed(heads, "_text", "_next", chain, anchors)
    heads = heads.select(F.col("_p1").alias("_k1"), F.col("_p2").alias("_k2"), "doc_id", "n_chars", F.expr("substring(_text, 1, CAST(n_chars DIV 2 AS INT))").alias("_head"), "_next")
    both = texts.join(heads, ["_k1", "_k2"]).drop("_k1", "_k2")
    both = both.withColumn("edited_text", F.expr("concat(substring(_text, 1, CAST(n_chars - n_chars DIV 2 AS INT)), _head)"))
    both = _signed(_signed(both, "_text", "signatures", chain, anchors).drop("_text", "_head"), "edited_text", "edited_signatures", chain, anchors)
    return both.select("doc_id", "n_chars", "edited_text", "signatures", "edited_signatures", jaccard("signatures", "edited_signatures").alias("near_edited"), jaccard("signatures", "_next").alias("near_next"))


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, chain: int = 2, anchors: list[str] = ANCHORS) -> DataFrame:
    """All pairs of fingerprints of likeness `threshold` (between 0 and 1) or more: first_id, second_id and likeness.

    Texts of equal signatures are one set, named by the least id among them: each other id of the set is a pair with that
    name, of likeness 1, and sets are paired by their names (an id with several texts can be paired with itself). Rows of one id and one set count once, null ids are left
    out, null texts count as empty, and empty sets are alike. An empty table gives no rows.

    - Of two sets of that likeness, the longer is in a length class between those of the shorter's length and of this
      length divided by `threshold`, and they share at least 2 * threshold / (1 + threshold) times the length of the shorter and threshold
      times that of the longer. So one is common among the first signatures of each, which are n less that share (rounded
      up) and one more, whatever the order of signatures. They are joined by class and signature, and then compared on
      whole sets.
      Two sets can't share more than their common first signatures and what follows the last of these in either, so
      pairs for which that is too little are not compared.
    - Signatures are in the order of their values, which are hashes, but the 10,000 most frequent ones of a sample of the
      sets come last, the most frequent one at the end. That bears on the number of candidates only.
    """
    signed = fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null"), "_text", "_sigs", chain, anchors)
    keyed = written(signed.select("_id", F.xxhash64("_sigs").alias("_k1"), F.xxhash64(F.lit(1), "_sigs").alias("_k2"), packed("_sigs").alias("_sigs")), "signed")
    sets = keyed.groupBy("_k1", "_k2").agg(F.min("_id").alias("_name"), F.count("*").alias("_rows"), F.first("_sigs").alias("_sigs"))
    sets = written(sets.select("*", (F.octet_length("_sigs") / _BYTES).cast("int").alias("_n"), F.monotonically_increasing_id().alias("_set")), "sets")

    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("_salt")
    shared = sets.filter("_rows > 1").select("_k1", "_k2", "_name", salts)
    same = keyed.select("_id", "_k1", "_k2", F.pmod(F.xxhash64("_id"), F.lit(64)).alias("_salt")).join(shared, ["_k1", "_k2", "_salt"]).filter("_id <> _name")
    same = same.select(F.col("_name").alias("first_id"), F.col("_id").alias("second_id"), F.lit(1.0).alias("likeness")).distinct()

    sample = sets.filter(F.pmod("_k1", F.lit(8)) == 0).select(F.explode(unpacked("_sigs")).alias("_sig")).groupBy("_sig").count()
    often = sample.filter("count > 1").orderBy(F.desc("count"), "_sig").limit(10_000)
    common = often.agg(F.array_sort(F.collect_list(F.struct("count", "_sig")))["_sig"].alias("_common"))
    least = F.greatest(F.ceil(F.col("_n") * threshold - 1e-9), F.lit(1)).cast("int")
    shared_least = F.ceil(F.col("_n") * (2 * threshold / (1 + threshold)) - 1e-9).cast("int")
    ordered = sets.filter("_n > 0").withColumn("_sigs", unpacked("_sigs")).crossJoin(F.broadcast(common)).withColumn("_ordered", F.concat(F.array_except("_sigs", "_common"), F.array_intersect("_common", "_sigs")))
    first = ordered.select("_set", "_n", F.posexplode(F.slice("_ordered", F.lit(1), F.col("_n") - least + 1)).alias("_at", "_sig"))
    classes = F.sequence(length_class(F.col("_n"), threshold), length_class(F.floor(F.col("_n") / threshold + 1e-9), threshold))
    short = first.filter(F.col("_at") <= F.col("_n") - shared_least).select(F.col("_set").alias("_a"), F.col("_n").alias("_na"), F.col("_at").alias("_ia"), "_sig", F.explode(classes).alias("_class"))
    long = first.select(F.col("_set").alias("_b"), F.col("_n").alias("_nb"), F.col("_at").alias("_ib"), "_sig", length_class(F.col("_n"), threshold).alias("_class"))
    ahead = (F.col("_na") < F.col("_nb")) | ((F.col("_na") == F.col("_nb")) & (F.col("_a") < F.col("_b")))
    found = short.join(long, ["_class", "_sig"]).filter(ahead & (F.col("_na") >= F.col("_nb") * threshold - 1e-9))
    found = found.groupBy("_a", "_b", "_na", "_nb").agg(F.count("*").alias("_c"), F.max("_ia").alias("_ia"), F.max("_ib").alias("_ib"))
    most = F.col("_c") + F.least(F.col("_na") - F.col("_ia"), F.col("_nb") - F.col("_ib")) - 1
    found = found.filter(most * (1 + threshold) >= (F.col("_na") + F.col("_nb")) * threshold - 1e-9).select("_a", "_b")
    of = {x: sets.select(F.col("_set").alias(f"_{x}"), F.col("_name").alias(f"_{x}_name"), F.col("_sigs").alias(f"_{x}_sigs")) for x in "ab"}
    both = found.join(of["a"], "_a").join(of["b"], "_b").withColumns({f"_{x}_sigs": unpacked(f"_{x}_sigs") for x in "ab"}).withColumn("likeness", jaccard("_a_sigs", "_b_sigs", threshold)).filter(F.col("likeness") >= threshold)
    return same.unionByName(both.select(F.least("_a_name", "_b_name").alias("first_id"), F.greatest("_a_name", "_b_name").alias("second_id"), "likeness"))
