"""Sharding by proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import HEAVY_SHARE, counted, looked_up, written


def _unit(text: Column) -> Column:
    """A number from 0 to 1 that follows from a text: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def before(rows: DataFrame, keys: Sequence[str], unit: Column, order: Sequence[str], n: int, per_bucket: int, weight: Column | None = None, name: str = "_before") -> DataFrame:
    """`rows` and, as `name`, the sum of the weights (1 each) of the rows of the same keys that come before, in the order of `unit` (from 0 to 1) and then `order`.

    Nothing is sorted as a whole: rows fall into buckets of about `per_bucket` of all `n` by their unit and are numbered
    within their key and bucket. Sums of buckets and of runs of buckets, in two levels, give what lies before each.
    """
    weight = F.lit(1) if weight is None else weight
    buckets = max(1, n // per_bucket)
    run = max(1, int(buckets**0.5))
    keys = list(keys)
    placed = rows.withColumns({"_w": weight, "_bucket": F.least(F.floor(unit * buckets), F.lit(buckets - 1)).cast("long")})
    sums = placed.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_sum")).withColumn("_run", F.expr(f"_bucket div {run}"))
    past = lambda *by: Window.partitionBy(*keys, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.groupBy(*keys, "_run").agg(F.sum("_sum").alias("_run_sum")).withColumn("_before_run", F.coalesce(F.sum("_run_sum").over(past("_run")), F.lit(0)))
    within = sums.withColumn("_in_run", F.coalesce(F.sum("_sum").over(past("_run", "_bucket")), F.lit(0)))
    bases = within.join(runs.drop("_run_sum"), [*keys, "_run"]).select(*keys, "_bucket", (F.col("_in_run") + F.col("_before_run")).alias("_base"))
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(bases, [*keys, "_bucket"]).withColumn(name, F.col("_base") + F.coalesce(F.sum("_w").over(own), F.lit(0))).drop("_w", "_bucket", "_base")


def interleaved(rows: DataFrame, n: int, seed: int, per_bucket: int, weight: Column | None = None) -> DataFrame:
    """Rows (_source, _unit, _order, …) and _place: their number, or the weight before them, in the order of their fractional rank in their source."""
    order = ["_unit", "_order", "_text", "size"]
    totals = rows.groupBy("_source").agg(F.count("*").alias("_total"))
    ranked = before(rows, ["_source"], F.col("_unit"), order, n, per_bucket, name="_rank").join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "_source")
    fraction = (F.col("_rank") + _unit(F.concat(F.lit(f"{seed}:"), F.col("_source")))) / F.col("_total")
    ranked = written(ranked.withColumn("_fraction", fraction).drop("_total"), "ranked")
    return before(ranked, [], F.col("_fraction"), ["_fraction", "_source", "_rank"], n, per_bucket, weight, "_place")


def shard(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    per_bucket: int = 250,
) -> DataFrame:
    """Deal rows to shards so that each has the mixture of sources of the whole and all counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text and 16), text_crc32, law ('rows'), shard (int), slot (long), grown_shard
    (null) and whole (whether all rows of the same text are in that shard).

    - Within a source the items are ranked in a seeded order of their ids. An item's fractional rank is its rank, moved by
      a seeded part of one that belongs to its source, over the items of its source. Items are sorted by it and cut.
    - Equal texts are one item, of the source of their first row, and stay in one shard. Rows of their own fill the shards
      up to the same count, so groups are split only if they are larger than a shard's share of such rows: the largest
      size that groups may have is the greatest for which all rows outside of smaller groups suffice. Rows of larger
      groups are dealt one by one.
    - Nothing is sorted as a whole and no source or group is one task: see `before`.
    - Null texts have no bytes; null sources are a source of their own; null ids are dealt as an id of their own; repeated
      rows are dealt each. An empty table gives no rows. Other columns are not used.
    """
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    order = F.md5(F.concat(F.lit(f"{seed}:"), id_text))
    rows, n = counted(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(raw) + 16).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.md5(raw).alias("_text"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("_source"),
            order.alias("_order"),
            (F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)).alias("_unit"),
        ),
        "rows",
    )
    lead = F.min(F.struct("_order", "_source", "_unit"))
    groups = written(rows.groupBy("_text", "size").agg(F.count("*").alias("count"), lead.alias("_lead")), "groups")
    sizes = groups.groupBy("count").agg(F.sum("count").alias("_rows"))  # a row for each size of groups: at most the root of twice the rows
    larger = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    loose = F.coalesce(F.sum("_rows").over(larger), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("count") == 1, F.col("_rows"))).over(Window.partitionBy()), F.lit(0))
    most = sizes.withColumn("_loose", loose).filter(F.col("count") > 1).filter(F.col("_loose") >= F.col("count") * n_shards).agg(F.max("count")).first()[0] or 1

    whole, n_groups = counted(groups.filter((F.col("count") > 1) & (F.col("count") <= most)).select("_text", "size", "count", "_lead.*"), "whole")
    heavy = whole.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    dealt = interleaved(whole, n_groups, seed, per_bucket, F.col("count"))
    in_shard = F.expr(f"CAST(_place * {n_shards}L DIV {max(heavy, 1)}L AS INT)")
    dealt = written(dealt.select("_text", "size", "count", "_place", in_shard.alias("shard")), "dealt")
    shards = {r.shard: (r.n, r.first) for r in dealt.groupBy("shard").agg(F.sum("count").alias("n"), F.min("_place").alias("first")).collect()}  # n_shards rows
    firsts = F.array(*(F.lit(shards.get(i, (0, 0))[1]).cast("long") for i in range(n_shards)))
    homes = dealt.select("_text", "size", "count", "shard", (F.col("_place") - F.get(firsts, F.col("shard"))).alias("_offset"))

    kept = looked_up(rows, homes, ["_text", "size"], ["shard", "_offset"], n / HEAVY_SHARE)
    numbered = before(kept, ["_text", "size"], F.col("_unit"), ["_unit", "_order", "_source", "doc_id"], most, per_bucket, name="_nth")
    one = numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_nth")).alias("slot"), F.lit(True).alias("whole"))

    alone = groups.filter((F.col("count") == 1) | (F.col("count") > most)).select("_text", "size", "count", (F.col("count") == 1).alias("_single"))
    rest, m = counted(looked_up(rows, alone, ["_text", "size"], ["_single"], n / HEAVY_SHARE), "rest")
    placed = interleaved(rest, m, seed, per_bucket)
    ends, total = [], 0
    for i in range(n_shards):
        target = -(-(i + 1) * n // n_shards) - -(-i * n // n_shards)
        total += target - shards.get(i, (0, 0))[0]
        ends.append(total)
    last = F.array(*(F.lit(x).cast("long") for x in ends))
    shard_of = F.size(F.filter(last, lambda x: x <= F.col("_place")))
    start = F.when(F.col("shard") == 0, 0).otherwise(F.get(last, F.col("shard") - 1))
    sizes_of = F.array(*(F.lit(shards.get(i, (0, 0))[0]).cast("long") for i in range(n_shards)))
    two = placed.withColumn("shard", shard_of).select("doc_id", "size", "text_crc32", "shard", (F.get(sizes_of, F.col("shard")) + F.col("_place") - start).alias("slot"), F.col("_single").alias("whole"))
    out = one.unionByName(two)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "whole")
