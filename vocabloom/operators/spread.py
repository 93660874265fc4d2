"""Orders over whole tables without a task that holds them: ranks and running sums in two levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def before(rows: DataFrame, by: Sequence[str], order: Sequence[str], out: str, keep: Callable[[DataFrame, str], DataFrame], weight: Column | None = None) -> DataFrame:
    """`rows` with the sum of `weight` (1 each unless given) over the rows before each in its group, a long.

    Rows are range-partitioned by group and order, summed up by range, and numbered within ranges; ranges of a group, a
    row each, get their start from a window. A task has a range, not a group. `keep` must store its table, as sampled bounds
    of ranges may differ when they are computed again. Rows that are equal in `order` come in any order.
    """
    weight = F.lit(1) if weight is None else weight
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_weight", weight.cast("long")).repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id())
    ranged = keep(ranged, f"ranged_{out}")
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*by, "_range").agg(F.sum("_weight").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    placed = ranged.withColumn("_before", F.coalesce(F.sum("_weight").over(inside), F.lit(0))).join(starts, [*by, "_range"])
    return placed.withColumn(out, c("_start") + c("_before")).drop("_weight", "_range", "_start", "_before")
