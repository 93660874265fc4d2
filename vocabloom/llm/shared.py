"""What several corpus operators need: shared intermediate tables, row keys, batches and skew-safe lookups."""

from __future__ import annotations

import functools
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys found in at least 1/HEAVY_SHARE of all rows are looked up through a broadcast; there can be at most HEAVY_SHARE such keys.
HEAVY_SHARE = 10_000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder (tests); others get an error."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`written`, and the number of rows, which is counted while they are written."""
    seen = Observation()
    made = written(df.observe(seen, F.count("*").alias("n")), name)
    return made, seen.get["n"]


def row_keys(id_col: str, text_col: str, docs: DataFrame) -> list[Column]:
    """Two longs that tell rows of different id or text apart; equal rows share them. Never null.

    A null id has the first key of id -1, and another second key than any row with an id.
    """
    whole = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    first = F.coalesce(F.col(id_col).cast("long"), F.lit(-1)) if whole else F.xxhash64(id_col)
    second = F.when(F.col(id_col).isNull(), F.xxhash64(text_col, F.lit(1))).otherwise(F.xxhash64(text_col))
    return [first.alias("_k1"), second.alias("_k2")]


def free_names(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Make an operator on `docs` leave columns alone whose names begin with _, as those that it adds on the way do.

    They have other names meanwhile, also where id_col or text_col is one of them.
    """
    shape = inspect.signature(work)

    @functools.wraps(work)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        given = shape.bind(docs, *args, **kwargs)
        given.apply_defaults()
        taken, renamed = {n.lower() for n in docs.columns}, {}
        for name in (n for n in docs.columns if n.startswith("_")):
            new = f"own{name}"
            while new.lower() in taken:
                new = f"x{new}"
            taken.add(new.lower())
            renamed[name] = new
        given.arguments["docs"] = docs.withColumnsRenamed(renamed)
        for n in {"id_col", "text_col"} & given.arguments.keys():
            given.arguments[n] = renamed.get(given.arguments[n], given.arguments[n])
        return work(*given.args, **given.kwargs).withColumnsRenamed({new: name for name, new in renamed.items()})

    return run


def flagged(left: DataFrame, keys: DataFrame, on: Sequence[str], n_left: int, flag: str = "_hit") -> DataFrame:
    """`left` with a boolean column: whether the row's key is in `keys` (one row per key, with its number of rows in `left` as `count`).

    Keys with at least n_left / HEAVY_SHARE rows (so at most HEAVY_SHARE of them) are broadcast; the others, of which
    none has many rows, are joined by shuffle.
    """
    bar = n_left / HEAVY_SHARE
    heavy = F.broadcast(keys.filter(F.col("count") >= bar).select(*on, F.lit(True).alias("_heavy")))
    light = keys.filter(F.col("count") < bar).select(*on, F.lit(True).alias("_light"))
    tagged = left.join(heavy, list(on), "left")
    columns = [F.col(c) for c in left.columns]
    hot = tagged.filter("_heavy").select(*columns, F.lit(True).alias(flag))
    cold = tagged.filter("_heavy is null").drop("_heavy").join(light, list(on), "left").select(*columns, F.col("_light").isNotNull().alias(flag))
    return hot.unionByName(cold)


def looked_up(left: DataFrame, keys: DataFrame, on: Sequence[str], values: Sequence[str], bar: float | None = None) -> DataFrame:
    """Inner join of `left` with the `values` of `keys` (a stored table, one row per key, with its number of rows in `left` as `count`).

    Keys with more than `bar` rows, 1 / HEAVY_SHARE of all unless it is given, so at most HEAVY_SHARE of them, are
    broadcast; the others, of which none has many rows, are joined by shuffle.
    """
    bar = keys.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] / HEAVY_SHARE if bar is None else bar
    heavy = F.broadcast(keys.filter(F.col("count") > bar).select(*on, *values, F.lit(True).alias("_heavy")))
    light = keys.filter(F.col("count") <= bar).select(*on, *values)
    marked = left.join(heavy, list(on), "left")
    cold = marked.filter("_heavy is null").drop("_heavy", *values).join(light.hint("merge"), list(on))
    return marked.filter("_heavy").drop("_heavy").unionByName(cold)


def bounded(features: DataFrame, most_bytes: int) -> DataFrame:
    """Rows of features (_row, and _unit from 0 to 1) with the least units, so many that they have about `most_bytes`.

    What a driver reads of a sample is bounded then, however many classes it has and however long its texts are.
    """
    total = features.agg(F.coalesce(F.sum(F.octet_length("_row")), F.lit(0))).first()[0]
    return features if total <= most_bytes else features.filter(F.col("_unit") < most_bytes / total)


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, list[bytes | None]]]:
    """Consecutive pieces of a text column as UTF-8, each of about `most_bytes` or of one text."""
    start, size, out = 0, 0, []
    for i, value in enumerate(texts.cast(pa.large_binary())):
        out.append(value.as_py())
        size += len(out[-1] or b"")
        if size >= most_bytes:
            yield start, out
            start, size, out = i + 1, 0, []
    if out:
        yield start, out


def with_columns(df: DataFrame, fields: Sequence[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], drop: Sequence[str] = ()) -> DataFrame:
    """`df` and new columns computed from its Arrow batches; new columns replace those of the same names.

    make: called once a task; returns a function from a batch to one array or list for each field.
    """
    new = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in new]
    names, types = [f.name for f in kept], [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(work(batch), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names=names + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(kept + list(fields)))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
