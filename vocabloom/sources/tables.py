"""Tables in the folder that a cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master gets a temporary one (tests); others get an error."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (given or _temporary()).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: its plan is then a scan, and lost executors don't matter.

    Subjects and places of statements are nearly all different, so no dictionary of them is begun.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    plain = {f"parquet.enable.dictionary#{n}": "false" for n in ("s", "seq") if n in df.columns}
    df.write.options(**plain).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
