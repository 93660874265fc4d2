"""Streams of requests and findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import probe
from ..operators.layout import Layout
from ..operators.model import large
from ..operators.negotiate import outcomes, select_representation
from ..sources.tables import shared_path

c = F.col


def chosen_types(requests: DataFrame) -> DataFrame:
    """A stream or table of requests with the media type that each gets; stateless."""
    return requests.withColumn("media_type", select_representation(c("accept"), c("query")))


def counts_by_window(requests: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests by media type in tumbling windows of ts; on a stream, rows later than `late` are dropped. A ts without time zone is in the session's."""
    timed = chosen_types(requests).withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "media_type").agg(F.count("*").alias("n")).select(c("w.start").alias("start"), "media_type", "n")


def first_findings(findings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One finding for each url and rule within the watermark of a stream (url, rule, ts)."""
    return findings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url", "rule"])


def resolved(requests: DataFrame, layout: Layout) -> DataFrame:
    """Outcomes of a stream of requests (request_id, release, path, accept, query): joined to the table of terms by path, without state."""
    terms = layout.terms.select("release", "ns", "local", "style").join(layout.entries.select("release", "ns", "mount"), ["release", "ns"])
    static = terms.select("release", F.concat("mount", "local").alias("at"), "mount", "local", "style")
    rows = requests.withColumn("at", F.regexp_replace("path", "/+$", "")).join(large(static), ["release", "at"], "left")
    return outcomes(rows, "request_id")


def findings_by_window(answers: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(release, start, rule, level, n, example): findings on answered asks in tumbling windows of their ts; the example is the least context.

    answers: answered asks with ts. On a stream, in append mode: a window comes out once the watermark has passed its end. An
    answer that is delivered again, all columns alike, counts once while the watermark hasn't passed its ts, and one that comes
    after that is dropped. Both happen before the findings are counted, so `arrivals` can tell how many answers were late.
    An answer without ts is in no window. A stream's watermark starts at the epoch, so what is not after it is late to a stream.
    """
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    whole = F.sha2(F.to_json(F.struct(*(n for n in answers.columns if n != "ts")), exact), 256)  # the state has this, not the columns
    once = answers.filter(c("ts").isNotNull()).withWatermark("ts", late).withColumn("_whole", whole).dropDuplicates(["ts", "_whole"]).drop("_whole")
    found = probe.judge(once, "ts")
    counts = found.groupBy("release", F.window("ts", window).alias("w"), "rule", "level").agg(F.count("*").alias("n"), F.min("context").alias("example"))
    return counts.select("release", c("w.start").alias("start"), "rule", "level", "n", "example")


def with_answers(asks: DataFrame, responses: DataFrame, horizon: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Asks (release, url, accept, ts, ...) with the status of what they got until the horizon, and measured, whether there was an answer.

    responses: (release, url, accept, answered_at, status). On streams, an ask without an answer comes out, with measured false
    and a null status, once the watermark has passed its horizon; only asks that can still be answered are kept as state. An ask
    with several answers in time has a row for each; an answer before its ask or after the horizon is no answer to it.
    As a stream's watermark starts at the epoch, an ask that is not after it is late to a stream and doesn't come out.
    """
    a = asks.withWatermark("ts", late).alias("a")
    r = responses.withWatermark("answered_at", late).alias("r")
    same = (c("a.release") == c("r.release")) & (c("a.url") == c("r.url")) & (c("a.accept") == c("r.accept"))
    in_time = (c("r.answered_at") >= c("a.ts")) & (c("r.answered_at") <= c("a.ts") + F.expr(f"INTERVAL {horizon}"))
    return a.join(r, same & in_time, "left").select("a.*", "r.answered_at", "r.status", c("r.answered_at").isNotNull().alias("measured"))


def _run(made: DataFrame, sink: str, marks: str) -> int:
    """Run a stream over all that is there now; how many rows came after the watermark."""
    run = made.writeStream.format("parquet").option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start(sink)
    run.awaitTermination()
    return sum(o.numRowsDroppedByWatermark for p in run.recentProgress for o in p.stateOperators)


def through(table: DataFrame, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run a table through a stream: write it as files, read those as a stream until no more are there, and read what was written."""
    return arrivals([table], make, name)[0]


def arrivals(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, int]:
    """Run tables through one stream in the order of their arrival: what was written, and how many rows were late.

    Each part is what has come since the stream ran last: it is written as files, and the stream goes on from its checkpoint.
    """
    spark = parts[0].sparkSession
    source, sink, marks = (shared_path(spark, f"{name}-{x}") for x in ("in", "out", "marks"))
    dropped = 0
    for part in parts:
        part.write.mode("append").parquet(source)
        made = make(spark.readStream.schema(part.schema).parquet(source))
        dropped += _run(made, sink, marks)
    return spark.read.schema(made.schema).parquet(sink), dropped
