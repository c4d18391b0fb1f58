"""Telemetry of searches: roll-ups of trace rows, in batch and as streams over the same functions.

Rows are (event_id, ts, user_id, event_type, value); an event's type is the module, a positive value is a success, and the
value is its time in milliseconds.

Windows of a stream take a lateness: in complete mode no row is lost; in the other modes a window that the watermark has
passed is closed, rows for it are dropped, and `late_rows` counts them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import versions


def measures() -> list[Column]:
    ok = F.col("value") > 50
    return [F.count("*").alias("n"), F.count_if(ok).alias("successes"), (F.count_if(ok) / F.count("*")).alias("success_rate"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value")]


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """Trace files of a folder as a stream."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def by_module(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(*measures())


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Measures per module and window; a stream closes a window once its watermark passes."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", size), "event_type").agg(*measures()).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "successes", "success_rate", "avg_value", "max_value")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("avg_value")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "avg_value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events less than a gap apart."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", "total")


def without_repeats(events: DataFrame, late: str | None = None) -> DataFrame:
    """Each event once, by event_id.

    A stream without `late` remembers all ids, which nothing bounds: no row is lost in whatever order files come.  With it, ids are
    remembered until the watermark passes; rows that come later than that are dropped, and `late_rows` counts them.
    `state.told_apart` bounds its ids and drops nothing.
    """
    if events.isStreaming and late is not None:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's watermark has dropped, over the progress reports that the session still keeps (the last hundred, unless
    `spark.sql.streaming.numRecentProgressUpdates` says otherwise); of windows, rows after partial sums.
    """
    return sum(op["numRowsDroppedByWatermark"] for report in query.recentProgress for op in report["stateOperators"])


def search_stats(events: DataFrame, *group: str) -> DataFrame:
    """Total, successes, failures, success rate, and sum and mean of times."""
    ok = F.col("value") > 50
    return events.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), (F.count_if(ok) / F.count("*")).alias("rate"), F.sum("value").alias("time_total"), F.avg("value").alias("time_mean"))


def weight_bands(rows: DataFrame, weight: str, *group: str) -> DataFrame:
    """Numbers of strong (0.8 and more) and middle (0.6 to 0.8) weights, and their mean."""
    w = F.col(weight)
    return rows.groupBy(*group).agg(F.count_if(w >= 0.8).alias("strong"), F.count_if((w >= 0.6) & (w < 0.8)).alias("middle"), F.avg(w).alias("mean_weight"))


def to_table(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The whole result of a roll-up as a table that each batch publishes anew; `read_table` sees one batch's or the one's before."""

    def write(df: DataFrame, batch: int) -> None:
        with versions.draft(df.sparkSession, folder) as new:
            new.write("rows", df)
            new.details["batch"] = batch

    return stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    return versions.current(spark, folder).table("rows")


def to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch to a function, exactly once per batch number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expansion_stats(searches: DataFrame, expanded: Column, duration: Column, *group: str) -> DataFrame:
    """Searches, expanded ones, their share to three places and the mean duration in ms to two."""
    n, e = F.count("*"), F.count_if(expanded)
    return searches.groupBy(*group).agg(n.alias("searches"), e.alias("expanded"), F.round(e / n, 3).alias("expansion_rate"), F.round(F.avg(duration) * 1000, 2).alias("avg_ms"))
