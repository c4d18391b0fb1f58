"""Roll-ups that keep state of their own between the batches of a stream: running means, and repeats with a side output.

State lies in RocksDB beside the checkpoint, so that a query which is started again goes on where it was; it is bounded: means are one
row a key, which a time-to-live may end, and ids are kept for as long as a repeat may come.  No row is dropped: what comes
later than that is told apart and written beside the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that ids are dealt to.
BUCKETS = 64


def with_rocksdb(spark: SparkSession) -> None:
    """Queries that are started from now on keep state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class RunningMean(StatefulProcessor):
    """Number and sum of a key's values so far."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "n long, total double", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for part in rows:
            values = part["value"].dropna()
            n, total = n + len(values), total + float(values.sum())
        self.state.update((n, total))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [total / n if n else None]})


def running_means(events: DataFrame, key: str, value: str, ttl_ms: int | None = None) -> DataFrame:
    """(key, n, mean) of a stream: for each key of a batch its number and mean of values up to then; nulls don't count.

    With `ttl_ms`, a key that has had no row for so long starts anew.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return rows.groupBy("key").transformWithStateInPandas(RunningMean(ttl_ms), "key string, n long, mean double", "update", mode)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last mean of each key among the rows that `to_updates` has written: counts only grow."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("key").agg(F.max_by("mean", "n").alias("mean"), F.max("n").alias("n")).select("key", "n", "mean")


def to_updates(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each batch's rows as a table of its own, which a batch that is run again replaces."""
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Repeats(StatefulProcessor):
    """The ids of a bucket with their times, as far back as a repeat may come."""

    def __init__(self, late_ms: int):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ms long")
        self.seen = handle.getMapState("seen", "id string", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self.newest.get()[0] if self.newest.exists() else None
        newest = before
        for part in rows:
            state = []
            for own, ms in zip(part["id"], part["ms"], strict=True):
                newest = ms if newest is None else max(newest, ms)
                if before is not None and ms < before - self.late_ms:
                    state.append("late")
                elif self.seen.containsKey((own,)):
                    state.append("repeat")
                else:
                    self.seen.updateValue((own,), (int(ms),))
                    state.append("first")
            yield pd.DataFrame({"state": state, "row": part["row"].tolist()})
        self.newest.update((int(newest),))
        for (own,), (ms,) in list(self.seen.iterator()):
            if ms < newest - self.late_ms:
                self.seen.removeKey((own,))


def told_apart(events: DataFrame, key: str, time: str, late: str, buckets: int = BUCKETS) -> DataFrame:
    """(state, *columns): each row of a stream as `first` of its id, a `repeat`, or too `late` to tell, by the newest time that its group
    of ids had before the batch.  A null id is its row's own hash; a null time counts as the newest, so that the row is not late.
    """
    names = events.columns
    row = F.to_json(F.struct(*names), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    own = F.coalesce(F.col(key).cast("string"), F.xxhash64(*names).cast("string"))
    ms = F.coalesce(F.unix_millis(F.col(time).cast("timestamp")), F.unix_millis(F.current_timestamp()))
    rows = events.select(F.pmod(F.xxhash64(own), F.lit(buckets)).alias("bucket"), own.alias("id"), ms.alias("ms"), row.alias("row"))
    late_ms = int(pd.Timedelta(late).total_seconds() * 1000)
    out = rows.groupBy("bucket").transformWithStateInPandas(Repeats(late_ms), "state string, row string", "append", "None")
    back = F.from_json("row", events.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return out.select("state", back.alias("row")).select("state", "row.*")


def to_two_tables(apart: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """`told_apart` rows as two tables, `first` and the side output `late`, and repeats as a count in the third: what came in is their sum."""

    def write(df: DataFrame, n: int) -> None:
        for state in ("first", "late"):
            df.where(F.col("state") == state).drop("state").write.mode("overwrite").parquet(f"{folder}/{state}/batch={n}")
        df.groupBy("state").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/counts/batch={n}")

    return apart.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
