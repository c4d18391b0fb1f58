"""State between the batches of a stream: what a stream comes to is what a batch comes to, also after it is started again."""

import pytest
from pyspark.sql import functions as F

from quillmark.streaming import state, trace


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.with_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_running_means_go_on_after_a_restart(rocks, tmp_path):
    events = rocks.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    odd = rocks.createDataFrame([(None, 5.0), ("only null", None)], "event_type string, value double")
    parts = [*events.randomSplit([1.0, 1.0, 1.0], 3)]
    for n, part in enumerate(parts[:2]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = trace.read_stream(rocks, str(tmp_path / "in"), events)
        state.to_updates(state.running_means(stream, "event_type", "value"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    parts[2].unionByName(odd, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = trace.read_stream(rocks, str(tmp_path / "in"), events)
    state.to_updates(state.running_means(stream, "event_type", "value"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r.key: (r.n, None if r["mean"] is None else round(r["mean"], 6)) for r in state.latest(rocks, str(tmp_path / "out")).collect()}
    every = rocks.read.parquet(str(tmp_path / "in"))
    want = {r.event_type: (r.n, None if r["m"] is None else round(r["m"], 6)) for r in every.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m")).collect()}
    assert got == want and len(want) == 7


def test_every_row_is_first_repeat_or_late(rocks, tmp_path):
    """What comes in is what goes out and to the side, over restarts; ids are forgotten when no repeat can come any more."""
    hours = lambda *own: [(i, f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00", f"v{i}@{h}") for i, h in own]
    files = [hours(*((k, k) for k in range(20))), hours((3, 19), (19, 19), (40, 40)), [*hours((1, 1), (30, 2), (40, 40), (41, 39)), (None, "2024-01-02 16:00:00", "no id"), (None, None, "nothing")]]
    came = 0
    for part in files:
        rocks.createDataFrame(part, "event_id long, ts string, note string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        came += len(part)
        stream = trace.read_stream(rocks, str(tmp_path / "in"), rocks.read.parquet(str(tmp_path / "in")))
        state.to_two_tables(state.told_apart(stream, "event_id", "ts", "12 hours", buckets=1), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        counts = {r.state: r.n for r in rocks.read.parquet(str(tmp_path / "out/counts")).groupBy("state").agg(F.sum("n").alias("n")).collect()}
        assert sum(counts.values()) == came
    first = {r.note for r in rocks.read.parquet(str(tmp_path / "out/first")).collect()}
    late = {(r.event_id, str(r.ts), r.note) for r in rocks.read.parquet(str(tmp_path / "out/late")).collect()}
    # id 3 was forgotten twelve hours after its first time, and so is new at 19; id 19 and 40 are repeats
    assert first == {f"v{k}@{k}" for k in range(20)} | {"v40@40", "v41@39", "no id", "nothing"} | {"v3@19"}
    assert late == {(1, "2024-01-01 01:00:00", "v1@1"), (30, "2024-01-01 02:00:00", "v30@2")} and counts["repeat"] == 2
