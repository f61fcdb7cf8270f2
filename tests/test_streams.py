"""Streams over replayed files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartolake.streaming import streams


def replay(spark, frame, path):
    frame.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(frame.schema).parquet(str(path))


def drain(stream, tmp_path, mode="append"):
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp_path}/out/*")


def test_settle(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", t0 + dt.timedelta(seconds=s)) for s in (0, 60, 100, 1000, 90000)]
    out = drain(streams.settle(replay(spark, spark.createDataFrame(rows, "repo_id string, ts timestamp"), tmp_path / "in")), tmp_path)
    assert sorted(r.changes for r in out.collect()) == [1, 3]  # the last burst has not been quiet yet


def test_dedupe_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("w", f"f{i % 3}", t0) for i in range(10)], "workspace_id string, fingerprint string, created_at timestamp")
    out = drain(streams.stream_dedupe_questions(replay(spark, df, tmp_path / "in")), tmp_path)
    assert {r.fingerprint for r in out.collect()} == {"f0", "f1", "f2"} and out.count() == 3


@pytest.fixture
def rocksdb(spark):
    held = {k: spark.conf.get(k, None) for k in streams.ROCKSDB}
    for k, v in streams.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def polls(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(r, s, None if at is None else t0 + dt.timedelta(seconds=at)) for r, s, at in rows], "repo_id string, head_sha string, ts timestamp")


def test_heads(spark, tmp_path, rocksdb):
    """Late, repeated and null polls ask for nothing; a restart from the checkpoint keeps every head."""
    seen = lambda n: sorted((r.repo_id, r.action, r.from_sha or "", r.to_sha) for r in spark.read.schema(streams.HEADS).parquet(f"{tmp_path}/out/{n}").collect())
    path = tmp_path / "in"
    polls(spark, [("r", "a", 0), ("r", "A", 1), ("r", "b", 2), ("q", "x", 9), ("q", None, 10), ("q", "y", None)]).coalesce(1).write.parquet(str(path))
    stream = lambda: streams.track_heads(spark.readStream.schema(polls(spark, []).schema).parquet(str(path)))
    drain(stream(), tmp_path)
    assert seen(0) == [("q", "initial", "", "x"), ("r", "diff", "A", "b"), ("r", "initial", "", "a")]
    polls(spark, [("r", "old", 1), ("r", "B", 3), ("r", "c", 4), ("r", "c", 4), ("q", "x", 9), ("new", "n", 0)]).coalesce(1).write.mode("append").parquet(str(path))
    drain(stream(), tmp_path)
    assert seen(1) == [("new", "initial", "", "n"), ("r", "diff", "B", "c")]


def test_changes_are_routed(spark, tmp_path):
    df = spark.createDataFrame([("r", "a", "removed", ""), ("r", "b", "added", "")], "repo_id string, filename string, status string, previous_filename string")
    w = streams.stream_file_changes(replay(spark, df, tmp_path / "in"), str(tmp_path / "routed"), str(tmp_path / "cp2"))
    w.trigger(availableNow=True).start().awaitTermination()
    assert {(r.action, r.path) for r in spark.read.parquet(str(tmp_path / "routed")).collect()} == {("prune", "a"), ("extract", "b")}


def test_daily_spend_columns(spark, tmp_path):
    df = spark.createDataFrame([("w", 1.5, True, dt.datetime(2024, 1, 1))], "workspace_id string, cost_usd double, cache_hit boolean, created_at timestamp").withColumn("cost_usd", F.col("cost_usd").cast("decimal(12,6)"))
    out = drain(streams.stream_daily_spend(replay(spark, df, tmp_path / "in")), tmp_path, "update").collect()
    assert [(str(r.cost_usd), r.calls, r.cached, r.day) for r in out] == [("1.500000", 1, 1, "2024-01-01")]
