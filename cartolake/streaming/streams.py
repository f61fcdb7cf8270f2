"""Structured-streaming forms of the reports, the change feed and the question intake."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from cartolake.operators import changelog
from cartolake.operators.changes import KEYS, log_changes, route_changes
from cartolake.operators.questions import sweep


def stream_daily_activity(telemetry: DataFrame, late: str = "1 day") -> DataFrame:
    """(workspace_id, day, calls, errors, p95): p95 is approximate, as exact percentiles need all rows."""
    rows = telemetry.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "workspace_id")
    out = rows.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.percentile_approx("latency_ms", 0.95, 10000).alias("p95"))
    return out.select("workspace_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "calls", "errors", "p95")


def stream_daily_spend(calls: DataFrame, late: str = "1 day") -> DataFrame:
    rows = calls.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "workspace_id")
    out = rows.agg(F.sum("cost_usd").cast("decimal(14,6)").alias("cost_usd"), F.count(F.lit(1)).alias("calls"), F.count_if("cache_hit").alias("cached"))
    return out.select("workspace_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "cost_usd", "calls", "cached")


def stream_rate_of_errors(telemetry: DataFrame, window: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    rows = telemetry.withWatermark("created_at", late).groupBy(F.window("created_at", window, slide).alias("w"), "workspace_id")
    out = rows.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status_code") >= 400).alias("errors"))
    return out.select("workspace_id", F.col("w.start").alias("window_start"), "calls", "errors")


def settle(changes: DataFrame, gap: str = "2 minutes", late: str = "1 minute") -> DataFrame:
    """(repo_id, started, ended, changes): one row per burst of changes, once it has been quiet for ``gap``."""
    rows = changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "repo_id")
    return rows.agg(F.count(F.lit(1)).alias("changes")).select("repo_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes")


def stream_dedupe_questions(questions: DataFrame, known: DataFrame | None = None, late: str = "1 day") -> DataFrame:
    """First question per tenant and fingerprint within the watermark, without those of the ``known`` table."""
    key = ["workspace_id", "fingerprint"]
    rows = questions.where("fingerprint is not null").withWatermark("created_at", late).dropDuplicatesWithinWatermark(key)
    return rows if known is None else rows.join(known.select(key), key, "left_anti")


def stream_file_changes(changes: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that routes each micro-batch of changes and writes it under its batch number, so that a batch that runs
    again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        route_changes(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_incremental_update(
    changes: DataFrame, files: DataFrame, extract: Callable[[DataFrame], DataFrame], start: dict[str, DataFrame], path: str, checkpoint: str, now: Column, most: int = 500, fold_every: int = 20
) -> DataStreamWriter:
    """A writer that applies each micro-batch of changes to the tables extractions, nodes and edges, kept below ``path`` as a base
    (at first ``start``) and a log of changed keys; ``read_incremental`` reads them.

    A micro-batch writes what it changed, not the tables; one that runs again gives the same tables.
    """
    schemas = {name: df.schema for name, df in start.items()}

    def write(batch: DataFrame, number: int) -> None:
        if not changelog.bases(batch.sparkSession, path):
            changelog.write_base(start, path, -1)
        log_changes(path, number, schemas, batch, files, extract, now, most, fold_every)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_incremental(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The tables that ``stream_incremental_update`` keeps."""
    return {name: changelog.read(spark, path, name, schema, KEYS[name]) for name, schema in schemas.items()}


def stream_sweep(ticks: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], path: str, checkpoint: str, every: str = "6 hours") -> DataStreamWriter:
    """A writer that sweeps the questions once per micro-batch of ``ticks`` (rows with ``ts``), which come ``every`` so often.

    ``load`` gives the current questions, nodes and edges. What each sweep returns is written below ``path`` under its batch
    number, at the time of its latest tick.
    """

    def write(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max("ts")).first()[0]
        if at is None:
            return
        for name, df in sweep(*load(), F.lit(at)).items():
            df.write.mode("overwrite").parquet(f"{path}/{number}/{name}")

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every)


HEADS = "repo_id string, action string, from_sha string, to_sha string"
#: Where the typed state of ``track_heads`` lives.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class HeadTracker(StatefulProcessor):
    """The last processed head of a repository and when it was seen, as typed value state without expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "sha string, at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        sha, at = self.head.get() if self.head.exists() else (None, None)
        before = sha, at
        # A micro-batch's polls of one repository, in order; ties by head, so that the result is the same every time.
        for ts, new in sorted((r["at"], r["head_sha"]) for r in rows if r["at"] is not None and r["head_sha"]):
            if at is not None and ts < at:
                continue  # older than what was processed
            if sha is None or sha.lower() != new.lower():
                yield Row(repo_id=key[0], action="initial" if sha is None else "diff", from_sha=sha, to_sha=new)
            sha, at = new, ts
        if (sha, at) != before:
            self.head.update((sha, at))

    def close(self) -> None:
        pass


def track_heads(heads: DataFrame) -> DataFrame:
    """(repo_id, action, from_sha, to_sha): what each poll (repo_id, head_sha, ts) of a repository asks for.

    The first head is an initial scan, a later one that differs (in any case of letters) a diff. A poll that comes late, with a
    time before the one that was processed last, asks for nothing; nor does one without head or time. State is typed, so it
    outlives a restart; it needs the state store of ``ROCKSDB`` in the session when the stream starts."""
    polls = heads.select("repo_id", "head_sha", F.unix_micros("ts").alias("at"))
    return polls.groupBy("repo_id").transformWithState(HeadTracker(), HEADS, "append", "None")
