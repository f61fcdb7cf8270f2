"""Exact deduplication with stateful streaming.

A stream of content digests runs through a keyed aggregation whose state (RocksDB, no watermark, so no expiry) holds for
each digest the stable identifier that stays, its content locator (file and row) and the group size. Digests that were hit
twice or more are checked on the full bytes; texts that share a digest but differ in bytes become groups of their own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.shared import as_bytes, bit_marked, mapped, scratch, stored

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_DIGESTS = "doc_id long, text_sha256 string, row string, batch string"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition reserves megabytes of disk
}


def normal_bytes(text: bytes) -> bytes:
    """A-Z lower-cased, every other byte as it is."""
    return text.translate(_LOWER)


def locator() -> F.Column:
    """Where a row's content is: its file and its row there."""
    return F.concat_ws("#", "_metadata.file_path", "_metadata.row_index")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, row): SHA-256 of each normalised text; null counts as empty. ``row`` locates the content."""

    def make(part: pa.RecordBatch) -> list:
        sums = [hashlib.sha256(normal_bytes(t)).hexdigest() for t in as_bytes(part.column("text")).to_pylist()]
        return [part.column("doc_id"), pa.array(sums, pa.string()), part.column("row")]

    rows = docs.select("doc_id", "text", locator().alias("row"))
    return mapped(rows, "text", "doc_id long, text_sha256 string, row string", ["doc_id", "text_sha256", "row"], make)


def stream_state(spark: SparkSession, folder: str, bytes_per_batch: int = 8 << 30) -> DataFrame:
    """Run the keyed stream over the digest files of ``folder`` that it has not seen yet, and read its state: text_sha256,
    keep_id, keep_row, group_size. The state stays in the folder without expiry; the session's settings are put back."""
    before = {key: spark.conf.get(key, None) for key in _STATE}
    try:
        for key, value in _STATE.items():
            spark.conf.set(key, value)
        feed = spark.readStream.schema(_DIGESTS).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(f"{folder}/digests/*")
        held = feed.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
        run = held.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    if not spark.read.schema(_DIGESTS).parquet(f"{folder}/digests/*").limit(1).count():
        return spark.createDataFrame([], "text_sha256 string, keep_id long, keep_row string, group_size long")
    state = spark.read.format("statestore").load(f"{folder}/state")
    stays, size = (F.col("value").getField(f.name) for f in state.schema["value"].dataType.fields)
    return state.select(
        F.col("key.text_sha256").alias("text_sha256"), stays["doc_id"].alias("keep_id"), stays["row"].alias("keep_row"), size.alias("group_size")
    )


def written(rows: DataFrame, path: str) -> None:
    """Write ``rows`` unless a finished write is there; what a failed one left is replaced."""
    jvm = rows.sparkSession._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).exists(done):
        rows.write.mode("overwrite").parquet(path)


def rows_name(docs: DataFrame) -> str:
    """A name for exactly these rows of these versions of their files; no text is read for it."""
    own = F.xxhash64("_metadata.file_path", "_metadata.file_modification_time", "_metadata.row_index")
    n, h = docs.select(own.alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h")).first()
    return f"{n}-{(h or 0) & (1 << 64) - 1:016x}"


def located(docs: DataFrame) -> DataFrame:
    return docs.select(locator().alias("row"), "text")


def clashing(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """(text_sha256) of repeated digests whose texts are not all the same bytes.

    ``texts``: row and text; ``hits``: row and text_sha256 of all rows of repeated digests. Only texts that a bitmap of fixed
    size cannot clear are shuffled. Least and greatest bytes of each digest are compared, so a task passes on two texts of a
    group at most.
    """

    def make(part: pa.RecordBatch) -> list:
        return [part.column("text_sha256"), pa.array([normal_bytes(t) for t in as_bytes(part.column("text")).to_pylist()], pa.binary())]

    hit = bit_marked(texts, "row", hits, "row", "__maybe").where("__maybe").select("row", "text").join(hits.select("row", "text_sha256"), "row")
    full = mapped(hit.select("text_sha256", "text"), "text", "text_sha256 string, body binary", ["text_sha256", "body"], make)
    return full.groupBy("text_sha256").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo <> hi").select("text_sha256")


def exact_dedup(docs: DataFrame, with_row: bool = False, folder: str | None = None, earlier: DataFrame | None = None, batch: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and its locator ``with_row``.

    ``docs`` must be read from files (the locator is file and row). Texts are equal if identical after lower-casing A-Z;
    the largest doc_id stays, and of rows that repeat that doc_id the last locator, so exactly one row of a group is kept.
    Null text counts as empty; a null doc_id loses to any other. No rows in, no rows out. Other columns are ignored.

    With a ``folder`` the state outlives the call: the next call with it goes on from there, and its rows are held against all
    that came before. ``earlier`` are those documents, read from files as well, whose bytes are checked on hits. A call that is
    repeated, as after a failure, counts its rows once: it is known by ``batch``, or else by its rows' places in their files.
    """
    spark = docs.sparkSession
    batch = batch or (rows_name(docs) if folder else "all")
    folder = folder or scratch(spark, "dedup")
    written(digests(docs).withColumn("batch", F.lit(batch)), f"{folder}/digests/{batch}")
    every = spark.read.schema(_DIGESTS).parquet(f"{folder}/digests/*")
    seen = every.where(F.col("batch") == batch).drop("batch")
    state = stored(stream_state(spark, folder), "dedup-held")
    hits = every.join(state.where("group_size > 1").select("text_sha256"), "text_sha256", "left_semi")
    own = located(docs)
    clashes = stored(clashing(own if earlier is None else own.unionByName(located(earlier)), hits), "dedup-clashes")
    out = seen.join(state, "text_sha256", "left")
    if clashes.limit(1).count():
        out = _split(docs, seen, out, clashes)
    return out.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("row").eqNullSafe(F.col("keep_row"))).alias("kept"), "text_sha256",
        *["row"] * with_row,
    )


def _split(docs: DataFrame, seen: DataFrame, out: DataFrame, clashes: DataFrame) -> DataFrame:
    """Groups of digests that several different texts share, told apart by their bytes within ``docs``."""
    bad = seen.join(clashes.select("text_sha256"), "text_sha256", "left_semi")
    body = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = docs.select(locator().alias("row"), body.cast("binary").alias("body")).join(bad, "row")
    classes = texts.groupBy("text_sha256", "body").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    again = texts.join(classes, ["text_sha256", "body"]).select(
        "text_sha256", "doc_id", "row", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row").alias("keep_row"), "group_size"
    )
    return out.join(clashes.select("text_sha256"), "text_sha256", "left_anti").unionByName(again)
