"""Scratch tables in the shared folder, and Arrow batches cut by bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to Python; each task holds a few of them outside the heap.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset, a local session (as in tests) sets one of its own; on a
    cluster, whose machines share no temporary folder, it is an error."""
    small_batches(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cartolake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, any executor can be lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for root in roots:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)


#: Bits of a filter of hashed keys: 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26


def bit_marked(df: DataFrame, column: str, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: false where ``column`` is surely not among the ``key`` values of ``wanted``.

    A bitmap of hashed keys, of fixed size, is broadcast. It lets some other rows pass (all of them, if it is full), so a join
    must follow for those that do.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = wanted.select(place(key).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bits"))
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("__bucket", F.bitmap_bucket_number(place(column))).join(F.broadcast(bits), "__bucket", "left")
    return found.select(*[F.col(c) for c in df.columns], F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(name))


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def as_bytes(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column; null counts as empty."""
    return texts.cast(pa.large_binary()).fill_null(b"")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds at most ``limit`` bytes of ``column``, or one row that is larger."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def mapped(df: DataFrame, column: str, schema: str, names: list[str], make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``make`` gives the arrays of ``names`` for each slice of ``df``; rows with no slice give nothing."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in make(part)], names)

    return df.mapInArrow(run, schema)
