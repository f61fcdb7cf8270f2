"""Filters of fixed size by hashed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 1 MB, whatever the number of keys.
BITS = 1 << 23


def possible(df: DataFrame, key: list[Column], wanted: DataFrame, wanted_key: list[Column]) -> DataFrame:
    """``df`` without most of the rows whose ``key`` is none of the keys of ``wanted``.

    A bitmap of hashed keys is broadcast. It lets some other rows pass (all of them, if it is full), so a join must follow."""
    place = lambda c: F.pmod(F.xxhash64(*c), F.lit(BITS))
    bits = wanted.select(place(wanted_key).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bits"))
    at = F.bitmap_bit_position(F.col("__place"))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = df.withColumn("__place", place(key)).withColumn("__bucket", F.bitmap_bucket_number("__place"))
    return rows.join(F.broadcast(bits), "__bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*df.columns)
