"""Tables kept as a base and a log of changed keys.

A batch writes only the rows that it changed and tombstones of the keys that it removed, under its number; a read takes the last
row of each key in the log and the base's rows of all other keys; folding makes a new base of both. Bytes written follow the
batch, and a batch that runs again replaces its own part. Layout below a folder: ``base/<last batch in it>/<table>`` and
``log/<table>/batch=<number>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

DONE = "_DONE"


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, fs = _files(spark, path)
    return fs.exists(where)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers that folders below ``path`` are named by."""
    where, fs = _files(spark, path)
    names = [s.getPath().getName().split("=")[-1] for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n) for n in names if n.lstrip("-").isdigit())


def bases(spark: SparkSession, path: str) -> list[int]:
    """The finished bases, by the last batch that is in them (-1: none is)."""
    return [n for n in _numbers(spark, f"{path}/base") if _exists(spark, f"{path}/base/{n}/{DONE}")]


def write_base(tables: dict[str, DataFrame], path: str, number: int) -> None:
    """A new base that holds all up to batch ``number``; it counts once all of its tables are written."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/base/{number}/{name}")
        spark = df.sparkSession
    where, fs = _files(spark, f"{path}/base/{number}/{DONE}")
    fs.create(where, True).close()


def _comparable(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one value that can be compared; maps have no order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.struct(*[F.array_sort(F.map_entries(c)).alias(c) if isinstance(kinds[c], MapType) else F.col(c) for c in columns])


def changed_rows(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``after`` that are new or differ from ``before``, and tombstones (``deleted``, other columns null) of keys that
    are gone. Keys are not null."""
    rest = [c for c in before.columns if c not in key]
    pack = lambda df, name: df.select(*key, F.struct(*rest).alias(name), _comparable(df, rest).alias(f"{name}_seen"))
    both = pack(before, "old").join(pack(after, "new"), key, "full_outer").where("new is null or old is null or not new_seen <=> old_seen")
    return both.select(*key, *[F.col("new")[c].alias(c) for c in rest], F.col("new").isNull().alias("deleted"))


def append(rows: DataFrame, path: str, table: str, number: int) -> None:
    """The log of batch ``number``; one that is there is replaced."""
    rows.write.mode("overwrite").parquet(f"{path}/log/{table}/batch={number}")


def read(spark: SparkSession, path: str, table: str, schema: StructType, key: list[str], before: int | None = None) -> DataFrame:
    """The table as it is, or as it was before batch ``before``."""
    base = max(n for n in bases(spark, path) if before is None or n < before)
    rows = spark.read.schema(schema).parquet(f"{path}/base/{base}/{table}")
    numbers = [n for n in _numbers(spark, f"{path}/log/{table}") if n > base and (before is None or n < before)]
    if not numbers:
        return rows
    log = spark.read.schema(StructType([*schema.fields]).add("deleted", "boolean")).option("basePath", f"{path}/log/{table}")
    log = log.parquet(*[f"{path}/log/{table}/batch={n}" for n in numbers])
    rest = [c for c in schema.names if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest, "deleted"), "batch").alias("last"))
    new = last.where("not last.deleted").select(*[F.col(c) if c in key else F.col("last")[c].alias(c) for c in schema.names])
    return rows.join(last.select(*key), key, "left_anti").select(*schema.names).unionByName(new)


def fold(spark: SparkSession, path: str, tables: dict[str, tuple[StructType, list[str]]], number: int) -> None:
    """A new base of the last one and the log up to batch ``number``. The base before stays for those who read it still; older
    ones go, with the log that it holds."""
    if number in bases(spark, path):
        return
    write_base({name: read(spark, path, name, schema, key, number + 1) for name, (schema, key) in tables.items()}, path, number)
    held = bases(spark, path)
    for old in held[:-2]:
        where, fs = _files(spark, f"{path}/base/{old}")
        fs.delete(where, True)
    for name in tables:
        for n in _numbers(spark, f"{path}/log/{name}"):
            if n <= held[-2 if len(held) > 1 else -1]:
                where, fs = _files(spark, f"{path}/log/{name}/batch={n}")
                fs.delete(where, True)
