"""Sinks: combined graphs, telemetry rows, wire JSON, tenant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_combined_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet below ``path``, partitioned by repository."""
    nodes.write.mode("overwrite").partitionBy("repo_id").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("repo_id").parquet(f"{path}/edges")


def write_tenant_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """A table partitioned by tenant; rows of a tenant are brought together, so partitions get few files."""
    df.repartition("workspace_id", F.pmod(F.xxhash64(*df.columns[:3]), F.lit(32))).write.mode(mode).partitionBy("workspace_id").parquet(path)


def telemetry_rows(rows: DataFrame, now: Column) -> DataFrame:
    """Rows as they are appended: created_at has a default, method and error are cut."""
    return rows.withColumns({"created_at": F.coalesce("created_at", now), "method": F.substring("method", 1, 200), "error": F.substring("error", 1, 4000)})


def append_telemetry(rows: DataFrame, path: str, now: Column) -> None:
    telemetry_rows(rows, now).write.mode("append").parquet(path)


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def to_wire_json(df: DataFrame) -> DataFrame:
    """(json): each row as JSON with camel-case keys; nulls are left out."""
    return df.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns])).alias("json"))
