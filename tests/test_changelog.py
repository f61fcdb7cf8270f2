"""Tables kept as a base and a log of changed keys, against the same changes applied to whole tables."""

import json
import os
import random

from pyspark.sql import functions as F

from cartolake.operators import changelog, changes, graph_write
from cartolake.operators.project import parse_extractions, project_all
from cartolake.schemas import EDGES, NODES
from cartolake.streaming import streams

EXTRACTIONS = "workspace_id string, repo_id string, file_path string, content_hash string, extraction_payload string, created_at timestamp"
CHANGES = "repo_id string, filename string, status string, previous_filename string, additions int, deletions int"


def at(day):
    return F.lit(f"2024-01-{day:02d}").cast("timestamp")


def payload(service, event):
    return json.dumps({"service": {"isPartOfService": True, "serviceName": service}, "eventsPublished": {"publishes": [{"name": event, "topic": "t"}]}})


def extracted(spark, rows, day):
    df = spark.createDataFrame([("w", r, f, f"{day}-{s}", payload(s, e)) for r, f, s, e in rows], EXTRACTIONS.rsplit(",", 1)[0])
    return df.withColumn("created_at", at(day))


def first_state(spark, n, folder):
    ex = extracted(spark, [("r", f"f{i}", f"S{i % 40}", f"E{i % 9}") for i in range(n)], 1)
    nodes, edges = project_all(parse_extractions(ex))
    merged = graph_write.upsert_nodes(spark.createDataFrame([], NODES), nodes, at(1))
    out = {"extractions": ex, "nodes": merged, "edges": graph_write.upsert_edges(spark.createDataFrame([], EDGES), edges, merged, at(1))}
    for name, df in out.items():
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in out.items()}


def a_batch(r, n):
    rows = []
    for f in r.sample(range(n + 5), 6):
        status = r.choice(["removed", "modified", "modified", "renamed", "added", "odd"])
        rows.append(("r", f"g{f}" if status == "renamed" else f"f{f}", status, f"f{f}" if status == "renamed" else None, None, 1))
    return rows


def rows(df):
    plain = [F.array_sort(F.map_entries(c)).alias(c) if k.startswith("map") else F.col(c) for c, k in sorted(df.dtypes)]
    return sorted(map(str, df.select(*plain).collect()))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_batches_equal_whole_tables(spark, tmp_path):
    """Rows after each batch; a batch that runs again; a fold; a batch that a base holds already."""
    r, n = random.Random(5), 60
    whole, path = first_state(spark, n, str(tmp_path / "start")), str(tmp_path / "log")
    schemas = {name: df.schema for name, df in whole.items()}
    changelog.write_base(whole, path, -1)
    files = spark.createDataFrame([("r", f"{k}{i}", 10, bytearray(b"x")) for k in "fg" for i in range(n + 5)], "repo_id string, path string, length int, content binary")
    for number in range(4):
        changed = spark.createDataFrame(a_batch(r, n), CHANGES)
        new = F.concat(F.lit("S"), (F.crc32("path") % 45).cast("string"))
        body = F.to_json(F.struct(F.struct(F.lit(True).alias("isPartOfService"), new.alias("serviceName")).alias("service"), F.struct(F.array(F.struct(F.lit(f"E{number}").alias("name"), F.lit("t").alias("topic"))).alias("publishes")).alias("eventsPublished")))
        extract = lambda todo, body=body, day=number + 2: todo.select(F.lit("w").alias("workspace_id"), "repo_id", F.col("path").alias("file_path"), F.lit(f"{day}").alias("content_hash"), body.alias("extraction_payload"), at(day).alias("created_at"))
        whole = changes.apply_changes(whole, changed, files, extract, at(number + 2))
        for name, df in whole.items():
            df.write.parquet(str(tmp_path / f"whole{number}" / name))
        whole = {name: spark.read.schema(schemas[name]).parquet(str(tmp_path / f"whole{number}" / name)) for name in whole}
        for _ in range(2 if number == 1 else 1):
            changes.log_changes(path, number, schemas, changed, files, extract, at(number + 2), fold_every=3)
        held = streams.read_incremental(spark, path, schemas)
        assert {name: rows(df) for name, df in held.items()} == {name: rows(df) for name, df in whole.items()}
    assert changelog.bases(spark, path) == [-1, 2] and changelog._numbers(spark, f"{path}/log/nodes") == [0, 1, 2, 3]
    before = size(path)
    changes.log_changes(path, 2, schemas, changed, files, extract, at(9))  # in the base already
    assert size(path) == before and {name: rows(df) for name, df in streams.read_incremental(spark, path, schemas).items()} == {name: rows(df) for name, df in whole.items()}
    changelog.fold(spark, path, {name: (schemas[name], changes.KEYS[name]) for name in schemas}, 3)
    assert changelog.bases(spark, path) == [2, 3] and changelog._numbers(spark, f"{path}/log/nodes") == [3]
    assert {name: rows(df) for name, df in streams.read_incremental(spark, path, schemas).items()} == {name: rows(df) for name, df in whole.items()}


def test_writes_follow_the_batch(spark, tmp_path):
    """The log of a change of two files is as long whether the tables hold 50 files or 2000."""
    found = []
    for n in (50, 2000):
        state, path = first_state(spark, n, str(tmp_path / f"start{n}")), str(tmp_path / f"log{n}")
        schemas = {name: df.schema for name, df in state.items()}
        changelog.write_base(state, path, -1)
        files = spark.createDataFrame([("r", "f3", 10, bytearray(b"x"))], "repo_id string, path string, length int, content binary")
        changed = spark.createDataFrame([("r", "f3", "modified", None, 1, 1), ("r", "f45", "removed", None, None, None)], CHANGES)
        changes.log_changes(path, 0, schemas, changed, files, lambda todo: extracted(spark, [("r", "f3", "New", "E1")], 2).join(todo.select("repo_id", F.col("path").alias("file_path")), ["repo_id", "file_path"], "left_semi").select("workspace_id", "repo_id", "file_path", "content_hash", "extraction_payload", "created_at"), at(2))
        found.append({name: spark.read.parquet(f"{path}/log/{name}").count() for name in schemas})
    assert found[0]["extractions"] == found[1]["extractions"] == 2 and all(c <= 12 for f in found for c in f.values())
