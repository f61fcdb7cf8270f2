"""Change processing: which repositories changed, what each changed file needs, and the incremental update."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartolake.operators import changelog
from cartolake.operators.corpus import drop_binary_content, drop_oversize
from cartolake.operators.graph_write import EDGE_KEY, NODE_KEY, check_tenant, remove_node, remove_orphans, skip_invalid, upsert_edges, upsert_nodes, validate_nodes
from cartolake.operators.project import edge_rows, facts, node_rows, parse_extractions
from cartolake.sources.scratch import stored


def detect_changed_repos(repos: DataFrame, heads: DataFrame) -> DataFrame:
    """(workspace_id, repo_id, action, from_sha, to_sha): none, initial or diff; repositories in a scan are left out."""
    rows = repos.where("status <> 'scanning'").join(heads, ["workspace_id", "repo_id"])
    old = F.nullif(F.trim("last_processed_sha"), F.lit(""))
    action = F.when(old.isNull(), "initial").when(F.lower(old) == F.lower("head_sha"), "none").otherwise("diff")
    return rows.select("workspace_id", "repo_id", action.alias("action"), old.alias("from_sha"), F.col("head_sha").alias("to_sha"))


def read_file_changes(changes: DataFrame) -> DataFrame:
    """Change rows with empty texts and zeros for nulls."""
    return changes.fillna("", ["filename", "status", "previous_filename"]).fillna(0, ["additions", "deletions"])


def route_changes(changes: DataFrame) -> DataFrame:
    """(repo_id, action, path): what each change asks for; a rename prunes the old path and extracts the new one."""
    item = lambda action, path: F.struct(F.lit(action).alias("action"), F.col(path).alias("path"))
    todo = (
        F.when(F.col("status") == "removed", F.array(item("prune", "filename")))
        .when(F.col("status") == "renamed", F.array(item("prune", "previous_filename"), item("extract", "filename")))
        .when(F.col("status").isin("added", "modified"), F.array(item("extract", "filename")))
    )
    return changes.select("repo_id", F.explode(todo).alias("t")).select("repo_id", "t.*").where("path <> ''")


def cap_diff(changes: DataFrame, most: int = 500) -> DataFrame:
    """A repository's first ``most`` files by name, with ``capped`` where there were more."""
    w = Window.partitionBy("repo_id")
    n = F.row_number().over(w.orderBy("filename"))
    return changes.withColumns({"__r": n, "capped": F.count(F.lit(1)).over(w) > most}).where(F.col("__r") <= most).drop("__r")


def files_to_extract(routed: DataFrame, files: DataFrame) -> DataFrame:
    """Contents of files to extract, after the filters that a change scan applies (size and binary content)."""
    wanted = routed.where("action = 'extract'").select("repo_id", "path").distinct()
    return drop_binary_content(drop_oversize(files)).join(wanted, ["repo_id", "path"], "left_semi")


def upsert_extractions(table: DataFrame, updates: DataFrame) -> DataFrame:
    """One row per (workspace_id, repo_id, file_path): the newest, and of equal ages the update."""
    key = ["workspace_id", "repo_id", "file_path"]
    both = table.withColumn("__u", F.lit(0)).unionByName(updates.withColumn("__u", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("created_at"), F.desc("__u"), "content_hash")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__u")


def incremental_update(extractions: DataFrame, routed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The extraction table after a change: pruned paths gone, fresh extractions put in."""
    gone = routed.where("action = 'prune'").select("repo_id", F.col("path").alias("file_path")).distinct()
    return upsert_extractions(extractions.join(gone, ["repo_id", "file_path"], "left_anti"), fresh)


def emit_changes(changes: DataFrame, files: DataFrame, extract: Callable[[DataFrame], DataFrame], most: int = 500, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(routed, fresh, emitted): what a batch of changed files asks for, the new extraction rows, and the facts in them.

    A repository's first ``most`` changes are routed; files to extract pass the size and binary filters; ``extract`` gives
    their extraction rows (with created_at). All three are read several times: ``keep`` may write them.
    """
    routed = keep(route_changes(cap_diff(read_file_changes(changes), most)), "routed")
    fresh = keep(extract(files_to_extract(routed, files)), "fresh")
    return routed, fresh, keep(facts(parse_extractions(fresh)), "emitted")


def updated(state: dict[str, DataFrame], routed: DataFrame, fresh: DataFrame, emitted: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The tables ``extractions``, ``nodes`` and ``edges`` after a batch: pruned files lose their extraction and all their nodes,
    fresh ones are projected and merged, and nodes that an earlier extraction of a fresh file left behind go."""
    pruned = routed.where("action = 'prune'").select("repo_id", F.col("path").alias("file_path")).distinct()
    nodes, edges = state["nodes"], state["edges"]
    left = nodes.join(pruned, ["repo_id", "file_path"], "left_semi").select(*NODE_KEY)
    nodes, edges = remove_node(nodes, edges, left)
    specs = skip_invalid(validate_nodes(check_tenant(node_rows(emitted))))[0]
    nodes = upsert_nodes(nodes, specs, now)
    edges = upsert_edges(edges, edge_rows(emitted), nodes, now)
    current = emitted.select("workspace_id", "repo_id", "file_path", F.col("extraction_id").alias("last_extraction_id")).distinct()
    seen = fresh.select("workspace_id", "repo_id", "file_path").distinct()
    nodes, edges, _ = remove_orphans(nodes, edges, seen, "current", current)
    return {"extractions": incremental_update(state["extractions"], routed, fresh), "nodes": nodes, "edges": edges}


def apply_changes(
    state: dict[str, DataFrame], changes: DataFrame, files: DataFrame, extract: Callable[[DataFrame], DataFrame], now: Column, most: int = 500
) -> dict[str, DataFrame]:
    """The whole tables after a batch of changed files. ``extract`` is the costly part: its rows are read several times, so it
    should return a written table."""
    return updated(state, *emit_changes(changes, files, extract, most), now)


def touched(state: dict[str, DataFrame], routed: DataFrame, fresh: DataFrame, emitted: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """The rows of ``state`` that a batch can change or must see: all of its files, the nodes that its facts name or link, and the
    edges that these files' nodes have or that its facts give.

    The batch's keys meet the stored tables; where ``keep`` writes them, their size is known, so small ones are broadcast and
    no stored table is shuffled."""
    here = F.lit(True)
    files = keep(routed.select("repo_id", F.col("path").alias("file_path")).union(fresh.select("repo_id", "file_path")).distinct(), "files")
    links = edge_rows(emitted).select(*EDGE_KEY)
    end = lambda c: links.select("workspace_id", F.col(c).alias("id"))
    ids = keep(node_rows(emitted).select("workspace_id", "id").union(end("source_id")).union(end("target_id")).distinct(), "ids")
    links = keep(links.distinct(), "links")
    nodes = state["nodes"].join(files.withColumn("__f", here), ["repo_id", "file_path"], "left").join(ids.withColumn("__i", here), ["workspace_id", "id"], "left")
    nodes = keep(nodes.where("__f or __i").select(*state["nodes"].columns, "__f"), "nodes")
    near = nodes.where("__f").select("workspace_id", "id").distinct()
    side = lambda c: near.select("workspace_id", F.col("id").alias(c), here.alias(f"__{c}"))
    edges = state["edges"].join(side("source_id"), ["workspace_id", "source_id"], "left").join(side("target_id"), ["workspace_id", "target_id"], "left")
    edges = edges.join(links.withColumn("__l", here), EDGE_KEY, "left").where("__source_id or __target_id or __l")
    return {
        "extractions": state["extractions"].join(files, ["repo_id", "file_path"], "left_semi").select(*state["extractions"].columns),
        "nodes": nodes.drop("__f"), "edges": keep(edges.select(*state["edges"].columns), "edges"),
    }


#: Keys of the tables that changes update.
KEYS = {"extractions": ["workspace_id", "repo_id", "file_path"], "nodes": NODE_KEY, "edges": EDGE_KEY}


def log_changes(
    path: str, number: int, schemas: dict[str, StructType], changes: DataFrame, files: DataFrame, extract: Callable[[DataFrame], DataFrame], now: Column, most: int = 500, fold_every: int = 20
) -> None:
    """Apply batch ``number`` of changed files to the tables that ``path`` keeps as a base and a log.

    Only the rows that the batch touches are taken out of the tables, and only those that it changed are logged. A batch that
    runs again replaces its own log; one that a base holds already does nothing. Every ``fold_every`` batches the log is
    folded into a new base."""
    spark = changes.sparkSession
    if number <= max(changelog.bases(spark, path)):
        return
    state = {name: changelog.read(spark, path, name, schema, KEYS[name], number) for name, schema in schemas.items()}
    routed, fresh, emitted = emit_changes(changes, files, extract, most, stored)
    before = touched(state, routed, fresh, emitted, stored)
    for name, after in updated(before, routed, fresh, emitted, now).items():
        changelog.append(changelog.changed_rows(before[name], after.select(*schemas[name].names), KEYS[name]), path, name, number)
    if (number + 1) % fold_every == 0:
        changelog.fold(spark, path, {name: (schema, KEYS[name]) for name, schema in schemas.items()}, number)


def full_rescan(extractions: DataFrame, repo_id: str, fresh: DataFrame) -> DataFrame:
    """The extraction table with one repository replaced."""
    return extractions.where(F.col("repo_id") != repo_id).unionByName(fresh.where(F.col("repo_id") == repo_id))


def scan_run_row(scans: DataFrame, now: Column) -> DataFrame:
    """Rows to append: open runs end now, errors are cut at 4000 characters."""
    ended = F.when(F.col("status").isin("succeeded", "failed"), F.coalesce("completed_at", now)).otherwise(F.col("completed_at"))
    return scans.withColumns({"completed_at": ended, "error_message": F.substring("error_message", 1, 4000)})
