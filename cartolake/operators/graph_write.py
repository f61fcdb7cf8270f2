"""Writing the graph: merging specs, removing, validating and pruning. Tables go in, a new version comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.schemas import EDGE_LABELS, IMPLEMENTATION_PROPERTIES, NODE_LABELS, edge_labels, node_labels

NODE_KEY = ["workspace_id", "label", "id"]
EDGE_KEY = ["workspace_id", "label", "source_id", "target_id"]


def _order(specs: DataFrame, order: Column) -> Column:
    """Specs apply in the order of their time; without ``created_at``, of ``order``."""
    return F.col("created_at") if "created_at" in specs.columns else order


def fold_props(specs: DataFrame, key: list[str], order: Column) -> DataFrame:
    """(key, props): property by property, the value of the last spec in ``order`` wins (of one time, the greatest); a null
    value stays to remove. Equal specs are one before their properties are looked at."""
    once = specs.groupBy(*key, F.map_entries("props").alias("props")).agg(F.max(order).alias("__o"))
    pairs = once.select(*key, "__o", F.explode_outer("props").alias("p"))
    last = pairs.groupBy(*key, F.col("p.key").alias("k")).agg(F.max(F.struct("__o", "p.value")).alias("b"))
    entries = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "b.value")))  # as many as there are properties
    return last.groupBy(*key).agg(F.map_from_entries(entries).alias("props"))


def merge_props(old: Column, new: Column) -> Column:
    """New keys win, old keys stay, null values remove their key."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_filter(F.map_concat(kept, new), lambda k, v: v.isNotNull())


def upsert_nodes(nodes: DataFrame, specs: DataFrame, now: Column, order: str = "last_extraction_id") -> DataFrame:
    """``nodes`` with ``specs`` merged by (workspace_id, label, id); specs of one id apply in the order of ``created_at``, or of
    ``order`` where they have none.

    Name and origin come from the last spec in one aggregation, properties from their own; both are dealt by key, as is the
    join that meets the stored nodes. ``specs`` are read for each of the two: write them first if they are costly.
    """
    at = _order(specs, F.col(order))
    own = ["name", "repo_id", "file_path", "last_extraction_id"]
    last = specs.groupBy(*NODE_KEY).agg(F.max(F.struct(at.alias("at"), "last_extraction_id", "file_path", "repo_id", "name")).alias("b"))
    new = last.select(*NODE_KEY, *[F.col(f"b.{c}").alias(c) for c in own]).join(fold_props(specs, NODE_KEY, at), NODE_KEY)
    o, n = nodes.alias("o"), new.alias("n")
    pick = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in own]
    changed = F.col("n.props").isNotNull()
    return o.join(n, NODE_KEY, "full_outer").select(
        *NODE_KEY, pick[0], merge_props(F.col("o.props"), F.col("n.props")).alias("props"), *pick[1:],
        F.when(changed, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def store_bucketed(df: DataFrame, table: str, path: str, key: list[str], buckets: int) -> DataFrame:
    """``df`` as the catalog's ``table`` below ``path``, dealt into ``buckets`` by ``key`` and sorted by it within them. What is joined
    or grouped by that key meets it where it lies."""
    df.repartition(buckets, *key).write.mode("overwrite").option("path", path).bucketBy(buckets, *key).sortBy(*key).saveAsTable(table)
    return df.sparkSession.table(table)


def store_graph(nodes: DataFrame, edges: DataFrame, name: str, path: str, buckets: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, ids) as bucketed tables: nodes and edges by their keys, and the nodes' ids, by which ends of edges are sought.

    ``upsert_nodes`` on the first, and ``upsert_edges`` on the second with ``ids`` as its nodes, shuffle the new specs only. Of 200
    buckets each is to fit into a task: take more for larger graphs."""
    return (
        store_bucketed(nodes, f"{name}_nodes", f"{path}/nodes", NODE_KEY, buckets),
        store_bucketed(edges, f"{name}_edges", f"{path}/edges", EDGE_KEY, buckets),
        store_bucketed(nodes.select("workspace_id", "id").distinct(), f"{name}_ids", f"{path}/ids", ["workspace_id", "id"], buckets),
    )


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist in the tenant."""
    ids = nodes.select("workspace_id", "id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "source_id"), ["workspace_id", "source_id"], "left_semi")
    return out.join(ids.withColumnRenamed("id", "target_id"), ["workspace_id", "target_id"], "left_semi")


def upsert_edges(edges: DataFrame, specs: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """``edges`` with ``specs`` merged into one edge per (source, label, target), in the order of ``created_at`` if they have it;
    specs without both ends are dropped."""
    return merge_edges(edges, with_both_ends(specs, nodes), now)


def merge_edges(edges: DataFrame, specs: DataFrame, now: Column) -> DataFrame:
    """The same for specs whose ends are known to exist."""
    new = fold_props(specs, EDGE_KEY, _order(specs, F.to_json("props")))
    o, n = edges.alias("o"), new.alias("n")
    return o.join(n, EDGE_KEY, "full_outer").select(
        *EDGE_KEY, merge_props(F.col("o.props"), F.col("n.props")).alias("props"),
        F.when(F.col("n.props").isNotNull(), now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def remove_node(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``keys`` (workspace_id, label, id), and edges without those that touched them."""
    ids = keys.select("workspace_id", "id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source_id"), ["workspace_id", "source_id"], "left_anti")
    left = left.join(ids.withColumnRenamed("id", "target_id"), ["workspace_id", "target_id"], "left_anti")
    return nodes.join(keys, NODE_KEY, "left_anti"), left


def remove_edge(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys, EDGE_KEY, "left_anti")


def orphans_for_files(nodes: DataFrame, files: DataFrame, keep: str = "max_id", current: DataFrame | None = None) -> DataFrame:
    """Keys of nodes of the given (workspace_id, repo_id, file_path) that a new scan left behind.

    ``keep``: 'max_id' keeps the largest last_extraction_id of each file, as text; 'current' the ones in ``current``
    (with last_extraction_id); 'none' drops all. Nodes without last_extraction_id always go.
    """
    key = ["workspace_id", "repo_id", "file_path"]
    mine = nodes.join(files.select(key).distinct(), key, "left_semi")
    if keep == "none":
        return mine.select(NODE_KEY)
    held = (current if keep == "current" else mine).groupBy(*key).agg(F.max("last_extraction_id").alias("held"))
    gone = mine.join(held, key, "left").where(F.col("last_extraction_id").isNull() | ~F.col("last_extraction_id").eqNullSafe(F.col("held")))
    return gone.select(NODE_KEY)


def remove_orphans(nodes: DataFrame, edges: DataFrame, files: DataFrame, keep: str = "max_id", current: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, removed keys)."""
    gone = orphans_for_files(nodes, files, keep, current)
    return *remove_node(nodes, edges, gone), gone


def apply_batch(nodes: DataFrame, edges: DataFrame, node_specs: DataFrame, edge_specs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, applied): all valid specs as one new version, and how many were applied."""
    good, _ = skip_invalid(validate_nodes(check_tenant(node_specs)))
    merged = upsert_nodes(nodes, good, now)
    good_edges, _ = skip_invalid(validate_edges(edge_specs, merged))
    usable = with_both_ends(good_edges, merged)
    count = good.select(F.lit(1).alias("n")).union(usable.select(F.lit(1))).agg(F.count("n").alias("applied"))
    return merged, merge_edges(edges, usable, now), count


def _warn(values: Column, text: str) -> Column:
    return F.transform(values, lambda v: F.format_string(text, v))


def validate_nodes(nodes: DataFrame) -> DataFrame:
    """Adds errors and is_valid. Missing required properties are errors, unknown ones warnings."""
    known = F.broadcast(node_labels(nodes.sparkSession))  # ten rows
    joined = nodes.join(known, "label", "left")
    missing = F.filter("required", lambda r: F.coalesce(F.trim(F.element_at("props", r)), F.lit("")) == "")
    allowed = F.concat("required", "optional", F.array(*map(F.lit, IMPLEMENTATION_PROPERTIES)))
    extra = F.array_sort(F.array_except(F.map_keys("props"), allowed))
    errors = F.when(F.col("required").isNull(), F.array(F.concat(F.lit("unknown label "), F.coalesce("label", F.lit("null"))))).otherwise(
        F.concat(_warn(missing, "missing %s"), _warn(extra, "[warn] unknown property %s"))
    )
    out = joined.withColumn("errors", F.coalesce(errors, F.array().cast("array<string>")))
    return out.withColumn("is_valid", F.forall("errors", lambda e: e.startswith("[warn]"))).drop("required", "optional", "label_rank")


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds errors and is_valid: labels must be known and allow both ends' labels; unknown ends are warnings."""
    ids = nodes.select("workspace_id", "id", F.col("label").alias("l"))
    e = edges.join(ids.toDF("workspace_id", "source_id", "from_label"), ["workspace_id", "source_id"], "left")
    e = e.join(ids.toDF("workspace_id", "target_id", "to_label"), ["workspace_id", "target_id"], "left")
    e = e.join(F.broadcast(edge_labels(edges.sparkSession)), "label", "left")  # fourteen rows
    side = lambda own, allowed, word: F.when(F.col(own).isNull(), F.lit(f"[warn] no {word} node")).when(
        ~F.array_contains(allowed, "*") & ~F.array_contains(F.col(allowed), F.col(own)), F.concat(F.lit(f"{word} label "), own)
    )
    ends = F.array_compact(F.array(side("from_label", "from_labels", "from"), side("to_label", "to_labels", "to")))
    errors = F.when(F.col("from_labels").isNull(), F.array(F.concat(F.lit("unknown edge label "), "label"))).otherwise(ends)
    out = e.withColumn("errors", errors).withColumn("is_valid", F.forall("errors", lambda x: x.startswith("[warn]")))
    return out.drop("from_labels", "to_labels", "from_label", "to_label")


def skip_invalid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the verdict, rejected rows with it)."""
    return validated.where("is_valid").drop("is_valid", "errors"), validated.where("not is_valid")


def schema_drift(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, problem): labels declared but not live, and live but not declared; names starting with _ are internal."""

    def side(live: DataFrame, declared: list[str], kind: str) -> DataFrame:
        spark = live.sparkSession
        own = live.select("label").distinct().where(~F.col("label").startswith("_"))
        want = spark.createDataFrame([(x,) for x in declared], "label string").coalesce(1)
        missing = want.join(own, "label", "left_anti").withColumn("problem", F.lit("missing"))
        extra = own.join(F.broadcast(want), "label", "left_anti").withColumn("problem", F.lit("extra"))
        return missing.union(extra).select(F.lit(kind).alias("kind"), "label", "problem")

    return side(nodes, list(NODE_LABELS), "vertex").union(side(edges, list(EDGE_LABELS), "edge"))


def check_property_keys(nodes: DataFrame) -> DataFrame:
    """Adds keys_ok: every property key is a lower-case identifier."""
    return nodes.withColumn("keys_ok", F.forall(F.map_keys("props"), lambda k: k.rlike("^[a-z_][a-z0-9_]*$")))


def iso_timestamp(at: Column) -> Column:
    """ISO-8601 in UTC with seven decimals."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))


def check_tenant(nodes: DataFrame) -> DataFrame:
    """Rows whose own workspace_id property is their tenant, with tenant and id set."""
    own = F.element_at("props", F.lit("workspace_id"))
    return nodes.where((F.coalesce("workspace_id", F.lit("")) != "") & (F.coalesce("id", F.lit("")) != "") & own.eqNullSafe(F.col("workspace_id")))


def schema_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, live, declared, n): declared and live labels with counts."""

    def side(live: DataFrame, declared: list[str], kind: str) -> DataFrame:
        want = live.sparkSession.createDataFrame([(x, True) for x in declared], "label string, declared boolean").coalesce(1)
        n = live.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        both = n.join(want, "label", "full_outer")
        return both.select(F.lit(kind).alias("kind"), "label", F.col("n").isNotNull().alias("live"), F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("n", F.lit(0)).alias("n"))

    return side(nodes, list(NODE_LABELS), "vertex").union(side(edges, list(EDGE_LABELS), "edge"))
