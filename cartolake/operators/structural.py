"""Structural (syntax) graphs: gnodes(repo_id, id, label, file_type, source_file) and gedges(repo_id, source, target, relation, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolake.functions.exprs import normalise_path


def combine_graphs(gnodes: DataFrame, gedges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One undirected simple graph of all repositories.

    Ids get the repository's first eight characters as prefix. A number as an edge's end is a position in its repository's
    node list (``pos``). Edges without both ends go; of (a, b) and (b, a) the later one (``ord``) stays, and of repeated
    nodes the later attributes.
    """
    prefix = F.concat(F.substring("repo_id", 1, 8), F.lit("__"))
    named = gnodes.withColumn("gid", F.concat(prefix, F.col("id")))
    nodes = named.groupBy("repo_id", "gid").agg(*[F.max_by(c, "pos").alias(c) for c in ("label", "file_type", "source_file")])
    by_place = named.select("repo_id", F.col("pos").cast("string").alias("p"), F.col("gid").alias("by_pos"))
    known = nodes.select("repo_id", "gid")
    e = gedges
    for end in ("source", "target"):
        e = e.join(by_place.withColumnsRenamed({"p": end, "by_pos": f"{end}_pos"}), ["repo_id", end], "left")
        e = e.withColumn(f"{end}_id", F.coalesce(F.when(F.col(end).rlike(r"^\d+$"), F.col(f"{end}_pos")), F.concat(prefix, F.col(end))))
        e = e.join(known.withColumnRenamed("gid", f"{end}_id"), ["repo_id", f"{end}_id"], "left_semi")
    pair = {"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")}
    edges = e.withColumns(pair).groupBy("repo_id", "a", "b").agg(F.max_by("relation", "ord").alias("relation"), F.max_by("label", "ord").alias("label"))
    return nodes, edges


def infer_repo_name(files: DataFrame) -> DataFrame:
    """(repo_id, repo_name): package.json's name, else a solution's stem, else pyproject's name, else the first heading of
    a readme, else the id's first eight characters."""
    base = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    pick = lambda test, value: F.min(F.when(test, F.struct("path", F.nullif(value, F.lit("")).alias("v"))))["v"]
    found = files.groupBy("repo_id").agg(
        F.coalesce(
            pick(base == "package.json", F.get_json_object("text", "$.name")),
            pick(base.endswith(".sln"), F.regexp_extract("path", r"([^/]*)\.sln$", 1)),
            pick(base == "pyproject.toml", F.regexp_extract("text", r"(?m)^\s*name\s*=\s*[\"']([^\"']+)", 1)),
            pick(base == "readme.md", F.trim(F.regexp_extract("text", r"(?m)^# (.+)$", 1))),
        ).alias("n")
    )
    return found.select("repo_id", F.coalesce("n", F.substring("repo_id", 1, 8)).alias("repo_name"))


def load_structural(gnodes: DataFrame, gedges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, name, …) and edges (source_id, target_id, label) with defaults; rows with blank ids go."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    nodes = gnodes.where(filled("id")).select("repo_id", "id", F.coalesce("file_type", F.lit("code")).alias("label"), F.coalesce("label", "id").alias("name"), "source_file")
    edges = gedges.where(filled("source") & filled("target")).select("repo_id", F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.coalesce("relation", "label", F.lit("rel")).alias("label"))
    return nodes, edges


def structural_degree(edges: DataFrame) -> DataFrame:
    """(id, degree): each end counts, a loop twice."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def top_degree_subgraph(nodes: DataFrame, edges: DataFrame, limit: int = 500, repo: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, totals): the ``limit`` (1..5000) nodes of largest degree, ties by id, and the edges among them.

    totals: total_nodes after the repository filter, total_edges of the whole graph, truncated.
    """
    limit = min(5000, max(1, limit))
    mine = nodes if repo is None else nodes.where(F.lower("repo_id") == repo.lower())
    ranked = mine.join(structural_degree(edges), "id", "left").fillna(0, ["degree"])
    top = ranked.orderBy(F.desc("degree"), "id").limit(limit)
    ids = top.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    totals = mine.agg(F.count(F.lit(1)).alias("total_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("total_edges")))  # one row each
    return top, inner, totals.withColumn("truncated", F.col("total_nodes") > limit)


def keyword_search(nodes: DataFrame, degrees: DataFrame, keywords: list[str], limit: int = 200) -> DataFrame:
    """(id, name, score, degree): how many keywords name, label and file hold; best first, then by degree and id."""
    wanted = sorted({k.strip().lower() for k in keywords} - {""})
    hay = F.lower(F.concat_ws(" ", "name", "label", "source_file"))
    score = sum((hay.contains(k).cast("int") for k in wanted), F.lit(0))
    hits = nodes.withColumn("score", score).where(F.col("score") > 0)
    return hits.join(degrees, "id", "left").fillna(0, ["degree"]).orderBy(F.desc("score"), F.desc("degree"), "id").limit(limit).select("id", "name", "score", "degree")


def repo_colour(nodes: DataFrame, colours: int = 10, buckets: int = 256) -> DataFrame:
    """(repo_id, colour): rank of the repository modulo the number of colours.

    Repositories are ranked within buckets between about ``buckets`` of them (chosen by hash, so the same ones each time), and
    each bucket begins where the counts of those before it end; only these counts meet in one task.
    """
    repos = nodes.select("repo_id").where("repo_id is not null").distinct()
    share = max(1, repos.count() // buckets)
    bounds = repos.where(F.pmod(F.xxhash64("repo_id"), F.lit(share)) == 0).agg(F.array_sort(F.collect_list("repo_id")).alias("bounds"))
    placed = repos.crossJoin(F.broadcast(bounds))  # one row of about ``buckets`` names
    placed = placed.select("repo_id", F.size(F.filter("bounds", lambda b: b <= F.col("repo_id"))).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("repo_id")) - 1
    return placed.join(F.broadcast(before), "bucket").select("repo_id", F.pmod(rank, F.lit(colours)).cast("int").alias("colour"))


def communities(nodes: DataFrame) -> DataFrame:
    """(community, size): each repository is a community."""
    return nodes.groupBy(F.col("repo_id").alias("community")).agg(F.count(F.lit(1)).alias("size"))


def file_context(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, outbound, inbound) of each asked file; paths meet normalised and ignoring case."""
    key = lambda c: F.lower(normalise_path(F.col(c)))
    asked = paths.select("path", key("path").alias("k")).distinct()
    own = nodes.withColumn("k", key("source_file")).join(asked, "k").select("path", "id", "label", "name")
    names = nodes.select("id", F.col("name").alias("n"))

    def side(mine: str, other: str) -> DataFrame:
        e = own.select("path", F.col("id").alias(mine), F.col("name").alias("own_name")).join(edges.select("source_id", "target_id", F.col("label").alias("edge")), mine)
        return e.join(names.withColumnRenamed("id", other), other)

    out = side("source_id", "target_id").select("path", F.col("own_name").alias("source_name"), F.col("edge").alias("label"), F.col("n").alias("target_name"))
    into = side("target_id", "source_id").select("path", F.col("n").alias("source_name"), F.col("edge").alias("label"), F.col("own_name").alias("target_name"))
    return own, out, into
