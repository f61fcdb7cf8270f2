"""Usage reports. ``now`` is always an argument; costs are decimals, percentages half-even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repo_summary(repos: DataFrame) -> DataFrame:
    return repos.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"))


def last_scan_at(scans: DataFrame) -> DataFrame:
    return scans.groupBy("workspace_id").agg(F.max("started_at").alias("last_scan_at"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with two decimals, half-even; 0 of nothing."""
    ratio = F.bround(part.cast("decimal(20,0)") * 100 / F.nullif(whole.cast("decimal(20,0)"), F.lit(0)), 2)
    return F.coalesce(ratio, F.lit(0)).cast("decimal(10,2)")


def cached_pct(calls: DataFrame) -> DataFrame:
    own = calls.where(F.col("purpose").startswith("Extraction"))
    n = own.groupBy("workspace_id").agg(percent(F.count_if("cache_hit"), F.count(F.lit(1))).alias("pct"))
    return calls.select("workspace_id").distinct().join(n, "workspace_id", "left").select("workspace_id", F.coalesce("pct", F.lit(0).cast("decimal(10,2)")).alias("cached_pct"))


def question_counts(questions: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return questions.groupBy("workspace_id").agg(n("Open"), n("Answered"), n("Dismissed"))


def skill_count(skills: DataFrame) -> DataFrame:
    return skills.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("skills"))


def spend_by_purpose(calls: DataFrame) -> DataFrame:
    """(workspace_id, purpose, calls, four token sums, cost, hit_pct): a row per purpose and one with purpose 'total'. Calls
    without columns for tokens read from and written to the model's cache have none."""
    cached = ["cache_read_tokens", "cache_write_tokens"]
    calls = calls.withColumns({c: F.lit(0) for c in cached if c not in calls.columns})
    r = calls.rollup("workspace_id", "purpose").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in cached],
        F.sum("cost_usd").cast("decimal(14,6)").alias("cost_usd"), percent(F.count_if("cache_hit"), F.count(F.lit(1))).alias("hit_pct"),
    )
    return r.where("g < 2").withColumn("purpose", F.when(F.col("g") == 1, "total").otherwise(F.col("purpose"))).drop("g")


def _quantile(p: float) -> Column:
    return F.coalesce(F.rint(F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY latency_ms)")).cast("int"), F.lit(0))


def latency_stats(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("calls"), _quantile(0.5).alias("p50"), _quantile(0.95).alias("p95"), percent(F.count_if(F.col("status_code") >= 400), F.count(F.lit(1))).alias("error_pct")
    )


def graph_counts(overview: DataFrame) -> DataFrame:
    """(workspace_id, node_counts, edge_counts): maps from label to number, of an overview (workspace_id, kind, label, n)."""
    own = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("label", "n"))))
    return overview.groupBy("workspace_id").agg(own("node").alias("node_counts"), own("edge").alias("edge_counts"))  # as many as there are labels


def summary(
    repos: DataFrame, scans: DataFrame, calls: DataFrame, questions: DataFrame, skills: DataFrame, telemetry: DataFrame, overview: DataFrame | None = None, extractions: DataFrame | None = None
) -> DataFrame:
    """One row per tenant: all single-row reports joined; with an ``overview`` also the graph's counts per label, with
    ``extractions`` the number of files, and spending over all purposes where calls have a cost."""
    out = repo_summary(repos)
    parts = [last_scan_at(scans), cached_pct(calls), question_counts(questions), skill_count(skills), latency_stats(telemetry)]
    if overview is not None:
        parts.append(graph_counts(overview))
    if extractions is not None:
        parts.append(extractions.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("files")))
    if "cost_usd" in calls.columns:
        total = spend_by_purpose(calls).where("purpose = 'total'")
        parts.append(total.select("workspace_id", F.col("calls").alias("llm_calls"), F.col("cost_usd").alias("llm_cost_usd"), F.col("hit_pct").alias("llm_hit_pct")))
    for part in parts:
        out = out.join(part, "workspace_id", "left")
    return out


def list_scans(scans: DataFrame, ws: str, repo: str | None = None, limit: int = 20) -> DataFrame:
    s = scans.where(F.col("workspace_id") == ws)
    s = s if repo is None else s.where(F.col("repo_id") == repo)
    return s.orderBy(F.desc("started_at"), "id").limit(min(200, max(1, limit)))


def scan_detail(scans: DataFrame) -> DataFrame:
    """Adds duration_ms, null while running and never below zero."""
    ms = F.expr("timestampdiff(MILLISECOND, started_at, completed_at)")
    return scans.withColumn("duration_ms", F.when(F.col("completed_at").isNotNull(), F.greatest(F.lit(0).cast("long"), ms)))


def _last_days(rows: DataFrame, now: Column, days: int) -> DataFrame:
    since = F.date_trunc("day", now) - F.make_interval(days=F.lit(days - 1))
    return rows.where((F.col("created_at") >= since) & (F.col("created_at") <= now)).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))


def daily_spend(calls: DataFrame, now: Column, days: int = 30) -> DataFrame:
    rows = _last_days(calls, now, min(90, max(1, days)))
    return rows.groupBy("workspace_id", "day").agg(F.sum("cost_usd").cast("decimal(14,6)").alias("cost_usd"), F.count(F.lit(1)).alias("calls"), F.count_if("cache_hit").alias("cached")).orderBy("day")


def daily_activity(telemetry: DataFrame, now: Column, days: int = 7) -> DataFrame:
    rows = _last_days(telemetry, now, min(90, max(1, days)))
    return rows.groupBy("workspace_id", "day").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status_code") >= 400).alias("errors"), _quantile(0.95).alias("p95")).orderBy("day")


def job_status(jobs: DataFrame, now: Column) -> DataFrame:
    """Counts of running, queued and scheduled jobs, and of those that failed or succeeded in the last hour."""
    hour = F.col("ended_at") >= now - F.make_interval(hours=F.lit(1))
    is_ = lambda s: F.col("state") == s
    return jobs.agg(
        F.count_if(is_("running")).alias("running"), F.count_if(is_("queued")).alias("queued"), F.count_if(is_("scheduled")).alias("scheduled"),
        F.count_if(is_("failed") & hour).alias("failed_hour"), F.count_if(is_("succeeded") & hour).alias("succeeded_hour"),
    )


def list_repos(repos: DataFrame, by: str = "created") -> DataFrame:
    return repos.orderBy("workspace_id", F.desc("created_at"), "repo_id") if by == "created" else repos.orderBy("workspace_id", "url")


def activity_feed(scans: DataFrame, questions: DataFrame, limit: int = 15, ws: str | None = None) -> DataFrame:
    """(kind, ref, at): newest events of started scans, ended scans and questions."""
    s = scans if ws is None else scans.where(F.col("workspace_id") == ws)
    q = questions if ws is None else questions.where(F.col("workspace_id") == ws)
    row = lambda df, kind, at: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("ref"), F.col(at).alias("at")).where("at is not null")
    ended = s.where(F.col("status").isin("succeeded", "failed"))
    out = row(s, "scan-started", "started_at").union(row(ended, "scan-ended", "completed_at")).union(row(q, "question", "created_at"))
    return out.orderBy(F.desc("at"), "kind", "ref").limit(limit)


def member_workspaces(workspaces: DataFrame, members: DataFrame, user: object | None = None) -> DataFrame:
    m = members if user is None else members.where(F.col("user_id") == user)
    return workspaces.join(m, "workspace_id").select("user_id", "workspace_id", "slug")


def resolve_workspace(workspaces: DataFrame, members: DataFrame, slug: str, user: object) -> DataFrame:
    """The tenant of a slug, only for its members."""
    return member_workspaces(workspaces, members, user).where(F.col("slug") == slug)


def graph_totals(overview: DataFrame) -> DataFrame:
    n = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}s")
    return overview.groupBy("workspace_id").agg(n("node"), n("edge"))


def top_labels(overview: DataFrame, top: int = 5, ws: str | None = None) -> DataFrame:
    rows = overview.where(F.col("kind") == "node")
    rows = rows if ws is None else rows.where(F.col("workspace_id") == ws)
    return rows.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(top)


def list_api_keys(keys: DataFrame, ws: str | None = None) -> DataFrame:
    """Newest first, without the hash."""
    k = keys if ws is None else keys.where(F.col("workspace_id") == ws)
    return k.drop("key_hash").orderBy(F.desc("created_at"), "id")
