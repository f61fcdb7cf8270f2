"""Skills, and the assembly of context for a task within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.functions.exprs import distinct_ci, significant_tokens
from cartolake.operators.matching import containing, text_id
from cartolake.sources.scratch import stored

WORD_SEPARATORS = r"""[ \t\n\r.,;:!?()\[\]{}"'/\\\-_]+"""


def _words(text: Column) -> Column:
    """Distinct lower-case words of four characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SEPARATORS), lambda w: F.length(w) >= 4))


def match_skills(skills: DataFrame, queries: DataFrame, top: int = 3) -> DataFrame:
    """(workspace_id, query_id, name, score, r): the best skills of each query.

    Three points for each trigger within the query, one for each word of the title, half for each of the description.
    ``skills``: workspace_id, name, title, description, triggers, enabled; ``queries``: workspace_id, query_id, query.
    Skills with the same name and tenant are one. Those with the same weighted words and triggers are a class: they score alike, so a
    class is scored once, for each distinct query of its tenant that contains one of its needles (by places of their rarest grams), and
    gives its first ``top`` names. Ranks are those of distinct queries, too.
    """
    top = max(1, top)
    weigh = lambda c, n: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda w: F.struct(w.alias("needle"), F.lit(n).alias("weight")))
    triggers = F.filter(F.transform("triggers", lambda t: F.lower(F.trim(t))), lambda t: t != "")
    parts = F.concat(weigh(triggers, 3.0), weigh(_words(F.col("title")), 1.0), weigh(_words(F.col("description")), 0.5))
    s = skills.where("enabled").select("workspace_id", "name", F.explode(parts).alias("p")).select("workspace_id", "name", "p.*")
    s = s.groupBy("workspace_id", "name", "needle").agg(F.sum("weight").alias("weight"))
    s = s.groupBy("workspace_id", "name").agg(F.array_sort(F.collect_list(F.struct("needle", "weight"))).alias("needles"))
    own = Window.partitionBy("workspace_id", "needles").orderBy("name")
    first = s.withColumn("__r", F.row_number().over(own)).where(F.col("__r") <= top).withColumn("class", F.sha2(F.to_json("needles"), 256))
    first = stored(first.select("workspace_id", "class", "name", F.when(F.col("__r") == 1, F.col("needles")).alias("needles")), "classes")
    needles = first.where("needles is not null").select("workspace_id", "class", F.inline("needles"))
    q = queries.where(F.trim("query") != "").select("workspace_id", "query_id", F.lower("query").alias("text"))
    found = containing(needles, q)
    both = needles.join(found, ["workspace_id", "needle"]).groupBy("workspace_id", "class", "text_id").agg(F.sum("weight").alias("score"))
    w = Window.partitionBy("workspace_id", "text_id").orderBy(F.desc("score"), "name")
    best = both.join(first.drop("needles"), ["workspace_id", "class"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    hits = q.select("workspace_id", "query_id", text_id(F.col("text")).alias("text_id")).join(best, ["workspace_id", "text_id"])
    return hits.select("workspace_id", "query_id", "name", "score", "r")


def task_tokens(tasks: DataFrame) -> DataFrame:
    """(workspace_id, query_id, tokens)."""
    return tasks.select("workspace_id", "query_id", significant_tokens(F.col("query")).alias("tokens"))


def _size(items: str) -> Column:
    return F.coalesce(F.size(items), F.lit(0))


def file_summary(rec: str = "rec") -> Column:
    """Sentences on what a file's facts hold."""
    s = f"{rec}.service"
    part = F.when(
        F.col(f"{s}.isPartOfService"),
        F.concat(F.lit("Part of service '"), f"{s}.serviceName", F.lit("'"), F.coalesce(F.concat(F.lit(": "), F.nullif(F.trim(f"{s}.servicePurpose"), F.lit(""))), F.lit("."))),
    )
    line = lambda items, verb, what: F.when(_size(items) > 0, F.concat(F.lit(f"{verb} "), F.size(items).cast("string"), F.lit(f" {what}(s).")))
    out = F.concat_ws(
        " ", part, line(f"{rec}.endpoints.endpoints", "Defines", "HTTP endpoint"), line(f"{rec}.eventsPublished.publishes", "Publishes", "event"),
        line(f"{rec}.eventsConsumed.consumes", "Consumes", "event"), line(f"{rec}.storage.storages", "Touches", "storage backend"), line(f"{rec}.conventions.conventions", "Declares", "convention"),
    )
    return F.when(out == "", "(no extractions on file)").otherwise(out)


def component_list(rec: str = "rec") -> Column:
    """array<struct<kind, a, b, c>> of all components: method, path, handler; name, version, topic; name, type, access; category, name, description."""
    t = "array<struct<kind:string,a:string,b:string,c:string>>"

    def each(items: str, kind: str, *fields: str) -> Column:
        made = F.transform(items, lambda e: F.struct(F.lit(kind).alias("kind"), *[e[f].alias(x) for f, x in zip(fields, "abc", strict=True)]))
        return F.coalesce(made.cast(t), F.array().cast(t))

    return F.concat(
        each(f"{rec}.endpoints.endpoints", "endpoint", "method", "path", "handlerSymbol"), each(f"{rec}.eventsPublished.publishes", "event_publish", "name", "version", "topic"),
        each(f"{rec}.eventsConsumed.consumes", "event_consume", "name", "version", "topic"), each(f"{rec}.storage.storages", "storage", "name", "type", "access"),
        each(f"{rec}.conventions.conventions", "convention", "category", "name", "description"),
    )


def extraction_hit(parsed: DataFrame) -> DataFrame:
    """(workspace_id, file_path, endpoints, published, consumed)."""
    event = lambda e: F.struct(e["name"].alias("name"), e["topic"].alias("topic"))
    return parsed.select(
        "workspace_id", "file_path", F.transform("rec.endpoints.endpoints", lambda e: F.struct(e["method"].alias("method"), e["path"].alias("path"), e["handlerSymbol"].alias("handler"))).alias("endpoints"),
        F.transform("rec.eventsPublished.publishes", event).alias("published"), F.transform("rec.eventsConsumed.consumes", event).alias("consumed"),
    )


def _lengths(items: Column) -> Column:
    return F.aggregate(F.coalesce(items, F.array().cast("array<int>")), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def skill_chars() -> Column:
    return sum((F.length(F.coalesce(c, F.lit(""))) for c in ("name", "title", "body")), F.lit(0))


def graph_chars() -> Column:
    return sum((F.length(F.coalesce(c, F.lit(""))) for c in ("label", "name", "description")), F.lit(0))


def file_chars(path: Column, summary: Column, components: Column) -> Column:
    """80 for each component, as an estimate."""
    return F.length(path) + F.length(summary) + 80 * F.coalesce(F.size(components), F.lit(0))


def hit_chars() -> Column:
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return F.length("file_path") + _lengths(F.transform("endpoints", lambda e: n(e["method"]) + n(e["path"]) + n(e["handler"]))) + _lengths(F.transform("published", lambda e: n(e["name"]) + n(e["topic"]))) + _lengths(F.transform("consumed", lambda e: n(e["name"]) + n(e["topic"])))


def relevant_context(parts: dict[str, DataFrame]) -> DataFrame:
    """Items of the four buckets skill, graph, file and extraction as one frame (query_id, bucket, pos, item, chars)."""
    frames = [df.select("query_id", F.lit(b).alias("bucket"), "pos", "item", "chars") for b, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fit_budget(items: DataFrame, max_tokens: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(items kept, (query_id, estimate, truncated)) for items (query_id, bucket, pos, item, chars).

    The limit is held in 256..32000. Over it, graph items go first, then extraction hits, then files from the tail; skills
    always stay. An estimate is a quarter of the characters, rounded up.
    """
    limit = min(32000, max(256, max_tokens))
    total = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("chars"))), F.lit(0)).alias(f"{b}_chars")
    has = lambda b: F.count_if(F.col("bucket") == b).alias(f"n_{b}")
    sums = items.groupBy("query_id").agg(*map(total, ("skill", "graph", "file", "extraction")), has("extraction"), has("file"))
    over = lambda *c: F.ceil(sum((F.col(f"{x}_chars") for x in c), F.lit(0)) / 4.0) > limit
    sums = sums.withColumn("drop_graph", over("skill", "graph", "file", "extraction"))
    sums = sums.withColumn("drop_hits", F.col("drop_graph") & over("skill", "file", "extraction") & (F.col("n_extraction") > 0))
    sums = sums.withColumn("trim", F.col("drop_hits") & over("skill", "file") & (F.col("n_file") > 0) | F.col("drop_graph") & (F.col("n_extraction") == 0) & over("skill", "file") & (F.col("n_file") > 0))
    w = Window.partitionBy("query_id", "bucket").orderBy("pos", "item").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("run", F.sum("chars").over(w)).join(sums, "query_id")
    keep = (
        (F.col("bucket") == "skill") | (F.col("bucket") == "graph") & ~F.col("drop_graph") | (F.col("bucket") == "extraction") & ~F.col("drop_hits")
        | (F.col("bucket") == "file") & (~F.col("trim") | (F.ceil((F.col("skill_chars") + F.col("run")) / 4.0) <= limit))
    )
    kept = rows.where(keep).select(*items.columns)
    left = kept.groupBy("query_id").agg(F.ceil(F.sum("chars") / 4.0).cast("long").alias("estimate"))
    verdict = sums.join(left, "query_id", "left").select("query_id", F.coalesce("estimate", F.lit(0)).cast("long").alias("estimate"), F.col("drop_graph").alias("truncated"))
    return kept, verdict


def enabled_skills(skills: DataFrame) -> DataFrame:
    """(workspace_id, name, description) of enabled skills; the title stands in for a blank description."""
    return skills.where("enabled").select("workspace_id", "name", F.coalesce(F.nullif(F.trim("description"), F.lit("")), "title").alias("description")).orderBy("workspace_id", "name")


def get_skill(skills: DataFrame, ws: str, name: str) -> DataFrame:
    return skills.where((F.col("workspace_id") == ws) & (F.col("name") == name) & F.col("enabled"))


def list_skills(skills: DataFrame) -> DataFrame:
    return skills.drop("body").orderBy("workspace_id", "name")


def next_revision(revisions: DataFrame, edits: DataFrame) -> DataFrame:
    """Revision rows of ``edits`` (skill_id, edited_at, title, body, change_note): versions go on from the largest one, and
    null fields keep the value before them."""
    last = revisions.groupBy("skill_id").agg(F.max("version").alias("v"), F.max_by("title", "version").alias("t"), F.max_by("body", "version").alias("b"))
    w = Window.partitionBy("skill_id").orderBy("edited_at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = edits.join(last, "skill_id", "left").withColumn("version", F.coalesce("v", F.lit(0)) + F.row_number().over(w))
    carry = lambda own, old: F.coalesce(F.last(own, True).over(so_far), old)
    return rows.select("skill_id", "version", carry("title", "t").alias("title"), carry("body", "b").alias("body"), "change_note")


def list_revisions(revisions: DataFrame) -> DataFrame:
    return revisions.orderBy("skill_id", F.desc("version"))


def get_revision(revisions: DataFrame, skill_id: object, version: int) -> DataFrame:
    return revisions.where((F.col("skill_id") == skill_id) & (F.col("version") == version))


def normalise_triggers(triggers: Column) -> Column:
    """Trimmed, not blank, at most 200 characters, first-seen ignoring case."""
    return distinct_ci(F.transform(F.filter(F.transform(triggers, lambda t: F.trim(t)), lambda t: t != ""), lambda t: F.substring(t, 1, 200)))
