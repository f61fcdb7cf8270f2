"""Open questions: candidates, ranking, deduplication, expiry and listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.functions.exprs import blank, fingerprint, normalised_name
from cartolake.operators.graph_read import prop
from cartolake.operators.matching import containing, text_id

#: Answers of questions that a sweep dismisses.
STALE_ANSWER = "[auto-dismissed] stale > 90d"
ORPHANED_ANSWER = "[auto-dismissed] referenced nodes no longer exist"
#: Answers offered for an endpoint that nothing calls.
ENDPOINT_CHOICES = ["Remove it", "Keep it", "Add a caller"]


def with_fingerprint(candidates: DataFrame, empty_marker: str = "") -> DataFrame:
    """Adds the fingerprint over tenant, topic, question and related files."""
    return candidates.withColumn("fingerprint", fingerprint(F.col("workspace_id"), F.col("topic"), F.col("question"), F.col("related_file_paths"), empty_marker))


def normalise_severity(severity: Column) -> Column:
    s = F.lower(F.trim(severity))
    return F.when(s.isin("low", "medium", "high"), s).otherwise("medium")


def name_hits(names: DataFrame, nodes: DataFrame, key: list[str], column: str = "related_node_names") -> DataFrame:
    """(key, name, hits): how many nodes of the tenant have each related name within their own, ignoring case.

    Distinct names meet distinct node names by places of their rarest grams, so no two are compared that do not share them.
    """
    wanted = names.select("workspace_id", F.explode(column).alias("name")).where(~blank(F.col("name"))).distinct()
    known = nodes.where("id is not null").groupBy("workspace_id", F.lower("name").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    found = containing(wanted.select("workspace_id", F.lower("name").alias("needle")), known.select("workspace_id", F.col("n").alias("text")))
    sums = found.join(known.withColumn("text_id", text_id(F.col("n"))), ["workspace_id", "text_id"]).groupBy("workspace_id", "needle").agg(F.sum("c").alias("hits"))
    hits = wanted.withColumn("needle", F.lower("name")).join(sums, ["workspace_id", "needle"]).drop("needle")
    return names.select("workspace_id", *key, F.explode(column).alias("name")).distinct().join(hits, ["workspace_id", "name"], "left").fillna(0, ["hits"])


def related_degree(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds degree: over related names, the nodes that each finds, 25 at most."""
    d = name_hits(candidates, nodes, ["id"]).groupBy("workspace_id", "id").agg(F.sum(F.least(F.col("hits"), F.lit(25))).alias("degree"))
    return candidates.join(d, ["workspace_id", "id"], "left").fillna(0, ["degree"])


def blocks_others(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds blocks: another open question has the tenant and topic but not the fingerprint."""
    key = ["workspace_id", "topic"]
    opened = questions.where("status = 'Open'").groupBy(*key).agg(F.min("fingerprint").alias("lo"), F.max("fingerprint").alias("hi"))
    out = candidates.join(opened, key, "left")
    other = (F.col("lo") != F.col("fingerprint")) | (F.col("hi") != F.col("fingerprint"))
    return out.withColumn("blocks", F.coalesce(other, F.lit(False))).drop("lo", "hi")


def priority(severity: Column, files: Column, degree: Column, blocks: Column, source: Column) -> Column:
    """0 to 100 from severity, number of files, degree, whether it blocks others, and its source."""
    s = normalise_severity(severity)
    points = F.when(s == "high", 20).when(s == "medium", 10).otherwise(-10)
    score = F.lit(50) + points + F.least(files, F.lit(20)) + F.least(F.floor(degree / 2), F.lit(15)) + F.when(blocks, 5).otherwise(0) + F.when(source == "CrossFileCorrelation", 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def insert_new(table: DataFrame, candidates: DataFrame, order: str = "created_at") -> DataFrame:
    """Candidates with a fingerprint that the tenant does not have yet, whatever its status; the first of equal ones."""
    key = ["workspace_id", "fingerprint"]
    good = candidates.where(~blank(F.col("fingerprint")))
    w = Window.partitionBy(*key).orderBy(order, "id")
    first = good.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return first.join(table.select(key), key, "left_anti")


def expire_stale(questions: DataFrame, now: Column, days: int = 90) -> DataFrame:
    old = (F.col("status") == "Open") & (F.col("created_at") < now - F.make_interval(days=F.lit(days)))
    return questions.withColumns({"status": F.when(old, "Dismissed").otherwise(F.col("status")), "answer": F.when(old, STALE_ANSWER).otherwise(F.col("answer"))})


def orphaned(questions: DataFrame, nodes: DataFrame, most: int = 200) -> DataFrame:
    """(workspace_id, id) of those of the oldest ``most`` open questions per tenant that have names, none of which a node has."""
    w = Window.partitionBy("workspace_id").orderBy("created_at", "id")
    opened = questions.where("status = 'Open'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).where(F.size("related_node_names") > 0)
    return name_hits(opened, nodes, ["id"]).groupBy("workspace_id", "id").agg(F.sum("hits").alias("h")).where("h = 0").select("workspace_id", "id")


def dismiss_orphaned(questions: DataFrame, nodes: DataFrame, most: int = 200) -> DataFrame:
    """``questions`` with the orphaned ones dismissed and answered so."""
    gone = orphaned(questions, nodes, most).withColumn("__gone", F.lit(True))
    out = questions.join(gone, ["workspace_id", "id"], "left")
    take = F.coalesce("__gone", F.lit(False))
    out = out.withColumns({"status": F.when(take, "Dismissed").otherwise(F.col("status")), "answer": F.when(take, ORPHANED_ANSWER).otherwise(F.col("answer"))})
    return out.select(*questions.columns)


def evidence_list(names: Column, files: Column | None = None) -> Column:
    """Markdown lines of names in backquotes; after each, its first three files."""
    tick = lambda v: F.concat(F.lit("`"), v, F.lit("`"))
    if files is None:
        return F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), tick(n), F.lit("\n"))), "")

    def line(n: Column) -> Column:
        own = F.element_at(files, n)
        listed = F.concat(F.lit(" — "), F.array_join(F.transform(F.slice(own, 1, 3), tick), ", "), F.when(F.size(own) > 3, ", …").otherwise(""))
        return F.concat(F.lit("- "), tick(n), F.when(F.coalesce(F.size(own), F.lit(0)) > 0, listed).otherwise(""), F.lit("\n"))

    return F.array_join(F.transform(names, line), "")


def duplicate_services(nodes: DataFrame) -> DataFrame:
    """(workspace_id, key, names, files, evidence): services whose names agree in letters and digits but differ."""
    s = nodes.where((F.col("label") == "Service") & ~blank(F.col("name")))
    files = F.split(F.coalesce(prop("source_files"), F.lit("")), ",")
    out = s.groupBy("workspace_id", normalised_name(F.col("name")).alias("key")).agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(files, lambda f: f != ""))))).alias("files")
    )
    out = out.where((F.size("names") >= 2) & (F.col("key") != ""))
    head = F.concat(F.lit("**Normalized name:** `"), "key", F.lit("`\n\n**Candidate originals:**\n\n"))
    return out.withColumn("evidence", F.concat(head, evidence_list(F.col("names"))))


def dangling_endpoints(nodes: DataFrame, edges: DataFrame, looked_at: int = 50, emitted: int = 20) -> DataFrame:
    """(workspace_id, id, method, path, evidence, choices): of a tenant's first ``looked_at`` endpoints by path and method,
    those that nothing calls and no service owns, ``emitted`` at most."""
    w = Window.partitionBy("workspace_id").orderBy("path", "method", "id")
    e = nodes.where("label = 'Endpoint'").select("workspace_id", "id", prop("method").alias("method"), prop("path").alias("path"))
    e = e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= looked_at)
    services = nodes.where("label = 'Service'").select("workspace_id", F.col("id").alias("source_id"))
    called = edges.where("label = 'CALLS'").select("workspace_id", F.col("target_id").alias("id"))
    owned = edges.join(services, ["workspace_id", "source_id"], "left_semi").select("workspace_id", F.col("target_id").alias("id"))
    e = e.join(called.union(owned).distinct(), ["workspace_id", "id"], "left_anti").withColumn("r", F.row_number().over(w)).where(F.col("r") <= emitted).drop("r")
    text = F.concat(F.lit("**Method:** `"), "method", F.lit("`  \n**Path:** `"), "path", F.lit("`  \n\nNo incoming CALLS edges were found in the graph, and no Service node EXPOSES this endpoint."))
    return e.withColumns({"evidence": text, "choices": F.array(*map(F.lit, ENDPOINT_CHOICES))})


def cap_submissions(candidates: DataFrame, cap: int = 50) -> DataFrame:
    """A tenant's first ``cap`` + 1 candidates by priority and id: a run stops once it is over the cap."""
    w = Window.partitionBy("workspace_id").orderBy(F.desc("priority"), "id")
    return candidates.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap + 1).drop("__r")


def conflict_questions(conflicts: DataFrame, services: DataFrame) -> DataFrame:
    """(workspace_id, repo_id, id, topic, question, choices, related_node_names, related_file_paths, evidence).

    ``services``: workspace_id, repo_id, service, files. Question and topic are cut at 2000 and 200 characters.
    """
    key = ["workspace_id", "repo_id"]
    c = conflicts.withColumn("involved", F.array_distinct("involved"))
    rows = c.select(*key, "id", F.explode_outer("involved").alias("service")).join(services, [*key, "service"], "left")
    files = rows.groupBy(*key, "id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("related_file_paths"),
        F.map_from_entries(F.collect_list(F.when(F.col("files").isNotNull(), F.struct("service", "files")))).alias("by_service"),
    )
    text = F.when(~blank(F.col("description")), F.col("description")).otherwise(F.concat(F.lit("Files disagree on "), "kind", F.lit(". Which is correct?")))
    evidence = F.concat(F.lit("**Conflict kind:** `"), "kind", F.lit("`\n\n"), F.when(~blank(F.col("description")), F.concat("description", F.lit("\n\n"))).otherwise(""),
                        F.when(F.size("involved") > 0, F.lit("**Involved services / asserted by:**\n\n")).otherwise(""), evidence_list(F.col("involved"), F.col("by_service")))
    return c.join(files, [*key, "id"]).select(
        *key, "id", F.substring("kind", 1, 200).alias("topic"), F.substring(text, 1, 2000).alias("question"), F.slice("involved", 1, 5).alias("choices"),
        F.col("involved").alias("related_node_names"), "related_file_paths", evidence.alias("evidence"),
    )


def ground_generated(questions: DataFrame) -> DataFrame:
    """Keeps related files and nodes that the evidence has (all of it if none is left), and five choices at most."""

    def known(mine: str, evidence: str) -> Column:
        both = F.array_intersect(mine, evidence)
        return F.when(F.size(both) > 0, both).otherwise(F.col(evidence))

    return questions.withColumns({"related_file_paths": known("related_file_paths", "evidence_files"), "related_node_names": known("related_node_names", "evidence_nodes"), "choices": F.slice("choices", 1, 5)})


def list_questions(questions: DataFrame, ws: str, status: str = "open", limit: int = 50) -> DataFrame:
    """By priority and newest first; status open, answered, dismissed or all; the limit is held in 1..200."""
    q = questions.where(F.col("workspace_id") == ws)
    q = q if status == "all" else q.where(F.lower("status") == status.lower())
    return q.orderBy(F.desc("priority"), F.desc("created_at"), "id").limit(min(200, max(1, limit)))


def questions_by_node(questions: DataFrame, ws: str, name: str, limit: int = 50) -> DataFrame:
    q = questions.where((F.col("workspace_id") == ws) & F.col("status").isin("Open", "Answered") & F.array_contains("related_node_names", name))
    return q.orderBy(F.desc("priority"), "id").limit(limit)


def answered_for_files(questions: DataFrame, files: DataFrame, most: int = 25) -> DataFrame:
    """(workspace_id, path, id, question, answer, r): answered questions about each file or its node names, newest first.

    ``files``: workspace_id, path, names. The two ways to meet are two equi-joins on exploded values.
    """
    q = questions.where((F.col("status") == "Answered") & ~blank(F.col("answer"))).select("workspace_id", "id", "question", "answer", "answered_at", "related_file_paths", "related_node_names")
    slim = lambda column, name: q.select("workspace_id", "id", F.explode(column).alias(name))
    by_file = files.select("workspace_id", "path").join(slim("related_file_paths", "path"), ["workspace_id", "path"])
    by_name = files.select("workspace_id", "path", F.explode("names").alias("n")).join(slim("related_node_names", "n"), ["workspace_id", "n"]).select("workspace_id", "path", "id")
    w = Window.partitionBy("workspace_id", "path").orderBy(F.desc_nulls_last("answered_at"), "id")
    rows = by_file.union(by_name).distinct().join(q.drop("related_file_paths", "related_node_names"), ["workspace_id", "id"])
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("workspace_id", "path", "id", "question", "answer", "r")


def _close(questions: DataFrame, given: DataFrame, status: str, text: Column, ok: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    g = given.select("id", F.col("text").alias("__t"))
    both = questions.join(g, "id", "left")
    take = (F.col("status") == "Open") & F.col("__t").isNotNull() & ok
    done = both.withColumns({"answer": F.when(take, text).otherwise(F.col("answer")), "answered_at": F.when(take, now).otherwise(F.col("answered_at")), "status": F.when(take, status).otherwise(F.col("status"))})
    accepted = questions.where("status = 'Open'").select("id")
    rejected = given.where(blank(F.col("text"))) if status == "Answered" else given.limit(0)
    return done.drop("__t"), given.join(accepted, "id", "left_anti").union(rejected).distinct()


def answer(questions: DataFrame, answers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(questions, rejected answers): ``answers`` (id, text) close open questions; blank ones and others are rejected."""
    return _close(questions, answers, "Answered", F.trim("__t"), ~blank(F.col("__t")), now)


def dismiss(questions: DataFrame, reasons: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(questions, rejected reasons): the reason becomes the answer, marked as dismissed."""
    return _close(questions, reasons, "Dismissed", F.concat(F.lit("[dismissed] "), F.trim("__t")), F.lit(True), now)


def get_question(questions: DataFrame, ws: str, id_: object) -> DataFrame:
    return questions.where((F.col("workspace_id") == ws) & (F.col("id") == id_))


def project_generated(raw: DataFrame) -> DataFrame:
    """Rows of generated lists: blank topics or questions go, texts are trimmed, severity has a default."""
    rows = raw.select("workspace_id", F.inline("questions")).where(~blank(F.col("topic")) & ~blank(F.col("question")))
    return rows.withColumns({"topic": F.trim("topic"), "question": F.trim("question"), "severity": normalise_severity(F.col("severity"))})


def sweep(questions: DataFrame, nodes: DataFrame, edges: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The periodic sweep's steps, one on the other: stale questions expire, orphaned ones are dismissed, and duplicate services
    and dangling endpoints become new questions where the tenant does not have them yet.

    ``questions``: the table after the sweep without the new ones; ``candidates``: rows to insert.
    """
    settled = dismiss_orphaned(expire_stale(questions, now), nodes)
    none = F.array().cast("array<string>")
    twins = duplicate_services(nodes).select(
        "workspace_id", F.concat(F.lit("duplicate_service:"), "key").alias("topic"), F.lit("Are these the same service?").alias("question"),
        F.col("names").alias("related_node_names"), F.col("files").alias("related_file_paths"), "evidence", F.col("names").alias("choices"), F.lit("medium").alias("severity"),
    )
    name = F.concat_ws(" ", "method", "path")
    bare = dangling_endpoints(nodes, edges).select(
        "workspace_id", F.concat(F.lit("dangling_endpoint:"), name).alias("topic"), F.concat(F.lit("Endpoint "), name, F.lit(" has no callers and no owner. Should it be removed?")).alias("question"),
        F.array(name).alias("related_node_names"), none.alias("related_file_paths"), "evidence", "choices", F.lit("low").alias("severity"),
    )
    found = with_fingerprint(twins.unionByName(bare)).withColumns({"id": F.col("fingerprint"), "created_at": now})
    return {"questions": settled, "candidates": insert_new(settled, found)}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
