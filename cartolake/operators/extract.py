"""Per-file extraction as joins: requests, result cache, assembled records. The model call itself is the caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prompts that every file gets, and US dollars per million tokens in and out.
PROMPTS = ["service", "endpoints", "events_published", "events_consumed", "storage", "conventions", "integration_contracts"]
BATCH_BYTES = 8 << 20  # of prompts on their way to a worker
PRICES = {"small": (Decimal("0.80"), Decimal("4.00")), "large": (Decimal("3.00"), Decimal("15.00"))}


def prompts(spark: SparkSession) -> DataFrame:
    """(prompt_id, version, template): one row per prompt."""
    rows = [(p, "v1", f"Find {p} in {{file_path}}:\n{{file_content}}") for p in PROMPTS]
    return spark.createDataFrame(rows, "prompt_id string, version string, template string").coalesce(1)


def fan_out_prompts(files: DataFrame, prompt_table: DataFrame) -> DataFrame:
    """One request per file and prompt; the prompts are a fixed short list, so they are broadcast."""
    return files.crossJoin(F.broadcast(prompt_table))


def render_prompt(requests: DataFrame, structure: Column | None = None, truth: Column | None = None) -> DataFrame:
    """Template with path and content put in, then the structural and the ground-truth block if there are any."""
    body = F.replace(F.replace(F.col("template"), F.lit("{file_path}"), F.col("path")), F.lit("{file_content}"), F.col("text"))
    extra = [F.nullif(c, F.lit("")) for c in (structure, truth) if c is not None]
    return requests.withColumn("prompt", F.concat_ws("\n\n", body, *extra))


def cache_key(content: Column, prompt_id: Column, version: Column, model: Column, structure_hash: Column | None = None, truth_hash: Column | None = None) -> Column:
    """SHA-256 over content, prompt, version (with hashes of added blocks) and model. The blocks' tags are fixed values."""
    tag = lambda name, c: [] if c is None else [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"+{name}:"), F.substring(c, 1, 12))).otherwise("")]
    full = F.concat(version, *tag("gfy", structure_hash), *tag("clf", truth_hash))
    return F.sha2(F.concat_ws("|", content, prompt_id, full, model), 256)


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("content_hash", "result"), "content_hash")


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, "content_hash", "left_anti")


def bump_hit_count(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds the number of hits of each key."""
    n = hits.groupBy("content_hash").agg(F.count(F.lit(1)).alias("__n"))
    return cache.join(n, "content_hash", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("__n", F.lit(0))).drop("__n")


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace model, prompt_version and result; workspace, hit_count and created_at of old rows stay."""
    old, own = cache.alias("o"), new.alias("n")
    either = lambda a, b, c: F.coalesce(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c)
    return old.join(own, "content_hash", "full_outer").select(
        "content_hash", either("o", "n", "workspace_id"), *[either("n", "o", c) for c in ("model", "prompt_version", "result")],
        F.coalesce("o.hit_count", "n.hit_count", F.lit(0)).alias("hit_count"), either("o", "n", "created_at"),
    )


def ground_truth_block(answers: DataFrame) -> DataFrame:
    """(workspace_id, file_path, block, hash12): a list of answered questions, newest first."""
    rows = F.sort_array(F.collect_list(F.struct("answered_at", "id", "question", "answer")), asc=False)
    lines = F.transform(rows, lambda r: F.concat(F.lit("- Q: "), r["question"], F.lit("\n  A: "), r["answer"]))
    text = F.concat(F.lit("Known answers:\n"), F.array_join(lines, "\n"))
    return answers.groupBy("workspace_id", "file_path").agg(text.alias("block")).withColumn("hash12", F.substring(F.sha2("block", 256), 1, 12))


def structural_block(context_nodes: DataFrame, context_edges: DataFrame, top: int = 40) -> DataFrame:
    """(path, block, hash12): entities of a file and its first ``top`` outgoing edges, by text order."""
    names = context_nodes.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", F.lit("-"), "label", "name"))), "\n").alias("n"))
    w = Window.partitionBy("path").orderBy("line")
    lines = context_edges.withColumn("line", F.concat_ws(" ", F.lit("-"), "source_name", "label", "target_name")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    edges = lines.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("e"))
    out = names.join(edges, "path", "left").withColumn("block", F.concat_ws("\n", F.lit("Entities:"), "n", F.when(F.col("e").isNotNull(), "Edges:"), "e"))
    return out.select("path", "block", F.substring(F.sha2("block", 256), 1, 12).alias("hash12"))


def assemble_record(results: DataFrame) -> DataFrame:
    """(workspace_id, repo_id, path, one column per prompt): a section without result stays null."""
    return results.groupBy("workspace_id", "repo_id", "path").pivot("prompt_id", PROMPTS).agg(F.max("result"))


def extract_with(requests: DataFrame, answer: Callable[[pd.Series], pd.Series], most: int = 256) -> DataFrame:
    """Answers requests with the caller's function over up to ``most`` prompts at once. Only prompts go to the workers, and only answers
    come back; the other columns, and prompts that nobody reads on, stay where they are."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            parts = [answer(prompts.iloc[i : i + most].reset_index(drop=True)) for i in range(0, len(prompts), most)]
            yield pd.concat(parts, ignore_index=True) if parts else prompts

    requests.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return requests.withColumn("result", run.asNondeterministic()(F.col("prompt")))  # nobody is asked twice


_ATTRIBUTE = r"\[Http(Get|Post|Put|Delete|Patch)(?:\(\s*\"([^\"]*)\"[^)]*\))?\]"
_CALL = r"\b(?:app|router|r|e|group)\.(get|post|put|delete|patch|GET|POST|PUT|DELETE|PATCH)\(\s*[\"'`]([^\"'`]+)[\"'`]"
_MINIMAL = r"\.Map(Get|Post|Put|Delete|Patch)\(\s*\"([^\"]+)\""
_DECORATOR = r"@\w+\.(?:route\(\s*[\"']([^\"']+)[\"'](?:[^)]*methods\s*=\s*\[([^\]]*)\])?)"
_SPRING = r"@(Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:value\s*=\s*)?\"([^\"]*)\"[^)]*\))?"
_PREFIX = r"(?:\[Route\(\s*\"([^\"]+)\"\s*\)\]|@RequestMapping\(\s*(?:value\s*=\s*)?\"([^\"]+)\")"


#: What every form above has.
_ANY_FORM = r"\[Http[GPD]|\.Map[GPD]|@\w+\.route\(|Mapping|\.(?:get|post|put|delete|patch|GET|POST|PUT|DELETE|PATCH)\("


def extract_routes(files: DataFrame) -> DataFrame:
    """(path, method, route): endpoints that a file declares in the forms of common web frameworks.

    Verbs are upper-case, one row per verb; a class-level route comes before its methods' routes. ``files`` has one row per
    path. A quick test spares files without any form; each form is looked for once, and its parts are read from what it found.
    """
    text = F.col("text")
    files = files.where(text.rlike(_ANY_FORM))
    declared = F.regexp_extract(text, _PREFIX, 0)
    prefix = F.coalesce(first_group(declared, _PREFIX, 1), first_group(declared, _PREFIX, 2), F.lit(""))
    pairs = lambda p, verb, route: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, p, verb).alias("verb"), F.regexp_extract(m, p, route).alias("route")))
    classed = F.concat(pairs(_ATTRIBUTE, 1, 2), pairs(_SPRING, 1, 2))
    plain = F.concat(pairs(_CALL, 1, 2), pairs(_MINIMAL, 1, 2))
    flask = F.transform(pairs(_DECORATOR, 2, 1), lambda x: F.struct(F.when(x["verb"] == "", "GET").otherwise(x["verb"]).alias("verb"), x["route"].alias("route")))
    joined = F.concat(
        F.transform(classed, lambda x: F.struct(x["verb"].alias("verb"), F.concat(prefix, F.lit("/"), x["route"]).alias("route"))),
        F.transform(plain, lambda x: F.struct(x["verb"].alias("verb"), x["route"].alias("route"))),
        flask,
    )
    rows = files.select("path", F.explode(F.array_distinct(joined)).alias("x"))
    verbs = F.explode(F.split(F.regexp_replace(F.upper("x.verb"), r"[\s\"']", ""), ","))
    route = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace("x.route", "/+$", "")), "/{2,}", "/")
    return rows.select("path", verbs.alias("method"), route.alias("route")).distinct()


def first_group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def model_cost(calls: DataFrame) -> DataFrame:
    """Adds cost_usd by the model's price; unknown models cost nothing."""
    price = lambda at: F.coalesce(*[F.when(F.col("model") == m, F.lit(p[at])) for m, p in PRICES.items()], F.lit(Decimal("0.00"))).cast("decimal(6,2)")
    total = F.col("input_tokens").cast("decimal(18,0)") * price(0) + F.col("output_tokens").cast("decimal(18,0)") * price(1)
    return calls.withColumn("cost_usd", (total / F.lit(Decimal(1000000))).cast("decimal(12,6)"))


def latest_for_files(extractions: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows whose (workspace_id, file_path) is asked for."""
    return extractions.join(paths.select("workspace_id", "file_path").distinct(), ["workspace_id", "file_path"], "left_semi")


def search_extractions(extractions: DataFrame, tokens: list[str], limit: int) -> DataFrame:
    """Newest rows that name a token, ignoring case, and have endpoints or events; ties by path."""
    payload, found = F.lower("extraction_payload"), F.lit(False)
    for token in tokens:
        found = found | payload.contains(token.lower())
    section = F.lit(False)
    for key in ("endpoints", "eventsPublished", "eventsConsumed"):
        section = section | F.get_json_object("extraction_payload", f"$.{key}").isNotNull()
    return extractions.where(found & section).orderBy(F.desc("created_at"), "file_path").limit(limit)
