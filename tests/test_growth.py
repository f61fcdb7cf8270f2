"""What work grows with, on literal rows."""

import random

import pandas as pd
from pyspark.sql import functions as F

from cartolake.operators import context, correlate, extract, graph_read


def _skills(n):
    r = random.Random(1)
    words = ["bolt", "gear", "ring", "valve"]
    return [("w", f"n{i:03}", f"{r.choice(words)} {r.choice(words)}", r.choice(words), [r.choice(["add gear", "ring"])], True) for i in range(n)]


SKILLS = "workspace_id string, name string, title string, description string, triggers array<string>, enabled boolean"


def test_skills_that_score_alike_are_scored_once(spark, monkeypatch):
    rows, asked = _skills(1000), []
    inner = context.containing
    monkeypatch.setattr(context, "containing", lambda needles, texts: (asked.append(needles.count()), inner(needles, texts))[1])
    queries = [("w", i, q) for i, q in enumerate(["Add gear to bolt", "ring", "add gear to bolt", "valves", "none"])]
    got = context.match_skills(spark.createDataFrame(rows, SKILLS), spark.createDataFrame(queries, "workspace_id string, query_id int, query string")).collect()
    want = set()
    for _, i, q in queries:
        scored = []
        for _, name, title, description, triggers, _ in rows:
            has = lambda w, q=q: w in q.lower()
            score = sum(3.0 for t in triggers if has(t)) + sum(1.0 for w in set(title.split()) if has(w)) + sum(0.5 for w in set(description.split()) if has(w))
            scored += [(-score, name)] if score else []
        want |= {("w", i, name, -s, r) for r, (s, name) in enumerate(sorted(scored)[:3], 1)}
    assert {tuple(x) for x in got} == want and want
    assert asked[0] < 500  # needles of classes, not of skills


def test_linked_services_are_formed_once(spark):
    r = random.Random(2)
    make = lambda: sorted({("w", r.choice("efg"), (s := r.choice("abcdefgh")), s.upper()) for _ in range(30)})
    p, c = make(), make()
    df = lambda rows, n: spark.createDataFrame(rows, f"workspace_id string, event string, {n} string, id_{n} string")
    got = [tuple(x) for x in graph_read.linked_services(df(p, "a"), df(c, "b")).collect()]
    want = {("w", a, i, b, j) for _, e, a, i in p for _, f, b, j in c if e == f and a != b}
    assert len(got) == len(set(got)) and set(got) == want


FILES = "workspace_id string, repo_id string, service string, file_path string"


def test_first_files_are_cut_before_rows_are_dealt_out(spark):
    rows = [("w", "r", "s", f"f{i % 90:02}") for i in range(200)]
    out = correlate.first_of(spark.createDataFrame(rows, FILES).repartition(3), ["workspace_id", "service"], "file_path", 5, "files", repeats=False)
    assert [x.files for x in out.collect()] == [["f00", "f01", "f02", "f03", "f04"]]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("HashAggregate") < plan.index("WindowGroupLimit")  # copies go after the cut


def test_services_are_summarized_in_two_passes(spark):
    convention = "array<struct<category string, name string, description string>>"
    parsed = spark.createDataFrame(
        [("w", "r", "a", ((True, "s"), ([("c", "n", None), ("c", "n", None), ("c", "m", "d")],))), ("w", "r", "b", ((True, "s"), ([],))), ("w", "r", "c", ((True, "s"), None)), ("w", "r", "d", ((True, "t"), None)), ("w", "r", "e", ((False, "t"), None))],
        f"workspace_id string, repo_id string, file_path string, rec struct<service struct<isPartOfService boolean, serviceName string>, conventions struct<conventions {convention}>>",
    )
    out = correlate.summarize_services(parsed)
    assert {(x.service, x.file_count, tuple(x.files), len(x.convention_hashes)) for x in out.collect()} == {("s", 3, ("a", "b", "c"), 2), ("t", 1, ("d",), 0)}
    assert out._jdf.queryExecution().sparkPlan().toString().count("ExistingRDD") == 1  # the other pass is written


def test_prompts_alone_go_to_workers(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).coalesce(1)
    out = extract.extract_with(rows, lambda prompts: pd.Series([f"{len(prompts)}:{p}" for p in prompts]))
    got = {x.id: x.result for x in out.collect()}
    assert len(got) == 1000 and all(v.split(":")[1] == f"p{k}" and int(v.split(":")[0]) <= 256 for k, v in got.items())
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_counted_edges_are_not_dealt_out(spark):
    nodes = spark.createDataFrame([("w", "Service", x) for x in "ab"] + [("v", "Service", "c")], "workspace_id string, label string, id string")
    e = [("w", "CALLS", "a", "b"), ("w", "CALLS", "a", "c"), ("w", "CALLS", "x", "b"), ("w", "EXPOSES", "b", None), ("w", None, "a", "b"), ("v", "CALLS", "c", "c")]
    edges = spark.createDataFrame(e, "workspace_id string, label string, source_id string, target_id string")
    out = graph_read.count_edges_per_label(nodes, edges)
    assert {(x.workspace_id, x.label, x.n) for x in out.collect() if x.n} == {("w", "CALLS", 1), ("v", "CALLS", 1)}
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert [x for x in plan if "LeftAnti" in x] == [x for x in plan if "BroadcastHashJoin" in x and "LeftAnti" in x] != []
    assert not any("LeftSemi" in x for x in plan)
