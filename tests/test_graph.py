"""Graph writes, reads and correlation on literal rows."""

import json
import random

from pyspark.sql import functions as F

from cartolake.operators import changes, context, correlate, graph_read, graph_write, matching, questions, reports, structural
from cartolake.operators.project import parse_extractions, project_all
from cartolake.schemas import EDGES, NODES


def nodes(spark, rows):
    full = [(ws, label, id_, name, props, "r", f, ex, None) for ws, label, id_, name, props, f, ex in rows]
    return spark.createDataFrame(full, NODES)


def test_payload_case_and_broken_json(spark):
    rows = [
        ("w", "r", "a", "h", '{"service":{"isPartOfService":true,"serviceName":"S"}}'),
        ("w", "r", "b", "h", '{"Service":{"IsPartOfService":true,"ServiceName":"T"},"Endpoints":{"Endpoints":[{"Method":"GET","Path":"/x"}]}}'),
        ("w", "r", "c", "h", '{"service": {'),
        ("w", "r", "d", "h", None),
    ]
    df = spark.createDataFrame(rows, "workspace_id string, repo_id string, file_path string, content_hash string, extraction_payload string")
    parsed = parse_extractions(df)
    assert {r.file_path: r.rec.service.serviceName for r in parsed.collect()} == {"a": "S", "b": "T"}
    n, e = project_all(parsed)
    assert {(r.label, r.name) for r in n.collect()} == {("Service", "S"), ("Service", "T"), ("Endpoint", "GET /x")}
    assert [r.label for r in e.collect()] == ["EXPOSES"]


def test_upsert_folds_properties(spark):
    old = nodes(spark, [("w", "Service", "1", "a", {"k": "old", "gone": "x"}, "f", "e0")])
    specs = spark.createDataFrame(
        [("w", "Service", "1", "a", {"k": "one"}, "r", "f", "e1"), ("w", "Service", "1", "a", {"k": "two", "gone": None}, "r", "f", "e2")],
        "workspace_id string, label string, id string, name string, props map<string,string>, repo_id string, file_path string, last_extraction_id string",
    )
    out = graph_write.upsert_nodes(old, specs, F.lit("2024-01-01").cast("timestamp")).collect()
    assert len(out) == 1 and out[0].props == {"k": "two"} and out[0].last_extraction_id == "e2"


def test_later_extraction_wins(spark):
    """Specs apply by time, whatever their extraction's id; of one spec's properties each has its own last value."""
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    specs = spark.createDataFrame(
        [("w", "Service", "1", "late", {"k": "late", "gone": None}, "r", "g", "a", at(2)), ("w", "Service", "1", "early", {"k": "early", "gone": "x", "own": "o"}, "r", "f", "z", at(1))],
        "workspace_id string, label string, id string, name string, props map<string,string>, repo_id string, file_path string, last_extraction_id string, created_at timestamp",
    )
    row = graph_write.upsert_nodes(spark.createDataFrame([], NODES), specs, F.lit(None).cast("timestamp")).first()
    assert (row["name"], row.props, row.file_path, row.last_extraction_id) == ("late", {"k": "late", "own": "o"}, "g", "a")
    edges = spark.createDataFrame([("w", "CALLS", "1", "1", {"e": "b"}, at(1)), ("w", "CALLS", "1", "1", {"e": "a"}, at(2))], "workspace_id string, label string, source_id string, target_id string, props map<string,string>, created_at timestamp")
    out = graph_write.upsert_edges(spark.createDataFrame([], EDGES), edges, nodes(spark, [("w", "Service", "1", "s", {}, "f", "e")]), F.lit(None).cast("timestamp"))
    assert out.first().props == {"e": "a"}


def test_mixed_case_payload(spark):
    df = spark.createDataFrame([("w", "r", "a", "h", '{"service":{"isPartOfService":true,"serviceName":"S"},"Endpoints":{"Endpoints":[{"Method":"GET","Path":"/x"}]}}')], "workspace_id string, repo_id string, file_path string, content_hash string, extraction_payload string")
    rec = parse_extractions(df).first().rec
    assert rec.service.serviceName == "S" and rec.endpoints.endpoints[0].path == "/x"


def test_edges_need_both_ends(spark):
    n = nodes(spark, [("w", "Service", "1", "a", {}, "f", "e"), ("w", "Event", "2", "b", {}, "f", "e")])
    specs = spark.createDataFrame([("w", "PUBLISHES", "1", "2", {"a": "b"}), ("w", "PUBLISHES", "1", "2", {"c": "d"}), ("w", "PUBLISHES", "1", "9", {})], "workspace_id string, label string, source_id string, target_id string, props map<string,string>")
    out = graph_write.upsert_edges(spark.createDataFrame([], EDGES), specs, n, F.lit(None).cast("timestamp")).collect()
    assert len(out) == 1 and out[0].props == {"a": "b", "c": "d"}


def test_orphans(spark):
    n = nodes(spark, [("w", "Service", str(i), "s", {}, "f", ex) for i, ex in enumerate(["a", "b", None])])
    gone = graph_write.orphans_for_files(n, n)
    assert sorted(r.id for r in gone.collect()) == ["0", "2"]
    assert graph_write.orphans_for_files(n, n, keep="none").count() == 3


def test_validation(spark):
    n = nodes(spark, [("w", "Service", "1", None, {"workspace_id": "w"}, "f", "e"), ("w", "Service", "2", "a", {"name": "a", "workspace_id": "w", "purpose": "p"}, "f", "e"), ("w", "Nope", "3", "a", {}, "f", "e")])
    out = {r.id: (r.is_valid, r.errors) for r in graph_write.validate_nodes(n).collect()}
    assert out["1"] == (False, ["missing name"])
    assert out["2"] == (True, ["[warn] unknown property purpose"])
    assert not out["3"][0]


def test_alias_match(spark):
    names = ["A", "A.B", "A.B.C", "A.BX"]
    n = nodes(spark, [("w", "Service", s, s, {}, "f", "e") for s in names] + [("w", "Endpoint", "x", "GET /x", {"method": "GET", "path": "/x"}, "f", "e")])
    e = spark.createDataFrame([("w", "EXPOSES", s, "x", {}, None) for s in names], EDGES)
    assert {r.service for r in graph_read.list_endpoints(n, e, "w", "A.B").collect()} == {"A", "A.B", "A.B.C"}
    assert {r.service for r in graph_read.list_endpoints(n, e, "w", "AB").collect()} == {"A"}


def test_owner_tiers(spark):
    known = spark.createDataFrame([("w", "r", "src/a/x.cs", "A"), ("w", "r", "src/b/y.cs", "B")], "workspace_id string, repo_id string, file_path string, service string")
    files = spark.createDataFrame([("w", "r", p) for p in ("src/a/x.cs", "repo/src/b/Y.cs", "src/a/z.cs", "other.txt")], "workspace_id string, repo_id string, file_path string")
    got = {r.file_path: (r.service, r.tier) for r in correlate.resolve_owner(files, known).collect()}
    assert got == {"src/a/x.cs": ("A", 1), "repo/src/b/Y.cs": ("B", 2), "src/a/z.cs": ("A", 3), "other.txt": (None, 0)}
    single = correlate.resolve_owner(files, known.where("service = 'A'"))
    assert {r.file_path: r.tier for r in single.collect()}["other.txt"] == 4


def test_one_owner_per_file(spark):
    """Two services name the same path: the file has one owner, and its facts come once."""
    known = spark.createDataFrame([("w", "r", "a.cs", "B"), ("w", "r", "a.cs", "A")], "workspace_id string, repo_id string, file_path string, service string")
    assert [(r.service, r.tier) for r in correlate.resolve_owner(known, known).collect()] == [("A", 1)]
    df = spark.createDataFrame([("w", "r", "a.cs", "h", '{"endpoints":{"endpoints":[{"method":"GET","path":"/x"}]}}')], "workspace_id string, repo_id string, file_path string, content_hash string, extraction_payload string")
    out = correlate.stitch_edges(parse_extractions(df), known).collect()
    assert [(r.service_name, r.x.edge) for r in out] == [("A", "EXPOSES")]


def test_raw_suffixes(spark):
    files = spark.createDataFrame([("w", "r", "lib/mycode.cs")], "workspace_id string, repo_id string, file_path string")
    known = files.limit(0).withColumn("service", F.lit("A")).union(spark.createDataFrame([("w", "r", "code.cs", "A"), ("w", "r", "z/y.cs", "B")], "workspace_id string, repo_id string, file_path string, service string"))
    assert correlate.resolve_owner(files, known).first().service is None and correlate.resolve_owner(files, known, raw=True).first().service == "A"


def test_contained_needles(spark):
    texts = spark.createDataFrame([("w", x) for x in ("abcdef", "xabcx", "a", "ab", "bc")] + [("v", "abc")], "workspace_id string, text string")
    needles = spark.createDataFrame([("w", x) for x in ("abc", "b", "ab", "zzz", "", "def")], "workspace_id string, needle string")
    got = {(r.needle, r.text) for r in matching.contains_pairs(needles, texts).collect()}
    rows = ["abcdef", "xabcx", "a", "ab", "bc"]
    assert got == {(n, t) for n in ("abc", "b", "ab", "zzz", "def") for t in rows if n in t}


def test_contained_needles_of_long_texts(spark):
    """Texts of 10 KB with characters outside the basic plane, copies and overlapping places; only their places are posted."""
    r = random.Random(4)
    made = ["".join(r.choice("abcdefgh é𝄞中") for _ in range(10_000)) for _ in range(40)]
    texts = spark.createDataFrame([(w, t) for w in "wv" for t in [*made, made[0], "", "aaaa"]] + [("w", None)], "workspace_id string, text string")
    wanted = [t[k : k + n] for t in made[:8] for k, n in ((0, 12), (5000, 9), (9990, 10), (77, 5))] + ["aa", "𝄞中", "q", "aaaaa", "aaaa", "h", None, ""]
    needles = spark.createDataFrame([("w", n) for n in wanted], "workspace_id string, needle string")
    got = {(x.workspace_id, x.needle, x.text) for x in matching.contains_pairs(needles, texts).collect()}
    assert got == {("w", n, t) for n in wanted if n for t in {*made, "aaaa"} if n in t}
    # What is posted is bounded by the places of the needles' rarest grams, not by the texts.
    plan = matching.containing(needles, texts)
    rare = spark.createDataFrame([("w", made[0][100:130])], "workspace_id string, needle string")
    sizes = []
    held = matching.stored
    matching.stored = lambda df, name: sizes.append((name, df.columns, (out := held(df, name)).count())) or out
    try:
        assert matching.containing(rare, texts).count() == 1
    finally:
        matching.stored = held
    assert [(n, c) for n, c, _ in sizes if n == "places"] == [("places", ["workspace_id", "needle", "text_id", "start"])] and dict((n, k) for n, _, k in sizes)["places"] < 400
    assert plan.columns == ["workspace_id", "needle", "text_id"] and matching.containing(needles, texts.limit(0)).count() == matching.containing(needles.limit(0), texts).count() == 0


def test_changes_update_the_graph(spark):
    """A removed file loses its node, a changed one its old node and gets the new one; the rest stays."""
    payload = lambda s: '{"service":{"isPartOfService":true,"serviceName":"%s"}}' % s
    rows = "workspace_id string, repo_id string, file_path string, content_hash string, extraction_payload string, created_at timestamp"
    now = F.lit("2024-01-01").cast("timestamp")
    first = spark.createDataFrame([("w", "r", f, "1", payload(s)) for f, s in (("a", "A"), ("b", "B"), ("c", "C"))], rows.rsplit(",", 1)[0]).withColumn("created_at", now)
    n, e = project_all(parse_extractions(first))
    state = {"extractions": first, "nodes": graph_write.upsert_nodes(spark.createDataFrame([], NODES), n, now), "edges": graph_write.upsert_edges(spark.createDataFrame([], EDGES), e, n, now)}
    changed = spark.createDataFrame([("r", "a", "removed", None, None, None), ("r", "b", "modified", None, 1, 1), ("r", "big", "added", None, 1, 1)], "repo_id string, filename string, status string, previous_filename string, additions int, deletions int")
    files = spark.createDataFrame([("r", "b", 10, bytearray(b"x")), ("r", "big", 2 << 20, bytearray(b"x")), ("r", "c", 10, bytearray(b"x"))], "repo_id string, path string, length int, content binary")
    extract = lambda todo: todo.select(F.lit("w").alias("workspace_id"), "repo_id", F.col("path").alias("file_path"), F.lit("2").alias("content_hash"), F.lit(payload("NEW")).alias("extraction_payload"), F.lit("2024-01-02").cast("timestamp").alias("created_at"))
    out = changes.apply_changes(state, changed, files, extract, now)
    assert {(r.file_path, r.content_hash) for r in out["extractions"].collect()} == {("b", "2"), ("c", "1")}
    assert {(r["name"], r.file_path) for r in out["nodes"].collect()} == {("NEW", "b"), ("C", "c")}


def test_shared_packages(spark):
    p = spark.createDataFrame([("w", "r1", "Acme.A", True), ("w", "r2", "acme.a", True), ("w", "r1", "Zed", False), ("w", "r3", "zed", False)], "workspace_id string, repo_id string, package string, internal boolean")
    s = spark.createDataFrame([("w", f"r{i}", f"s{i}") for i in (1, 2, 3)], "workspace_id string, repo_id string, service string")
    got = {(r.source, r.target): (r.signal, r.shared) for r in correlate.shared_packages(p, s).collect()}
    assert got == {("s1", "s2"): ("internal", ["acme.a"]), ("s1", "s3"): ("transitive", ["zed"])}


def stored_scans(df):
    """For each scan of a stored table in the plan, the operators between it and the join that it goes into."""
    held, found = {}, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        name = line.lstrip(" :+-*(0123456789)")
        depth = len(line) - len(line.lstrip(" :+-"))
        held = {k: v for k, v in held.items() if k < depth} | {depth: name}
        if name.startswith("FileScan") and "spark_catalog" in name:
            above = [held[k] for k in sorted(held, reverse=True)]
            found.append(above[: next(i for i, x in enumerate(above) if "Join" in x)])
    return found


def test_merging_into_bucketed_tables(spark, tmp_path):
    """Stored tables are neither shuffled nor broadcast, and the result is that of plain tables."""
    specs = nodes(spark, [("w", "Service", f"s{i}", f"S{i}", {"a": str(i)}, "f", "1") for i in range(40)])
    now = F.lit("2024-01-01").cast("timestamp")
    plain = graph_write.upsert_nodes(spark.createDataFrame([], NODES), specs, now)
    links = spark.createDataFrame([("w", "CALLS", f"s{i}", f"s{i + 1}", {"n": "1"}) for i in range(30)], "workspace_id string, label string, source_id string, target_id string, props map<string,string>")
    joined = graph_write.upsert_edges(spark.createDataFrame([], EDGES), links, plain, now)
    n, e, ids = graph_write.store_graph(plain, joined, "bucket_test", str(tmp_path / "graph"), 4)
    more = nodes(spark, [("w", "Service", f"s{i}", f"S{i}", {"b": "new"}, "f", "2") for i in range(35, 45)])
    ends = links.limit(3).withColumn("props", F.create_map(F.lit("m"), F.lit("2"))).union(spark.createDataFrame([("w", "CALLS", "s1", "nowhere", {})], links.schema))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = [(graph_write.upsert_nodes(n, more, now), graph_write.upsert_nodes(plain, more, now), 1), (graph_write.upsert_edges(e, ends, ids, now), graph_write.upsert_edges(joined, ends, plain, now), 3)]
        for got, want, scans in both:
            between = stored_scans(got)
            assert len(between) >= scans and not any("Exchange" in x for path in between for x in path)
            view = lambda df: sorted(str(r) for r in df.select(*[F.array_sort(F.map_entries(c)).alias(c) if k.startswith("map") else c for c, k in sorted(df.dtypes)]).collect())
            assert view(got) == view(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("nodes", "edges", "ids"):
            spark.sql(f"DROP TABLE bucket_test_{name}")


def test_package_classes(spark):
    """A package of 10,000 repositories is 10,000 rows; pairs are expanded for what is asked."""
    n = 10_000
    p = spark.range(n).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("r"), "id").alias("repo_id"), F.lit("Common").alias("package"), F.lit(False).alias("internal"))
    p = p.union(spark.createDataFrame([("w", "r5", "Own", True), ("w", "r7", "own", False), ("w", "r7", "OWN", True), ("w", "r9", "single", True)], p.schema))
    classes = correlate.package_classes(p)
    assert classes.count() == n + 2 and {(r.package, r.members) for r in classes.select("package", "members").distinct().collect()} == {("common", n), ("own", 2)}
    s = spark.range(n).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("r"), "id").alias("repo_id"), F.concat(F.lit("s"), "id").alias("service"))
    asked = spark.createDataFrame([("w", "r7"), ("w", "r5"), ("w", "none")], "workspace_id string, repo_id string")
    out = correlate.shared_packages(p, s, asked=asked).cache()
    assert out.count() == 2 * (n - 1) - 1
    assert [(r.source, r.target, r.signal, r.shared) for r in out.where("signal = 'internal'").collect()] == [("s5", "s7", "internal", ["own"])]


def test_aliases(spark):
    known = spark.createDataFrame([("w", x) for x in ("Acme", "Acme.Api", "Acme.Api.V1", "Acm", "Other", "acme", None)] + [("v", "Acme")], "workspace_id string, name string")
    names = ["Acme", "Acme.Api", "AcmeX", "Oth", "Acme.Api.", "", "Zed.Y", None]
    got = {(r.asked, r.name) for r in graph_read.aliases(known, spark.createDataFrame([("w", x) for x in names], known.schema)).where("workspace_id = 'w'").collect()}
    rows = [r.name for r in known.where("workspace_id = 'w' and name is not null").collect()]
    assert got == {(a, k) for a in names if a is not None for k in rows if k == a or k.startswith(a + ".") or a.startswith(k)}


def test_one_sided_events(spark):
    def record(repo, published, consumed):
        body = {"service": {"isPartOfService": True, "serviceName": "S"}, "eventsPublished": {"publishes": [{"name": e} for e in published]}, "eventsConsumed": {"consumes": [{"name": e} for e in consumed]}}
        return ("w", repo, "f", "h", json.dumps(body))

    rows = [record("a", ["both", "self", "out"], ["self", "many"]), record("b", ["many"], ["both"]), record("c", ["many"], [])]
    df = spark.createDataFrame(rows, "workspace_id string, repo_id string, file_path string, content_hash string, extraction_payload string")
    got = {(r.repo_id, r.event, r.missing_side) for r in correlate.one_sided_events(parse_extractions(df)).collect()}
    assert got == {("a", "self", "consumer"), ("a", "self", "publisher"), ("a", "out", "consumer")}
    out = {r.repo_id: (r.endpoints, r.published, r.consumed) for r in correlate.workspace_summary(parse_extractions(df)).collect()}
    assert out == {"a": ([], ["both", "out", "self"], ["many", "self"]), "b": ([], ["many"], ["both"]), "c": ([], ["many"], [])}


def test_combined_graph_is_simple(spark):
    n = spark.createDataFrame([("repo1", i, x, x, "code", None) for i, x in enumerate("ab")], "repo_id string, pos int, id string, label string, file_type string, source_file string")
    e = spark.createDataFrame([("repo1", "a", "b", "one", None, 0), ("repo1", "1", "0", "two", None, 1), ("repo1", "a", "zz", "bad", None, 2)], "repo_id string, source string, target string, relation string, label string, ord int")
    assert [(r.a, r.b, r.relation) for r in structural.combine_graphs(n, e)[1].collect()] == [("repo1__a", "repo1__b", "two")]


def test_budget(spark):
    items = [("q", "skill", 0, "s", 4 * 200), ("q", "graph", 0, "g", 4 * 200), ("q", "file", 0, "a", 400), ("q", "file", 1, "b", 400)]
    df = spark.createDataFrame(items, "query_id string, bucket string, pos int, item string, chars int")
    kept, verdict = context.fit_budget(df, 450)
    assert {r.item for r in kept.collect()} == {"s", "a", "b"} and tuple(verdict.first()) == ("q", 400, True)
    kept, verdict = context.fit_budget(df, 300)
    assert {r.item for r in kept.collect()} == {"s", "a"} and tuple(verdict.first()) == ("q", 300, True)
    big = spark.createDataFrame([("q", "skill", 0, "s", 9999)], df.schema)
    kept, verdict = context.fit_budget(big, 256)
    assert kept.count() == 1 and verdict.first().truncated


def test_latency(spark):
    t = spark.createDataFrame([("w", v, 200) for v in (1, 2, 4)], "workspace_id string, latency_ms int, status_code int")
    assert reports.latency_stats(t).first().p95 == 4


def test_cap_lets_one_more_through(spark):
    c = spark.range(80).select(F.lit("w").alias("workspace_id"), "id", F.lit(1).alias("priority"))
    assert questions.cap_submissions(c).count() == 51


def test_changes(spark):
    c = spark.createDataFrame([("r", "a", "removed", None), ("r", "b", "renamed", "old"), ("r", "c", "added", None), ("r", "d", "odd", None)], "repo_id string, filename string, status string, previous_filename string")
    got = {(r.action, r.path) for r in changes.route_changes(changes.read_file_changes(c.withColumn("additions", F.lit(None).cast("int")).withColumn("deletions", F.lit(1)))).collect()}
    assert got == {("prune", "a"), ("prune", "old"), ("extract", "b"), ("extract", "c")}


def test_ranks_over_buckets(spark):
    repos = spark.range(300).select(F.concat(F.lit("r"), (F.col("id") * 7919 % 1000).cast("string")).alias("repo_id"))
    got = {r.repo_id: r.colour for r in structural.repo_colour(repos, 7, buckets=16).collect()}
    assert got == {x: i % 7 for i, x in enumerate(sorted({r.repo_id for r in repos.collect()}))}
    assert structural.repo_colour(repos.limit(0)).count() == 0
