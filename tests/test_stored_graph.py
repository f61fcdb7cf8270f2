"""What queries write of the graph: nodes and edges of the labels that they read, from facts that are one where they are emitted."""

import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cartolake.operators import graph_write, project
from cartolake.plans import adapters as A
from cartolake.schemas import EDGES, NODES

SF = "/root/testdata/sf0.001"
ALL = sorted(project.EDGE_SECTIONS)
#: Queries, and the labels of the edges that they write.
READS = {
    "r1_get_service": [],
    "st6_sweep": ALL,
}
#: The same for queries whose plans alone are looked at.
PLANS = {
    "p17_graph_totals": ALL,
    "q8_dismiss_orphaned": [],
    "r16_callers_by_id": ["CALLS"],
    "r20_callers_of_service": ["CALLS", "EXPOSES"],
    "r21_legend_counts": [],
    "r2_list_services": [],
    "r5_event_consumers": ["CONSUMES"],
    "r8_conventions": [],
    "r9_nodes_by_label": [],
    "w10_schema_drift": ALL,
    "w11_check_property_keys": [],
    "w14_schema_report": ALL,
    "w9_skip_invalid": [],
    "q10_dangling_endpoints": ALL,
    "p8_summary": ALL,
    "q3_related_degree": [],
    "q9_duplicate_services": [],
    "r10_node_detail": ALL,
    "r11_count_nodes_per_label": [],
    "r13_service_neighborhood": ["CONSUMES", "DEPENDS_ON", "EXPOSES", "PUBLISHES"],
}


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else str(v.item() if hasattr(v, "item") else v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", READS)
def test_query_writes_no_facts_and_only_its_edges(spark, name):
    A._written.clear()
    got = entry.queries()[name](spark, SF).toPandas()
    assert {k[0] for k in A._written} <= {"items", "nodes", "edges"}
    assert sorted(k[3] for k in A._written if k[0] == "edges") == READS[name]
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    assert rows(got) == rows(con.sql(entry.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", PLANS)
def test_query_asks_for_its_edges_only(spark, monkeypatch, name):
    asked = []

    def edges(spark, sf_dir, labels=None):
        asked.extend(ALL if labels is None else labels)
        return spark.createDataFrame([], EDGES)

    def emitted(*_):
        raise AssertionError("all facts are written")

    monkeypatch.setattr(A, "emitted", emitted)
    monkeypatch.setattr(A, "nodes", lambda spark, sf_dir: spark.createDataFrame([], NODES), raising=False)
    monkeypatch.setattr(A, "edges", edges, raising=False)
    A._written.clear()
    entry.queries()[name](spark, SF)
    assert sorted(set(asked)) == PLANS[name]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["g16_project_all", "w1_upsert_nodes", "w2_upsert_edges", "w6_apply_batch"])
def test_merges_take_distinct_specs(spark, monkeypatch, name):
    def facts(*_, **__):
        raise AssertionError("every fact is projected")

    monkeypatch.setattr(A, "facts", facts)
    monkeypatch.setattr(project, "facts", facts)
    A._written.clear()
    entry.queries()[name](spark, SF)


def _parsed(spark, seed):
    """Random files: services with and without name, the same targets in several sections, times that tie."""
    r = random.Random(seed)
    some = lambda make: [make() for _ in range(r.randint(0, 3))]
    text = lambda *of: r.choice([*of, None, " "])
    call = lambda: {"service": text("a", "b"), "method": text("m", "n"), "evidence": text("l1")}
    out = []
    for i in range(60):
        payload = {
            "service": {"isPartOfService": r.random() < 0.8, "serviceName": text("a", "b"), "servicePurpose": text("p", "q"), "techStack": r.choice([None, [], ["x"], ["x", "y"]])},
            "endpoints": {"endpoints": some(lambda: {"method": text("GET", "PUT"), "path": text("/x", "/y")})},
            "eventsPublished": {"publishes": some(lambda: {"name": text("e", "f"), "topic": text("t", "u")})},
            "eventsConsumed": {"consumes": some(lambda: {"name": text("e", "f"), "version": text("1")})},
            "storage": {"storages": some(lambda: {"name": text("s", "t"), "access": text("owns", "reads")})},
            "integrationContracts": {
                "httpClientCalls": some(lambda: {"method": "get", "path": text("/x", "/y"), "evidence": text("l1", "l2")}),
                "grpcClientCalls": some(call), "grpcServerImpls": some(call), "signalRHubMethods": some(call), "signalRClientInvokes": some(call),
                "messagingConsumes": some(lambda: {"kind": "sqs", "queue": text("e", "f")}),
                "messagingPublishes": some(lambda: {"kind": text("rabbitmq", "kafka"), "exchange": text("e", "f"), "routingKey": text("k", "l")}),
            },
            "conventions": {"conventions": some(lambda: {"category": text("c", "d"), "name": text("n"), "description": text("1", "2")})},
        }
        out.append((r.choice("vw"), r.choice("rs"), f"f{i % 40}", r.choice("hi"), json.dumps(payload), r.randint(0, 3)))
    df = spark.createDataFrame(out, "workspace_id string, repo_id string, file_path string, content_hash string, extraction_payload string, t int")
    return project.parse_extractions(df.withColumn("created_at", F.timestamp_seconds("t")).drop("t")).localCheckpoint()


def _sorted(df):
    return sorted((str({**r.asDict(), "props": sorted(r.props.items())}) for r in df.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_distinct_facts_merge_to_the_same_graph(spark, seed):
    parsed, now = _parsed(spark, seed), F.lit(0).cast("timestamp")
    emitted = project.facts(parsed).localCheckpoint()
    want = graph_write.upsert_nodes(spark.createDataFrame([], NODES), project.node_rows(emitted), now)
    specs = project.distinct_node_rows(project.distinct_items(parsed)).localCheckpoint()
    assert _sorted(graph_write.upsert_nodes(spark.createDataFrame([], NODES), specs, now)) == _sorted(want)
    assert specs.agg(F.sum("specs")).first()[0] == emitted.count() > specs.count()
    edges = graph_write.upsert_edges(spark.createDataFrame([], EDGES), project.edge_rows(emitted), want, now)
    assert _sorted(project.first_edges(parsed, now)) == _sorted(edges)
    some = ["PUBLISHES", "WRITES_TO"]
    assert _sorted(project.first_edges(parsed, now, some)) == _sorted(edges.where(F.col("label").isin(some)))


def test_edges_are_dealt_out_once(spark):
    plan = project.first_edges(_parsed(spark, 0), F.lit(0).cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
