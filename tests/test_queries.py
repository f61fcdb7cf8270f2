"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = "g16_project_all w1_upsert_nodes r4_event_publishers r6_topology r15_list_endpoints r18_search_nodes t5_top_degree_subgraph f3_drop_binary_ext f12_trim_source f16_normalise_http_path x4_cache_hits x12_extract_routes c1_summarize_services c7_resolve_owner c18_shared_packages c23_one_sided_events q4_blocks_others q6_insert_new k1_match_skills k4_fit_budget p6_spend_by_purpose p7_latency_stats p12_daily_activity d2_route_changes s3_read_structural_graph st1_stream_daily_activity".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else str(v.item() if hasattr(v, "item") else v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
