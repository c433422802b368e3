"""Plans hold the operators they should."""

import pytest

from quillspan.plans.catalog import QUERIES


def plan(spark, sf_dir, name: str) -> str:
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_top_k_is_cut_within_partitions(spark, sf_dir):
    assert "WindowGroupLimit" in plan(spark, sf_dir, "bm25_topk")


def test_dimension_join_is_broadcast_by_its_size(spark, sf_dir):
    text = plan(spark, sf_dir, "rollup_joined")
    assert "BroadcastHashJoin" in text and "ReadSchema: struct<s_suppkey:bigint,s_nationkey:int>" in text


def test_scans_read_only_what_is_asked(spark, sf_dir):
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan(spark, sf_dir, "resume_anti")


@pytest.mark.parametrize("name", ["resolve_suffix", "contains_join", "bm25_chunks", "dag_hard_propagate", "cursor_hits"])
def test_no_cartesian_product_of_rows(spark, sf_dir, name):
    assert "CartesianProduct" not in plan(spark, sf_dir, name)
