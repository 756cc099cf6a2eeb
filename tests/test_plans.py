"""Shapes of physical plans that must hold at any scale."""

import re

import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    df = catalog.QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(text: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>\s*$", text, re.M)]


@pytest.mark.parametrize("name, columns", [
    ("s03_projected_scan", {"c_custkey", "c_mktsegment"}),
    ("a15_group_count", {"c_mktsegment"}),
    ("a02_model_usage", {"event_type", "value"}),
    ("w05_latest", {"user_id", "event_id", "value"}),
])
def test_only_needed_columns_are_read(spark, name, columns):
    assert columns_read(plan(spark, name)) == [columns]


@pytest.mark.parametrize("name, pushed", [("s02_point_lookup", "o_orderkey"), ("p16_min_score", "value"), ("j06_inner_cutoff", "o_orderdate"), ("e20_subscribe", "event_type")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert any(pushed in p for p in re.findall(r"PushedFilters: \[(.*?)\]", plan(spark, name)))


@pytest.mark.parametrize("name", ["w05_latest", "e06_keep_created", "d01_upsert", "a29_dedup", "u03_last_wins"])
def test_last_rows_are_partial_aggregates(spark, name):
    text = plan(spark, name)
    assert "partial_max_by" in text and "Window" not in text


@pytest.mark.parametrize("name", ["j20_as_of", "j08_nest", "j10_full_outer_merge", "e02_replay", "w01_prune"])
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["t01_newest", "t07_top_score", "t08_newest_matches", "t12_keep_newest"])
def test_top_n_is_not_a_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


#: Products of blocks of vectors, and the splice of a JSON text, are Arrow functions by design.
BLOCKS = {"f23_json_set", "j15_similarity", "r06_vector_search", "r06_index_exact", "r07_brute_force", "r08_overfetch", "r09_hybrid_merge", "r12_pipeline", "r13_save_gate"}


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE) - BLOCKS - {"f38_fuzzy_replace", "f41_sections", "f54_seek", "r03_embed", "x01_registered_function", "x02_discovered", "x03_reregistered", "x04_decorated", "f47_keywords", "f48_expanded", "e08_debounce", "e12_anchored_window"}))
def test_sql_queries_run_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))
