"""What plans may hold: tile queries stay in the JVM, join by equality, and read only the columns that they use."""

import re

import pytest

from terrashard import catalog

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "morton_2d": {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"}, "subtree_root": {"event_id", "user_id"}, "external_uri": {"l_orderkey", "l_linenumber", "url"},
    "flags_union": {"l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"}, "subtree_census": {"l_partkey", "l_suppkey", "l_linenumber"},
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries that join with a table of one literal row; the optimiser drops its constant key.
LITERAL = {"range_any", "subtree_errors"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - LITERAL))
def test_no_python_and_no_cross_join(spark, name):
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan(catalog.QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_are_pruned(spark, name):
    text = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = {c for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in re.findall(r"(\w+):", schema)}
    assert read and read <= COLUMNS[name]


def test_lookups_are_one_join_and_one_aggregate_pair(spark):
    text = plan(catalog.QUERIES["tracker_flags_octree"](spark, SF))
    assert len(re.findall("SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin", text)) == 2  # subtrees, and the flags back to their tiles
    assert len(re.findall(r"HashAggregate|SortAggregate", text)) == 2
