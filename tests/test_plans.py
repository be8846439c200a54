"""What the plans must not contain, and where shuffles must not be."""

import re

import pytest

import __spark_entry__ as entry
from tidelog.plans import store_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(spark, run):
    """The plans of everything that ``run`` executes, written steps included."""
    store = spark._jsparkSession.sharedState().statusStore()

    def since(last):
        found, each = [], store.executionsList()
        for i in range(each.size() - 1, -1, -1):  # in the order of their ids; old ones are dropped
            e = each.apply(i)
            if e.executionId() <= last:
                break
            found.append((e.executionId(), e.physicalPlanDescription()))
        return found

    each = store.executionsList()
    last = each.apply(each.size() - 1).executionId() if each.size() else -1
    run()
    return [text for _, text in since(last)]


WHOLE = ["p1_found", "p3_found", "p4_found", "p5_found", "p6_found", "requests", "bloom_probe", "read_metrics", "index_locate", "rotation"]


@pytest.mark.parametrize("name", WHOLE)
def test_no_cross_joins_in_anything_executed(spark, sf, name):
    plans = executed(spark, lambda: entry.queries()[name](spark, sf).collect())
    assert plans
    for text in plans:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(store_queries.QUERIES.keys() - {"stream_live_snapshot"}))
def test_no_cross_joins_planned(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["write_quorum_outcome", "read_quorum_outcome"])
def test_no_exchange_by_node_alone(spark, sf, name):
    for text in executed(spark, lambda: entry.queries()[name](spark, sf).collect()):
        assert not re.search(r"hashpartitioning\(node_id#\d+L?, \d+\)", text)


@pytest.mark.parametrize("name", ["p3_found", "deleted_keys", "memory_size"])
def test_narrow_folds_are_hash_aggregates(spark, sf, name):
    for text in executed(spark, lambda: entry.queries()[name](spark, sf).collect()):
        assert "SortAggregate" not in text


def test_columns_are_pruned(spark, sf):
    text = plan(entry.queries()["p1_found"](spark, sf))
    assert "ReadSchema: struct<key:binary>" in text and "arrived_at" not in text


def test_counts_are_combined_before_the_shuffle(spark, sf):
    for name in ("p1_found", "p3_found"):
        text = plan(entry.queries()[name](spark, sf))
        assert "partial_" in text and "SortAggregate" not in text
