"""Plan shapes that the scale design relies on (checked with explain)."""

from pyspark.sql import functions as F

from answerlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_filters_are_partial_group_limits(spark):
    for name in ("milestones", "first_vote_per_question", "context_prompts"):
        p = plan(QUERIES[name](spark, SF))
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_sparse_retrieval_has_no_cartesian_product(spark):
    p = plan(QUERIES["retrieve_top1"](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "MapInArrow" in p or "PythonMapInArrow" in p
    served = plan(QUERIES["serve_top1"](spark, SF))
    assert "CartesianProduct" not in served and "NestedLoop" not in served and "MapInArrow" not in served


def test_scans_read_only_needed_columns(spark):
    p = plan(QUERIES["vote_pivot"](spark, SF))
    assert "ReadSchema: struct<o_orderstatus:string,o_orderpriority:string>" in p


def test_top1_aggregates_partially(spark):
    p = plan(QUERIES["latest_question"](spark, SF))
    assert "partial_max_by" in p


def test_single_pass_plans(spark):
    import re
    counters = plan(QUERIES["session_counters"](spark, SF))
    assert len(re.findall("FileScan", counters)) == 1 and "Join" not in counters
    centroid = plan(QUERIES["classify_centroid"](spark, SF))
    assert "NestedLoop" not in centroid and "Join" not in centroid and "Exchange" not in centroid
    assert "Join" not in plan(QUERIES["token_stats"](spark, SF))
