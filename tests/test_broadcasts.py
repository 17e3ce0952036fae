"""Tables exploded from pages are never sent to every executor through the driver."""

from __future__ import annotations

import pytest
from conftest import FOLDER

from gradelake.functions import coords as X
from gradelake.operators import layout as LA
from gradelake.operators import quality as Q
from gradelake.plans.registry import spark_queries

NAMES = ["a17_coordinate_suggestions", "a17_layout_summary", "a19_column_projections", "j10_snap_blocks", "j17_overlap_pairs", "j23_resolve_remarks",
         "j27_item_marking", "w9_region_means", "pf20_grid_response", "w15_word_gaps", "w15_word_gaps_by_line", "w1_runs_all", "j13_inject_marking"]


def first_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_page_tables_are_merged(spark, name):
    plan = first_plan(spark_queries()[name](spark, FOLDER))
    assert "Join" in plan and "Broadcast" not in plan


def test_operators_merge_what_they_explode(spark):
    # plain tables without the fixtures' hint
    boxes = spark.range(50).selectExpr("id AS doc_id", "1 AS page", "1 AS pos").withColumn("box", X.range_bounds(X.rect_range_id("pos", "pos", "pos", "pos")))
    assert "Broadcast" not in first_plan(Q.overlap_pairs(boxes))
    ink = spark.range(50).selectExpr("id AS doc_id", "1 AS page", "1 AS y", "10 AS x", "1 AS value")
    lines = spark.range(50).selectExpr("id AS doc_id", "1 AS page", "1 AS line", "20 AS y")
    assert "Broadcast" not in first_plan(LA.column_projections(ink, lines, 70, 48))
    columns = spark.range(50).selectExpr("id AS doc_id", "1 AS page", "1 AS line", "1 AS x", "2 AS ink", "2 AS raw_ink")
    assert "Broadcast" not in first_plan(LA.word_gaps(columns))
