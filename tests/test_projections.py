"""Column projections join pixels by page, where they lie, and match the rule pixel by pixel."""

from __future__ import annotations

from collections import defaultdict

from conftest import FOLDER

from gradelake.operators import layout as LA
from gradelake.plans.registry import spark_queries


def test_pixels_are_neither_shuffled_nor_sorted(spark):
    plan = spark_queries()["a19_column_projections"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan and "Sort" not in plan
    # the page table is dealt out by page, once a side; nothing exploded from it moves
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2


def test_bands_beyond_the_page(spark):
    height, width = 30, 48
    half, left, right = LA.line_half_height(height), int(width * LA.LEFT_MARGIN), int(width * LA.RIGHT_MARGIN)
    pixels = [(d, 1, y, x, None if (x, y) == (9, 3) else (d + 7 * y + x) % 5) for d in range(3) for y in range(-2, 33) for x in range(0, 48, 3)]
    pixels += [(0, 1, 4, 9, 2), (0, 1, 4, 9, 5), (1, 1, 29, 40, None)]
    # the last two begin below the page, and the first ends above it
    lines = [(0, 1, 1, -40), (0, 1, 2, 0), (0, 1, 3, 9), (0, 1, 4, 15), (0, 1, 5, 29), (1, 1, 1, 20), (1, 1, 2, 42), (1, 1, 3, 60), (4, 1, 1, 10)]
    want = defaultdict(list)
    for d, p, y, x, value in pixels:
        for of, page, line, at in lines:
            if (of, page) == (d, p) and left <= x < right and max(0, at - half) <= y < min(height, at + half):
                want[d, p, line, x - left].append(value)
    ink = spark.createDataFrame(pixels, "doc_id long, page int, y int, x int, value int")
    got = LA.column_projections(ink, spark.createDataFrame(lines, "doc_id long, page int, line int, y int"), height, width)
    assert got.dtypes == [("doc_id", "bigint"), ("page", "int"), ("line", "int"), ("x", "int"), ("ink", "bigint")]
    rows = {tuple(r)[:4]: r["ink"] for r in got.collect()}
    assert rows == {k: sum(found) if (found := [n for n in v if n is not None]) else None for k, v in want.items()} and got.count() == len(rows)
