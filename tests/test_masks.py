"""Page masks from cells, and what they cost."""

from __future__ import annotations

import random

from gradelake.operators import grid as G

CELLS = "doc_id string, page int, row int, col int, writable boolean"
GRID = "doc_id string, page int, rows int, cols int, cell_size_pts double, left_margin_pts double, top_margin_pts double, page_w_pts double, page_h_pts double"
SIZE = (10.0, 0.0, 0.0, 100.0, 100.0)


def drawn(cells, taken, rows, cols):
    on = {(r, c) for r, c, w in cells if w} - set(taken)
    return ["".join("1" if (r, c) in on else "0" for c in range(1, cols + 1)) for r in range(1, rows + 1)]


def test_masks_of_pages_of_all_sizes(spark):
    rng = random.Random(3)
    sizes = {("a", 1): (3, 4), ("a", 2): (1, 70), ("b", 1): (0, 5), ("b", 2): (40, 1), ("c", 9): (5, 5)}
    cells, taken = {}, {}
    for page in sizes:
        cells[page] = [(rng.randint(-1, 42), rng.randint(-1, 72), rng.choice([True, False, None])) for _ in range(400)] if page[0] != "c" else []
        taken[page] = [(rng.randint(-1, 42), rng.randint(-1, 72)) for _ in range(30)]
    c = spark.createDataFrame([(*p, *x) for p, xs in cells.items() for x in xs] + [("a", 1, None, 1, True), ("z", 1, 1, 1, True)], CELLS).repartition(4)
    t = spark.createDataFrame([(*p, *x) for p, xs in taken.items() for x in xs] + [("a", 1, None, 1)], "doc_id string, page int, row int, col int")
    g = spark.createDataFrame([(*p, *s, *SIZE) for p, s in sizes.items()] + [("n", 1, None, 5, *SIZE)], GRID)
    for without in (None, t):
        got = {(r.doc_id, r.page): r["mask"] for r in G.page_masks(c, g, taken=without).collect()}
        assert got.pop(("n", 1)) is None
        assert got == {p: drawn(cells[p], taken[p] if without else [], *sizes[p]) for p in sizes}


def test_masks_move_no_cells(spark, tables):
    """Cells that lie by page already are gathered where they are, once, without a string per cell."""
    plan = G.page_masks(tables.fx_cells, tables.fx_page_grid, taken=tables.fx_cells.filter("row = 3"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") and "rpad" not in plan


def test_flow_makes_its_tables_once(spark, tables):
    """Masks, runs, score boxes and placements are stored, so the report's plan neither places comments nor looks at cells again."""
    from gradelake.plans.registry import spark_queries

    plan = spark_queries()["flow_grade_report"](spark, tables.folder)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow fold" not in plan and "collect_list" not in plan and "Window" not in plan


def test_blocks_are_scored_once_a_page():
    """The best block of each region, against a search of every block."""
    import numpy as np

    from gradelake.operators import placement as PL

    rng = np.random.default_rng(4)
    for _ in range(60):
        rows, cols = rng.integers(3, 14, 2)
        state = PL.PageState({"mask": ["".join(x) for x in rng.choice(["0", "1", "1", "1"], (rows, cols))], "cell_size_pts": 10.0, "left_margin_pts": 0.0,
                              "top_margin_pts": 0.0, "page_w_pts": 10.0 * cols, "page_h_pts": 10.0 * rows})
        state.taken = rng.random((rows, cols)) < 0.1
        taken_sum = np.zeros((rows + 1, cols + 1), dtype=np.int64)
        taken_sum[1:, 1:] = state.taken.cumsum(axis=0).cumsum(axis=1)
        ar, ac = int(rng.integers(1, rows + 1)), int(rng.integers(1, cols + 1))
        for rg in state.regions.tolist():
            nr, nc = int(rng.integers(1, rg[1] - rg[0] + 2)), int(rng.integers(1, rg[3] - rg[2] + 2))
            found = []
            for r in range(max(rg[0], ar - nr + 1), rg[1] - nr + 2):
                for c in range(max(rg[2], ac - nc + 1), rg[3] - nc + 2):
                    if not state.taken[r - 1:r - 1 + nr, c - 1:c - 1 + nc].any():
                        edge = 3.0 * (c <= 1) + 3.0 * (c + nc - 1 >= cols) + max(0.0, nc / nr - 8.0) * 0.3
                        found.append((round(float(np.hypot(r + nr / 2.0 - ar, c + nc / 2.0 - ac)) + edge, 9), r, c))
            hit = PL._carve(PL._block_scores(state, taken_sum, ar, ac, nr, nc), rg, ar, ac, nr, nc)
            assert (hit and (round(hit[0], 9), *hit[1:])) == (min(found) if found else None)
