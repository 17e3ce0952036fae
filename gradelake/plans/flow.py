"""The main flow over a corpus: items and grades to placed comments and violation rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.operators import grading, grid, placement, quality
from gradelake.sources.stages import stored


def grade_and_check(items: DataFrame, evaluations: DataFrame, annotations: DataFrame, cells: DataFrame, page_grid: DataFrame) -> DataFrame:
    """Merge grades, find score boxes, place comments, validate the result, report per document."""
    def once(df: DataFrame, name: str) -> DataFrame:
        """What several steps read; merged, since a file of a few megabytes unpacks to far more."""
        return stored(df, name).hint("merge")

    masks = once(grid.page_masks(cells, page_grid), "masks")
    runs = once(grid.with_percent(grid.writable_runs(cells, 3).select(*grid.P, "row", "start_col", "end_col", "cell_count"), page_grid), "runs")
    graded = grading.merge_evaluations(items, evaluations).filter("NOT teacher_only").drop("marking_box_page")
    boxed = once(grading.inject_marking(graded, runs), "boxed")
    keys = ["doc_id", "page", "item_index", "annotation_index"]
    notes = annotations.select(*keys, "comment", "x_start_percent", "x_end_percent", "y_position_percent")
    placed = placement.place_cells(boxed, notes, masks, page_grid)
    none = F.lit(None)
    wire = once(notes.select(*keys, "comment").join(placed.select(*keys, F.nullif("range_id", F.lit("")).alias("comment_range")), keys).withColumns({
        "comment_font_pts": F.lit(quality.FONT_DEFAULT),
        "anchor": quality.normalize_anchor(F.lit("none"), none.cast("array<string>"), none.cast("map<string,string>"))}), "wire")
    found = quality.mask_violations(quality.adapt_percent_items(boxed.drop("score_range", "score_box_range"), page_grid), wire, masks)
    return quality.telemetry(found, boxed, wire)
