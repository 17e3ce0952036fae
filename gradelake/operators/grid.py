"""Cell grids: metrics from pixels, writable runs, rectangles, blobs and masks.

A cell is unique per (doc_id, page, row, col) and a page holds a few thousand
cells at most, so every window and group below is bounded by the page grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gradelake.functions import coords as X

P = ["doc_id", "page"]
GRID_COLUMNS = "rows cols cell_size_pts left_margin_pts top_margin_pts page_w_pts page_h_pts".split()

# Thresholds of the two scoring rules.
RULES = {
    "v4": {"min_score": 0.88, "max_ink": 0.005, "ink_below": 0.75},
    "v1": {"min_score": 0.85, "max_ink": 0.03, "ink_below": 0.45},
}


def page_grid_from_size(pages: DataFrame, cell_size: float = 10.0, centred: bool = True) -> DataFrame:
    """Grid columns for pages given page_w_pts and page_h_pts.

    Centred grids split the slack on both sides; the older layout put all of it
    left and on top.
    """
    share = 2.0 if centred else 1.0
    cols = F.greatest(F.lit(1), F.floor(F.col("page_w_pts") / cell_size).cast("int"))
    rows = F.greatest(F.lit(1), F.floor(F.col("page_h_pts") / cell_size).cast("int"))
    return pages.withColumns({
        "rows": rows, "cols": cols, "cell_size_pts": F.lit(float(cell_size)),
        "left_margin_pts": X.round_even((F.col("page_w_pts") - cols * cell_size) / share, 2),
        "top_margin_pts": X.round_even((F.col("page_h_pts") - rows * cell_size) / share, 2),
    })


def cell_rectangles(cells: DataFrame, page_grid: DataFrame) -> DataFrame:
    """Add the cell id, percent bounds (3 places) and point bounds (2 places)."""
    j = cells.join(page_grid.select(*P, *GRID_COLUMNS), P)
    pct = X.rect_percent("row", "col", "row", "col", digits=3)
    pts = X.rect_points("row", "col", "row", "col")
    return j.withColumn("cell_id", X.cell_id("row", "col")).withColumn("_p", pct).withColumn("_q", pts).select(
        *cells.columns, "cell_id",
        F.col("_p.x1_percent").alias("x_start_percent"), F.col("_p.x2_percent").alias("x_end_percent"),
        F.col("_p.y1_percent").alias("y_start_percent"), F.col("_p.y2_percent").alias("y_end_percent"),
        *[X.round_even(F.col(f"_q.{a}_pts"), 2).alias(f"pdf_{a}") for a in ("x1", "y1", "x2", "y2")],
    )


def cell_metrics(pixels: DataFrame, page_grid: DataFrame, dpi: float, rule: str = "v4") -> DataFrame:
    """Score, ink ratio and writable flag per cell from a pixel table.

    ``pixels`` has doc_id, page, y, x, value (0 black to 255 white) and, for the
    cleaned mask, a boolean ``ink``; without it ink is a plain threshold. Sums
    are whole numbers, so the result does not depend on the order of the rows.
    """
    t = RULES[rule]
    scale = dpi / 72.0
    j = pixels.join(page_grid.select(*P, "rows", "cols", "cell_size_pts", "left_margin_pts", "top_margin_pts"), P)

    def index(pos: str, margin: str) -> Column:
        edge = (F.col(pos) + 1) / F.lit(scale) - F.col(margin)
        return F.ceil(edge / F.col("cell_size_pts")).cast("int")

    ink = F.col("ink") if "ink" in pixels.columns else (F.col("value") / 255.0 < t["ink_below"])
    located = j.withColumn("row", index("y", "top_margin_pts")).withColumn("col", index("x", "left_margin_pts")).filter(
        F.col("row").between(1, F.col("rows")) & F.col("col").between(1, F.col("cols")))
    v = F.col("value").cast("bigint")
    sums = located.groupBy(*P, "row", "col").agg(
        F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.count(F.lit(1)).alias("n"), F.sum(ink.cast("int")).alias("k"))
    mean = F.col("s1") / F.col("n") / 255.0
    var = F.greatest(F.lit(0.0), F.col("s2") / F.col("n") / 65025.0 - mean * mean)
    std = F.sqrt(var)
    raw = mean - std if rule == "v4" else mean * (F.lit(1.0) - F.least(F.lit(1.0), std * 3.0))
    score = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    ratio = F.col("k") / F.col("n")
    return sums.select(
        *P, "row", "col", X.round_even(score, 4).alias("score"), X.round_even(ratio, 4).alias("ink_ratio"),
        ((score >= t["min_score"]) & (ratio <= t["max_ink"])).alias("writable"))


def coarse_scores(pixels: DataFrame, sizes: DataFrame, rows: int = 20, cols: int = 8) -> DataFrame:
    """Emptiness score on a coarse grid: mean brightness times (1 - 3 std)."""
    j = pixels.join(sizes.select(*P, "height", "width"), P)

    def band(pos: str, size: str, n: int) -> Column:
        # bands start at floor(k * size / n), so this is the last k whose start is not after pos
        return (F.ceil((F.col(pos) + 1) * n / F.col(size)) - 1).cast("int")

    v = F.col("value").cast("bigint")
    sums = j.groupBy(*P, band("y", "height", rows).alias("row0"), band("x", "width", cols).alias("col0")).agg(
        F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.count(F.lit(1)).alias("n"))
    mean = F.col("s1") / F.col("n") / 255.0
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") / 65025.0 - mean * mean))
    score = F.least(F.greatest(mean * (F.lit(1.0) - F.least(F.lit(1.0), std * 3.0)), F.lit(0.0)), F.lit(1.0))
    return sums.select(*P, "row0", "col0", score.alias("score"))


def _exact_mean(name: str) -> Column:
    return X.round_even(F.sum(F.rint(F.col(name) * 10000.0).cast("bigint")) / F.count(F.lit(1)) / 10000.0, 4)


def writable_runs(cells: DataFrame, min_len: int = 2) -> DataFrame:
    """Maximal horizontal runs of writable cells per row, with their mean scores."""
    w = Window.partitionBy(*P, "row").orderBy("col")
    free = cells.filter("writable").withColumn("_isl", F.col("col") - F.row_number().over(w))
    return (
        free.groupBy(*P, "row", "_isl")
        .agg(F.min("col").alias("start_col"), F.max("col").alias("end_col"), F.count(F.lit(1)).cast("int").alias("cell_count"),
             _exact_mean("score").alias("mean_score"), _exact_mean("ink_ratio").alias("mean_ink_ratio"))
        .filter(F.col("cell_count") >= min_len)
        .drop("_isl")
        .withColumn("range_id", X.rect_range_id("row", "start_col", "row", "end_col"))
    )


def with_percent(rects: DataFrame, page_grid: DataFrame, r1="row", c1="start_col", r2="row", c2="end_col") -> DataFrame:
    """Add percent bounds (3 places) to runs or regions."""
    j = rects.join(page_grid.select(*P, *GRID_COLUMNS).hint("merge"), P)
    return j.withColumn("_p", X.rect_percent(r1, c1, r2, c2, digits=3)).select(
        *rects.columns, F.col("_p.x1_percent").alias("x_start_percent"), F.col("_p.x2_percent").alias("x_end_percent"),
        F.col("_p.y1_percent").alias("y_start_percent"), F.col("_p.y2_percent").alias("y_end_percent"))


def page_masks(cells: DataFrame, page_grid: DataFrame, flag: str = "writable", taken: DataFrame | None = None) -> DataFrame:
    """One row per page with the grid columns and ``mask``, an array of 0/1 strings, one per row.

    The cells of a page are gathered as numbers, bounded by the page grid, and drawn for many pages at once. Cells that are missing from
    the table count as not writable, and so do those in ``taken`` (doc_id, page, row, col). Joins with the masks are merged by page: Spark takes
    a packed mask for a small value.
    """
    def gathered(df: DataFrame, cond: Column, out: str) -> DataFrame:
        # row and column in one number
        place = F.when(cond & (F.col("row") >= 1) & (F.col("col") >= 1), F.shiftleft(F.col("row").cast("long"), 32) + F.col("col"))
        return df.groupBy(*P).agg(F.collect_list(place).alias(out)).hint("merge")

    j = page_grid.select(*P, *GRID_COLUMNS).join(gathered(cells, F.col(flag), "_set"), P, "left")
    none = F.lit(None).cast("array<bigint>")
    j = j.withColumn("_off", none) if taken is None else j.join(gathered(taken, F.lit(True), "_off"), P, "left")
    return j.withColumn("mask", _drawn("_set", "_off", "rows", "cols")).drop("_set", "_off").hint("merge")


@F.arrow_udf(ArrayType(StringType()))
def _drawn(there: pa.Array, gone: pa.Array, rows: pa.Array, cols: pa.Array) -> pa.Array:
    """Masks of pages from their cells; null for a page without rows or columns given."""
    sized = np.asarray(pc.and_(rows.is_valid(), cols.is_valid()))
    height, width = (np.where(sized, np.maximum(x.fill_null(0).to_numpy(zero_copy_only=False), 0), 0).astype(np.int64) for x in (rows, cols))
    first = np.concatenate([[0], np.cumsum(height * width)])
    bits = np.full(first[-1], ord("0"), dtype=np.uint8)
    for lists, mark in ((there, "1"), (gone, "0")):
        at = pc.list_parent_indices(lists).to_numpy()
        place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row, col = place >> 32, place & 0xFFFFFFFF
        inside = (row <= height[at]) & (col <= width[at])
        at, row, col = at[inside], row[inside], col[inside]
        bits[first[at] + (row - 1) * width[at] + col - 1] = ord(mark)
    ends = np.concatenate([[0], np.cumsum(np.repeat(width, height))])
    lines = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(bits)).cast(pa.string())
    pages = np.concatenate([[0], np.cumsum(height)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(pages), lines, mask=pa.array(~sized))


def page_parts(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """First row and end of each page in a batch that is sorted by page."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for name in P:
        codes = np.asarray(batch[name].dictionary_encode(null_encoding="encode").indices)
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], batch.num_rows]))


def mask_array(mask) -> np.ndarray:
    """Boolean (rows, cols) array of a mask column value."""
    lines = list(mask)
    if not lines:
        return np.zeros((0, 0), dtype=bool)
    return (np.frombuffer("".join(lines).encode(), dtype=np.uint8) == 49).reshape(len(lines), -1)


def maximal_rectangles(free: np.ndarray, min_cells: int, min_dim: int) -> np.ndarray:
    """All maximal all-true rectangles as rows (r1, r2, c1, c2), 1-based inclusive.

    A rectangle with a cell of limiting height in its bottom row cannot grow up,
    left or right; it is maximal when the row below is not free over its width.
    """
    rows, cols = free.shape
    height = np.zeros((rows + 1, cols), dtype=np.int64)
    for r in range(rows):
        height[r + 1] = np.where(free[r], height[r] + 1, 0)
    height = height[1:]
    lower = height[:, None, :] < height[:, :, None]  # [r, c, other]: other column is lower
    idx = np.arange(cols)
    left = np.where(lower & (idx[None, None, :] < idx[None, :, None]), idx[None, None, :], -1).max(axis=2)
    right = np.where(lower & (idx[None, None, :] > idx[None, :, None]), idx[None, None, :], cols).min(axis=2)
    r2, c = np.nonzero(height > 0)
    h, c1, c2 = height[r2, c], left[r2, c] + 1, right[r2, c] - 1
    blocked = np.zeros((rows + 1, cols + 1), dtype=np.int64)
    blocked[:rows, 1:] = np.cumsum(~free, axis=1)
    blocked[rows, 1:] = np.arange(1, cols + 1)  # below the page nothing is free
    grows_down = blocked[r2 + 1, c2 + 1] == blocked[r2 + 1, c1]
    wide = c2 - c1 + 1
    keep = ~grows_down & (h >= min_dim) & (wide >= min_dim) & (h * wide >= min_cells)
    return np.unique(np.stack([r2 - h + 2, r2 + 1, c1 + 1, c2 + 1], axis=1)[keep], axis=0)


def largest_rectangles(free: np.ndarray, min_cells: int = 2, min_dim: int = 2, top: int = 32) -> np.ndarray:
    """The largest maximal rectangles as rows (r1, r2, c1, c2, area), largest first, ties by position."""
    rects = maximal_rectangles(free, min_cells, min_dim)
    area = (rects[:, 1] - rects[:, 0] + 1) * (rects[:, 3] - rects[:, 2] + 1)
    order = np.lexsort((rects[:, 3], rects[:, 1], rects[:, 2], rects[:, 0], -area))[:top]
    return np.column_stack([rects[order], area[order]])


def writable_regions(masks: DataFrame, min_cells: int = 2, min_dim: int = 2, top: int = 32) -> DataFrame:
    """The largest maximal free rectangles per page, R1 first; ties by position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, page, mask in zip(pdf["doc_id"], pdf["page"], pdf["mask"]):
                for n, rect in enumerate(largest_rectangles(mask_array(mask), min_cells, min_dim, top).tolist(), start=1):
                    out.append((doc, page, f"R{n}", n, *rect))
            yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "page", "region_id", "region_no", "row_start", "row_end", "col_start", "col_end", "cell_count"]
    types = dict(masks.select(*P).dtypes)
    schema = (f"doc_id {types['doc_id']}, page {types['page']}, region_id string, region_no int, row_start int, row_end int, "
              "col_start int, col_end int, cell_count int")
    return masks.select(*P, "mask").mapInPandas(run, schema).withColumn(
        "range_id", X.rect_range_id("row_start", "col_start", "row_end", "col_end"))


def region_means(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean score and mean ink of each region, to 4 places. Cells meet only the regions of their page, a bounded number.

    Sums are taken in millionths, so the result doesn't depend on the order of rows.
    """
    def mean(c: str) -> Column:
        return X.round_even(F.sum(F.rint(F.col(c) * 1e6).cast("long")) / F.count(F.lit(1)) / 1e6, 4)

    inside = F.col("row").between(F.col("row_start"), F.col("row_end")) & F.col("col").between(F.col("col_start"), F.col("col_end"))
    bounds = regions.select(*P, "region_no", "row_start", "row_end", "col_start", "col_end").hint("merge")
    means = cells.select(*P, "row", "col", "score", "ink_ratio").join(bounds, P).filter(inside).groupBy(*P, "region_no").agg(
        mean("score").alias("mean_score"), mean("ink_ratio").alias("mean_ink_ratio"))
    return regions.join(means.hint("merge"), [*P, "region_no"], "left")


def region_cell_ids() -> Column:
    """Cell ids of a region row, derived from its bounds."""
    return F.flatten(F.transform(
        F.sequence("row_start", "row_end"),
        lambda r: F.transform(F.sequence("col_start", "col_end"), lambda c: X.cell_id(r, c))))


def marking_hints(regions: DataFrame) -> DataFrame:
    """Likely score-box region per page: right half, mid height, most cells, farthest from the middle.

    ``regions`` carries percent bounds (3 places) from with_percent().
    """
    cx = (F.col("x_start_percent") + F.col("x_end_percent")) / 2.0
    cy = (F.col("y_start_percent") + F.col("y_end_percent")) / 2.0
    near = regions.filter((cx >= 48.0) & cy.between(18.0, 82.0))
    best = F.min_by("range_id", F.struct(-F.col("cell_count"), -F.abs(F.lit(50.0) - cy), F.col("region_no")))
    return near.groupBy(*P).agg(best.alias("hint"))


def blob_regions(masks: DataFrame, connectivity: int = 8, min_cells: int = 3) -> DataFrame:
    """Connected groups of writable cells with their bounds and fill ratio (3 places)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, page, mask in zip(pdf["doc_id"], pdf["page"], pdf["mask"]):
                free = mask_array(mask)
                label = connected_labels(free, connectivity)
                rr, cc = np.nonzero(free)
                for lab in np.unique(label[free]):
                    sel = label[rr, cc] == lab
                    if sel.sum() >= min_cells:
                        r, c = rr[sel] + 1, cc[sel] + 1
                        box = (r.max() - r.min() + 1) * (c.max() - c.min() + 1)
                        out.append((doc, page, int(r.min()), int(r.max()), int(c.min()), int(c.max()), int(sel.sum()),
                                    round(float(sel.sum()) / float(box), 3)))
            yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "page", "row_min", "row_max", "col_min", "col_max", "area_cells", "fill_ratio"]
    types = dict(masks.select(*P).dtypes)
    schema = (f"doc_id {types['doc_id']}, page {types['page']}, row_min int, row_max int, col_min int, col_max int, "
              "area_cells int, fill_ratio double")
    return masks.select(*P, "mask").mapInPandas(run, schema)


def connected_labels(free: np.ndarray, connectivity: int) -> np.ndarray:
    """Smallest cell number of each connected group, spread until nothing changes."""
    rows, cols = free.shape
    big = rows * cols
    lab = np.where(free, np.arange(big).reshape(rows, cols), big)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    if connectivity == 8:
        steps += [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    while True:
        padded = np.full((rows + 2, cols + 2), big, dtype=lab.dtype)
        padded[1:-1, 1:-1] = lab
        nxt = lab
        for dr, dc in steps:
            nxt = np.minimum(nxt, padded[1 + dr:rows + 1 + dr, 1 + dc:cols + 1 + dc])
        nxt = np.where(free, nxt, big)
        # pointer jumping: a label is itself a cell, follow it once
        flat = np.append(nxt.ravel(), big)
        nxt = flat[nxt]
        if np.array_equal(nxt, lab):
            return lab
        lab = nxt
