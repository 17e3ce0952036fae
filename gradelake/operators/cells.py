"""Sets of cells: block cells, free cells, snapping, ranges and occupancy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from gradelake.functions import coords as X
from gradelake.functions.text import page_from_block_id
from gradelake.operators.grid import GRID_COLUMNS, P, page_parts
from gradelake.sources.stages import stored

# One letter per block kind.
KIND_LETTERS = {
    "printed_question": "Q", "handwritten_answer": "A", "marking_box": "M", "header_footer": "H", "instructions": "I",
}


def block_cells(tokens: DataFrame, page_grid: DataFrame, col: str = "token", keep: list[str] | None = None) -> DataFrame:
    """Explode row tokens to in-grid (row, col) cells; bad tokens give none. Joins with the cells are merged, however small the tokens are."""
    keep = keep if keep is not None else [c for c in tokens.columns if c not in ("row", "col", col)]
    t = tokens.join(page_grid.select(*P, "rows", "cols"), P)
    # inline() is a step of its own in the plan, so each token is parsed once
    parsed = t.select(*keep, F.inline(F.array(X.clipped_token(col, "rows", "cols"))))
    return parsed.filter("row IS NOT NULL").select(*keep, "row", F.explode(F.sequence("c1", "c2")).alias("col")).hint("merge")


def block_page(block_id="block_id") -> Column:
    """Page of a block from its id; ids without a page prefix belong to page 1."""
    return F.coalesce(page_from_block_id(block_id), F.lit(1))


def free_cells(cells: DataFrame, occupied: DataFrame) -> DataFrame:
    """Writable cells not covered by any block cell of the page."""
    on = [*P, "row", "col"]
    return cells.filter("writable").select(*on).join(occupied.select(*on), on, "left_anti")


def distinct_cells(tokens: DataFrame, page_grid: DataFrame, keys: list[str], col: str = "token") -> DataFrame:
    """Distinct in-grid cells of all tokens per key (union of ranges)."""
    return block_cells(tokens, page_grid, col, keys).distinct()


def snap_blocks(blocks: DataFrame, cells: DataFrame, page_grid: DataFrame) -> DataFrame:
    """Clamp block tokens to the grid and, for handwriting, to inked cells.

    Per token the kept columns shrink to first..last. A handwriting block with
    no inked cell at all keeps its in-grid cells; with none of those it is dropped.
    ``blocks`` has doc_id, page, block_id, kind, token and a token position ``row``.
    """
    key = [*P, "block_id"]
    spread = block_cells(blocks.withColumn("_tok", F.col("row")), page_grid, "token", [*key, "kind", "_tok"])
    inked = spread.join(cells.select(*P, "row", "col", F.col("writable").alias("_w")), [*P, "row", "col"])
    hand = F.col("kind") == "handwritten_answer"
    usable = ~hand | ~F.col("_w")
    per_token = inked.groupBy(*key, "kind", "_tok", "row").agg(
        F.min("col").alias("a1"), F.max("col").alias("a2"),
        F.min(F.when(usable, F.col("col"))).alias("u1"), F.max(F.when(usable, F.col("col"))).alias("u2"))
    any_ink = F.max(F.col("u1").isNotNull().cast("int")).over(Window.partitionBy(*key)) == 1
    lo, hi = F.when(F.col("_any"), F.col("u1")).otherwise(F.col("a1")), F.when(F.col("_any"), F.col("u2")).otherwise(F.col("a2"))
    return per_token.withColumn("_any", any_ink).withColumns({"c1": lo, "c2": hi}).filter("c1 IS NOT NULL").select(
        *key, "kind", "row", X.rect_range_id("row", "c1", "row", "c2").alias("token"))


def bounding(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding rectangle and range id of the cells per key."""
    return cells.groupBy(*keys).agg(
        F.min("row").alias("r1"), F.min("col").alias("c1"), F.max("row").alias("r2"), F.max("col").alias("c2")
    ).withColumn("range_id", X.rect_range_id("r1", "c1", "r2", "c2"))


def bounding_boxes(cells: DataFrame, keys: list[str], page_grid: DataFrame) -> DataFrame:
    """Bounding percent box (2 places) of the cells per key; keys include doc_id and page."""
    b = bounding(cells, keys).join(page_grid.select(*P, *GRID_COLUMNS), P)
    return b.withColumn("_b", X.rect_percent("r1", "c1", "r2", "c2")).select(*keys, "range_id", "_b.*")


def compact_ranges(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Row segments of a cell set: one row per maximal run, with its token."""
    keys = keys or P
    unique = cells.select(*keys, "row", "col").distinct()
    w = Window.partitionBy(*keys, "row").orderBy("col")
    return (
        unique.withColumn("_isl", F.col("col") - F.row_number().over(w)).groupBy(*keys, "row", "_isl")
        .agg(F.min("col").alias("c1"), F.max("col").alias("c2")).drop("_isl")
        .withColumn("token", X.rect_range_id("row", "c1", "row", "c2")))


def ranges_payload(segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ordered token array per key; bounded by the page grid."""
    keys = keys or P
    item = F.struct("row", "c1", "token")
    return segments.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["token"]).alias("tokens"))


def spatial_payload(free: DataFrame, occupied: DataFrame) -> DataFrame:
    """FREE and OCCUPIED token arrays per page."""
    f = ranges_payload(compact_ranges(free)).withColumnRenamed("tokens", "free")
    o = ranges_payload(compact_ranges(occupied)).withColumnRenamed("tokens", "occupied")
    none = F.array().cast("array<string>")
    return f.join(o, P, "full").select(*P, F.coalesce("free", none).alias("free"), F.coalesce("occupied", none).alias("occupied"))


def cells_in_rect(rects: DataFrame, page_grid: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose centre lies in a percent rectangle (x1, y1, x2, y2; corners may be swapped).

    The grid is uniform, so candidate rows and columns follow from the bounds;
    no join against the cell table is needed. Centres come from bounds rounded
    to 3 places.
    """
    j = rects.join(page_grid.select(*P, *GRID_COLUMNS), P)
    cs = F.col("cell_size_pts")

    def candidates(lo, hi, margin, full, n):
        first = F.greatest(F.lit(1), F.floor((lo / 100.0 * F.col(full) - F.col(margin)) / cs).cast("int"))
        last = F.least(F.col(n), F.ceil((hi / 100.0 * F.col(full) - F.col(margin)) / cs).cast("int") + 1)
        none = F.array().cast("array<int>")
        return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(none)

    def centre(k, margin, full):
        a = X.round_even((F.col(margin) + (F.col(k) - 1) * cs) / F.col(full) * 100.0, 3)
        b = X.round_even((F.col(margin) + F.col(k) * cs) / F.col(full) * 100.0, 3)
        return (a + b) / 2.0

    lx, hx = F.least("x1", "x2"), F.greatest("x1", "x2")
    ly, hy = F.least("y1", "y2"), F.greatest("y1", "y2")
    spread = j.withColumn("row", F.explode(candidates(ly, hy, "top_margin_pts", "page_h_pts", "rows"))).withColumn(
        "col", F.explode(candidates(lx, hx, "left_margin_pts", "page_w_pts", "cols")))
    return spread.filter(
        centre("row", "top_margin_pts", "page_h_pts").between(ly, hy) & centre("col", "left_margin_pts", "page_w_pts").between(lx, hx)
    ).select(*keys, "row", "col")


def occupancy(blocks: DataFrame, comments: DataFrame, page_grid: DataFrame) -> DataFrame:
    """One text line per grid row showing what covers each cell.

    ``blocks`` (doc_id, page, block_pos, kind, token) in block order: the first
    block wins a cell, but an answer replaces a printed question. Comments
    (doc_id, page, token) cover everything with ``*``; ``.`` is free.
    """
    letters = F.create_map(*[F.lit(x) for kv in KIND_LETTERS.items() for x in kv])
    b = block_cells(blocks, page_grid, "token", [*P, "block_pos", "kind"]).withColumn(
        "ch", F.coalesce(F.try_element_at(letters, F.col("kind")), F.lit("#")))
    on = [*P, "row", "col"]
    claim = b.groupBy(*on).agg(F.min_by("ch", "block_pos").alias("first"), F.bool_or(F.col("ch") == "A").alias("answered"))
    shown = claim.select(*on, F.when((F.col("first") == "Q") & F.col("answered"), "A").otherwise(F.col("first")).alias("ch"),
                         F.lit(1).alias("prio"))
    notes = block_cells(comments, page_grid, "token", P).select(*on, F.lit("*").alias("ch"), F.lit(0).alias("prio"))
    top = shown.unionByName(notes).groupBy(*on).agg(F.min_by("ch", "prio").alias("ch"))
    lines = top.groupBy(*P, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "ch"))).alias("m"))
    grid = page_grid.select(*P, "cols", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"))
    text = F.array_join(
        F.transform(F.sequence(F.lit(1), F.col("cols")),
                    lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit("."))), "")
    return grid.join(lines, [*P, "row"], "left").select(*P, "row", F.coalesce(text, F.repeat(F.lit("."), F.col("cols"))).alias("line"))


def slot_pool(cells: DataFrame, page_grid: DataFrame, slots: int = 20) -> DataFrame:
    """Horizontal strips of a page and the writable area inside each.

    A cell belongs to the strip that holds it fully; a strip without one falls
    back to the right margin.
    """
    h = 100.0 / slots
    grid = page_grid.select(*P, *GRID_COLUMNS)
    w = cells.filter("writable").select(*P, "row", "col").join(grid, P).withColumn("_r", X.rect_percent("row", "col", "row", "col", 3))
    slot = F.floor(F.col("_r.y1_percent") / h).cast("int")
    inside = w.withColumn("slot", slot).filter(
        (F.col("_r.y2_percent") <= F.least(F.lit(100.0), (F.col("slot") + 1) * F.lit(h))) & (F.col("slot") < slots))
    boxes = inside.groupBy(*P, "slot").agg(
        F.min("_r.x1_percent").alias("x1"), F.min("_r.y1_percent").alias("y1"), F.max("_r.x2_percent").alias("x2"), F.max("_r.y2_percent").alias("y2"))
    every = grid.select(*P, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    y = F.col("slot") * F.lit(h)
    return every.join(boxes, [*P, "slot"], "left").select(
        *P, "slot", X.round_even(F.coalesce("x1", F.lit(87.5)), 2).alias("x1_percent"), X.round_even(F.coalesce("y1", y), 2).alias("y1_percent"),
        X.round_even(F.coalesce("x2", F.lit(100.0)), 2).alias("x2_percent"), X.round_even(F.coalesce("y2", y + h), 2).alias("y2_percent"))


def anchor_rows(tokens: DataFrame, page_grid: DataFrame, keys: list[str]) -> DataFrame:
    """Mean row of the anchor cells, half to even; mid page without any. keys include doc_id, page."""
    c = distinct_cells(tokens, page_grid, keys)
    mean = c.groupBy(*keys).agg((F.sum("row") / F.count(F.lit(1))).alias("m"))
    base = tokens.select(*keys).distinct().join(page_grid.select(*P, "rows"), P)
    mid = F.greatest(F.lit(1), F.floor(F.col("rows") / F.lit(2.0)).cast("int"))
    return base.join(mean, keys, "left").select(*keys, F.coalesce(F.rint("m").cast("int"), mid).alias("anchor_row"))


def verify_grid(api: DataFrame, service: DataFrame) -> DataFrame:
    """Compare grid metadata per page; counts differing columns."""
    s = service.select(*P, *[F.col(c).alias(f"s_{c}") for c in GRID_COLUMNS])
    diff = sum((F.col(c).eqNullSafe(F.col(f"s_{c}")) == F.lit(False)).cast("int") for c in GRID_COLUMNS)
    return api.join(s, P).select(*P, diff.alias("differences"), (diff == 0).alias("matches"))


def verify_boxes(annotations: DataFrame, page_grid: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Recompute boxes from cell_ids; flags mismatches and counts cells off the grid.

    ``annotations``: doc_id, page, keys..., cell_ids array<string>, x1_percent .. y2_percent.
    """
    j = annotations.join(page_grid.select(*P, *GRID_COLUMNS), P).withColumn(
        "_rc", F.transform("cell_ids", lambda c: F.struct(X.cell_row(c).alias("r"), X.cell_col(c).alias("c"))))
    rs, cs = F.transform("_rc", lambda x: x["r"]), F.transform("_rc", lambda x: x["c"])
    box = X.rect_percent(F.array_min(rs), F.array_min(cs), F.array_max(rs), F.array_max(cs))
    off = F.size(F.filter("_rc", lambda x: (x["r"] < 1) | (x["r"] > F.col("rows")) | (x["c"] < 1) | (x["c"] > F.col("cols"))))
    names = ["x1_percent", "y1_percent", "x2_percent", "y2_percent"]
    k = j.withColumn("_b", box)
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.abs(F.col(f"_b.{n}") - F.col(n)) < tolerance)
    return k.select(*[c for c in annotations.columns if c not in ("cell_ids", *names)], ok.alias("box_ok"), off.alias("out_of_range"))


def anchor_cells(points: DataFrame, page_grid: DataFrame) -> DataFrame:
    """``anchor_row`` and ``anchor_col`` of percent points (doc_id, page, x_percent, y_percent).

    Of the cells that hold the point the one with the closest centre, else the cell with the closest centre, and (1, 1)
    on a page without a grid. Edges are percentages to 3 places; points off the page move to its edge.
    """
    def near(at: Column, n: str, margin: str, size: str, length: str) -> Column:
        def edge(k: Column) -> Column:
            return X.round_even((F.col(margin) + k * F.col(size)) / F.col(length) * 100.0, 3)

        return F.transform(F.sequence(F.lit(1), F.col(n)), lambda k: F.struct(
            F.pow((edge(k - 1) + edge(k)) / 2.0 - at, F.lit(2.0)).alias("d"), k.alias("k"), at.between(edge(k - 1), edge(k)).alias("holds")))

    def held(name: str) -> Column:
        return F.filter(name, lambda c: c["holds"])

    x, y = (F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(c))) for c in ("x_percent", "y_percent"))
    j = points.join(page_grid.select(*P, *GRID_COLUMNS), P, "left").withColumns({
        "_x": near(x, "cols", "left_margin_pts", "cell_size_pts", "page_w_pts"), "_y": near(y, "rows", "top_margin_pts", "cell_size_pts", "page_h_pts")})
    both = (F.size(held("_x")) > 0) & (F.size(held("_y")) > 0)

    def pick(name: str) -> Column:
        return F.coalesce(F.array_min(F.when(both, held(name)).otherwise(F.col(name)))["k"], F.lit(1))

    return j.select(*points.columns, pick("_y").alias("anchor_row"), pick("_x").alias("anchor_col"))


#: Finest bins of ``nearest_cells``: 2 ** LEVELS to a side of the page for cells that may hold a point, 2 ** NEAR for the closest centres.
LEVELS, NEAR = 6, 4
#: A page with more cells or points than these is crowded: its points and cells are spread over bins.
PAGE_CELLS, PAGE_POINTS = 4096, 1_000_000
EDGES = ["x_start_percent", "x_end_percent", "y_start_percent", "y_end_percent"]


def nearest_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``anchor_row`` and ``anchor_col`` of percent points (doc_id, page, x_percent, y_percent, ...) on any set of rectangles.

    ``cells``: doc_id, page, row, col and x_start_percent, x_end_percent, y_start_percent, y_end_percent; they may overlap, leave gaps and differ in size.
    Of the cells that hold the point the one with the closest centre, else the cell with the closest centre, and (1, 1) on a page without cells; of equally
    close ones the first by row and column. Points off the page move to its edge. Cells without all four edges are left out.

    Points and cells are stored once and shuffled once, by page: a task keeps the cells of one page and reads its points as a stream. Crowded pages
    (see ``PAGE_CELLS`` and ``PAGE_POINTS``) are spread over bins instead.
    """
    spots = stored(points.select(F.struct(*points.columns).alias("_row"), *P, _on_page(F.col("x_percent")).alias("_x"), _on_page(F.col("y_percent")).alias("_y")), "spots")
    whole = stored(cells.dropna(subset=[*P, *EDGES]).select(*P, "row", "col", *EDGES), "loose-cells")
    crowded = stored(_pages_above(whole, PAGE_CELLS).unionByName(_pages_above(spots, PAGE_POINTS)).distinct(), "crowded-pages")
    if crowded.isEmpty():
        found = _nearest_by_page(spots, whole)
    else:
        few = [df.join(crowded, P, "left_anti") for df in (spots, whole)]
        many = [df.join(crowded, P, "left_semi") for df in (spots, whole)]
        found = _nearest_by_page(*few).unionByName(_nearest_by_bins(*many))
    return found.select("_row.*", F.coalesce("best_row", F.lit(1)).alias("anchor_row"), F.coalesce("best_col", F.lit(1)).alias("anchor_col"))


def _on_page(c) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))


def _pages_above(df: DataFrame, most: int) -> DataFrame:
    return df.dropna(subset=P).groupBy(*P).count().filter(F.col("count") > most).select(*P)


def _nearest_by_page(spots: DataFrame, whole: DataFrame) -> DataFrame:
    """(_row, best_row, best_col) of spots; the cells of a page come first in its stream, ordered by row and column."""
    far = F.lit(float("inf"))
    a, b, c, d = (F.col(e) for e in EDGES)
    sides = [F.nanvl(e.cast("double"), far).alias(e_) for e, e_ in zip((a, b, c, d), EDGES)]
    first = whole.select(*P, F.lit(0).alias("_k"), "row", "col", *sides, F.nanvl((a + b) / 2.0, far).alias("_x"), F.nanvl((c + d) / 2.0, far).alias("_y"))
    # an explicit number keeps small but compute-heavy shuffles from being merged into one task
    tasks = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = first.unionByName(spots.select(*P, F.lit(1).alias("_k"), "_x", "_y", "_row"), allowMissingColumns=True)
    stream = both.repartition(tasks, *P).sortWithinPartitions(*P, "_k", "row", "col")
    schema = StructType([spots.schema["_row"], *[StructField(f"best_{c}", whole.schema[c].dataType) for c in ("row", "col")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            points = np.flatnonzero(batch["_k"].to_numpy())
            best = {"row": [], "col": []}
            for lo, hi in page_parts(batch):
                now = (batch["doc_id"][lo].as_py(), batch["page"][lo].as_py())
                if now != page:
                    page, held = now, []
                cut = hi - int(np.searchsorted(points, hi) - np.searchsorted(points, lo))  # cells from lo, points from there
                if cut > lo:
                    held.append(batch.slice(lo, cut - lo))
                if hi > cut:
                    held = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]] if len(held) > 1 else held
                    for name, values in zip(best, _closest(held, batch["_x"].to_numpy()[cut:hi], batch["_y"].to_numpy()[cut:hi], arrow)):
                        best[name].append(values)
            if len(points):
                rows = [pa.concat_arrays(best[name]) for name in best]
                yield pa.RecordBatch.from_arrays([batch["_row"].take(pa.array(points)).cast(arrow.field(0).type), *rows], schema=arrow)

    return stream.mapInArrow(run, schema)


def _closest(held: list[pa.RecordBatch], x: np.ndarray, y: np.ndarray, arrow: pa.Schema, block: int = 1 << 20) -> list[pa.Array]:
    """Row and column of the best cell for each point of a page; nulls where the page has no cells."""
    if not held:
        return [pa.nulls(len(x), arrow.field(k).type) for k in (1, 2)]
    cells = held[0]
    x1, x2, y1, y2, cx, cy = (cells[c].to_numpy()[None, :] for c in (*EDGES, "_x", "_y"))
    best, step = np.empty(len(x), dtype=np.int64), max(1, block // cells.num_rows)
    for lo in range(0, len(x), step):
        px, py = x[lo:lo + step, None], y[lo:lo + step, None]
        # squares beyond all numbers stay behind the others, and before those of cells that do not hold the point
        with np.errstate(over="ignore"):
            away = np.minimum((cx - px) ** 2 + (cy - py) ** 2, 1e300)
        holds = (x1 <= px) & (px <= x2) & (y1 <= py) & (py <= y2)
        away[holds.any(axis=1)[:, None] & ~holds] = np.inf
        best[lo:lo + step] = away.argmin(axis=1)  # the first of equals
    return [cells[c].take(pa.array(best)).cast(arrow.field(k).type) for k, c in ((1, "row"), (2, "col"))]


def _nearest_by_bins(spots: DataFrame, whole: DataFrame) -> DataFrame:
    """(_row, best_row, best_col) of spots by equi joins on bins, which spread a crowded page.

    A cell lies in at most four bins of the level that fits its size, so a
    point looks for its holders in one bin per level. The closest centre is looked for in the three by three bins around the point, on ever
    coarser levels: what is found within one bin's width is settled, and only the rest goes on.
    """
    def bin_of(c, level) -> Column:
        n = F.pow(F.lit(2.0), level)
        return F.least(n - 1, F.floor(_on_page(c) / 100.0 * n)).cast("int")

    def away(x: str, y: str) -> Column:
        return F.pow(F.col("cx") - F.col(x), F.lit(2.0)) + F.pow(F.col("cy") - F.col(y), F.lit(2.0))

    edges = EDGES
    spots = stored(spots.withColumn("_id", F.monotonically_increasing_id()), "crowded-spots")
    whole = whole.withColumns({"cx": (F.col(edges[0]) + F.col(edges[1])) / 2.0, "cy": (F.col(edges[2]) + F.col(edges[3])) / 2.0})
    size = F.greatest(_on_page(F.col(edges[1])) - _on_page(F.col(edges[0])), _on_page(F.col(edges[3])) - _on_page(F.col(edges[2])), F.lit(0.0))
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(100.0 / F.greatest(size, F.lit(0.001)))).cast("int")))
    bins = whole.withColumn("level", level).filter((F.col(edges[0]) <= F.col(edges[1])) & (F.col(edges[2]) <= F.col(edges[3])))
    bins = bins.withColumn("bx", F.explode(F.sequence(bin_of(F.col(edges[0]), F.col("level")), bin_of(F.col(edges[1]), F.col("level"))))).withColumn(
        "by", F.explode(F.sequence(bin_of(F.col(edges[2]), F.col("level")), bin_of(F.col(edges[3]), F.col("level")))))
    looks = spots.select("_id", *P, "_x", "_y", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    looks = looks.withColumns({"bx": bin_of(F.col("_x"), F.col("level")), "by": bin_of(F.col("_y"), F.col("level"))})
    holds = F.col("_x").between(F.col(edges[0]), F.col(edges[1])) & F.col("_y").between(F.col(edges[2]), F.col(edges[3]))
    best = F.min(F.struct(away("_x", "_y").alias("d"), "row", "col")).alias("best")
    found = [looks.join(bins, [*P, "level", "bx", "by"]).filter(holds).groupBy("_id").agg(best)]
    open_ = stored(spots.drop("_row").join(found[0].select("_id"), "_id", "left_anti").join(whole.select(*P).distinct(), P, "left_semi"), "open-spots")
    for k in range(NEAR, -1, -1):
        if open_.isEmpty():
            break
        mine = whole.withColumns({"bx": bin_of(F.col("cx"), F.lit(k)), "by": bin_of(F.col("cy"), F.lit(k))})
        near = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct(
            (bin_of(F.col("_x"), F.lit(k)) + i).alias("bx"), (bin_of(F.col("_y"), F.lit(k)) + j).alias("by"))))))
        around = open_.withColumn("_n", near).select("_id", *P, "_x", "_y", "_n.bx", "_n.by")
        tried = stored(open_.join(around.join(mine, [*P, "bx", "by"]).groupBy("_id").agg(best), "_id", "left"), "tried-spots")
        # a centre beyond the nine bins is farther away than one bin is wide; equally far ones could still come first
        settled = F.coalesce(F.col("best.d") < (100.0 / 2**k) ** 2, F.lit(False)) if k else F.lit(True)
        found.append(tried.filter(settled).select("_id", "best"))
        open_ = tried.filter(~settled).drop("best")
    every = reduce(lambda a, b: a.unionByName(b), found)
    return spots.join(every, "_id", "left").select("_row", F.col("best.row").alias("best_row"), F.col("best.col").alias("best_col"))
