"""Placement of comments in free cells.

The greedy placements are sequential by nature: each comment sees what the
earlier ones on its page took. Pages are independent, so the work spreads by
page; within one the rows are streamed (see stateful.run_sequential).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradelake.functions import coords as X
from gradelake.functions.glyphs import cells_needed
from gradelake.functions.scoring import layout_position, layout_positions
from gradelake.operators.grid import P, largest_rectangles, mask_array
from gradelake.operators.keyed import block_of, first_wins, split_rank
from gradelake.operators.stateful import run_sequential

# Search limits of the placement rules.
WRAP_ROWS, NEAR_SHAPES, LONGEST_RUNS, MAX_DRIFT_ROWS, SLOTS = 3, 8, 5, 8, 20


def nearest_shapes(anchors: DataFrame, regions: DataFrame, k: int = 8, min_rows: int = 1, min_cols: int = 1) -> DataFrame:
    """The k regions nearest to each anchor among those at least min_rows x min_cols.

    A page has at most 32 regions, so they travel as one array per page and the
    ranking happens inside the row.
    """
    shape = F.struct("region_no", "row_start", "row_end", "col_start", "col_end", "range_id")
    packed = regions.filter(
        (F.col("row_end") - F.col("row_start") + 1 >= min_rows) & (F.col("col_end") - F.col("col_start") + 1 >= min_cols)
    ).groupBy(*P).agg(F.collect_list(shape).alias("_s"))

    def keyed(s):
        dist = F.hypot((s["row_start"] + s["row_end"]) / 2.0 - F.col("anchor_row"), (s["col_start"] + s["col_end"]) / 2.0 - F.col("anchor_col"))
        return F.struct(dist.alias("d"), s["region_no"].alias("n"), s.alias("s"))

    j = anchors.join(packed, P)
    best = F.slice(F.array_sort(F.transform("_s", keyed)), 1, k)
    return j.select(*anchors.columns, F.posexplode(best).alias("rank", "_x")).select(
        *anchors.columns, (F.col("rank") + 1).alias("rank"), F.col("_x.d").alias("distance"), "_x.s.*")


# ---- page state -----------------------------------------------------------

class PageState:
    """Free cells of one page and what placements have taken so far."""

    def __init__(self, h: dict):
        self.h = h
        self.free = mask_array(h["mask"])
        self.taken = np.zeros_like(self.free)
        self.rows, self.cols = self.free.shape
        size = h["cell_size_pts"]
        edge_x = [round((h["left_margin_pts"] + k * size) / h["page_w_pts"] * 100.0, 3) for k in range(self.cols + 1)]
        edge_y = [round((h["top_margin_pts"] + k * size) / h["page_h_pts"] * 100.0, 3) for k in range(self.rows + 1)]
        self.ex, self.ey = np.array(edge_x), np.array(edge_y)
        self.cx, self.cy = (self.ex[:-1] + self.ex[1:]) / 2.0, (self.ey[:-1] + self.ey[1:]) / 2.0
        self.runs = row_runs(self.free)
        self.slots = None
        self._regions = None

    @property
    def regions(self) -> np.ndarray:
        """Largest free rectangles (r1, r2, c1, c2, area), 1-based, found when first needed."""
        if self._regions is None:
            self._regions = largest_rectangles(self.free)
        return self._regions

    def in_rect(self, x1, y1, x2, y2):
        """Rows and columns of cells whose centre lies in a percent rectangle."""
        x1, x2, y1, y2 = min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2)
        c = np.nonzero((self.cx >= x1) & (self.cx <= x2))[0]
        r = np.nonzero((self.cy >= y1) & (self.cy <= y2))[0]
        return [(int(a), int(b)) for a in r for b in c]

    def take(self, cells):
        for r, c in cells:
            self.taken[r, c] = True

    def anchor(self, x, y):
        """0-based cell holding a percent point, else the nearest one."""
        x, y = min(100.0, max(0.0, x)), min(100.0, max(0.0, y))
        in_x = np.nonzero((self.ex[:-1] <= x) & (x <= self.ex[1:]))[0]
        in_y = np.nonzero((self.ey[:-1] <= y) & (y <= self.ey[1:]))[0]
        if not (len(in_x) and len(in_y)):
            in_x, in_y = np.arange(self.cols), np.arange(self.rows)
        return int(in_y[np.argmin((self.cy[in_y] - y) ** 2)]), int(in_x[np.argmin((self.cx[in_x] - x) ** 2)])

    def wrap_from(self, open_, row, col, need):
        """Walk right from a cell, wrapping to the next rows, until ``need`` cells are found."""
        out = []
        for r in range(row, min(row + WRAP_ROWS, self.rows)):
            c = col if r == row or open_[r, col] else 0
            line = open_[r, c:]
            stop = np.nonzero(~line)[0]
            length = min(int(stop[0]) if len(stop) else len(line), need - len(out))
            out.extend((r, k) for k in range(c, c + length))
            if len(out) >= need:
                break
        return out if len(out) >= need else None

    def by_runs(self, need, x, y):
        """Cells for a comment of ``need`` cells: the anchor row, near runs, then the longest runs."""
        if need <= 0:
            return []
        open_ = self.free & ~self.taken
        if not open_.any():
            return []
        ar, ac = self.anchor(x, y)
        col = ac
        if not open_[ar, ac]:
            right, left = np.nonzero(open_[ar, ac:])[0], np.nonzero(open_[ar, :ac])[0]
            col = ac + int(right[0]) if len(right) else (int(left[0]) if len(left) else ac)
        if open_[ar, col]:
            got = self.wrap_from(open_, ar, col, need)
            if got:
                return got
        if not len(self.runs):
            return []
        length = self.runs[:, 2] - self.runs[:, 1] + 1
        # centres and anchor are compared in 1-based cell numbers
        dist = np.hypot(self.runs[:, 0] - ar, (self.runs[:, 1] + self.runs[:, 2]) / 2.0 - ac)
        near = np.lexsort((np.arange(len(length)), -length, dist))[:NEAR_SHAPES]
        longest = np.lexsort((np.arange(len(length)), -length))[:LONGEST_RUNS]
        for k in [*near, *longest]:
            got = self.wrap_from(open_, int(self.runs[k, 0]), int(self.runs[k, 1]), need)
            if got:
                return got
        return []

    def box(self, cells):
        r, c = [a for a, _ in cells], [b for _, b in cells]
        return [round(float(v), 2) for v in (self.ex[min(c)], self.ey[min(r)], self.ex[max(c) + 1], self.ey[max(r) + 1])]

    def box_from_points(self, cells):
        h, s = self.h, self.h["cell_size_pts"]
        r, c = [a for a, _ in cells], [b for _, b in cells]
        x = [(h["left_margin_pts"] + k * s) / h["page_w_pts"] * 100.0 for k in (min(c), max(c) + 1)]
        y = [(h["top_margin_pts"] + k * s) / h["page_h_pts"] * 100.0 for k in (min(r), max(r) + 1)]
        return [round(x[0], 2), round(y[0], 2), round(x[1], 2), round(y[1], 2)]

    def nearest_slot(self, y):
        """Claim the unused horizontal strip whose middle is nearest to y; None when all are used."""
        if self.slots is None:
            self.slots = page_slots(self)
        left = [k for k in self.slots if k is not None]
        if not left:
            return None
        best = min(left, key=lambda s: abs(s[0] - y))
        self.slots[self.slots.index(best)] = None
        return best[1]


def row_runs(free: np.ndarray) -> np.ndarray:
    """Runs of free cells as rows (row, first, last), 0-based, row-major."""
    padded = np.pad(free.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    r1, c1 = np.nonzero(step == 1)
    _, c2 = np.nonzero(step == -1)
    return np.stack([r1, c1, c2 - 1], axis=1)


def page_slots(p: PageState) -> list:
    out, h = [], 100.0 / SLOTS
    for i in range(SLOTS):
        y1, y2 = i * h, min(100.0, (i + 1) * h)
        rows = np.nonzero((p.ey[:-1] >= y1) & (p.ey[1:] <= y2))[0]
        rr, cc = np.nonzero(p.free[rows]) if len(rows) else (np.array([]), np.array([]))
        if len(rr):
            box = [p.ex[cc.min()], p.ey[rows[rr.min()]], p.ex[cc.max() + 1], p.ey[rows[rr.max()] + 1]]
        else:
            box = [87.5, y1, 100.0, y2]
        out.append(((y1 + y2) / 2.0, [round(float(v), 2) for v in box]))
    return out


def free_strip_box(x1, x2, y, clip_both: bool) -> list[float]:
    """Box around an annotation's own position, three percent high."""
    lo, hi = max(0.0, x1), min(100.0, x2)
    if clip_both:
        lo, hi = min(100.0, lo), max(0.0, hi)
    return [round(lo, 2), round(max(0.0, y - 1.5), 2), round(hi, 2), round(min(100.0, y + 1.5), 2)]


def _letters(c: int) -> str:
    out = ""
    while c > 0:
        c, k = divmod(c - 1, 26)
        out = chr(65 + k) + out
    return out


def _ids(cells) -> list[str]:
    return [f"{_letters(c + 1)}{r + 1}" for r, c in cells]


def _span(cells) -> str:
    if not cells:
        return ""
    r, c = [a for a, _ in cells], [b for _, b in cells]
    a, b = f"{_letters(min(c) + 1)}{min(r) + 1}", f"{_letters(max(c) + 1)}{max(r) + 1}"
    return a if a == b else f"{a}:{b}"


def _events(items: DataFrame, annotations: DataFrame, page_grid: DataFrame, boxes_first: bool, font: float) -> DataFrame:
    """Score boxes and annotations of each page as one ordered list of events.

    A score box counts before all annotations, or when its item is reached.
    """
    box = items.filter("marking_box_page IS NOT NULL").select(
        "doc_id", F.col("marking_box_page").alias("page"), (F.lit(-1) if boxes_first else F.col("item_index")).alias("o1"),
        F.lit(-1).alias("o2"), F.lit(True).alias("is_box"), F.col("box_x1").alias("x1"), F.col("box_y1").alias("y1"),
        F.col("box_x2").alias("x2"), F.col("box_y2").alias("y2"), F.lit(0).alias("need"), F.lit(None).cast("array<string>").alias("comment_rows"))
    sized = annotations.join(page_grid.select(*P, "cell_size_pts"), P, "left")
    rows = F.col("comment_rows") if "comment_rows" in annotations.columns else F.lit(None).cast("array<string>")
    x1 = F.coalesce("x_start_percent", F.lit(50.0))
    y = F.coalesce("y_position_percent", F.lit(50.0))
    ann = sized.select(
        *P, F.col("item_index").alias("o1"), F.col("annotation_index").alias("o2"), F.lit(False).alias("is_box"), x1.alias("x1"), y.alias("y1"),
        F.coalesce("x_end_percent", F.least(F.lit(100.0), x1 + 20.0)).alias("x2"), y.alias("y2"),
        F.coalesce(cells_needed("comment", font, "cell_size_pts"), F.lit(0)).alias("need"), rows.alias("comment_rows"))
    return box.unionByName(ann)


def run_cells(annotations: DataFrame, masks: DataFrame, font: float = 11.0) -> DataFrame:
    """Cells by runs only, every annotation on its own: nothing is reserved between them.

    There is no state, so a page with very many annotations may be split over tasks.
    """
    types = dict(annotations.dtypes)
    keys = [*P, "item_index", "annotation_index"]
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", cell_ids array<string>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    j = annotations.join(masks, P, "left").select(
        *keys, F.coalesce("x_start_percent", F.lit(50.0)).alias("x"), F.coalesce("y_position_percent", F.lit(50.0)).alias("y"),
        cells_needed("comment", font, "cell_size_pts").alias("need"), F.struct(*[c for c in masks.columns if c not in P]).alias("h"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, state = None, None
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if (e["doc_id"], e["page"]) != page:
                    page, state = (e["doc_id"], e["page"]), PageState(e["h"]) if e["h"]["mask"] else None
                cells = state.by_runs(e["need"], e["x"], e["y"]) if state else []
                out.append({**{k: e[k] for k in keys}, "cell_ids": _ids(cells)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return j.mapInArrow(place, schema)


def place_boxes(items: DataFrame, annotations: DataFrame, masks: DataFrame, page_grid: DataFrame, font: float = 11.0) -> DataFrame:
    """A box for every annotation: free cells (1), a horizontal strip (2), or its own position (3).

    All score boxes of a page are reserved before any annotation.
    """
    types = dict(annotations.dtypes)
    schema = (f"doc_id {types['doc_id']}, page {types['page']}, item_index {types['item_index']}, annotation_index {types['annotation_index']}, "
              "tier int, x1_percent double, y1_percent double, x2_percent double, y2_percent double")

    def step(state, e):
        if e["is_box"]:
            if state is not None:
                state.take(state.in_rect(e["x1"], e["y1"], e["x2"], e["y2"]))
            return None
        box, tier = None, 3
        if state is not None:
            cells = state.by_runs(e["need"], e["x1"], e["y1"])
            if cells:
                state.take(cells)
                box, tier = state.box(cells), 1
            else:
                box, tier = state.nearest_slot(e["y1"]), 2
        if box is None:
            box, tier = free_strip_box(e["x1"], e["x2"], e["y1"], False), 3
        return {"doc_id": e["doc_id"], "page": e["page"], "item_index": e["o1"], "annotation_index": e["o2"], "tier": tier,
                "x1_percent": box[0], "y1_percent": box[1], "x2_percent": box[2], "y2_percent": box[3]}

    events = _events(items, annotations, page_grid, True, font)
    return run_sequential(events, masks, P, ["o1", "o2"], schema, PageState, step)


def _block_scores(state: PageState, taken_sum, ar, ac, nr, nc):
    """Score of the nr x nc block that starts at each cell of the page, lower is better; infinite where it covers taken cells."""
    used = taken_sum[nr:, nc:] - taken_sum[:-nr, nc:] - taken_sum[nr:, :-nc] + taken_sum[:-nr, :-nc]
    r, c = np.arange(1, used.shape[0] + 1)[:, None], np.arange(1, used.shape[1] + 1)[None, :]
    score = np.hypot(r + nr / 2.0 - ar, c + nc / 2.0 - ac)
    score = score + 3.0 * (c <= 1) + 3.0 * (c + nc - 1 >= state.cols) + max(0.0, nc / max(1, nr) - 8.0) * 0.3
    score[used > 0] = np.inf
    return score


def _carve(scores, rg, ar, ac, nr, nc):
    """Best nr x nc block of a region near the anchor that avoids taken cells: (score, row, col), 1-based."""
    r1, r2, c1, c2 = rg[:4]
    r_lo, r_hi = max(r1, ar - nr + 1), r2 - nr + 1
    c_lo, c_hi = max(c1, ac - nc + 1), c2 - nc + 1
    if r_lo > r_hi or c_lo > c_hi:
        return None
    part = scores[r_lo - 1:r_hi, c_lo - 1:c_hi]
    i, j = divmod(int(part.argmin()), part.shape[1])
    best = float(part[i, j])
    return None if math.isinf(best) else (best, r_lo + i, c_lo + j)


def region_cells(state: PageState, need: int, ar: int, ac: int):
    """Cells of the best block over all region shapes within reach of the anchor, or None.

    Blocks are scored once for the whole page, not once for each region.
    """
    if not (state.free & ~state.taken).any():
        return None  # a full page answers at once, however many annotations follow
    taken_sum = np.zeros((state.rows + 1, state.cols + 1), dtype=np.int64)
    taken_sum[1:, 1:] = state.taken.cumsum(axis=0).cumsum(axis=1)
    best = None
    shapes = state.regions
    dist = np.hypot((shapes[:, 0] + shapes[:, 1]) / 2.0 - ar, (shapes[:, 2] + shapes[:, 3]) / 2.0 - ac)
    nearest_first = shapes[np.argsort(dist, kind="stable")].tolist()
    for nr in range(1, WRAP_ROWS + 1):
        nc = max(1, math.ceil(max(1, need) / nr))
        fitting = [g for g in nearest_first if g[1] - g[0] + 1 >= nr and g[3] - g[2] + 1 >= nc][:NEAR_SHAPES]
        scores = _block_scores(state, taken_sum, ar, ac, nr, nc) if fitting else None
        for g in fitting:
            hit = _carve(scores, g, ar, ac, nr, nc)
            if hit is None or abs((2 * hit[1] + nr - 1) / 2.0 - ar) > MAX_DRIFT_ROWS:
                continue
            score = hit[0] + (2.5 if nr == 1 and (hit[2] <= 1 or hit[2] + nc - 1 >= state.cols) else 0.0)
            if best is None or score < best[0]:
                best = (score, hit[1], hit[2], nr, nc)
    if best is None:
        return None
    _, r, c, nr, nc = best
    return [(a - 1, b - 1) for a in range(r, r + nr) for b in range(c, c + nc)]


def _point_cell(state: PageState, x: float, y: float) -> tuple[int, int]:
    """1-based cell at a percent point, clamped to the grid."""
    h = state.h
    px = max(0.0, min(h["page_w_pts"], x / 100.0 * h["page_w_pts"]))
    py = max(0.0, min(h["page_h_pts"], y / 100.0 * h["page_h_pts"]))
    col = int((px - h["left_margin_pts"]) / h["cell_size_pts"]) + 1
    row = int((py - h["top_margin_pts"]) / h["cell_size_pts"]) + 1
    return max(1, min(state.rows, row)), max(1, min(state.cols, col))


def place_cells(items: DataFrame, annotations: DataFrame, masks: DataFrame, page_grid: DataFrame, font: float = 11.0) -> DataFrame:
    """Cells, range and box per annotation: a region block (1), run cells (2), or its own position (3).

    Placements more than eight rows from the anchor are refused. Annotations
    that come with comment_rows keep those cells and take nothing from the page.
    The regions follow from the page mask, so the task finds them itself; that
    saves a second pass over the cells.
    """
    types = dict(annotations.dtypes)
    schema = (f"doc_id {types['doc_id']}, page {types['page']}, item_index {types['item_index']}, annotation_index {types['annotation_index']}, "
              "tier int, range_id string, cell_ids array<string>, x1_percent double, y1_percent double, x2_percent double, y2_percent double")

    def result(e, tier, cells, box):
        return {"doc_id": e["doc_id"], "page": e["page"], "item_index": e["o1"], "annotation_index": e["o2"], "tier": tier,
                "range_id": _span(cells), "cell_ids": _ids(cells), "x1_percent": box[0], "y1_percent": box[1], "x2_percent": box[2], "y2_percent": box[3]}

    def step(state, e):
        if e["is_box"]:
            if state is not None:
                state.take(state.in_rect(e["x1"], e["y1"], e["x2"], e["y2"]))
            return None
        own = free_strip_box(e["x1"], e["x2"], e["y1"], True)
        if state is None:
            return result(e, 3, [], own)
        if e["comment_rows"]:
            cells = sorted(set(token_cells(e["comment_rows"], state.rows, state.cols)))
            box = state.box_from_points(cells) if cells else free_strip_box(50.0, 50.0, 50.0, True)
            return result(e, 1 if cells else 3, cells, box)
        ar, ac = _point_cell(state, e["x1"], e["y1"])
        cells, tier = region_cells(state, e["need"], ar, ac), 1
        if not cells:
            cells, tier = state.by_runs(e["need"], e["x1"], e["y1"]), 2
            rows = [r + 1 for r, _ in cells]
            if cells and abs((min(rows) + max(rows)) / 2.0 - ar) > MAX_DRIFT_ROWS:
                cells = []
        if cells:
            state.take(cells)
            return result(e, tier, cells, state.box_from_points(cells))
        return result(e, 3, state.in_rect(*own), own)

    events = _events(items, annotations, page_grid, False, font)
    return run_sequential(events, masks, P, ["o1", "o2"], schema, PageState, step)


# ---- comment planning -----------------------------------------------------

def parse_token(token: str) -> tuple[int, int, int] | None:
    """(row, first, last) of a single-row token, 1-based; None when it is no such token."""
    ends = [part.strip() for part in (token or "").split(":")]
    if not 1 <= len(ends) <= 2:
        return None
    out = []
    for part in ends:
        letters = part.rstrip("0123456789")
        if not (1 <= len(letters) <= 3 and letters.isascii() and letters.isalpha() and len(part) > len(letters)):
            return None
        col = 0
        for ch in letters.upper():
            col = col * 26 + ord(ch) - 64
        out.append((int(part[len(letters):]), col))
    if out[0][0] != out[-1][0]:
        return None
    return out[0][0], min(out[0][1], out[-1][1]), max(out[0][1], out[-1][1])


def token_cells(tokens, rows: int, cols: int):
    """In-grid cells (0-based) of row tokens."""
    for token in tokens or []:
        hit = parse_token(token)
        if hit and 1 <= hit[0] <= rows:
            for c in range(max(1, hit[1]), min(cols, hit[2]) + 1):
                yield hit[0] - 1, c - 1


class CommentState:
    """Planning and validation state of one question on one page."""

    def __init__(self, h: dict):
        writable = mask_array(h["mask"])
        self.rows, self.cols = writable.shape
        runs = row_runs(writable)
        self.runs = runs[runs[:, 2] - runs[:, 1] >= 1]
        self.plan_free = mask_array(h["free"])
        self.real_free = self.plan_free.copy()

    def plan(self, free, anchor_rows, side, length, font):
        """Up to four equal row spans under the best free run, as (row, first, last) 0-based."""
        cells = set(token_cells(anchor_rows, self.rows, self.cols))
        # Python's round() is half to even, as the rule asks
        anchor = round(sum(r + 1 for r, _ in cells) / len(cells)) if cells else max(1, self.rows // 2)
        per_col = max(0.35, max(14.0, font) * 0.06)
        need = max(8, min(48, math.ceil(length * per_col / 8.0)))
        row, a, b = self.runs[:, 0] + 1, self.runs[:, 1] + 1, self.runs[:, 2] + 1
        width = b - a + 1
        count = np.zeros((self.rows, self.cols + 1), dtype=np.int64)
        count[:, 1:] = free.cumsum(axis=1)
        whole = count[row - 1, b] - count[row - 1, a - 1] == width
        score = (0.4 * (1.0 / (1.0 + np.abs(row - anchor) / 5.0)) + 0.3 * np.minimum(1.0, width / max(need, 1))
                 + 0.2 * (1.0 - np.abs(row / max(self.rows, 1) - 0.5) * 0.5) + 0.1 * np.minimum(1.0, width / 12.0))
        sides = [side] + [s for s in ("right", "left", "gap") if s != side]
        for s in sides:
            ok = whole & ({"left": b <= 11, "right": a >= 48, "gap": (width >= 18) | ((a <= 15) & (b >= 40))}.get(s, np.ones(len(a), bool)))
            if ok.any():
                k = int(np.argmax(np.where(ok, score, -np.inf)))
                r, c1, c2 = int(self.runs[k, 0]), int(self.runs[k, 1]), int(self.runs[k, 2])
                spans = []
                for rr in range(r, min(r + 4, self.rows)):
                    if not free[rr, c1:c2 + 1].all():
                        break
                    spans.append((rr, c1, c2))
                return spans
        return []

    def keep_prefixes(self, spans):
        """Claim the still-free left part of each span."""
        kept = []
        for r, c1, c2 in spans:
            closed = np.nonzero(~self.real_free[r, c1:c2 + 1])[0]
            n = int(closed[0]) if len(closed) else c2 - c1 + 1
            if n:
                self.real_free[r, c1:c1 + n] = False
                kept.append((r, c1, c1 + n - 1))
        return kept

    def validate(self, spans, anchor_rows, length, font):
        """Free prefixes of the spans; when nothing is left, plan once more; else drop."""
        kept = self.keep_prefixes(spans)
        if kept:
            return kept
        for side in ("right", "left", "gap"):
            again = self.plan(self.real_free, anchor_rows, side, length, font)
            if again:
                return self.keep_prefixes(again)
        return []


def comment_headers(annotations: DataFrame, masks: DataFrame, free_masks: DataFrame) -> DataFrame:
    """Page masks for each (question, page) that has annotations; every question starts fresh."""
    pages = annotations.select("doc_id", "question_id", "page").distinct()
    m = masks.select(*P, "mask").join(free_masks.select(*P, F.col("mask").alias("free")), P)
    return pages.join(m, P)


def _comment_order(annotations: DataFrame) -> DataFrame:
    """Priority 1 first, unreadable priority counts as 2, then the given order."""
    return annotations.withColumn("prio", F.coalesce(F.col("priority").try_cast("int"), F.lit(2)))


def by_priority(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Position of each annotation in priority order per key."""
    return split_rank(_comment_order(annotations), keys, ["prio", "annotation_index"], [F.col("prio"), block_of("annotation_index")], "turn")


def plan_comments(annotations: DataFrame, masks: DataFrame, free_masks: DataFrame, validate: bool = True) -> DataFrame:
    """Comment rows from geometry, then repaired against real reservations.

    ``annotations``: doc_id, question_id, page, annotation_index, comment,
    comment_font_pts, preferred_side, priority, anchor_rows. With ``validate``
    the second step runs too and ``outcome`` tells kept from dropped.
    """
    return _comments(annotations, masks, free_masks, plan=True, check=validate)


def validate_comments(annotations: DataFrame, masks: DataFrame, free_masks: DataFrame) -> DataFrame:
    """Repair given comment_rows: per token keep the free prefix, re-plan once, else drop."""
    return _comments(annotations, masks, free_masks, plan=False, check=True)


def _comments(annotations, masks, free_masks, plan, check):
    types = dict(annotations.dtypes)
    keys = ["doc_id", "question_id", "page"]
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "annotation_index"]) + ", comment_rows array<string>, outcome string"

    def step(state, e):
        if state is None:
            return None  # a page without a grid gives no comment
        length, font = len(e["comment"] or ""), 14.0 if e["comment_font_pts"] is None else float(e["comment_font_pts"])
        if plan:
            spans = state.plan(state.plan_free, e["anchor_rows"], (e["preferred_side"] or "right").lower(), length, font)
            for r, c1, c2 in spans:
                state.plan_free[r, c1:c2 + 1] = False
        else:
            hits = [parse_token(t) for t in e["comment_rows"] or []]
            spans = [(r - 1, a - 1, b - 1) for r, a, b in (h for h in hits if h)
                     if 1 <= r <= state.rows and a >= 1 and b <= state.cols]
        kept = state.validate(spans, e["anchor_rows"], length, font) if check else spans
        rows = [f"{_letters(a + 1)}{r + 1}" if a == b else f"{_letters(a + 1)}{r + 1}:{_letters(b + 1)}{r + 1}" for r, a, b in kept]
        outcome = ("kept" if rows else "no valid free cells") if check else ("planned" if rows else "no run")
        return {**{k: e[k] for k in [*keys, "annotation_index"]}, "comment_rows": rows, "outcome": outcome}

    ordered = _comment_order(annotations) if "priority" in annotations.columns else annotations.withColumn("prio", F.lit(0))
    headers = comment_headers(annotations, masks, free_masks)
    if not plan:
        return run_sequential(ordered, headers, keys, ["prio", "annotation_index"], schema, CommentState, step)
    first, rest = _plannable(ordered, masks, keys)
    done = run_sequential(first, headers, keys, ["prio", "annotation_index"], schema, CommentState, step)
    missed = rest.select(*keys, "annotation_index", F.array().cast("array<string>").alias("comment_rows"),
                         F.lit("no valid free cells" if check else "no run").alias("outcome"))
    return done.unionByName(missed)


def _plannable(ordered: DataFrame, masks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split off the annotations that cannot find a run any more, whatever their text.

    A plan takes a whole run, and whether one is left depends on the sides
    tried, not on the comment. The three known sides are always all tried, so
    among those annotations the successes come first and are no more than the
    page has runs; the same holds among annotations with another side, which
    accept any run. Later ones fail for certain and skip the sequential step.
    """
    known = F.lower(F.coalesce("preferred_side", F.lit("right"))).isin("right", "left", "gap")
    turns = split_rank(ordered.withColumn("_known", known), [*keys, "_known"], ["prio", "annotation_index"],
                       [F.col("prio"), block_of("annotation_index")], "_turn")
    limits = masks.select(*P, F.floor(F.col("rows") * F.col("cols") / F.lit(2.0)).alias("_most"))
    j = turns.join(limits, P)
    return j.filter(F.col("_turn") <= F.col("_most")).drop("_known", "_turn", "_most"), j.filter(F.col("_turn") > F.col("_most"))


# ---- automatic remark placement -------------------------------------------

def box_positions(boxes: DataFrame) -> DataFrame:
    """Canvas positions of free boxes, best area times score first.

    ``boxes``: page, canvas_w, canvas_h and zone percents in the content area, with keys.
    """
    def lo(size, part):
        return (F.col(size) * part).cast("int")

    x0, x1 = lo("canvas_w", X.CONTENT_LEFT), lo("canvas_w", X.CONTENT_RIGHT)
    y0, y1 = lo("canvas_h", X.CONTENT_TOP), lo("canvas_h", X.CONTENT_BOTTOM)
    w, h = F.greatest(F.lit(1), x1 - x0), F.greatest(F.lit(1), y1 - y0)
    mx, my = (F.col("x_start_percent") + F.col("x_end_percent")) / 2, (F.col("y_start_percent") + F.col("y_end_percent")) / 2
    worth = (F.col("x_end_percent") - F.col("x_start_percent")) * (F.col("y_end_percent") - F.col("y_start_percent")) * F.col("score")
    return boxes.withColumns({
        "x": x0 + (w * mx / 100).cast("int"), "y": y0 + (h * my / 100).cast("int"), "worth": worth})


def auto_place(remarks: DataFrame, boxes: DataFrame | None, strategy: str = "free_space") -> DataFrame:
    """Give unplaced remarks of a (session, page) positions in order.

    ``remarks``: session_id, page, key, ord, canvas_w, canvas_h (only unplaced
    ones). Free boxes come first, then grid positions; equal positions count once. Every remark gives a row; one without a
    position left has none.

    ``boxes`` belong to a page of a session if they have ``session_id``, else to that page of every session. Without boxes a remark's spot follows from its turn
    and the number of remarks, so no list of spots is made.
    """
    keys = ["session_id", "page"]
    ranked = split_rank(remarks, keys, ["ord"], [block_of("ord")], "turn")
    n = remarks.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("canvas_w").alias("canvas_w"), F.max("canvas_h").alias("canvas_h"))
    if strategy != "free_space" or boxes is None:
        spot = layout_position("grid" if strategy == "free_space" else strategy, F.col("turn") - 1, "n", "canvas_w", "canvas_h")
        return ranked.drop("canvas_w", "canvas_h").join(n, keys).withColumn("_p", spot).select(*keys, "key", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    spots = n.select(*keys, F.posexplode(layout_positions("grid", "n", "canvas_w", "canvas_h")).alias("i", "_p")).select(
        *keys, F.lit(1).alias("src"), F.col("i").cast("double").alias("o"), F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    best = box_positions(n.join(boxes, [k for k in keys if k in boxes.columns])).select(
        *keys, F.lit(0).alias("src"), (-F.col("worth")).alias("o"), "x", "y")
    spots = ordered_union(best, spots, keys)
    return ranked.join(spots.select(*keys, "turn", "x", "y"), [*keys, "turn"], "left").select(*keys, "key", "x", "y")


def page_rejects(remarks: DataFrame, page_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remarks (session_id, page, ...) on pages that exist, and the others with the reason. ``page_counts``: session_id, n_pages."""
    j = remarks.join(page_counts, "session_id", "left")
    reason = F.when(F.col("page") < 1, F.concat(F.lit("Page must be ≥ 1, got "), F.col("page"))).when(
        F.col("page") > F.coalesce("n_pages", F.lit(0)), F.concat(F.lit("Page "), F.col("page"), F.lit(" out of range (1–"), F.coalesce("n_pages", F.lit(0)), F.lit(")")))
    judged = j.withColumn("reason", reason)
    return judged.filter("reason IS NULL").select(*remarks.columns), judged.filter("reason IS NOT NULL").select(*remarks.columns, "reason")


def ordered_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two position lists: the first list leads, repeats keep their first place."""
    both = first.unionByName(second).withColumn("_at", F.struct("src", "o", "x", "y"))
    unique = first_wins(both, [*keys, "x", "y"], "_at")
    return split_rank(unique, keys, ["src", "o", "x", "y"], [F.col("src"), F.floor(F.col("o") / 4096.0)], "turn").drop("_at")


def unplaced(remarks: DataFrame, placements: DataFrame) -> DataFrame:
    """Remarks of a session that have no placement."""
    return remarks.join(placements.select("session_id", "key"), ["session_id", "key"], "left_anti")


def latest_placements(log: DataFrame) -> DataFrame:
    """Current placement per (session, key) of a log of place and remove actions."""
    from gradelake.operators.keyed import last_wins

    return last_wins(log, ["session_id", "key"], "ord").filter("action = 'place'")


def export_placements(placements: DataFrame, fmt: str = "full") -> DataFrame:
    """Column subsets of the export formats full, minimal, pdf and normalized."""
    shapes = {"minimal": "page x y pct_x pct_y", "pdf": "page pdf_x pdf_y text", "normalized": "page pct_x pct_y text"}
    if fmt == "full":
        return placements
    return placements.select("session_id", "key", *shapes[fmt].split())
