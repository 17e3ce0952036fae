"""Marks, placement scores and small classification rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.coords import _c, round_even


def round_half(x) -> Column:
    """Nearest half mark, ties to even."""
    return F.rint(_c(x) * 2.0) / 2.0


def clamp_marks(marks, total) -> Column:
    return F.least(F.greatest(round_half(marks), F.lit(0.0)), _c(total).cast("double"))


def semantic_bucket(y) -> Column:
    v = _c(y)
    return F.when(v < 33.0, "top").when(v > 67.0, "bottom").otherwise("mid")


def region_class(fill_ratio) -> Column:
    v = _c(fill_ratio)
    return F.when(v >= 0.9, "solid").when(v >= 0.7, "good").when(v >= 0.5, "fair").otherwise("poor")


def needed_cols(text_len, font_pts) -> Column:
    """Columns a comment asks for, from its length and font size: 8 to 48."""
    per_col = F.greatest(F.lit(0.35), _c(font_pts) * 0.06)
    wanted = F.ceil(_c(text_len) * per_col / 8.0).cast("int")
    return F.greatest(F.lit(8), F.least(F.lit(48), wanted))


def side_ok(side, start_col, end_col) -> Column:
    """Whether a run lies on the asked side: left band, right band or a wide gap."""
    s, a, b = F.lower(F.coalesce(_c(side), F.lit("right"))), _c(start_col), _c(end_col)
    wide = (b - a + 1 >= 18) | ((a <= 15) & (b >= 40))
    return (
        F.when(s == "left", b <= 11).when(s == "right", a >= 48).when(s == "gap", wide).otherwise(F.lit(True))
    )


def planner_score(run_row, width, anchor_row, cols_needed, rows) -> Column:
    """Weighted proximity, fit, balance and continuity of a run for a comment."""
    near = F.lit(1.0) / (F.lit(1.0) + F.abs(_c(run_row) - _c(anchor_row)) / 5.0)
    fit = F.least(F.lit(1.0), _c(width) / F.greatest(_c(cols_needed), F.lit(1)))
    balance = F.lit(1.0) - F.abs(_c(run_row) / F.greatest(_c(rows), F.lit(1)) - 0.5) * 0.5
    length = F.least(F.lit(1.0), _c(width) / 12.0)
    return near * 0.4 + fit * 0.3 + balance * 0.2 + length * 0.1


def zone_score(zone_y, wanted_y, zone_value, max_shift: float = 35.0) -> Column:
    """Score of a zone for an annotation: same third of the page, nearness, emptiness."""
    same = F.when(semantic_bucket(zone_y) == semantic_bucket(wanted_y), 15.0).otherwise(0.0)
    return same + (F.lit(max_shift) - F.abs(_c(zone_y) - _c(wanted_y))) + _c(zone_value) * 5.0


def carve_score(r0, c0, n_rows, n_cols, anchor_row, anchor_col, grid_cols) -> Column:
    """Lower is better: distance, touching page edges, and very wide strips."""
    dist = F.hypot(_c(r0) + _c(n_rows) / 2.0 - _c(anchor_row), _c(c0) + _c(n_cols) / 2.0 - _c(anchor_col))
    left = F.when(_c(c0) <= 1, 3.0).otherwise(0.0)
    right = F.when(_c(c0) + _c(n_cols) - 1 >= _c(grid_cols), 3.0).otherwise(0.0)
    wide = F.greatest(F.lit(0.0), _c(n_cols) / F.greatest(_c(n_rows), F.lit(1)) - 8.0) * 0.3
    return dist + left + right + wide


def layout_position(strategy: str, i, n, width, height) -> Column:
    """struct(x, y) of spot ``i`` (from 0) of n on a canvas: 'column', 'row' or 'grid'."""
    i, k, w, h = _c(i), _c(n).cast("int"), _c(width), _c(height)

    def part(size: Column, i: Column, parts: Column) -> Column:
        return (size * (i + 1) / (parts + 1)).cast("int")

    if strategy == "column":
        return F.struct((w * 0.85).cast("int").alias("x"), part(h, i, k).alias("y"))
    if strategy == "row":
        return F.struct(part(w, i, k).alias("x"), (h * 0.08).cast("int").alias("y"))
    cols = F.greatest(F.lit(1), F.rint(F.sqrt(k.cast("double"))).cast("int"))
    return F.struct(part(w, i % cols, cols).alias("x"), part(h, F.floor(i / cols).cast("int"), F.ceil(k / cols).cast("int")).alias("y"))


def layout_positions(strategy: str, n, width, height) -> Column:
    """array<struct(x, y)> of n spots on a canvas."""
    k = _c(n).cast("int")
    idx = F.when(k >= 1, F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: layout_position(strategy, i, n, width, height))


def word_target(answer_type) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(_c(answer_type), F.lit("")))) == "essay", 1200).otherwise(300)


def mean_half_even(total, n, digits: int = 4) -> Column:
    return round_even(_c(total) / _c(n), digits)
