"""Cell ids, range ids and percent/point geometry as Column expressions.

Cells are addressed like a spreadsheet: letters for the column (bijective base
26), then the 1-based row. A range is one cell, or two corner cells joined by a
colon. Everything here stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_RE = r"^\s*([A-Za-z]+)([0-9]+)\s*$"
RANGE_RE = r"^\s*([A-Za-z]+)([0-9]+)\s*:\s*([A-Za-z]+)([0-9]+)\s*$"
#: Stands for any row or column number of ten digits or six letters and more: in no grid, and safe to add to.
BEYOND = 10**9
ROW_TOKEN_RE = r"^\s*([A-Za-z]{1,3})([0-9]+)\s*:\s*([A-Za-z]{1,3})([0-9]+)\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def round_even(x, digits: int) -> Column:
    """Round half to even in double arithmetic, the rule Python's round() follows."""
    scale = float(10**digits)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trunc_int(x) -> Column:
    """Truncate toward zero to int; null when the value does not fit."""
    return _c(x).try_cast("int")


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(_c(x), _c(low)), _c(high))


def column_letters(col) -> Column:
    """Spreadsheet letters of a 1-based column number, as many as it takes."""
    n = _c(col).cast("long")

    def more(acc: Column, _: Column) -> Column:
        left = acc["n"] - 1
        return F.when(acc["n"] > 0, F.struct(F.call_function("div", left, F.lit(26)).alias("n"), F.concat(letter(left % 26), acc["s"]).alias("s"))).otherwise(acc)

    def letter(zero_based: Column) -> Column:
        return F.char(zero_based + F.lit(65))

    last = letter((n - 1) % 26)
    middle = letter(F.floor((n - 27) / F.lit(26.0)).cast("int") % 26)
    first = letter(F.floor((n - 703) / F.lit(676.0)).cast("int"))
    return (
        F.when(n < 1, None)
        .when(n <= 26, last)
        .when(n <= 702, F.concat(middle, last))
        .when(n <= 18278, F.concat(first, middle, last))
        .otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.alias("n"), F.lit("").alias("s")), more, lambda acc: acc["s"]))
    )


def row_number(digits: Column) -> Column:
    """Row of a digit group; null when empty. Numbers beyond BEYOND are held as BEYOND, which lies outside every grid."""
    return F.when(F.length(F.ltrim(digits, F.lit("0"))) > 9, BEYOND).otherwise(digits.try_cast("int"))


def letters_to_column(letters: Column) -> Column:
    """Column number of a letter group; null when empty. Six letters and more are held as BEYOND, outside every grid."""
    padded = F.lpad(F.upper(letters), 4, "@")  # "@" sits just before "A", so it counts as 0

    def digit(i: int) -> Column:
        return F.ascii(F.substring(padded, i, 1)) - 64

    number = ((digit(1) * 26 + digit(2)) * 26 + digit(3)) * 26 + digit(4)
    five = ((((digit5(letters, 1) * 26 + digit5(letters, 2)) * 26 + digit5(letters, 3)) * 26 + digit5(letters, 4)) * 26) + digit5(letters, 5)
    return F.when(F.length(letters).between(1, 4), number).when(F.length(letters) == 5, five).when(F.length(letters) > 5, BEYOND)


def digit5(letters: Column, i: int) -> Column:
    return F.ascii(F.substring(F.upper(letters), i, 1)) - 64


def cell_id(row, col) -> Column:
    r, c = _c(row).cast("int"), _c(col)
    return F.when(r >= 1, F.concat(column_letters(c), r.cast("string")))


def cell_row(cell) -> Column:
    return row_number(F.regexp_extract(_c(cell), CELL_RE, 2))


def cell_col(cell) -> Column:
    return letters_to_column(F.regexp_extract(_c(cell), CELL_RE, 1))


def range_id(first, last) -> Column:
    a, b = _c(first), _c(last)
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(":"), b))


def rect_range_id(r1, c1, r2, c2) -> Column:
    return range_id(cell_id(r1, c1), cell_id(r2, c2))


def _corners(token: Column, pattern: str) -> Column:
    """struct(ra, ca, rb, cb) of the two corners as written; parts that do not parse are null."""
    # a single cell is the range from itself to itself
    pair = F.when(F.instr(token, ":") > 0, token).otherwise(F.concat(token, F.lit(":"), token))

    def parts(p: Column) -> Column:
        return F.struct(*[F.regexp_extract(p, pattern, k).alias(f"g{k}") for k in (1, 2, 3, 4)])

    return let(let(pair, parts), lambda g: F.struct(
        row_number(g["g2"]).alias("ra"), letters_to_column(g["g1"]).alias("ca"),
        row_number(g["g4"]).alias("rb"), letters_to_column(g["g3"]).alias("cb")))


def _parsed(k: Column) -> Column:
    return k["ra"].isNotNull() & k["ca"].isNotNull() & k["rb"].isNotNull() & k["cb"].isNotNull()


def range_bounds(token) -> Column:
    """struct(r1, c1, r2, c2) of a range; corners may be swapped; null if unparseable."""
    return let(_corners(_c(token), RANGE_RE), lambda k: F.when(_parsed(k), F.struct(
        F.least(k["ra"], k["rb"]).alias("r1"), F.least(k["ca"], k["cb"]).alias("c1"),
        F.greatest(k["ra"], k["rb"]).alias("r2"), F.greatest(k["ca"], k["cb"]).alias("c2"))))


def expand_range(token, rows=None, cols=None) -> Column:
    """array<struct(row, col)> of a range in row-major order; null if unparseable. With ``rows`` and ``cols`` only
    the cells inside that grid, so that a token can't ask for more cells than the grid has."""
    def cells(b: Column) -> Column:
        return F.flatten(F.transform(
            steps(F.greatest(b["r1"], F.lit(1)) if rows is not None else b["r1"], b["r2"] if rows is None else F.least(b["r2"], _c(rows))),
            lambda r: F.transform(steps(F.greatest(b["c1"], F.lit(1)) if cols is not None else b["c1"], b["c2"] if cols is None else F.least(b["c2"], _c(cols))),
                                  lambda c: F.struct(r.alias("row"), c.alias("col")))))

    def steps(a: Column, z: Column) -> Column:
        return F.when(a <= z, F.sequence(a, z)).otherwise(F.array().cast("array<int>"))

    return let(range_bounds(token), lambda b: F.when(b.isNotNull(), cells(b)))


def row_token(token) -> Column:
    """struct(row, c1, c2) of a single-row token such as ``H15:O15`` or ``H15``.

    At most three letters; a token whose two ends lie on different rows is null.
    """
    return let(_corners(_c(token), ROW_TOKEN_RE), lambda k: F.when(_parsed(k) & (k["ra"] == k["rb"]), F.struct(
        k["ra"].alias("row"), F.least(k["ca"], k["cb"]).alias("c1"), F.greatest(k["ca"], k["cb"]).alias("c2"))))


def row_token_error(token, rows, cols) -> Column:
    """Why a comment row token is unusable, or null when it is fine."""
    t, nr, nc = _c(token), _c(rows), _c(cols)
    is_range = F.instr(t, ":") > 0

    def check(tok: Column) -> Column:
        row_bad = (tok["row"] < 1) | (tok["row"] > nr)
        col_bad = (tok["c1"] < 1) | (tok["c2"] > nc)
        return (
            F.when(t.isNull() | (F.trim(t) == ""), "empty")
            .when(tok.isNull(), "unparseable")
            .when(is_range & row_bad, "row_oob")
            .when(is_range & col_bad, "col_oob")
            .when(~is_range & (row_bad | col_bad), "oob")
        )

    return let(row_token(t), check)


def clip_row(tok: Column, rows, cols) -> Column:
    """A row_token() struct clipped to the grid; null when no cell is left."""
    lo, hi = F.greatest(tok["c1"], F.lit(1)), F.least(tok["c2"], _c(cols))
    inside = (tok["row"] >= 1) & (tok["row"] <= _c(rows)) & (lo <= hi)
    return F.when(inside, F.struct(tok["row"].alias("row"), lo.alias("c1"), hi.alias("c2")))


def clipped_token(token, rows, cols) -> Column:
    return let(row_token(token), lambda tok: clip_row(tok, rows, cols))


def valid_tokens(tokens, rows, cols) -> Column:
    """Keep the tokens that cover at least one cell of the grid (order kept)."""
    return F.filter(_c(tokens), lambda t: clipped_token(t, rows, cols).isNotNull())


def token_cells(tokens, rows, cols) -> Column:
    """Distinct in-grid cells of a token array, row-major: array<struct(row, col)>."""
    clipped = F.filter(F.transform(_c(tokens), lambda t: clipped_token(t, rows, cols)), lambda k: k.isNotNull())
    pieces = F.transform(
        clipped,
        lambda k: F.transform(F.sequence(k["c1"], k["c2"]), lambda c: F.struct(k["row"].alias("row"), c.alias("col"))))
    return F.array_sort(F.array_distinct(F.flatten(pieces)))


def rect_rows(r1, c1, r2, c2) -> Column:
    """One token per row of a rectangle."""
    return F.transform(F.sequence(_c(r1), _c(r2)), lambda r: range_id(cell_id(r, c1), cell_id(r, c2)))


def percent_to_col(x_pct, width, left, size, cols) -> Column:
    step = trunc_int((_c(width) * (_c(x_pct) / 100.0) - _c(left)) / _c(size))
    return F.when(_c(size) > 0, clamp(step + 1, F.lit(1), _c(cols)))


def percent_to_row(y_pct, height, top, size, rows) -> Column:
    step = trunc_int((_c(height) * (_c(y_pct) / 100.0) - _c(top)) / _c(size))
    return F.when(_c(size) > 0, clamp(step + 1, F.lit(1), _c(rows)))


def percent_to_cell(x_pct, y_pct) -> Column:
    """Cell id at a percent position; reads the page grid columns beside it."""
    return cell_id(
        percent_to_row(y_pct, "page_h_pts", "top_margin_pts", "cell_size_pts", "rows"),
        percent_to_col(x_pct, "page_w_pts", "left_margin_pts", "cell_size_pts", "cols"),
    )


def cell_at_y(y_pct, side: str) -> Column:
    """Leftmost (side='top') or rightmost (side='bottom') cell of the row at y."""
    row = percent_to_row(y_pct, "page_h_pts", "top_margin_pts", "cell_size_pts", "rows")
    return cell_id(row, F.lit(1) if side == "top" else F.col("cols"))


def rect_percent(r1, c1, r2, c2, digits: int = 2) -> Column:
    """Percent rectangle of a cell rectangle; reads the page grid columns beside it."""
    size, left, top = F.col("cell_size_pts"), F.col("left_margin_pts"), F.col("top_margin_pts")
    w, h = F.col("page_w_pts"), F.col("page_h_pts")
    return F.struct(
        round_even((left + (_c(c1) - 1) * size) / w * 100.0, digits).alias("x1_percent"),
        round_even((top + (_c(r1) - 1) * size) / h * 100.0, digits).alias("y1_percent"),
        round_even((left + _c(c2) * size) / w * 100.0, digits).alias("x2_percent"),
        round_even((top + _c(r2) * size) / h * 100.0, digits).alias("y2_percent"),
    )


def rect_points(r1, c1, r2, c2) -> Column:
    """Point rectangle (origin top left) of a cell rectangle."""
    size, left, top = F.col("cell_size_pts"), F.col("left_margin_pts"), F.col("top_margin_pts")
    return F.struct(
        (left + (_c(c1) - 1) * size).alias("x1_pts"), (top + (_c(r1) - 1) * size).alias("y1_pts"),
        (left + _c(c2) * size).alias("x2_pts"), (top + _c(r2) * size).alias("y2_pts"),
    )


def range_points(token) -> Column:
    """Point rectangle of a range id; null when the id does not parse."""
    b = range_bounds(token)
    return F.when(b.isNotNull(), rect_points(b["r1"], b["c1"], b["r2"], b["c2"]))


def rects_overlap(a: Column, b: Column) -> Column:
    """Inclusive overlap of two range_bounds() structs."""
    return (a["r1"] <= b["r2"]) & (b["r1"] <= a["r2"]) & (a["c1"] <= b["c2"]) & (b["c1"] <= a["c2"])


def rect_contains(outer: Column, inner: Column) -> Column:
    return (
        (inner["r1"] >= outer["r1"]) & (inner["r2"] <= outer["r2"])
        & (inner["c1"] >= outer["c1"]) & (inner["c2"] <= outer["c2"])
    )


# The content area of a page as fractions of its size.
CONTENT_LEFT, CONTENT_RIGHT, CONTENT_TOP, CONTENT_BOTTOM = 0.18, 0.97, 0.04, 0.93


def content_percent_to_pdf(x1, y1, x2, y2, page_w, page_h) -> Column:
    """Percent of the content area to PDF points (y axis pointing up)."""
    w, h = _c(page_w), _c(page_h)
    x0, y0 = w * CONTENT_LEFT, h * CONTENT_TOP
    cw, ch = w * CONTENT_RIGHT - x0, h * CONTENT_BOTTOM - y0
    top = h - (y0 + _c(y1) / 100.0 * ch)
    bottom = h - (y0 + _c(y2) / 100.0 * ch)
    return F.struct(
        round_even(x0 + _c(x1) / 100.0 * cw, 2).alias("pdf_x1"),
        round_even(F.least(top, bottom), 2).alias("pdf_y1"),
        round_even(x0 + _c(x2) / 100.0 * cw, 2).alias("pdf_x2"),
        round_even(F.greatest(top, bottom), 2).alias("pdf_y2"),
    )


def canvas_to_pdf(x, y, canvas_w, canvas_h, page_w, page_h) -> Column:
    """Canvas pixel to PDF points (y up) and to percent of the canvas."""
    fx, fy = _c(x) / _c(canvas_w), _c(y) / _c(canvas_h)
    return F.struct(
        round_even(fx * _c(page_w), 2).alias("pdf_x"),
        round_even(_c(page_h) - fy * _c(page_h), 2).alias("pdf_y"),
        round_even(fx * 100, 2).alias("pct_x"),
        round_even(fy * 100, 2).alias("pct_y"),
    )
