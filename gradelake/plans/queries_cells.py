"""Cell, grid and free-zone queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import coords as X
from gradelake.functions import scoring as S
from gradelake.operators import cells as CE
from gradelake.operators import grid as G
from gradelake.operators import zones as Z
from gradelake.operators.keyed import top_k
from gradelake.plans.registry import query

P = ["doc_id", "page"]


# DuckDB forms of the coordinate functions
def L(c: str) -> str:
    """Column letters (up to two letters are enough for the test grids)."""
    return f"CASE WHEN {c} <= 26 THEN chr(CAST(64 + {c} AS INT)) ELSE concat(chr(CAST(64 + floor(({c} - 1) / 26.0) AS INT)), chr(CAST(65 + ({c} - 1) % 26 AS INT))) END"


def ID(r: str, c: str) -> str:
    return f"concat({L(c)}, {r})"


def RID(r1, c1, r2, c2) -> str:
    return f"CASE WHEN {r1} = {r2} AND {c1} = {c2} THEN {ID(r1, c1)} ELSE concat({ID(r1, c1)}, ':', {ID(r2, c2)}) END"


def COL(t: str, part: int = 0) -> str:
    """Column number of the corner ``part`` (0 or 1) of a one- or two-letter range."""
    token = f"upper(regexp_extract(split_part({t}, ':', {part + 1}), '([A-Za-z]+)', 1))"
    return f"CASE length({token}) WHEN 1 THEN ascii({token}) - 64 ELSE (ascii({token}) - 64) * 26 + ascii(substr({token}, 2, 1)) - 64 END"


def ROW(t: str, part: int = 0) -> str:
    return f"CAST(regexp_extract(split_part({t}, ':', {part + 1}), '([0-9]+)', 1) AS INT)"


def PX(c: str, d: int = 3) -> str:
    return f"round_even((9.5 + ({c}) * 24.0) / 595.0 * 100.0 * 1e{d}, 0) / 1e{d}"


def PY(r: str, d: int = 3) -> str:
    return f"round_even((1.0 + ({r}) * 24.0) / 842.0 * 100.0 * 1e{d}, 0) / 1e{d}"


@query("c1_cell_id", f"SELECT DISTINCT p_size AS n, CASE WHEN p_size + 0 >= 1 THEN {ID('p_size', 'p_size')} END AS cell FROM part")
def _(t):
    return t.part.select(F.col("p_size").alias("n"), X.cell_id("p_size", "p_size").alias("cell")).distinct()


@query("c1_wide_columns", """
SELECT n, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) WHEN n <= 702 THEN concat(chr(CAST(65 + floor((n - 27) / 26.0) AS INT)), chr(CAST(65 + (n - 1) % 26 AS INT)))
 ELSE concat(chr(CAST(65 + floor((n - 703) / 676.0) AS INT)), chr(CAST(65 + CAST(floor((n - 27) / 26.0) AS BIGINT) % 26 AS INT)), chr(CAST(65 + (n - 1) % 26 AS INT))) END AS letters, CAST(n AS INT) AS back
FROM (SELECT p_partkey % 18278 + 1 AS n FROM part) t""")
def _(t):
    n = (F.col("p_partkey") % 18278 + 1).alias("n")
    return t.part.select(n).select("n", X.column_letters("n").alias("letters"), X.cell_col(X.cell_id(F.lit(1), "n")).alias("back"))


@query("c2_parse_cell", f"""
SELECT doc_id, page, annotation_index, {ROW('comment_range')} AS r, {COL('comment_range')} AS c FROM fx_annotations""")
def _(t):
    first = F.split_part(F.col("comment_range"), F.lit(":"), F.lit(1))
    return t.fx_annotations.select(*P, "annotation_index", X.cell_row(first).alias("r"), X.cell_col(first).alias("c"))


@query("c4_range_bounds", f"""
SELECT doc_id, page, annotation_index, least({ROW('comment_range')}, {ROW('comment_range', 1)}) AS r1, least({COL('comment_range')}, {COL('comment_range', 1)}) AS c1,
 greatest({ROW('comment_range')}, {ROW('comment_range', 1)}) AS r2, greatest({COL('comment_range')}, {COL('comment_range', 1)}) AS c2 FROM fx_annotations""")
def _(t):
    return t.fx_annotations.select(*P, "annotation_index", X.range_bounds("comment_range").alias("b")).select(*P, "annotation_index", "b.*")


@query("c4_expand_range", f"""
SELECT doc_id, page, annotation_index, CAST(count(*) AS INT) AS n, string_agg({ID('r', 'c')}, ' ' ORDER BY r, c) AS cells FROM (
 SELECT doc_id, page, annotation_index, r, unnest(generate_series(c1, c2)) AS c FROM (
  SELECT *, unnest(generate_series(r1, r2)) AS r FROM (SELECT doc_id, page, annotation_index, {ROW('comment_range')} AS r1, {ROW('comment_range', 1)} AS r2,
   {COL('comment_range')} AS c1, {COL('comment_range', 1)} AS c2 FROM fx_annotations) a) b) d GROUP BY ALL""")
def _(t):
    e = t.fx_annotations.select(*P, "annotation_index", X.expand_range("comment_range").alias("e"))
    return e.select(*P, "annotation_index", F.size("e").alias("n"), F.array_join(F.transform("e", lambda x: X.cell_id(x["row"], x["col"])), " ").alias("cells"))


@query("c5_row_token", f"""
SELECT doc_id, page, annotation_index, CASE WHEN {ROW('comment_range')} = {ROW('comment_range', 1)} THEN concat({ROW('comment_range')}, '/', {COL('comment_range')}, '/', {COL('comment_range', 1)}) END AS tok,
 CASE WHEN {ROW('comment_range')} <> {ROW('comment_range', 1)} THEN 'unparseable' WHEN {ROW('comment_range')} > 30 THEN 'row_oob' WHEN {COL('comment_range', 1)} > 20 THEN 'col_oob' END AS err,
 CASE WHEN anchor_range = 'Z90:Z90' THEN 'row_oob' END AS anchor_err
FROM fx_annotations""")
def _(t):
    tok = X.row_token("comment_range")
    text = F.when(tok.isNotNull(), F.concat_ws("/", tok["row"], tok["c1"], tok["c2"]))
    return t.fx_annotations.select(*P, "annotation_index", text.alias("tok"),
                                   X.row_token_error("comment_range", F.lit(30), F.lit(20)).alias("err"),
                                   X.row_token_error("anchor_range", F.lit(35), F.lit(24)).alias("anchor_err"))


_CELL_AT = f"""SELECT a.doc_id, a.page, a.annotation_index,
 greatest(1, least(g.cols, CAST(trunc((g.page_w_pts * (a.x_start_percent / 100.0) - g.left_margin_pts) / g.cell_size_pts) AS INT) + 1)) AS c,
 greatest(1, least(g.rows, CAST(trunc((g.page_h_pts * (a.y_position_percent / 100.0) - g.top_margin_pts) / g.cell_size_pts) AS INT) + 1)) AS r, g.cols
 FROM fx_annotations a JOIN fx_page_grid g ON g.doc_id = a.doc_id AND g.page = a.page"""


@query("c6_percent_to_cell", f"""
SELECT doc_id, page, annotation_index, {ID('r', 'c')} AS cell, concat('A', r) AS top_cell, {ID('r', 'cols')} AS bottom_cell FROM ({_CELL_AT}) t""")
def _(t):
    j = t.fx_annotations.join(t.fx_page_grid, P)
    return j.select(*P, "annotation_index", X.percent_to_cell("x_start_percent", "y_position_percent").alias("cell"),
                    X.cell_at_y("y_position_percent", "top").alias("top_cell"), X.cell_at_y("y_position_percent", "bottom").alias("bottom_cell"))


@query("c7_cell_rect_percent", f"""
SELECT doc_id, page, row, col, {PX('col - 1', 2)} AS x1_percent, {PY('row - 1', 2)} AS y1_percent, {PX('col', 2)} AS x2_percent, {PY('row', 2)} AS y2_percent FROM fx_cells""")
def _(t):
    j = t.fx_cells.join(t.fx_page_grid.select(*P, *G.GRID_COLUMNS), P)
    return j.select(*P, "row", "col", X.rect_percent("row", "col", "row", "col").alias("b")).select(*P, "row", "col", "b.*")


@query("t4_cell_rectangles", f"""
SELECT doc_id, page, row, col, {ID('row', 'col')} AS cell_id, {PX('col - 1')} AS x_start_percent, {PX('col')} AS x_end_percent, {PY('row - 1')} AS y_start_percent, {PY('row')} AS y_end_percent,
 9.5 + (col - 1) * 24.0::DOUBLE AS pdf_x1, 1.0 + (row - 1) * 24.0::DOUBLE AS pdf_y1, 9.5 + col * 24.0::DOUBLE AS pdf_x2, 1.0 + row * 24.0::DOUBLE AS pdf_y2 FROM fx_cells""")
def _(t):
    return G.cell_rectangles(t.fx_cells.select(*P, "row", "col"), t.fx_page_grid)


@query("c8_rect_relations", f"""
SELECT doc_id, question_id, {ROW('score_range')} <= {ROW('score_box_range', 1)} AND {ROW('score_box_range')} <= {ROW('score_range', 1)} AND {COL('score_range')} <= {COL('score_box_range', 1)} AND {COL('score_box_range')} <= {COL('score_range', 1)} AS overlap,
 {ROW('score_range')} >= {ROW('score_box_range')} AND {ROW('score_range', 1)} <= {ROW('score_box_range', 1)} AND {COL('score_range')} >= {COL('score_box_range')} AND {COL('score_range', 1)} <= {COL('score_box_range', 1)} AS inside FROM fx_items""")
def _(t):
    a, b = X.range_bounds("score_range"), X.range_bounds("score_box_range")
    return t.fx_items.select("doc_id", "question_id", X.rects_overlap(a, b).alias("overlap"), X.rect_contains(b, a).alias("inside"))


@query("c9_content_to_pdf", """
SELECT doc_id, page, annotation_index, round_even((w * 0.18 + x1 / 100.0 * (w * 0.97 - w * 0.18)) * 100, 0) / 100 AS pdf_x1, round_even(least(a, b) * 100, 0) / 100 AS pdf_y1,
 round_even((w * 0.18 + x2 / 100.0 * (w * 0.97 - w * 0.18)) * 100, 0) / 100 AS pdf_x2, round_even(greatest(a, b) * 100, 0) / 100 AS pdf_y2
FROM (SELECT doc_id, page, annotation_index, x_start_percent AS x1, x_end_percent AS x2, CAST(595 AS DOUBLE) AS w,
 842.0::DOUBLE - (842.0::DOUBLE * 0.04::DOUBLE + y_position_percent / 100.0 * (842.0::DOUBLE * 0.93::DOUBLE - 842.0::DOUBLE * 0.04::DOUBLE)) AS a,
 842.0::DOUBLE - (842.0::DOUBLE * 0.04::DOUBLE + (y_position_percent + 2) / 100.0 * (842.0::DOUBLE * 0.93::DOUBLE - 842.0::DOUBLE * 0.04::DOUBLE)) AS b FROM fx_annotations) t""")
def _(t):
    y = F.col("y_position_percent")
    box = X.content_percent_to_pdf("x_start_percent", y, "x_end_percent", y + 2, F.lit(595.0), F.lit(842.0))
    return t.fx_annotations.select(*P, "annotation_index", box.alias("b")).select(*P, "annotation_index", "b.*")


@query("c9_canvas_to_pdf", """
SELECT session_id, ord, round_even(x / 1240.0::DOUBLE * 595.0::DOUBLE * 100, 0) / 100 AS pdf_x, round_even((842.0::DOUBLE - y / 1754.0::DOUBLE * 842.0::DOUBLE) * 100, 0) / 100 AS pdf_y,
 round_even(x / 1240.0::DOUBLE * 100 * 100, 0) / 100 AS pct_x, round_even(y / 1754.0::DOUBLE * 100 * 100, 0) / 100 AS pct_y FROM fx_placements""")
def _(t):
    spot = X.canvas_to_pdf("x", "y", F.lit(1240.0), F.lit(1754.0), F.lit(595.0), F.lit(842.0))
    return t.fx_placements.select("session_id", "ord", spot.alias("s")).select("session_id", "ord", "s.*")


@query("c29_range_points", f"""
SELECT doc_id, page, annotation_index, 9.5 + ({COL('comment_range')} - 1) * 24.0::DOUBLE AS x1_pts, 1.0 + ({ROW('comment_range')} - 1) * 24.0::DOUBLE AS y1_pts,
 9.5 + {COL('comment_range', 1)} * 24.0::DOUBLE AS x2_pts, 1.0 + {ROW('comment_range', 1)} * 24.0::DOUBLE AS y2_pts FROM fx_annotations""")
def _(t):
    j = t.fx_annotations.join(t.fx_page_grid, P)
    return j.select(*P, "annotation_index", X.range_points("comment_range").alias("b")).select(*P, "annotation_index", "b.*")


@query("c34_rect_rows", f"""
SELECT doc_id, page, annotation_index, string_agg({RID('r', 'c1', 'r', 'c2')}, ' ' ORDER BY r) AS tokens FROM (SELECT *, unnest(generate_series(r1, r2)) AS r FROM (
 SELECT doc_id, page, annotation_index, {ROW('comment_range')} AS r1, {ROW('comment_range', 1)} AS r2, {COL('comment_range')} AS c1, {COL('comment_range', 1)} AS c2 FROM fx_annotations) a) b GROUP BY ALL""")
def _(t):
    b = t.fx_annotations.select(*P, "annotation_index", X.range_bounds("comment_range").alias("b"))
    return b.select(*P, "annotation_index", F.array_join(X.rect_rows("b.r1", "b.c1", "b.r2", "b.c2"), " ").alias("tokens"))


def _metrics_sql(ink: str, raw: str, lo: str, hi: str, src: str) -> str:
    return f"""
SELECT doc_id, page, row, col, round_even(score * 10000, 0) / 10000 AS score, round_even(ratio * 10000, 0) / 10000 AS ink_ratio, score >= {lo} AND ratio <= {hi} AS writable FROM (
 SELECT doc_id, page, row, col, ratio, least(greatest({raw}, 0.0::DOUBLE), 1.0::DOUBLE) AS score FROM (
  SELECT *, sqrt(greatest(0.0::DOUBLE, s2 / n / 65025.0::DOUBLE - mean * mean)) AS std FROM (
   SELECT doc_id, page, row, col, CAST(sum(value) AS DOUBLE) / count(*) / 255.0::DOUBLE AS mean, CAST(sum(value * value) AS DOUBLE) AS s2, count(*) AS n, CAST(sum(CASE WHEN {ink} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS ratio
   FROM ({src}) p GROUP BY doc_id, page, row, col) a) b) c"""


_PIX_CELLS = """SELECT *, CAST(ceil(((y + 1) / (6.0::DOUBLE / 72.0::DOUBLE) - 1.0::DOUBLE) / 24.0::DOUBLE) AS INT) AS row, CAST(ceil(((x + 1) / (6.0::DOUBLE / 72.0::DOUBLE) - 9.5::DOUBLE) / 24.0::DOUBLE) AS INT) AS col FROM fx_pixels"""


@query("a1_cell_metrics", _metrics_sql("value / 255.0::DOUBLE < 0.75::DOUBLE", "mean - std", "0.88::DOUBLE", "0.005::DOUBLE", _PIX_CELLS))
def _(t):
    return G.cell_metrics(t.fx_pixels, t.fx_page_grid, dpi=6.0)


@query("a1_cell_metrics_v1", _metrics_sql("value / 255.0::DOUBLE < 0.45::DOUBLE", "mean * (1.0::DOUBLE - least(1.0::DOUBLE, std * 3.0::DOUBLE))", "0.85::DOUBLE", "0.03::DOUBLE", _PIX_CELLS))
def _(t):
    return G.cell_metrics(t.fx_pixels, t.fx_page_grid, dpi=6.0, rule="v1")


@query("a1_coarse_scores", """
SELECT doc_id, page, row0, col0, least(greatest(mean * (1.0::DOUBLE - least(1.0::DOUBLE, sqrt(greatest(0.0::DOUBLE, s2 / n / 65025.0::DOUBLE - mean * mean)) * 3.0::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE) AS score FROM (
 SELECT doc_id, page, CAST(ceil((y + 1) * 20 / 70.0::DOUBLE) AS INT) - 1 AS row0, CAST(ceil((x + 1) * 8 / 48.0::DOUBLE) AS INT) - 1 AS col0,
  CAST(sum(value) AS DOUBLE) / count(*) / 255.0::DOUBLE AS mean, CAST(sum(value * value) AS DOUBLE) AS s2, count(*) AS n FROM fx_pixels GROUP BY ALL) a""")
def _(t):
    sizes = t.fx_page_grid.select(*P, F.lit(70).alias("height"), F.lit(48).alias("width"))
    return G.coarse_scores(t.fx_pixels, sizes)


_RUNS = """SELECT doc_id, page, row, min(col) AS start_col, max(col) AS end_col, CAST(count(*) AS INT) AS cell_count,
 round_even(CAST(sum(CAST(round_even(score * 10000, 0) AS BIGINT)) AS DOUBLE) / count(*) / 10000 * 10000, 0) / 10000 AS mean_score,
 round_even(CAST(sum(CAST(round_even(ink_ratio * 10000, 0) AS BIGINT)) AS DOUBLE) / count(*) / 10000 * 10000, 0) / 10000 AS mean_ink_ratio
 FROM (SELECT *, col - row_number() OVER (PARTITION BY doc_id, page, row ORDER BY col) AS isl FROM fx_cells WHERE writable) t
 GROUP BY doc_id, page, row, isl"""


@query("w1_writable_runs", f"SELECT *, {RID('row', 'start_col', 'row', 'end_col')} AS range_id FROM ({_RUNS} HAVING count(*) >= 2) r")
def _(t):
    return G.writable_runs(t.fx_cells, 2)


@query("w1_runs_all", f"SELECT doc_id, page, row, start_col, end_col, {PX('start_col - 1')} AS x_start_percent, {PX('end_col')} AS x_end_percent, {PY('row - 1')} AS y_start_percent, {PY('row')} AS y_end_percent FROM ({_RUNS}) r")
def _(t):
    return G.with_percent(G.writable_runs(t.fx_cells, 1).select(*P, "row", "start_col", "end_col"), t.fx_page_grid)


_RECTS = """(WITH h AS (SELECT doc_id, page, row, col, CASE WHEN writable THEN row - coalesce(max(CASE WHEN NOT writable THEN row END) OVER (PARTITION BY doc_id, page, col ORDER BY row), 0) ELSE 0 END AS ht FROM fx_cells),
 lim AS (SELECT a.doc_id, a.page, a.row, a.col, a.ht, coalesce(max(CASE WHEN b.col < a.col AND b.ht < a.ht THEN b.col END), 0) + 1 AS c1, coalesce(min(CASE WHEN b.col > a.col AND b.ht < a.ht THEN b.col END), 25) - 1 AS c2
  FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.page = b.page AND a.row = b.row WHERE a.ht > 0 GROUP BY a.doc_id, a.page, a.row, a.col, a.ht),
 rc AS (SELECT DISTINCT doc_id, page, row - ht + 1 AS r1, row AS r2, c1, c2 FROM lim WHERE ht >= 2 AND c2 - c1 >= 1),
 mx AS (SELECT * FROM rc x WHERE NOT EXISTS (SELECT 1 FROM rc y WHERE y.doc_id = x.doc_id AND y.page = x.page AND y.r1 <= x.r1 AND y.r2 >= x.r2 AND y.c1 <= x.c1 AND y.c2 >= x.c2
   AND (y.r1 < x.r1 OR y.r2 > x.r2 OR y.c1 < x.c1 OR y.c2 > x.c2))),
 rk AS (SELECT *, CAST((r2 - r1 + 1) * (c2 - c1 + 1) AS INT) AS area, row_number() OVER (PARTITION BY doc_id, page ORDER BY (r2 - r1 + 1) * (c2 - c1 + 1) DESC, r1, c1, r2, c2) AS rn FROM mx)
 SELECT doc_id, page, CAST(rn AS INT) AS region_no, CAST(r1 AS INT) AS row_start, CAST(r2 AS INT) AS row_end, CAST(c1 AS INT) AS col_start, CAST(c2 AS INT) AS col_end, area AS cell_count FROM rk WHERE rn <= 32)"""


@query("w9_writable_regions", f"SELECT *, concat('R', region_no) AS region_id, {RID('row_start', 'col_start', 'row_end', 'col_end')} AS range_id FROM {_RECTS} x")
def _(t):
    return _regions(t)


def _regions(t):
    return G.writable_regions(G.page_masks(t.fx_cells, t.fx_page_grid))


@query("j18_region_cells", f"SELECT doc_id, page, region_no, string_agg({ID('r', 'c')}, ' ' ORDER BY r, c) AS cell_ids FROM (SELECT doc_id, page, region_no, r, unnest(generate_series(col_start, col_end)) AS c FROM (SELECT *, unnest(generate_series(row_start, row_end)) AS r FROM {_RECTS} x) y) z GROUP BY ALL")
def _(t):
    return _regions(t).select(*P, "region_no", F.array_join(G.region_cell_ids(), " ").alias("cell_ids"))


_HINTS = f"""(SELECT doc_id, page, range_id AS hint FROM (SELECT doc_id, page, {RID('row_start', 'col_start', 'row_end', 'col_end')} AS range_id,
 row_number() OVER (PARTITION BY doc_id, page ORDER BY cell_count DESC, abs(50.0 - cy) DESC, region_no) AS rn FROM (
  SELECT *, ({PX('col_start - 1')} + {PX('col_end')}) / 2.0 AS cx, ({PY('row_start - 1')} + {PY('row_end')}) / 2.0 AS cy FROM {_RECTS} x) y WHERE cx >= 48.0 AND cy BETWEEN 18.0 AND 82.0) z WHERE rn = 1)"""


@query("w10_marking_hints", f"SELECT * FROM {_HINTS} h")
def _(t):
    return hints(t)


def hints(t):
    return G.marking_hints(G.with_percent(_regions(t), t.fx_page_grid, "row_start", "col_start", "row_end", "col_end"))


@query("u13_blob_regions")
def _(t):
    return G.blob_regions(G.page_masks(t.fx_cells, t.fx_page_grid))


@query("c32_region_class", """
SELECT doc_id, page, row0, col0, CASE WHEN score >= 0.9 THEN 'solid' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END AS cls FROM fx_coarse""")
def _(t):
    return t.fx_coarse.select(*P, "row0", "col0", S.region_class("score").alias("cls"))


# ---- zones ----------------------------------------------------------------

_FZ = """(SELECT * FROM (SELECT doc_id, page, round_even(col0 * 100.0::DOUBLE / 8 * 100, 0) / 100 AS x_start_percent, round_even(least((col0 + 1) * 100.0::DOUBLE / 8, 100.0::DOUBLE) * 100, 0) / 100 AS x_end_percent,
 round_even(row0 * 100.0::DOUBLE / 20 * 100, 0) / 100 AS y_start_percent, round_even(least((row0 + 1) * 100.0::DOUBLE / 20, 100.0::DOUBLE) * 100, 0) / 100 AS y_end_percent,
 round_even(score * 10000, 0) / 10000 AS score, row0, col0, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(score * 10000, 0) / 10000 DESC, row0, col0) AS INT) AS zone_pos
 FROM fx_coarse WHERE row0 < 18 AND col0 >= 2 AND score >= 0.7) z WHERE zone_pos <= {n})"""


@query("w2_free_zones", f"SELECT * FROM {_FZ.format(n=15)} z")
def _(t):
    return Z.free_zones(t.fx_coarse)


_FOLD = "list_reduce(list({s} ORDER BY {k}), lambda a, b: round_even((a + b) / 2.0 * 10000, 0) / 10000)"
_MERGED = f"""(WITH z AS (SELECT * FROM {_FZ.format(n=30)} q),
 h AS (SELECT doc_id, page, row0, min(col0) AS col0, arg_min(x_start_percent, col0) AS x_start_percent, arg_max(x_end_percent, col0) AS x_end_percent, min(y_start_percent) AS y_start_percent, min(y_end_percent) AS y_end_percent,
  {_FOLD.format(s='score', k='col0')} AS score FROM (SELECT *, col0 - row_number() OVER (PARTITION BY doc_id, page, row0 ORDER BY col0) AS isl FROM z) a GROUP BY doc_id, page, row0, isl),
 v AS (SELECT doc_id, page, min(row0) AS row0, col0, arg_min(x_start_percent, row0) AS x_start_percent, arg_min(x_end_percent, row0) AS x_end_percent, arg_min(y_start_percent, row0) AS y_start_percent, arg_max(y_end_percent, row0) AS y_end_percent,
  {_FOLD.format(s='score', k='row0')} AS score FROM (SELECT *, row0 - row_number() OVER (PARTITION BY doc_id, page, col0 ORDER BY row0) AS isl FROM h) a GROUP BY doc_id, page, col0, isl)
 SELECT doc_id, page, x_start_percent, x_end_percent, y_start_percent, y_end_percent, score, row0, col0,
  CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, y_start_percent, col0, row0) AS INT) AS zone_pos FROM v)"""


@query("w3_merge_zones", f"SELECT * FROM {_MERGED} m")
def _(t):
    return Z.merge_zones(Z.free_zones(t.fx_coarse, top_n=30))


@query("w2w3_page_free_zones", f"SELECT * FROM {_MERGED} m WHERE zone_pos <= 15")
def _(t):
    return Z.page_free_zones(t.fx_coarse)


_SNAP = f"""(SELECT a.doc_id, a.page, a.item_index, a.annotation_index, a.y_position_percent, a.x_start_percent, a.x_end_percent, arg_min(z.zone_pos, (abs((z.y_start_percent + z.y_end_percent) / 2.0 - a.y_position_percent), z.zone_pos)) AS zp
 FROM fx_annotations a LEFT JOIN (SELECT * FROM {_MERGED} m WHERE zone_pos <= 15) z ON z.doc_id = a.doc_id AND z.page = a.page AND abs((z.y_start_percent + z.y_end_percent) / 2.0 - a.y_position_percent) <= 30 GROUP BY ALL)"""
_SNAPPED = f"""SELECT s.doc_id, s.page, s.item_index, s.annotation_index, CASE WHEN zp IS NULL THEN s.y_position_percent ELSE round_even((z.y_start_percent + z.y_end_percent) / 2.0 * 100, 0) / 100 END AS y_position_percent,
 coalesce(z.x_start_percent, s.x_start_percent) AS x_start_percent, coalesce(z.x_end_percent, s.x_end_percent) AS x_end_percent, zp IS NOT NULL AS snapped, z.score AS snap_score
FROM {_SNAP} s LEFT JOIN {_MERGED} z ON z.doc_id = s.doc_id AND z.page = s.page AND z.zone_pos = s.zp"""


def _anns(t):
    return t.fx_annotations.select(*P, "item_index", "annotation_index", "y_position_percent", "x_start_percent", "x_end_percent")


@query("j16_snap_nearest", _SNAPPED)
def _(t):
    return Z.snap_nearest(_anns(t), Z.page_free_zones(t.fx_coarse))


@query("a15_snap_counts", f"SELECT doc_id, count(*) FILTER (WHERE snapped) AS snapped, count(*) AS annotations FROM ({_SNAPPED}) s GROUP BY doc_id")
def _(t):
    return Z.snap_counts(Z.snap_nearest(_anns(t), Z.page_free_zones(t.fx_coarse)))


@query("a15_zone_counts", f"""
SELECT g.doc_id, count(DISTINCT g.page) AS page_count, count(z.zone_pos) AS total_zones FROM fx_page_grid g LEFT JOIN (SELECT * FROM {_MERGED} m WHERE zone_pos <= 15) z ON z.doc_id = g.doc_id AND z.page = g.page GROUP BY g.doc_id""")
def _(t):
    return Z.zone_counts(t.fx_page_grid, Z.page_free_zones(t.fx_coarse))


@query("u2_assign_zones")
def _(t):
    return Z.assign_zones(_anns(t), Z.page_free_zones(t.fx_coarse))


@query("u9_diverse_points")
def _(t):
    cand = t.fx_coarse.select(*P, (F.col("row0") * 8 + F.col("col0")).alias("pos"), (1 - F.col("score")).alias("proximity"),
                              ((F.col("row0") + 0.5) * 5.0).alias("y_pct"), ((F.col("col0") + 0.5) * 12.5).alias("x_pct"))
    return Z.diverse_points(cand, max_prox=0.2, sample_rows=20, sample_cols=8)


@query("a2_otsu", """
SELECT doc_id, page, CASE WHEN max(between_) IS NULL THEN 128 ELSE arg_max(value, (coalesce(between_, -1), -value)) END AS threshold FROM (
 SELECT doc_id, page, value, CASE WHEN wb > 0 AND w - wb > 0 THEN wb * (w - wb) * (sb / wb - (s - sb) / (w - wb)) * (sb / wb - (s - sb) / (w - wb)) END AS between_ FROM (
  SELECT doc_id, page, value, CAST(sum(n) OVER u AS DOUBLE) AS wb, CAST(sum(n * value) OVER u AS DOUBLE) AS sb, CAST(sum(n) OVER a AS DOUBLE) AS w, CAST(sum(n * value) OVER a AS DOUBLE) AS s
  FROM (SELECT doc_id, page, value, count(*) AS n FROM fx_pixels GROUP BY ALL) h
  WINDOW u AS (PARTITION BY doc_id, page ORDER BY value ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY doc_id, page)) x) y GROUP BY doc_id, page""")
def _(t):
    return Z.otsu(Z.pixel_histogram(t.fx_pixels))


@query("pf22_clamp_params", """
SELECT p_partkey, least(greatest(p_size, 4), 40) AS rows, least(greatest(p_size - 20, 4), 20) AS cols, least(greatest(p_retailprice / 1000 - 0.5, 0.0), 1.0) AS min_score FROM part""")
def _(t):
    raw = t.part.select("p_partkey", F.col("p_size").alias("rows"), (F.col("p_size") - 20).alias("cols"), (F.col("p_retailprice") / 1000 - 0.5).alias("min_score"))
    return Z.clamp_params(raw)


@query("c12_zone_score", """
SELECT a.doc_id, a.page, a.annotation_index, z.row0, z.col0, CASE WHEN b1 = b2 THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END + (35.0::DOUBLE - abs(zy - y)) + z.score * 5.0::DOUBLE AS score FROM (
 SELECT *, y_position_percent AS y, CASE WHEN y_position_percent < 33 THEN 't' WHEN y_position_percent > 67 THEN 'b' ELSE 'm' END AS b2 FROM fx_annotations) a
 JOIN (SELECT *, row0 * 5.0 + 2.5 AS zy, CASE WHEN row0 * 5.0 + 2.5 < 33 THEN 't' WHEN row0 * 5.0 + 2.5 > 67 THEN 'b' ELSE 'm' END AS b1 FROM fx_coarse) z ON z.doc_id = a.doc_id AND z.page = a.page""")
def _(t):
    z = t.fx_coarse.select(*P, "row0", "col0", F.col("score").alias("zs"), (F.col("row0") * 5.0 + 2.5).alias("zy"))
    return t.fx_annotations.join(z, P).select(*P, "annotation_index", "row0", "col0", S.zone_score("zy", "y_position_percent", "zs").alias("score"))


@query("c13_semantic_bucket", """
SELECT doc_id, page, annotation_index, CASE WHEN y_position_percent < 33 THEN 'top' WHEN y_position_percent > 67 THEN 'bottom' ELSE 'mid' END AS bucket FROM fx_annotations""")
def _(t):
    return t.fx_annotations.select(*P, "annotation_index", S.semantic_bucket("y_position_percent").alias("bucket"))


# ---- cell sets ------------------------------------------------------------

_BC = f"""(SELECT DISTINCT doc_id, page, kind, block_id, row, unnest(generate_series({COL('token')}, {COL('token', 1)})) AS col FROM fx_blocks)"""


@query("j11_free_cells", f"""
SELECT c.doc_id, c.page, c.row, c.col FROM fx_cells c WHERE c.writable AND NOT EXISTS (SELECT 1 FROM {_BC} b WHERE b.doc_id = c.doc_id AND b.page = c.page AND b.row = c.row AND b.col = c.col)""")
def _(t):
    return _free(t)


def _free(t):
    return CE.free_cells(t.fx_cells, CE.block_cells(t.fx_blocks, t.fx_page_grid, keep=P))


_FREE = f"(SELECT c.doc_id, c.page, c.row, c.col FROM fx_cells c WHERE c.writable AND NOT EXISTS (SELECT 1 FROM {_BC} b WHERE b.doc_id = c.doc_id AND b.page = c.page AND b.row = c.row AND b.col = c.col))"


def _segments(src: str) -> str:
    return f"(SELECT doc_id, page, row, min(col) AS c1, max(col) AS c2 FROM (SELECT *, col - row_number() OVER (PARTITION BY doc_id, page, row ORDER BY col) AS isl FROM {src} s) t GROUP BY doc_id, page, row, isl)"


@query("a12_compact_ranges", f"SELECT doc_id, page, row, CAST(c1 AS INT) AS c1, CAST(c2 AS INT) AS c2, {RID('row', 'c1', 'row', 'c2')} AS token FROM {_segments(_FREE)} g")
def _(t):
    return CE.compact_ranges(_free(t))


_OCC = f"(SELECT DISTINCT doc_id, page, row, col FROM {_BC} b WHERE kind = 'handwritten_answer')"


@query("a12_spatial_payload", f"""
SELECT coalesce(f.doc_id, o.doc_id) AS doc_id, coalesce(f.page, o.page) AS page, coalesce(f.t, '') AS free, coalesce(o.t, '') AS occupied FROM
 (SELECT doc_id, page, string_agg({RID('row', 'c1', 'row', 'c2')}, ' ' ORDER BY row, c1) AS t FROM {_segments(_FREE)} g GROUP BY ALL) f
 FULL JOIN (SELECT doc_id, page, string_agg({RID('row', 'c1', 'row', 'c2')}, ' ' ORDER BY row, c1) AS t FROM {_segments(_OCC)} g GROUP BY ALL) o ON o.doc_id = f.doc_id AND o.page = f.page""")
def _(t):
    occ = CE.block_cells(t.fx_blocks.filter("kind = 'handwritten_answer'"), t.fx_page_grid, keep=P)
    out = CE.spatial_payload(_free(t), occ)
    return out.select(*P, F.array_join("free", " ").alias("free"), F.array_join("occupied", " ").alias("occupied"))


@query("so6_distinct_cells", f"SELECT DISTINCT doc_id, page, row, CAST(col AS INT) AS col FROM {_BC} b")
def _(t):
    return CE.distinct_cells(t.fx_blocks, t.fx_page_grid, P)


@query("j10_snap_blocks", f"""
WITH s AS (SELECT b.doc_id, b.page, b.block_id, b.kind, b.row, b.col, c.writable FROM {_BC} b JOIN fx_cells c ON c.doc_id = b.doc_id AND c.page = b.page AND c.row = b.row AND c.col = b.col),
 t AS (SELECT doc_id, page, block_id, kind, row, min(col) AS a1, max(col) AS a2, min(CASE WHEN kind <> 'handwritten_answer' OR NOT writable THEN col END) AS u1, max(CASE WHEN kind <> 'handwritten_answer' OR NOT writable THEN col END) AS u2 FROM s GROUP BY ALL),
 u AS (SELECT *, max(CASE WHEN u1 IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, block_id) AS anyink FROM t)
SELECT doc_id, page, block_id, kind, row, {RID('row', 'c1', 'row', 'c2')} AS token FROM (SELECT *, CASE WHEN anyink = 1 THEN u1 ELSE a1 END AS c1, CASE WHEN anyink = 1 THEN u2 ELSE a2 END AS c2 FROM u) v WHERE c1 IS NOT NULL""")
def _(t):
    return CE.snap_blocks(t.fx_blocks, t.fx_cells, t.fx_page_grid)


_BND = f"(SELECT doc_id, page, block_id, min(row) AS r1, min(col) AS c1, max(row) AS r2, max(col) AS c2 FROM {_BC} b GROUP BY ALL)"


@query("a5_bounding", f"""
SELECT doc_id, page, block_id, {RID('r1', 'c1', 'r2', 'c2')} AS range_id, {PX('c1 - 1', 2)} AS x1_percent, {PY('r1 - 1', 2)} AS y1_percent, {PX('c2', 2)} AS x2_percent, {PY('r2', 2)} AS y2_percent FROM {_BND} b""")
def _(t):
    keys = [*P, "block_id"]
    return CE.bounding_boxes(CE.block_cells(t.fx_blocks, t.fx_page_grid, keep=keys), keys, t.fx_page_grid)


@query("j15_cells_in_rect", f"""
SELECT a.doc_id, a.page, a.annotation_index, c.row, c.col FROM (SELECT doc_id, page, annotation_index, x_start_percent AS x1, x_end_percent AS x2, y_position_percent - 2.5 AS y1, y_position_percent + 2.5 AS y2 FROM fx_annotations) a
JOIN (SELECT doc_id, page, row, col, ({PX('col - 1')} + {PX('col')}) / 2.0 AS cx, ({PY('row - 1')} + {PY('row')}) / 2.0 AS cy FROM fx_cells) c
 ON c.doc_id = a.doc_id AND c.page = a.page AND c.cx BETWEEN a.x1 AND a.x2 AND c.cy BETWEEN a.y1 AND a.y2""")
def _(t):
    y = F.col("y_position_percent")
    # corners deliberately swapped: the operator orders them
    rects = t.fx_annotations.select(*P, "annotation_index", F.col("x_end_percent").alias("x1"), F.col("x_start_percent").alias("x2"), (y + 2.5).alias("y1"), (y - 2.5).alias("y2"))
    return CE.cells_in_rect(rects, t.fx_page_grid, [*P, "annotation_index"])


@query("a14_occupancy", f"""
WITH b AS (SELECT doc_id, page, row, col, min(CASE WHEN kind = 'printed_question' THEN '2Q' WHEN kind = 'header_footer' THEN '1H' WHEN kind = 'marking_box' THEN '3M' ELSE '4A' END) AS first, max(CASE WHEN kind = 'handwritten_answer' THEN 1 ELSE 0 END) AS ans FROM {_BC} x GROUP BY ALL),
 n AS (SELECT DISTINCT doc_id, page, {ROW('comment_range')} AS row, unnest(generate_series({COL('comment_range')}, least(24, {COL('comment_range', 1)}))) AS col FROM fx_annotations WHERE {ROW('comment_range')} = {ROW('comment_range', 1)}),
 g AS (SELECT c.doc_id, c.page, c.row, c.col, CASE WHEN n.row IS NOT NULL THEN '*' WHEN b.first = '2Q' AND b.ans = 1 THEN 'A' WHEN b.first IS NOT NULL THEN substr(b.first, 2, 1) ELSE '.' END AS ch FROM fx_cells c
  LEFT JOIN b ON b.doc_id = c.doc_id AND b.page = c.page AND b.row = c.row AND b.col = c.col LEFT JOIN n ON n.doc_id = c.doc_id AND n.page = c.page AND n.row = c.row AND n.col = c.col)
SELECT doc_id, page, row, string_agg(ch, '' ORDER BY col) AS line FROM g GROUP BY ALL""")
def _(t):
    pos = F.regexp_extract("block_id", "b([0-9]+)$", 1).cast("int")
    blocks = t.fx_blocks.select(*P, pos.alias("block_pos"), "kind", "token")
    return CE.occupancy(blocks, t.fx_annotations.select(*P, F.col("comment_range").alias("token")), t.fx_page_grid)


@query("a6_slot_pool", f"""
WITH c AS (SELECT doc_id, page, {PX('col - 1')} AS x1, {PX('col')} AS x2, {PY('row - 1')} AS y1, {PY('row')} AS y2 FROM fx_cells WHERE writable),
 s AS (SELECT g.doc_id, g.page, i AS slot FROM fx_page_grid g CROSS JOIN (SELECT CAST(unnest(generate_series(0, 19)) AS INT) AS i) n)
SELECT s.doc_id, s.page, s.slot, round_even(coalesce(min(x1), 87.5) * 100, 0) / 100 AS x1_percent, round_even(coalesce(min(y1), s.slot * 5.0::DOUBLE) * 100, 0) / 100 AS y1_percent,
 round_even(coalesce(max(x2), 100.0) * 100, 0) / 100 AS x2_percent, round_even(coalesce(max(y2), s.slot * 5.0::DOUBLE + 5) * 100, 0) / 100 AS y2_percent
FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.page = s.page AND c.y1 >= s.slot * 5.0 AND c.y2 <= s.slot * 5.0 + 5 GROUP BY s.doc_id, s.page, s.slot""")
def _(t):
    return CE.slot_pool(t.fx_cells, t.fx_page_grid)


@query("a18_anchor_rows", f"""
SELECT doc_id, page, annotation_index, CASE WHEN anchor_range = 'Z90:Z90' THEN 17 ELSE 8 END AS anchor_row FROM fx_annotations""")
def _(t):
    return CE.anchor_rows(t.fx_annotations.select(*P, "annotation_index", F.col("anchor_range").alias("token")), t.fx_page_grid, [*P, "annotation_index"])


@query("j14_anchor_cell", f"SELECT doc_id, page, annotation_index, r AS row, c AS col FROM ({_CELL_AT}) t")
def _(t):
    j = t.fx_annotations.join(t.fx_page_grid, P)
    return j.select(*P, "annotation_index", X.percent_to_row("y_position_percent", "page_h_pts", "top_margin_pts", "cell_size_pts", "rows").alias("row"),
                    X.percent_to_col("x_start_percent", "page_w_pts", "left_margin_pts", "cell_size_pts", "cols").alias("col"))


@query("j20_verify_grid", """
SELECT doc_id, page, CASE WHEN page = 3 THEN 2 ELSE 0 END AS differences, page <> 3 AS matches FROM fx_page_grid""")
def _(t):
    service = t.fx_page_grid.withColumn("rows", F.when(F.col("page") == 3, 36).otherwise(F.col("rows"))).withColumn(
        "page_h_pts", F.when(F.col("page") == 3, 841.9).otherwise(F.col("page_h_pts")))
    return CE.verify_grid(t.fx_page_grid, service)


@query("j20_verify_boxes", f"""
SELECT b.doc_id, b.page, b.block_id, CASE WHEN b.page = 4 THEN FALSE ELSE TRUE END AS box_ok, 0 AS out_of_range FROM {_BND} b""")
def _(t):
    keys = [*P, "block_id"]
    cells = CE.block_cells(t.fx_blocks, t.fx_page_grid, keep=keys)
    ids = cells.groupBy(*keys).agg(F.collect_set(X.cell_id("row", "col")).alias("cell_ids"))
    boxes = CE.bounding_boxes(cells, keys, t.fx_page_grid).drop("range_id")
    off = boxes.withColumn("x1_percent", F.when(F.col("page") == 4, F.col("x1_percent") + 0.06).otherwise(F.col("x1_percent")))
    return CE.verify_boxes(ids.join(off, keys), t.fx_page_grid)


@query("j19_nearest_regions", f"""
SELECT doc_id, page, annotation_index, region_no, CAST(rn AS INT) AS rank FROM (SELECT a.doc_id, a.page, a.annotation_index, x.region_no,
  row_number() OVER (PARTITION BY a.doc_id, a.page, a.annotation_index ORDER BY sqrt(((x.row_start + x.row_end) / 2.0::DOUBLE - a.r) * ((x.row_start + x.row_end) / 2.0::DOUBLE - a.r) + ((x.col_start + x.col_end) / 2.0::DOUBLE - a.c) * ((x.col_start + x.col_end) / 2.0::DOUBLE - a.c)), x.region_no) AS rn
 FROM ({_CELL_AT}) a JOIN {_RECTS} x ON x.doc_id = a.doc_id AND x.page = a.page AND x.row_end - x.row_start + 1 >= 2 AND x.col_end - x.col_start + 1 >= 4) t WHERE rn <= 8""")
def _(t):
    from gradelake.operators.placement import nearest_shapes

    j = t.fx_annotations.join(t.fx_page_grid, P)
    anchors = j.select(*P, "annotation_index", X.percent_to_row("y_position_percent", "page_h_pts", "top_margin_pts", "cell_size_pts", "rows").alias("anchor_row"),
                       X.percent_to_col("x_start_percent", "page_w_pts", "left_margin_pts", "cell_size_pts", "cols").alias("anchor_col"))
    return nearest_shapes(anchors, _regions(t), 8, min_rows=2, min_cols=4).select(*P, "annotation_index", "region_no", "rank")


@query("s3_largest_regions", f"SELECT doc_id, page, region_no, cell_count FROM {_RECTS} x WHERE region_no <= 5")
def _(t):
    return top_k(_regions(t), P, [F.col("cell_count").desc(), F.col("region_no")], 5).select(*P, "region_no", "cell_count")
