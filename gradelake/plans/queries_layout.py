"""Page layout, rasters and placement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import coords as X
from gradelake.functions import scoring as S
from gradelake.operators import cells as CE
from gradelake.operators import grid as G
from gradelake.operators import layout as LA
from gradelake.operators import placement as PL
from gradelake.operators import raster as RA
from gradelake.operators import zones as Z
from gradelake.operators.keyed import top_k
from gradelake.plans.queries_cells import _CELL_AT, _PIX_CELLS, _metrics_sql, _regions
from gradelake.plans.queries_quality import marking_items
from gradelake.plans.registry import query

P = ["doc_id", "page"]
H, W = 1500, 1060  # pixel size of the pages the layout tables describe

# ---- lines, gaps, strips ---------------------------------------------------

_LINES = """(WITH c AS (SELECT doc_id, page, CAST(cy AS DOUBLE) AS cy FROM fx_components WHERE h > 12 AND h < 90 AND w > 5 AND w < 150 AND area > 40 AND area < 8000),
 n AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY doc_id, page ORDER BY cy) < 22 THEN 0 ELSE 1 END AS new FROM c),
 b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY cy) AS b FROM n),
 r AS (SELECT doc_id, page, CAST(trunc(median(cy)) AS INT) AS y FROM b GROUP BY doc_id, page, b HAVING count(*) >= 3),
 f AS (SELECT doc_id, page, list_reduce(list_prepend({'k': CAST([] AS INT[]), 'l': -100000}, list_transform(list(y ORDER BY y), lambda v: {'k': [v], 'l': v})),
   lambda a, b: CASE WHEN b.l - a.l > 35 THEN {'k': list_concat(a.k, b.k), 'l': b.l} ELSE a END).k AS ys FROM r GROUP BY doc_id, page)
 SELECT doc_id, page, CAST(i AS INT) AS line, ys[i] AS y FROM (SELECT doc_id, page, ys, unnest(generate_series(1, len(ys))) AS i FROM f) u)"""


@query("w12_text_lines", f"SELECT * FROM {_LINES} l")
def _(t):
    return LA.text_lines(t.fx_components.withColumn("cy", F.col("cy").cast("double")))


_LH = 27  # max(12, 1500 // 55)
_GAPS = f"""(SELECT doc_id, page, line AS after_line, y_top, y_bot, y_bot - y_top AS height, CAST(floor((y_top + y_bot) / 2.0) AS INT) AS y_center FROM (
 SELECT doc_id, page, line, y + {_LH + 4} AS y_top, coalesce(lead(y) OVER (PARTITION BY doc_id, page ORDER BY line) - {_LH + 4}, {H - 4}) AS y_bot FROM fx_lines) g WHERE y_bot - y_top >= 55)"""


@query("w13_line_gaps", f"SELECT * FROM {_GAPS} g")
def _(t):
    return LA.line_gaps(t.fx_lines, H)


_STRIPS = """(SELECT doc_id, page, zone, y_top, y_bot, y_bot - y_top AS height FROM (SELECT doc_id, page, zone, min(y) AS y_top, max(y) + 1 AS y_bot FROM (
 SELECT *, y - row_number() OVER (PARTITION BY doc_id, page, zone ORDER BY y) AS i FROM fx_projections WHERE ink <= CASE zone WHEN 2 THEN 200 ELSE 80 END) a GROUP BY doc_id, page, zone, i) b WHERE y_bot - y_top >= CASE zone WHEN 2 THEN 40 ELSE 35 END)"""


def strips(t):
    return LA.free_strips(t.fx_projections, {1: 80, 2: 200, 3: 80}, {1: 35, 2: 40, 3: 35})


@query("w14_free_strips", f"SELECT * FROM {_STRIPS} s")
def _(t):
    return strips(t)


@query("w14_tagged_strips", f"""
SELECT s.doc_id, s.page, s.y_top, s.y_bot, CAST(count(l.y) FILTER (WHERE l.y + 12 < s.y_top) AS INT) AS after_line, CAST(count(l.y) - count(l.y) FILTER (WHERE l.y - 12 > s.y_bot) AS INT) AS before_line
FROM {_STRIPS} s LEFT JOIN fx_lines l ON l.doc_id = s.doc_id AND l.page = s.page WHERE s.zone = 2 GROUP BY s.doc_id, s.page, s.y_top, s.y_bot""")
def _(t):
    return LA.tag_strips(strips(t).filter("zone = 2"), t.fx_lines, 400).select(*P, "y_top", "y_bot", "after_line", "before_line")


_WORDS = """(WITH m AS (SELECT doc_id, page, line, max(ink) AS peak, max(raw_ink) AS rp, max(x) + 1 AS w FROM fx_col_projections GROUP BY ALL),
 k AS (SELECT p.doc_id, p.page, p.line, p.x, m.rp, m.w, p.x - row_number() OVER (PARTITION BY p.doc_id, p.page, p.line ORDER BY p.x) AS i FROM fx_col_projections p JOIN m ON m.doc_id = p.doc_id AND m.page = p.page AND m.line = p.line WHERE m.peak > 0 AND p.ink > m.peak * 0.05),
 wd AS (SELECT doc_id, page, line, min(x) AS a, max(x) + 1 AS b, max(rp) AS rp, max(w) AS w FROM k GROUP BY doc_id, page, line, i HAVING max(x) + 1 - min(x) >= 15),
 g AS (SELECT *, b AS g1, lead(a) OVER (PARTITION BY doc_id, page, line ORDER BY a) AS g2 FROM wd)
 SELECT g.doc_id, g.page, g.line, coalesce(max(p.x) FILTER (WHERE p.raw_ink > CASE WHEN g.rp > 0 THEN g.rp * 0.03 ELSE 1 END AND p.x <= least(g1 + 25, g.w) - 1 AND p.x > greatest(0, g1 - 5)), g1) AS left_end,
  coalesce(min(p.x) FILTER (WHERE p.raw_ink > CASE WHEN g.rp > 0 THEN g.rp * 0.03 ELSE 1 END AND p.x >= greatest(0, g2 - 25) AND p.x < least(g.w, g2 + 5)), g2) AS right_start
 FROM g JOIN fx_col_projections p ON p.doc_id = g.doc_id AND p.page = g.page AND p.line = g.line WHERE g2 - g1 >= 10 GROUP BY g.doc_id, g.page, g.line, g1, g2)"""


@query("w15_word_gaps", f"SELECT *, right_start - left_end AS width, CAST(floor((left_end + right_start) / 2.0) AS INT) AS x_center FROM {_WORDS} w")
def _(t):
    return LA.word_gaps(t.fx_col_projections)


@query("w15_word_gaps_by_line", f"SELECT doc_id, page, count(DISTINCT line) AS n_lines, count(*) AS n_gaps FROM {_WORDS} w GROUP BY ALL")
def _(t):
    m = LA.word_gaps_by_line(LA.word_gaps(t.fx_col_projections))
    sizes = F.aggregate(F.map_values("word_gap_by_line"), F.lit(0), lambda a, xs: a + F.size(xs)).cast("bigint")
    return m.select(*P, F.size("word_gap_by_line").cast("bigint").alias("n_lines"), sizes.alias("n_gaps"))


_OCC = f"""(WITH s AS {_STRIPS}, b AS (SELECT *, coalesce(max(y_bot) OVER (PARTITION BY doc_id, page, zone ORDER BY y_top, y_bot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM s)
 SELECT doc_id, page, zone, cur AS y0, y_top AS y1 FROM b WHERE y_top > cur + 4
 UNION ALL SELECT doc_id, page, zone, max(y_bot) AS y0, 400 AS y1 FROM s GROUP BY doc_id, page, zone HAVING 400 - max(y_bot) > 4)"""


@query("w16_occupied_ranges", f"SELECT * FROM {_OCC} o")
def _(t):
    return LA.occupied_ranges(strips(t), 400)


@query("a19_row_projections", """
SELECT doc_id, page, CASE WHEN x < 6 THEN 1 WHEN x >= 42 THEN 3 ELSE 2 END AS zone, y, CAST(sum(value) AS BIGINT) AS ink FROM fx_pixels GROUP BY ALL""")
def _(t):
    return LA.row_projections(t.fx_pixels, 48)


@query("a19_column_projections", """
SELECT p.doc_id, p.page, l.line, p.x - 6 AS x, CAST(sum(value) AS BIGINT) AS ink FROM fx_pixels p JOIN (SELECT doc_id, page, line, CAST(floor(y / 25.0) AS INT) AS y FROM fx_lines) l ON l.doc_id = p.doc_id AND l.page = p.page
 AND p.y >= greatest(0, l.y - 12) AND p.y < least(70, l.y + 12) WHERE p.x >= 6 AND p.x < 42 GROUP BY ALL""")
def _(t):
    lines = t.fx_lines.select(*P, "line", F.floor(F.col("y") / 25.0).cast("int").alias("y"))
    return LA.column_projections(t.fx_pixels, lines, 70, 48)


_REQ = "(SELECT doc_id, page, pos, line FROM fx_remarks)"


def _gap_sql(prefer: str) -> str:
    order = "below, above" if prefer == "below" else "above, below"
    return f"""SELECT r.doc_id, r.page, r.pos, r.line, g.after_line, g.height FROM (SELECT r.doc_id, r.page, r.pos, r.line, coalesce({order}) AS pick FROM (
 SELECT r.doc_id, r.page, r.pos, r.line, min(g.after_line) FILTER (WHERE g.after_line BETWEEN r.line AND r.line + 5) AS below, max(g.after_line) FILTER (WHERE g.after_line >= r.line - 5 AND g.after_line < r.line) AS above
 FROM {_REQ} r LEFT JOIN {_GAPS} g ON g.doc_id = r.doc_id AND g.page = r.page GROUP BY ALL) r) r LEFT JOIN {_GAPS} g ON g.doc_id = r.doc_id AND g.page = r.page AND g.after_line = r.pick"""


def _requests(t):
    return t.fx_remarks.select(*P, "pos", "line")


@query("j21_best_gap", _gap_sql("below"))
def _(t):
    return LA.best_gap(_requests(t), LA.line_gaps(t.fx_lines, H)).select(*P, "pos", "line", "after_line", "height")


@query("j21_best_gap_above", _gap_sql("above"))
def _(t):
    return LA.best_gap(_requests(t), LA.line_gaps(t.fx_lines, H), prefer="above").select(*P, "pos", "line", "after_line", "height")


@query("j22_nearest_line", """
SELECT r.doc_id, r.page, r.pos, r.ty, arg_min(l.y, (abs(l.y - r.ty), l.y)) AS nearest FROM (SELECT doc_id, page, pos, line * 61 AS ty FROM fx_remarks) r LEFT JOIN fx_lines l ON l.doc_id = r.doc_id AND l.page = r.page GROUP BY r.doc_id, r.page, r.pos, r.ty""")
def _(t):
    return LA.nearest(t.fx_remarks.select(*P, "pos", (F.col("line") * 61).alias("ty")), t.fx_lines, P, "ty", "y")


def rects(t):
    """Free rectangles in pixels, from the writable regions of the page."""
    r = _regions(t)
    return r.select(*P, ((F.col("col_start") - 1) * 44).alias("x1"), ((F.col("row_start") - 1) * 42).alias("y1"), (F.col("col_end") * 44).alias("x2"), (F.col("row_end") * 42).alias("y2"),
                    (F.col("cell_count") * 44 * 42).alias("area"), ((F.col("col_start") - 1 + F.col("col_end")) * 22 * 100 / F.lit(1056.0)).alias("cx"),
                    ((F.col("row_start") - 1 + F.col("row_end")) * 21 * 100 / F.lit(1470.0)).alias("cy"))


def layout(t):
    sizes = t.fx_page_grid.select(*P, F.lit(W).alias("width"), F.lit(H).alias("height"))
    r = LA.nearest_line(rects(t), t.fx_lines)
    return LA.pack_layout(sizes, t.fx_lines, LA.line_gaps(t.fx_lines, H), LA.word_gaps(t.fx_col_projections), r)


@query("a17_layout_summary", f"""
SELECT g.doc_id, g.page, 18 AS lines, CAST((SELECT count(*) FROM {_GAPS} x WHERE x.doc_id = g.doc_id AND x.page = g.page) AS INT) AS gaps, CAST((SELECT count(*) FROM {_WORDS} x WHERE x.doc_id = g.doc_id AND x.page = g.page) AS INT) AS words,
 (SELECT count(*) FROM {_STRIPS} x WHERE x.doc_id = g.doc_id AND x.page = g.page AND zone = 1) AS left_strips, (SELECT count(*) FROM {_STRIPS} x WHERE x.doc_id = g.doc_id AND x.page = g.page AND zone = 3) AS right_strips FROM fx_page_grid g""")
def _(t):
    return LA.layout_summary(layout(t), strips(t)).select(*P, "lines", "gaps", "words", "left_strips", "right_strips")


def _pct(v: str, of: int) -> str:
    return f"round_even({v} / {of}::DOUBLE * 100.0::DOUBLE * 100, 0) / 100"


@query("a17_coordinate_suggestions", f"""
WITH s AS (SELECT s.doc_id, s.page, s.zone, s.y_top, s.y_bot, s.height, count(l.y) FILTER (WHERE l.y + {_LH} < s.y_top) AS above, count(l.y) - count(l.y) FILTER (WHERE l.y - {_LH} > s.y_bot) AS below,
  {_pct('s.y_top', H)} AS top, {_pct('s.y_bot', H)} AS bottom FROM {_STRIPS} s LEFT JOIN fx_lines l ON l.doc_id = s.doc_id AND l.page = s.page GROUP BY s.doc_id, s.page, s.zone, s.y_top, s.y_bot, s.height),
 m AS (SELECT doc_id, page, string_agg(concat(CAST(round_even((top + bottom) * 500, 0) AS BIGINT), ':', height, ':', above), ' ' ORDER BY y_top) AS margins, CAST(count(*) AS INT) AS n FROM s WHERE zone = 3 GROUP BY ALL),
 g AS (SELECT doc_id, page, string_agg(concat(above, ':', below, ':', CAST(round_even(top * 100, 0) AS BIGINT), ':', CAST(round_even(bottom * 100, 0) AS BIGINT), ':', height), ' ' ORDER BY above, y_top) AS gaps FROM s WHERE zone = 2 GROUP BY ALL),
 c AS (SELECT doc_id, page, line, CAST(round_even({_pct('floor((left_end + right_start) / 2.0)', W)} * 100, 0) AS BIGINT) AS x, left_end FROM {_WORDS} w),
 wl AS (SELECT doc_id, page, line, string_agg(x, ',' ORDER BY x) AS xs FROM c GROUP BY ALL), wg AS (SELECT doc_id, page, string_agg(concat(line, '=', xs), ' ' ORDER BY line) AS words FROM wl GROUP BY ALL)
SELECT p.doc_id, p.page, coalesce(margins, '') AS margins, coalesce(gaps, '') AS gaps, coalesce(words, '') AS words, 18 AS line_count FROM fx_page_grid p LEFT JOIN m USING (doc_id, page) LEFT JOIN g USING (doc_id, page) LEFT JOIN wg USING (doc_id, page)""")
def _(t):
    out = LA.coordinate_suggestions(layout(t), strips(t), t.fx_lines, H)

    def whole(x, times: int):
        return F.rint(x * times).cast("long")

    margins = F.transform("margin_anchors", lambda a: F.concat_ws(":", whole(a["y_pct"], 1000), a["height_px"], a["after_line"]))
    gaps = F.transform("gap_anchors", lambda a: F.concat_ws(":", a["after_line"], a["before_line"], whole(a["y_top_pct"], 100), whole(a["y_bot_pct"], 100), a["height_px"]))
    words = F.transform(F.array_sort(F.map_entries("word_gap_by_line")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda x: whole(x, 100)), ",")))
    return out.select(*P, F.array_join(margins, " ").alias("margins"), F.array_join(gaps, " ").alias("gaps"), F.array_join(words, " ").alias("words"), "line_count")


@query("j23_resolve_remarks", f"""
SELECT r.doc_id, r.page, r.pos, r.type, CASE r.type WHEN 'score_circle' THEN 0 WHEN 'tick' THEN 1 WHEN 'curly_brace' THEN 2 WHEN 'underline_remark' THEN 3 WHEN 'exponent_insert' THEN 5 ELSE 9 END AS priority,
 least(17, r.line - 1) AS line_idx, CASE WHEN r.type = 'score_circle' THEN NULL ELSE l.y END AS cy_px, CASE WHEN r.type <> 'score_circle' AND r.remark_zone = 'gap' AND p.height >= 36 THEN 'gap' ELSE 'right_margin' END AS zone_used,
 CASE WHEN r.type = 'underline_remark' THEN CAST(1060 * 0.1 AS INT) ELSE 148 END AS x_start_px, 922 AS x_end_px
FROM fx_remarks r JOIN fx_lines l ON l.doc_id = r.doc_id AND l.page = r.page AND l.line = least(18, r.line) JOIN ({_gap_sql('below')}) p ON p.doc_id = r.doc_id AND p.page = r.page AND p.pos = r.pos""")
def _(t):
    specs = t.fx_remarks.withColumn("line", F.col("line").cast("string")).withColumns({
        "x_start": F.when(F.col("type") == "underline_remark", "10").otherwise("auto_line"), "x_end": F.lit("auto_line")})
    out = LA.resolve_remarks(specs, layout(t))
    return out.select(*P, "pos", "type", "priority", "line_idx", F.when(F.col("type") != "score_circle", F.col("cy_px")).alias("cy_px"), "zone_used", "x_start_px", "x_end_px")


@query("s4_remark_order", """
SELECT doc_id, page, pos, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE type WHEN 'score_circle' THEN 0 WHEN 'tick' THEN 1 WHEN 'curly_brace' THEN 2 WHEN 'underline_remark' THEN 3 WHEN 'exponent_insert' THEN 5 ELSE 9 END, line, pos) AS INT) AS n FROM fx_remarks""")
def _(t):
    return LA.order_remarks(t.fx_remarks).select(*P, "pos", "n")


@query("pf21_remark_rank", """
SELECT doc_id, page, pos, CASE type WHEN 'score_circle' THEN 0 WHEN 'tick' THEN 1 WHEN 'curly_brace' THEN 2 WHEN 'underline_remark' THEN 3 WHEN 'exponent_insert' THEN 5 ELSE 9 END AS priority,
 CASE WHEN severity = 'odd' THEN 'suggestion' ELSE severity END AS severity_class FROM fx_remarks""")
def _(t):
    return LA.remark_rank(t.fx_remarks).select(*P, "pos", "priority", "severity_class")


@query("s6_first_strips", f"SELECT doc_id, page, zone, string_agg(concat(y_top, '-', y_bot), ' ' ORDER BY y_top) AS anchors FROM {_STRIPS} s GROUP BY ALL")
def _(t):
    return LA.strips_by_zone(strips(t)).select(*P, "zone", F.array_join(F.transform("strips", lambda s: F.concat_ws("-", s["y_top"], s["y_bot"])), " ").alias("anchors"))


@query("u8_margin_slots")
def _(t):
    remarks = t.fx_remarks.select(*P, F.when(F.col("pos") % 2 == 0, 1).otherwise(3).alias("zone"), "pos", (F.col("line") * 17).alias("pref_y"), (20 + F.col("pos") * 6).cast("int").alias("text_height"))
    sizes = t.fx_page_grid.select(*P, F.lit(400).alias("height"))
    return LA.margin_slots(remarks, LA.occupied_ranges(strips(t), 400), sizes)


# ---- rasters ---------------------------------------------------------------

_SPREAD = "(SELECT doc_id, page, y, x, max(v) OVER (PARTITION BY doc_id, page, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM (SELECT doc_id, page, y, x, max(v) OVER (PARTITION BY doc_id, page, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {src} s) a)"
_CLEAN = f"""(SELECT doc_id, page, y, x, CASE WHEN min(v) OVER w = 1 AND count(*) OVER w = 3 THEN 1 ELSE 0 END AS ink FROM (
 SELECT doc_id, page, y, x, CASE WHEN min(v) OVER w = 1 AND count(*) OVER w = 3 THEN 1 ELSE 0 END AS v FROM {_SPREAD.format(src=_SPREAD.format(src="(SELECT doc_id, page, y, x, CASE WHEN value / 255.0::DOUBLE < 0.75::DOUBLE THEN 1 ELSE 0 END AS v FROM fx_pixels)"))} d
 WINDOW w AS (PARTITION BY doc_id, page, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) e WINDOW w AS (PARTITION BY doc_id, page, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@query("u11_raster_cells", _metrics_sql("ink = 1", "mean - std", "0.88::DOUBLE", "0.005::DOUBLE",
       f"SELECT p.*, k.ink FROM ({_PIX_CELLS}) p JOIN {_CLEAN} k ON k.doc_id = p.doc_id AND k.page = p.page AND k.y = p.y AND k.x = p.x"))
def _(t):
    return RA.raster_cells(RA.rasters_from_pixels(t.fx_pixels), t.fx_page_grid, dpi=6.0)


@query("u12_ink_proximity")
def _(t):
    near = RA.raster_proximity(RA.rasters_from_pixels(t.fx_pixels), dpi=6.0)
    return near.select(*P, "pos", F.round("proximity", 4).alias("proximity"), "y_pct", "x_pct")


@query("u9_u12_clear_points")
def _(t):
    near = RA.raster_proximity(RA.rasters_from_pixels(t.fx_pixels), dpi=6.0)
    return Z.diverse_points(near, max_prox=0.4)


@query("u14_components")
def _(t):
    return RA.raster_components(RA.rasters_from_pixels(t.fx_pixels)).select(*P, F.round("cy", 3).alias("cy"), "w", "h", "area")


@query("u14_ink_pixels")
def _(t):
    return RA.raster_ink(RA.rasters_from_pixels(t.fx_pixels)).groupBy(*P).agg(F.count(F.lit(1)).alias("ink_pixels"))


@query("u14_free_rects")
def _(t):
    return RA.raster_free_rects(RA.rasters_from_pixels(t.fx_pixels), grow=2, open_=3, min_area=20)


# ---- placement -------------------------------------------------------------

def masks(t):
    return G.page_masks(t.fx_cells, t.fx_page_grid)


def free_masks(t):
    return G.page_masks(t.fx_cells, t.fx_page_grid, taken=CE.block_cells(t.fx_blocks, t.fx_page_grid, keep=P))


def place_input(t):
    return t.fx_annotations.select(*P, "item_index", "annotation_index", "comment", "x_start_percent", "x_end_percent", "y_position_percent")


@query("u3_place_boxes")
def _(t):
    return PL.place_boxes(marking_items(t), place_input(t), masks(t), t.fx_page_grid)


@query("u4_place_cells")
def _(t):
    out = PL.place_cells(marking_items(t), place_input(t), masks(t), t.fx_page_grid)
    return out.withColumn("cell_ids", F.array_join("cell_ids", " "))


@query("u5_legacy_cell_ids")
def _(t):
    return PL.run_cells(place_input(t), masks(t)).withColumn("cell_ids", F.array_join("cell_ids", " "))


def comment_input(t):
    return t.fx_annotations.select("doc_id", "question_id", "page", "annotation_index", "comment", "comment_font_pts", "preferred_side", "priority", F.array("anchor_range").alias("anchor_rows"))


@query("u6_plan_comments")
def _(t):
    return PL.plan_comments(comment_input(t), masks(t), free_masks(t), validate=False).withColumn("comment_rows", F.array_join("comment_rows", " "))


@query("u6u7_plan_and_validate")
def _(t):
    return PL.plan_comments(comment_input(t), masks(t), free_masks(t)).withColumn("comment_rows", F.array_join("comment_rows", " "))


@query("u7_validate_comments")
def _(t):
    given = comment_input(t).withColumn("comment_rows", F.array(F.lit("E6:S6"), F.lit("E7:Z7"), F.lit("T2")))
    return PL.validate_comments(given, masks(t), free_masks(t)).withColumn("comment_rows", F.array_join("comment_rows", " "))


@query("w18_by_priority", """
SELECT doc_id, question_id, annotation_index, CAST(row_number() OVER (PARTITION BY doc_id, question_id ORDER BY coalesce(TRY_CAST(priority AS INT), 2), annotation_index) AS INT) AS turn FROM fx_annotations""")
def _(t):
    return PL.by_priority(t.fx_annotations, ["doc_id", "question_id"]).select("doc_id", "question_id", "annotation_index", "turn")


@query("c11_carve_score", f"""
SELECT doc_id, page, annotation_index, sqrt((r0 + 1.0::DOUBLE - r) * (r0 + 1.0::DOUBLE - r) + (2 + 2.5::DOUBLE - c) * (2 + 2.5::DOUBLE - c)) AS near, CASE WHEN r0 = 1 THEN 'top' ELSE 'other' END AS tag
FROM (SELECT *, greatest(1, r - 1) AS r0 FROM ({_CELL_AT}) t) u""")
def _(t):
    j = t.fx_annotations.join(t.fx_page_grid, P)
    r = X.percent_to_row("y_position_percent", "page_h_pts", "top_margin_pts", "cell_size_pts", "rows")
    c = X.percent_to_col("x_start_percent", "page_w_pts", "left_margin_pts", "cell_size_pts", "cols")
    k = j.select(*P, "annotation_index", r.alias("r"), c.alias("c")).withColumn("r0", F.greatest(F.lit(1), F.col("r") - 1))
    # a 2 x 5 block away from the edges scores its distance only
    near = F.sqrt(F.pow(F.col("r0") + 1.0 - F.col("r"), F.lit(2)) + F.pow(4.5 - F.col("c"), F.lit(2)))
    same = F.abs(S.carve_score("r0", F.lit(2), F.lit(2), F.lit(5), "r", "c", F.lit(24)) - near) < 1e-9
    return k.select(*P, "annotation_index", F.when(same, near).alias("near"), F.when(F.col("r0") == 1, "top").otherwise("other").alias("tag"))


@query("c12_planner_score", """
SELECT doc_id, page, row, start_col, 0.4::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + abs(row - 12) / 5.0::DOUBLE)) + 0.3::DOUBLE * least(1.0::DOUBLE, w / 8.0::DOUBLE) + 0.2::DOUBLE * (1.0::DOUBLE - abs(row / 35.0::DOUBLE - 0.5::DOUBLE) * 0.5::DOUBLE) + 0.1::DOUBLE * least(1.0::DOUBLE, w / 12.0::DOUBLE) AS score
FROM (SELECT doc_id, page, row, min(col) AS start_col, count(*) AS w FROM (SELECT *, col - row_number() OVER (PARTITION BY doc_id, page, row ORDER BY col) AS isl FROM fx_cells WHERE writable) a GROUP BY doc_id, page, row, isl HAVING count(*) >= 2) r""")
def _(t):
    runs = G.writable_runs(t.fx_cells, 2)
    return runs.select(*P, "row", "start_col", S.planner_score("row", "cell_count", F.lit(12), F.lit(8), F.lit(35)).alias("score"))


@query("c14_needed_cols", """
SELECT doc_id, page, annotation_index, greatest(8, least(48, CAST(ceil(length(comment) * greatest(0.35::DOUBLE, comment_font_pts * 0.06::DOUBLE) / 8.0::DOUBLE) AS INT))) AS n,
 CASE preferred_side WHEN 'left' THEN TRUE WHEN 'right' THEN FALSE ELSE TRUE END AS ok FROM fx_annotations""")
def _(t):
    return t.fx_annotations.select(*P, "annotation_index", S.needed_cols(F.length("comment"), "comment_font_pts").alias("n"),
                                   S.side_ok("preferred_side", F.lit(2), F.when(F.col("preferred_side") == "left", 11).otherwise(40)).alias("ok"))




@query("c10_layout_positions", """
SELECT p_partkey, i, CAST(trunc(1000 * (i % c + 1) / CAST(c + 1 AS DOUBLE)) AS INT) AS x, CAST(trunc(1400 * (CAST(floor(i / CAST(c AS DOUBLE)) AS INT) + 1) / CAST(CAST(ceil(n / CAST(c AS DOUBLE)) AS INT) + 1 AS DOUBLE)) AS INT) AS y
FROM (SELECT p_partkey, p_size AS n, greatest(1, CAST(round_even(sqrt(CAST(p_size AS DOUBLE)), 0) AS INT)) AS c, CAST(unnest(generate_series(0, p_size - 1)) AS INT) AS i FROM part) t""")
def _(t):
    spots = S.layout_positions("grid", "p_size", F.lit(1000), F.lit(1400))
    return t.part.select("p_partkey", F.posexplode(spots).alias("i", "p")).select("p_partkey", "i", "p.x", "p.y")


@query("c10_column_row_positions", """
SELECT p_partkey, i, CAST(trunc(1400 * (i + 1) / CAST(n + 1 AS DOUBLE)) AS INT) AS col_y, CAST(trunc(1000 * (i + 1) / CAST(n + 1 AS DOUBLE)) AS INT) AS row_x, 850 AS col_x, 112 AS row_y
FROM (SELECT p_partkey, p_size AS n, CAST(unnest(generate_series(0, p_size - 1)) AS INT) AS i FROM part) t""")
def _(t):
    both = F.arrays_zip(S.layout_positions("column", "p_size", F.lit(1000), F.lit(1400)).alias("c"), S.layout_positions("row", "p_size", F.lit(1000), F.lit(1400)).alias("r"))
    z = t.part.select("p_partkey", F.posexplode(both).alias("i", "z"))
    a, b = (f"z.`{f.name}`" for f in z.schema["z"].dataType.fields)
    return z.select("p_partkey", "i", F.expr(f"{a}.y").alias("col_y"), F.expr(f"{b}.x").alias("row_x"), F.expr(f"{a}.x").alias("col_x"), F.expr(f"{b}.y").alias("row_y"))


def remarks_to_place(t):
    t.events
    return t.spark.sql("""SELECT user_id AS session_id, CAST(1 + user_id % 4 AS INT) AS page, concat('k', event_id) AS key, event_id AS ord, 1240 AS canvas_w, 1754 AS canvas_h FROM events""")


@query("u10_auto_place_grid", """
SELECT session_id, page, key, x, y FROM (SELECT *, greatest(1, CAST(round_even(sqrt(CAST(n AS DOUBLE)), 0) AS INT)) AS c FROM (SELECT user_id AS session_id, CAST(1 + user_id % 4 AS INT) AS page, concat('k', event_id) AS key,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) a) b,
 LATERAL (SELECT CAST(trunc(1240 * (i % c + 1) / CAST(c + 1 AS DOUBLE)) AS INT) AS x, CAST(trunc(1754 * (floor(i / CAST(c AS DOUBLE)) + 1) / (ceil(n / CAST(c AS DOUBLE)) + 1)) AS INT) AS y) p""")
def _(t):
    return PL.auto_place(remarks_to_place(t), None, "grid")


def _boxes(t):
    z = top_k(Z.page_free_zones(t.fx_coarse), ["page"], [F.col("score").desc(), F.col("doc_id"), F.col("zone_pos")], 10)
    return z.select("page", "x_start_percent", "x_end_percent", "y_start_percent", "y_end_percent", "score")


@query("u10_auto_place_free")
def _(t):
    return PL.auto_place(remarks_to_place(t), _boxes(t), "free_space")


@query("s5_box_positions", """
SELECT doc_id, page, zone_pos, CAST(trunc(223 + trunc((1202 - 223) * ((x_start_percent + x_end_percent) / 2) / 100)) AS INT) AS x, CAST(trunc(70 + trunc((1631 - 70) * ((y_start_percent + y_end_percent) / 2) / 100)) AS INT) AS y FROM (
 SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(score * 10000, 0) / 10000 DESC, row0, col0) AS INT) AS zone_pos, col0 * 12.5 AS x_start_percent, (col0 + 1) * 12.5 AS x_end_percent, row0 * 5.0 AS y_start_percent, (row0 + 1) * 5.0 AS y_end_percent
 FROM fx_coarse WHERE row0 < 18 AND col0 >= 2 AND score >= 0.7) z WHERE zone_pos <= 15""")
def _(t):
    z = Z.free_zones(t.fx_coarse).withColumns({"canvas_w": F.lit(1240), "canvas_h": F.lit(1754)})
    return PL.box_positions(z).select(*P, "zone_pos", "x", "y")


@query("so1_ordered_union", """
WITH a AS (SELECT user_id AS session_id, CAST(floor(value) AS INT) AS x, CAST(1 AS INT) AS y, 0 AS src, CAST(event_id AS DOUBLE) AS o FROM events UNION ALL SELECT user_id, CAST(floor(value / 2) AS INT), 1, 1, CAST(event_id AS DOUBLE) FROM events),
 f AS (SELECT *, row_number() OVER (PARTITION BY session_id, x, y ORDER BY src, o) AS rn FROM a)
SELECT session_id, x, CAST(row_number() OVER (PARTITION BY session_id ORDER BY src, o, x, y) AS INT) AS turn FROM f WHERE rn = 1""")
def _(t):
    def spots(src: int, div: int):
        return t.events.select(F.col("user_id").alias("session_id"), F.lit(src).alias("src"), F.col("event_id").cast("double").alias("o"),
                               F.floor(F.col("value") / div).cast("int").alias("x"), F.lit(1).alias("y"))

    return PL.ordered_union(spots(0, 1), spots(1, 2), ["session_id"]).select("session_id", "x", "turn")


_LAST = "(SELECT session_id, key, arg_max(action, ord) AS action, arg_max(page, ord) AS page, arg_max(x, ord) AS x, arg_max(y, ord) AS y, max(ord) AS ord FROM fx_placements GROUP BY 1, 2)"


@query("t22_latest_placements", f"SELECT session_id, key, ord, page, x, y FROM {_LAST} l WHERE action = 'place'")
def _(t):
    return PL.latest_placements(t.fx_placements).select("session_id", "key", "ord", "page", "x", "y")


@query("j26_unplaced", f"SELECT DISTINCT p.session_id, p.key FROM fx_placements p WHERE NOT EXISTS (SELECT 1 FROM {_LAST} l WHERE l.action = 'place' AND l.session_id = p.session_id AND l.key = p.key)")
def _(t):
    return PL.unplaced(t.fx_placements.select("session_id", "key").distinct(), PL.latest_placements(t.fx_placements))


@query("pf19_export_minimal", f"SELECT session_id, key, page, x, y, round_even(x / 1240.0::DOUBLE * 100 * 100, 0) / 100 AS pct_x, round_even(y / 1754.0::DOUBLE * 100 * 100, 0) / 100 AS pct_y FROM {_LAST} l WHERE action = 'place'")
def _(t):
    spot = X.canvas_to_pdf("x", "y", F.lit(1240.0), F.lit(1754.0), F.lit(595.0), F.lit(842.0))
    full = PL.latest_placements(t.fx_placements).withColumn("s", spot).select("*", "s.*").drop("s")
    return PL.export_placements(full, "minimal")
