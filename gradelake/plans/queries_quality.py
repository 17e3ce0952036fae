"""Layout invariants, telemetry, reports and the wire shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import glyphs
from gradelake.functions import coords as X
from gradelake.operators import quality as Q
from gradelake.operators.grid import page_masks
from gradelake.plans.queries_cells import COL, ID, RID, ROW
from gradelake.plans.registry import query
from gradelake.sources.stages import stored

P = ["doc_id", "page"]


def WIDTH(text: str) -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = " + ".join(f"{w} * (length({text}) - length(translate({text}, {lit(ch)}, '')))" for w, ch in glyphs.HELVETICA_WIDTHS.items())
    every = "".join(glyphs.HELVETICA_WIDTHS.values())
    return f"({known} + {glyphs.OTHER_WIDTH} * length(translate({text}, {lit(every)}, '')))"


_FIT = f"""(list_reduce(list_prepend({{'lines': 1, 'cur': 0.0::DOUBLE, 'w': 0.0::DOUBLE, 'ok': TRUE}},
  list_transform(string_split(comment, ' '), lambda x: {{'lines': 1, 'cur': 0.0::DOUBLE, 'w': {WIDTH('x')} * fnt / 1000.0::DOUBLE, 'ok': TRUE}})),
  lambda a, b: {{'lines': CASE WHEN a.cur = 0 OR a.cur + 278 * fnt / 1000.0::DOUBLE + b.w <= aw THEN a.lines ELSE a.lines + 1 END,
   'cur': CASE WHEN a.cur = 0 THEN b.w WHEN a.cur + 278 * fnt / 1000.0::DOUBLE + b.w <= aw THEN a.cur + 278 * fnt / 1000.0::DOUBLE + b.w ELSE b.w END, 'w': 0.0::DOUBLE, 'ok': a.ok AND b.w <= aw}}))"""

_A = f"""(SELECT *, 24.0::DOUBLE * (c2 - c1 + 1) * 0.95::DOUBLE AS aw, 24.0::DOUBLE * (r2 - r1 + 1) * 0.95::DOUBLE AS ah FROM (SELECT doc_id, page, item_index, annotation_index, comment, comment_range, comment_font_pts AS font, least(16.0, greatest(14.0, comment_font_pts)) AS fnt, anchor_type, anchor_range, missing_word, side,
 least({ROW('comment_range')}, {ROW('comment_range', 1)}) AS r1, greatest({ROW('comment_range')}, {ROW('comment_range', 1)}) AS r2, least({COL('comment_range')}, {COL('comment_range', 1)}) AS c1, greatest({COL('comment_range')}, {COL('comment_range', 1)}) AS c2 FROM fx_annotations) z)"""

_V = f"""(WITH a AS {_A}, cw AS (SELECT a.doc_id, a.page, a.annotation_index, count(c.row) AS free FROM a LEFT JOIN fx_cells c ON c.doc_id = a.doc_id AND c.page = a.page AND c.writable AND c.row BETWEEN a.r1 AND a.r2 AND c.col BETWEEN a.c1 AND a.c2 GROUP BY ALL),
 f AS (SELECT a.*, cw.free, {_FIT.replace('comment,', 'a.comment,')} AS fit FROM a JOIN cw ON cw.doc_id = a.doc_id AND cw.page = a.page AND cw.annotation_index = a.annotation_index)
 SELECT doc_id, 'I5' AS invariant, page, item_index, annotation_index, 1 AS n FROM f WHERE font < 14 OR font > 16
 UNION ALL SELECT doc_id, 'I1', page, item_index, annotation_index, 1 FROM f WHERE r2 > 35 OR c2 > 24
 UNION ALL SELECT doc_id, 'I2', page, item_index, annotation_index, 1 FROM f WHERE free < (r2 - r1 + 1) * (c2 - c1 + 1)
 UNION ALL SELECT doc_id, 'I6', page, item_index, annotation_index, 1 FROM f WHERE NOT (fnt * 1.4::DOUBLE <= ah AND fit.ok AND fit.lines * (fnt * 1.4::DOUBLE) <= ah)
 UNION ALL SELECT doc_id, 'I3', page, item_index, annotation_index, 1 FROM f WHERE anchor_type <> 'none' AND anchor_range = 'Z90:Z90'
 UNION ALL SELECT doc_id, 'I8', page, item_index, annotation_index, 1 FROM f WHERE anchor_type = 'exponent_caret' AND trim(coalesce(missing_word, '')) = ''
 UNION ALL SELECT doc_id, 'I9', page, item_index, annotation_index, 1 FROM f WHERE anchor_type = 'curly_brace' AND side NOT IN ('left', 'right')
 UNION ALL SELECT doc_id, 'I4', marking_page, item_index, NULL, 1 FROM fx_items WHERE score_range = 'A1:B2'
 UNION ALL SELECT a.doc_id, 'I7', a.page, NULL, NULL, count(*) FROM a JOIN a b ON b.doc_id = a.doc_id AND b.page = a.page AND a.annotation_index < b.annotation_index
   AND a.r1 <= b.r2 AND b.r1 <= a.r2 AND a.c1 <= b.c2 AND b.c1 <= a.c2 GROUP BY a.doc_id, a.page)"""


def wire_annotations(t):
    extra = F.map_from_entries(F.array_compact(F.array(
        *[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c in ("missing_word", "side")])))
    return t.fx_annotations.select("doc_id", "page", "item_index", "annotation_index", "question_id", "comment", "comment_font_pts", "comment_range",
                                   Q.normalize_anchor("anchor_type", F.array("anchor_range"), extra).alias("anchor"))


def violations(t):
    return Q.validate_layout(t.fx_items, wire_annotations(t), t.fx_page_grid, t.fx_cells)


@query("v1_validate_layout", f"SELECT * FROM {_V} v")
def _(t):
    return violations(t).drop("check_no", "detail")


@query("j17_overlap_pairs", f"""
SELECT doc_id, page, pos, pos2, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY pos, pos2) AS INT) AS pair_no FROM (
 SELECT a.doc_id, a.page, a.annotation_index AS pos, b.annotation_index AS pos2 FROM {_A} a JOIN {_A} b ON b.doc_id = a.doc_id AND b.page = a.page AND a.annotation_index < b.annotation_index
   AND a.r1 <= b.r2 AND b.r1 <= a.r2 AND a.c1 <= b.c2 AND b.c1 <= a.c2) t""")
def _(t):
    rects = t.fx_annotations.select(*P, F.col("annotation_index").alias("pos"), X.range_bounds("comment_range").alias("box"))
    return Q.overlap_pairs(rects)


_TEL = f"""SELECT d.doc_id, d.items_total, a.annotations_total, {', '.join(f"CAST(coalesce(sum(n) FILTER (WHERE invariant = 'I{i}'), 0) AS BIGINT) AS i{i}" for i in range(1, 10))},
 CAST(coalesce(sum(n), 0) AS BIGINT) AS violations, round_even(coalesce(sum(n), 0) / CAST(a.annotations_total AS DOUBLE) * 10000, 0) / 10000 AS violation_rate
FROM (SELECT doc_id, count(*) AS items_total FROM fx_items GROUP BY 1) d JOIN (SELECT doc_id, count(*) AS annotations_total FROM fx_annotations GROUP BY 1) a ON a.doc_id = d.doc_id
LEFT JOIN {_V} v ON v.doc_id = d.doc_id GROUP BY d.doc_id, d.items_total, a.annotations_total"""


@query("a3_telemetry", _TEL)
def _(t):
    return Q.telemetry(violations(t), t.fx_items, t.fx_annotations)


@query("a3_samples", f"""
SELECT doc_id, invariant, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY invariant = 'I7', item_index NULLS FIRST, annotation_index NULLS FIRST,
 CASE invariant WHEN 'I4' THEN 0 WHEN 'I5' THEN 2 WHEN 'I1' THEN 4 WHEN 'I2' THEN 5 WHEN 'I6' THEN 6 WHEN 'I3' THEN 8 WHEN 'I8' THEN 9 WHEN 'I9' THEN 10 ELSE 11 END, page) AS rn FROM {_V} v) s WHERE rn <= 5 GROUP BY ALL""")
def _(t):
    return Q.violation_samples(violations(t), 5).groupBy("doc_id", "invariant").agg(F.count(F.lit(1)).alias("n"))


@query("a4_corpus_report", f"""
WITH v AS {_V}, own AS (SELECT doc_id, count(*) AS c FROM fx_annotations GROUP BY 1),
 g AS (SELECT invariant, doc_id, CAST(sum(n) AS BIGINT) AS n, grouping(invariant) AS gi, grouping(doc_id) AS gd FROM v GROUP BY ROLLUP (invariant, doc_id))
SELECT CASE WHEN gd = 0 THEN 'document' WHEN gi = 0 THEN 'invariant' ELSE 'overall' END AS level, invariant, doc_id, n,
 round_even(100.0::DOUBLE * n / CASE WHEN gd = 0 THEN greatest(1, coalesce(c, 0)) ELSE (SELECT count(*) FROM fx_annotations) END * 10000, 0) / 10000 AS pct,
 CASE WHEN gi = 1 THEN 100.0::DOUBLE * n / (SELECT count(*) FROM fx_annotations) < 5 END AS passes FROM g LEFT JOIN own USING (doc_id)""")
def _(t):
    return Q.corpus_report(stored_violations(t), t.fx_annotations)


def stored_violations(t):
    return stored(violations(t), "violations")


@query("a4_document_reports", f"""
WITH v AS {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY invariant = 'I7', item_index NULLS FIRST, annotation_index NULLS FIRST,
  CASE invariant WHEN 'I4' THEN 0 WHEN 'I5' THEN 2 WHEN 'I1' THEN 4 WHEN 'I2' THEN 5 WHEN 'I6' THEN 6 WHEN 'I3' THEN 8 WHEN 'I8' THEN 9 WHEN 'I9' THEN 10 ELSE 11 END, page) AS no FROM v),
 s AS (SELECT doc_id, string_agg(concat_ws(' ', invariant, page, item_index, annotation_index), ', ' ORDER BY no) AS sample FROM r WHERE no <= 5 GROUP BY doc_id),
 c AS (SELECT doc_id, string_agg(concat(invariant, '=', n), ' ' ORDER BY invariant) AS counts FROM (SELECT doc_id, invariant, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY ALL) GROUP BY doc_id)
SELECT t.doc_id, items_total, annotations_total, coalesce(counts, '') AS counts, violation_rate, coalesce(sample, '') AS sample FROM ({_TEL}) t LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""")
def _(t):
    found = Q.document_reports(stored_violations(t), t.fx_items, t.fx_annotations)
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    sample = F.array_join(F.transform("violations_sample", lambda x: F.concat_ws(" ", x["invariant"], x["page"], x["item_index"], x["annotation_index"])), ", ")
    return found.select("doc_id", "items_total", "annotations_total", counts.alias("counts"), "violation_rate", sample.alias("sample"))


@query("v1_colliding_annotations", f"""
SELECT a.doc_id, a.page, a.item_index, a.annotation_index, a.comment_range, count(*) AS overlaps FROM {_A} a JOIN {_A} b ON b.doc_id = a.doc_id AND b.page = a.page
 AND a.annotation_index <> b.annotation_index AND a.r1 <= b.r2 AND b.r1 <= a.r2 AND a.c1 <= b.c2 AND b.c1 <= a.c2 GROUP BY ALL""")
def _(t):
    return Q.colliding_annotations(Q.check_annotations(wire_annotations(t), page_masks(t.fx_cells, t.fx_page_grid)))


@query("j17_annotation_overlaps", """
SELECT a.doc_id, a.page, a.annotation_index, count(b.item_index) AS overlaps FROM fx_crowd a LEFT JOIN fx_crowd b ON b.doc_id = a.doc_id AND b.page = a.page
 AND b.annotation_index <> a.annotation_index AND a.r1 <= b.r2 AND b.r1 <= a.r2 AND a.c1 <= b.c2 AND b.c1 <= a.c2 GROUP BY ALL""")
def _(t):
    rects = t.fx_crowd.select(*P, "annotation_index", X.range_bounds("comment_range").alias("box"))
    return Q.annotation_overlaps(rects).drop("box")


@query("j17_page_overlaps", """
SELECT a.doc_id, a.page, count(*) AS n FROM fx_crowd a JOIN fx_crowd b ON b.doc_id = a.doc_id AND b.page = a.page
 AND b.annotation_index > a.annotation_index AND a.r1 <= b.r2 AND b.r1 <= a.r2 AND a.c1 <= b.c2 AND b.c1 <= a.c2 GROUP BY ALL""")
def _(t):
    return Q.overlap_counts(t.fx_crowd.select(*P, X.range_bounds("comment_range").alias("box")))


@query("c15_text_width", f"""
SELECT doc_id, {WIDTH("text")} * 11.0::DOUBLE / 1000.0::DOUBLE AS width FROM documents""")
def _(t):
    return t.documents.select("doc_id", glyphs.text_width("text", 11.0).alias("width"))


@query("c15_cells_needed", f"""
SELECT doc_id, annotation_index, page, CAST(greatest(1, ceil({WIDTH("comment")} * 11.0::DOUBLE / 1000.0::DOUBLE / 24.0::DOUBLE)) AS INT) AS cells FROM fx_annotations""")
def _(t):
    return t.fx_annotations.select("doc_id", "page", "annotation_index", glyphs.cells_needed("comment", 11.0, 24.0).alias("cells"))


@query("c16_comment_fits", f"""
SELECT doc_id, page, annotation_index, fnt * 1.4::DOUBLE <= ah AND fit.ok AND fit.lines * (fnt * 1.4::DOUBLE) <= ah AS fits FROM (SELECT *, {_FIT} AS fit FROM {_A} a) b""")
def _(t):
    j = t.fx_annotations.withColumn("b", X.range_bounds("comment_range"))
    font = X.clamp("comment_font_pts", 14.0, 16.0)
    return j.select(*P, "annotation_index", glyphs.comment_fits("comment", font, F.expr("b.c2 - b.c1 + 1"), F.expr("b.r2 - b.r1 + 1"), F.lit(24.0)).alias("fits"))


@query("pf14_normalize_anchor", """
SELECT doc_id, page, annotation_index, CASE anchor_type WHEN 'tick' THEN 'ellipse' WHEN 'underline' THEN 'none' ELSE anchor_type END AS type,
 CASE WHEN anchor_type = 'underline' THEN NULL ELSE anchor_range END AS rows FROM fx_annotations""")
def _(t):
    kind = F.when(F.col("anchor_type") == "tick", "circle").when(F.col("anchor_type") == "underline", "scribble").otherwise(F.col("anchor_type"))
    a = Q.normalize_anchor(kind, F.array("anchor_range"), F.lit(None).cast("map<string,string>"))
    return t.fx_annotations.select(*P, "annotation_index", a.alias("a")).select(*P, "annotation_index", "a.type", F.array_join("a.rows", " ").alias("rows"))


@query("pf18_snap_anchor", """
SELECT doc_id, page, annotation_index, CASE WHEN anchor_range = 'Z90:Z90' THEN 'none' ELSE anchor_type END AS type, CASE WHEN anchor_range <> 'Z90:Z90' THEN anchor_range END AS rows FROM fx_annotations""")
def _(t):
    j = wire_annotations(t).join(t.fx_page_grid.select(*P, "rows", "cols"), P)
    return j.withColumn("a", Q.snap_anchor("anchor", "rows", "cols")).select(*P, "annotation_index", "a.type", F.array_join("a.rows", " ").alias("rows"))


_SPAN = f"""SELECT doc_id, question_id, page, concat('A', greatest(1, least(35, CAST(trunc((842.0::DOUBLE * (ty / 100.0) - 1.0) / 24.0) AS INT) + 1))) AS top_cell,
 {ID("greatest(1, least(35, CAST(trunc((842.0::DOUBLE * (b_y / 100.0) - 1.0) / 24.0) AS INT) + 1))", '24')} AS bottom_cell FROM (
 SELECT i.doc_id, i.question_id, g.page, CASE WHEN g.page = i.start_page THEN i.start_y ELSE 0.0::DOUBLE END AS ty, CASE WHEN g.page = i.end_page THEN i.end_y ELSE 100.0::DOUBLE END AS b_y
 FROM fx_items i JOIN fx_page_grid g ON g.doc_id = i.doc_id AND g.page BETWEEN i.start_page AND i.end_page) t"""


@query("pf15_answer_span", _SPAN)
def _(t):
    return Q.answer_span(t.fx_items, t.fx_page_grid)


_MARK_ITEMS = """SELECT doc_id, question_id, item_index, start_page, end_page, start_y, end_y, marking_page, start_y AS marking_y, 90.0 AS marking_x, CASE WHEN question_id <> 4 THEN marking_page END AS marking_box_page,
 80.0 AS box_x1, start_y AS box_y1, 95.0 AS box_x2, end_y AS box_y2 FROM fx_items"""


def _cell_at(x: str, y: str) -> str:
    c = f"greatest(1, least(24, CAST(trunc((595.0::DOUBLE * ({x} / 100.0::DOUBLE) - 9.5) / 24.0) AS INT) + 1))"
    r = f"greatest(1, least(35, CAST(trunc((842.0::DOUBLE * ({y} / 100.0::DOUBLE) - 1.0) / 24.0) AS INT) + 1))"
    return ID(r, c)


def marking_items(t):
    t.fx_items
    return t.spark.sql(_MARK_ITEMS.replace("90.0 AS", "90.0D AS").replace("80.0 AS", "80.0D AS").replace("95.0 AS", "95.0D AS"))


_BLOCK = f"""SELECT doc_id, question_id, marking_page AS page, {_cell_at('marking_x', 'marking_y')} AS score_range,
 CASE WHEN marking_box_page IS NOT NULL THEN concat({_cell_at('box_x1', 'box_y1')}, CASE WHEN {_cell_at('box_x1', 'box_y1')} = {_cell_at('box_x2', 'box_y2')} THEN '' ELSE concat(':', {_cell_at('box_x2', 'box_y2')}) END) END AS score_box_range FROM ({_MARK_ITEMS}) m"""


@query("pf15_marking_block", _BLOCK)
def _(t):
    return Q.marking_block(marking_items(t), t.fx_page_grid)


@query("pf16_adapt_items", f"SELECT doc_id, question_id, score_range, score_box_range FROM ({_BLOCK}) b")
def _(t):
    return Q.adapt_percent_items(marking_items(t), t.fx_page_grid).select("doc_id", "question_id", "score_range", "score_box_range")


@query("pf16_adapt_annotations", """
SELECT doc_id, item_index, annotation_index, page, comment, 14.0::DOUBLE AS comment_font_pts, comment_range, 'none' AS anchor_type FROM fx_annotations""")
def _(t):
    raw = t.fx_annotations.select("doc_id", "item_index", "annotation_index", (F.col("page") - 1).cast("string").alias("page_index"), "comment",
                                  F.lit(None).cast("string").alias("comment_font_pts"), F.col("comment_range").alias("range_id"))
    return Q.adapt_percent_annotations(raw).withColumn("anchor_type", F.col("anchor.type")).drop("anchor")


_ROWS = f"""SELECT doc_id, page, annotation_index, CASE WHEN r1 <= 35 AND c1 <= 24 THEN CASE WHEN r1 = r2 OR r2 > 35 THEN {RID('r1', 'c1', 'r1', 'c2')} ELSE concat({RID('r1', 'c1', 'r1', 'c2')}, ' ', {RID('r2', 'c1', 'r2', 'c2')}) END END AS comment_rows FROM {_A} a"""


@query("pf15_comment_rows", _ROWS)
def _(t):
    raw = t.fx_annotations.select(*P, "annotation_index", F.col("comment_range").alias("range_id"), F.lit(None).cast("array<string>").alias("comment_rows"),
                                  F.lit(None).cast("array<string>").alias("cell_ids"))
    return Q.comment_rows(raw, t.fx_page_grid).select(*P, "annotation_index", F.array_join("comment_rows", " ").alias("comment_rows"))


@query("pf15_response_items", f"""
SELECT i.doc_id, i.question_id, (SELECT string_agg(concat(page, ':', top_cell, ':', bottom_cell), ' ' ORDER BY page) FROM ({_SPAN}) s WHERE s.doc_id = i.doc_id AND s.question_id = i.question_id) AS spans,
 b.score_range, (SELECT string_agg(coalesce(comment_rows, '-'), '|' ORDER BY annotation_index) FROM ({_ROWS}) r WHERE r.doc_id = i.doc_id AND r.page = i.question_id) AS comments
FROM fx_items i LEFT JOIN ({_BLOCK}) b ON b.doc_id = i.doc_id AND b.question_id = i.question_id""")
def _(t):
    anns = t.fx_annotations.select(*P, "question_id", "annotation_index", "comment", "comment_font_pts", F.col("comment_range").alias("range_id"),
                                   F.lit(None).cast("array<string>").alias("comment_rows"), F.lit(None).cast("array<string>").alias("cell_ids"))
    out = Q.response_items(marking_items(t), anns, t.fx_page_grid)
    spans = F.array_join(F.transform("answer_span", lambda s: F.concat_ws(":", s["page"], s["top_cell"], s["bottom_cell"])), " ")
    comments = F.array_join(F.transform("annotations", lambda a: F.coalesce(F.array_join(a["comment_rows"], " "), F.lit("-"))), "|")
    return out.select("doc_id", "question_id", spans.alias("spans"), "marking.score_range", comments.alias("comments"))
