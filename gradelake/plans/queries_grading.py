"""Pages, answers, grades and their merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import scoring as S
from gradelake.functions import similarity
from gradelake.operators import grading as GR
from gradelake.operators import grid as G
from gradelake.operators import pages as PG
from gradelake.plans.queries_cells import _HINTS, _RUNS, COL, PX, PY, RID, hints
from gradelake.plans.registry import query

P = ["doc_id", "page"]


# ---- page texts -----------------------------------------------------------

# On these pages a near copy is an equal text, so equality stands in for the similarity ratio.
_DEDUP = """(WITH c AS (SELECT doc_id, page, page_type, text, coalesce(text = lag(text) OVER (PARTITION BY doc_id ORDER BY page) AND page - 1 = lag(page) OVER (PARTITION BY doc_id ORDER BY page), FALSE) AS sim FROM fx_ocr_pages),
 r AS (SELECT *, page_type = 'DUPLICATE' AND page > 1 AS dup FROM c),
 s AS (SELECT *, max(CASE WHEN dup OR NOT sim THEN page END) OVER (PARTITION BY doc_id ORDER BY page) AS st FROM r),
 o AS (SELECT s.*, d.dup AS start_dup FROM s JOIN r d ON d.doc_id = s.doc_id AND d.page = s.st)
 SELECT doc_id, page, page_type, text, CASE WHEN (page - st) % 2 = 1 THEN NOT start_dup ELSE start_dup END AS omitted, dup FROM o)"""


@query("w7_dedup_pages", f"""
SELECT doc_id, page, page_type, omitted, CASE WHEN dup THEN 'classified_duplicate' WHEN omitted THEN 'near_duplicate' END AS reason FROM {_DEDUP} d""")
def _(t):
    return PG.dedup_pages(t.fx_ocr_pages)


@query("a16_dedup_summary", f"""
SELECT doc_id, page, NOT omitted AS kept, page_type, CAST(length(text) AS INT) AS orig_chars, CASE WHEN omitted THEN 0 ELSE CAST(length(text) AS INT) END AS after_chars FROM {_DEDUP} d""")
def _(t):
    return PG.dedup_summary(t.fx_ocr_pages, PG.dedup_pages(t.fx_ocr_pages))


@query("c31_similarity_ratio")
def _(t):
    prev = t.fx_ocr_pages.select("doc_id", (F.col("page") + 1).alias("page"), F.col("text").alias("before"))
    return t.fx_ocr_pages.join(prev, P).select(*P, F.round(similarity.ratio("before", "text"), 6).alias("ratio"))


@query("pf12_drop_covers", """
SELECT b.doc_id, b.page, b.block_id, b.token FROM fx_blocks b WHERE NOT EXISTS (SELECT 1 FROM fx_items i WHERE i.doc_id = b.doc_id AND i.start_page = b.page AND i.section_name = '')""")
def _(t):
    typed = t.fx_items.select("doc_id", F.col("start_page").alias("page"), F.expr("CASE WHEN section_name = '' THEN 'COVER' ELSE 'PARAGRAPH' END").alias("page_type"))
    return PG.drop_covers(t.fx_blocks, typed)[0].select(*P, "block_id", "token")


_SKIP = """SELECT d.doc_id, p AS page FROM fx_docs d CROSS JOIN (SELECT CAST(unnest(generate_series(1, 10)) AS INT) AS p) n WHERE p <= d.page_count AND NOT EXISTS (
 SELECT 1 FROM fx_items i WHERE i.doc_id = d.doc_id AND i.section_name <> '' AND p BETWEEN least(i.start_page, d.page_count) AND least(i.end_page, d.page_count))"""


@query("j12_skipped_pages", _SKIP)
def _(t):
    return PG.skipped_pages(t.fx_docs, t.fx_items)


@query("so3_skipped_or_cover", f"SELECT * FROM ({_SKIP}) s UNION SELECT doc_id, page FROM fx_page_grid WHERE page = 1")
def _(t):
    return PG.skipped_pages(t.fx_docs, t.fx_items, t.fx_page_grid.filter("page = 1"))


@query("a7_expected_questions", r"""
WITH m AS (SELECT doc_id, TRY_CAST(unnest(list_concat(list_concat(regexp_extract_all(text, '(?i)\bq(?:uestion)?\s*[:.\-]?\s*([0-9]{1,3})\b', 1), regexp_extract_all(text, '(?i)(?:^|\n)\s*\(?([0-9]{1,3})\)?\s*[.)\-:]\s+', 1)),
 regexp_extract_all(text, '(?i)(?:प्रश्न|उ\.?\s*प्र\.?)\s*[:.\-]?\s*([0-9]{1,3})\b', 1))) AS INT) AS n FROM (SELECT doc_id, concat('Q.', page, ' then ', chr(10), '(', page * 7, ') - ', text) AS text FROM fx_ocr_pages) x)
SELECT d.doc_id, max(m.n) FILTER (WHERE m.n BETWEEN 1 AND 200) AS expected FROM (SELECT DISTINCT doc_id FROM fx_ocr_pages) d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(t):
    labelled = t.fx_ocr_pages.withColumn("text", F.concat(F.lit("Q."), F.col("page").cast("string"), F.lit(" then \n("), (F.col("page") * 7).cast("string"), F.lit(") - "), F.col("text")))
    return PG.expected_questions(labelled)


@query("a9_transcripts", """
SELECT doc_id, t AS transcript, CAST(floor(length(t) / 4.0) AS INT) AS token_estimate FROM (SELECT doc_id, string_agg(concat('--- Page ', page, ' ---', chr(10), trim(text)), concat(chr(10), chr(10)) ORDER BY page) AS t
 FROM fx_ocr_pages GROUP BY doc_id HAVING count(*) <= 30 AND count(*) FILTER (WHERE trim(coalesce(text, '')) = '') = 0) x""")
def _(t):
    return PG.transcripts(t.fx_ocr_pages)[0]


@query("a9_transcript_rejects", """
SELECT doc_id, 'too_many_pages' AS reason, CAST(NULL AS INT) AS empty_page FROM fx_ocr_pages GROUP BY doc_id HAVING count(*) > 5""")
def _(t):
    return PG.transcripts(t.fx_ocr_pages, max_pages=5)[1]


# ---- ids ------------------------------------------------------------------

_W8 = """SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 + o_orderkey % 17 AS INT) END AS question_id, CAST(1 + o_orderkey % 4 AS INT) AS start_page, o_totalprice / 5000.0 AS start_y FROM orders"""


def _w8(t):
    t.orders
    return t.spark.sql(_W8.replace("5000.0", "5000.0D"))


@query("w8_fill_question_ids", f"""
WITH i AS ({_W8.replace('5000.0', '5000.0::DOUBLE')}), s AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY start_page, start_y, pos) AS k FROM i WHERE question_id IS NULL),
 free AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM (SELECT DISTINCT doc_id FROM i) d CROSS JOIN (SELECT CAST(unnest(generate_series(1, 200)) AS INT) AS n) g
  WHERE NOT EXISTS (SELECT 1 FROM i u WHERE u.doc_id = d.doc_id AND u.question_id = g.n))
SELECT i.doc_id, i.pos, coalesce(i.question_id, free.n) AS question_id FROM i LEFT JOIN s ON s.doc_id = i.doc_id AND s.pos = i.pos LEFT JOIN free ON free.doc_id = s.doc_id AND free.k = s.k""")
def _(t):
    return PG.fill_question_ids(_w8(t)).select("doc_id", "pos", "question_id")


@query("so4_split_retry", f"""
WITH i AS ({_W8.replace('5000.0', '5000.0::DOUBLE')}), e AS (SELECT c_custkey AS doc_id, CAST(c_custkey % 18 AS INT) AS expected, CAST(c_custkey % 4 AS INT) AS page_count FROM customer),
 short AS (SELECT e.doc_id FROM e LEFT JOIN (SELECT doc_id, count(*) AS n FROM i GROUP BY 1) c ON c.doc_id = e.doc_id WHERE expected > 0 AND page_count >= 2 AND coalesce(n, 0) < greatest(1, floor(expected * 0.8::DOUBLE))),
 h AS (SELECT doc_id, pos, CAST(1 + pos % 9 AS INT) AS question_id, start_page, start_y FROM i)
SELECT doc_id, pos, question_id FROM i WHERE doc_id NOT IN (SELECT doc_id FROM short)
UNION ALL SELECT doc_id, pos, question_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, question_id ORDER BY start_page, start_y, question_id, pos) AS rn FROM h WHERE doc_id IN (SELECT doc_id FROM short)) x WHERE rn = 1""")
def _(t):
    items = _w8(t)
    halves = items.withColumn("question_id", (1 + F.col("pos") % 9).cast("int"))
    expected = t.customer.select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 18).cast("int").alias("expected"), (F.col("c_custkey") % 4).cast("int").alias("page_count"))
    return PG.split_retry(items, halves, expected).select("doc_id", "pos", "question_id")


# ---- answers --------------------------------------------------------------

_BLOCKS = "(SELECT DISTINCT doc_id, block_id, kind, trim(text) AS t FROM fx_blocks)"


@query("j9_resolve_items", f"""
SELECT doc_id, question_id, coalesce(nullif(concat_ws(concat(chr(10), chr(10)), nullif(coalesce(qt, ''), ''), nullif(trim(stem), '')), ''), concat('Question ', question_id)) AS question,
 coalesce(st, '') AS student_answer, coalesce(st, '') <> '' AND flag AS is_attempted, coalesce(p1, 1) AS start_page, coalesce(p2, 1) AS end_page FROM (
 SELECT r.doc_id, r.question_id, string_agg(b.t, concat(chr(10), chr(10)) ORDER BY ref_pos) FILTER (WHERE ref_kind = 'question' AND b.t <> '') AS qt,
  string_agg(b.t, concat(chr(10), chr(10)) ORDER BY ref_pos) FILTER (WHERE ref_kind = 'answer' AND kind = 'handwritten_answer' AND b.t <> '') AS st,
  max(stem) AS stem, bool_and(coalesce(is_attempted, TRUE)) AS flag, CAST(min(CASE WHEN ref_kind = 'answer' AND b.kind IS NOT NULL THEN r.question_id END) AS INT) AS p1, CAST(max(CASE WHEN ref_kind = 'answer' AND b.kind IS NOT NULL THEN r.question_id END) AS INT) AS p2
 FROM fx_refs r LEFT JOIN {_BLOCKS} b ON b.doc_id = r.doc_id AND b.block_id = r.block_ref GROUP BY r.doc_id, r.question_id) x""")
def _(t):
    return PG.resolve_items(t.fx_refs, t.fx_blocks.select("doc_id", "block_id", "kind", "text").distinct())


_SPANS = """(SELECT r.doc_id, r.question_id, b.page, b.token, r.ref_pos, b.row FROM fx_refs r JOIN fx_blocks b ON b.doc_id = r.doc_id AND b.block_id = r.block_ref WHERE ref_kind = 'answer' AND kind = 'handwritten_answer')"""


@query("a20_answer_spans", f"SELECT doc_id, question_id, page, string_agg(token, ' ' ORDER BY ref_pos, row) AS rows FROM {_SPANS} s GROUP BY ALL")
def _(t):
    return PG.answer_spans(t.fx_refs, t.fx_blocks, t.fx_page_grid).withColumn("rows", F.array_join("rows", " "))


@query("c33_answer_centre", f"""
SELECT doc_id, question_id, round_even((9.5 + 4.5 * 24.0::DOUBLE) / 595.0 * 100.0 * 100, 0) / 100 AS x, y, greatest(0.0::DOUBLE, y - 5.0) AS start_y, least(100.0::DOUBLE, y + 5.0) AS end_y FROM (
 SELECT doc_id, question_id, round_even((1.0 + (min(row) - 0.5) * 24.0::DOUBLE) / 842.0 * 100.0 * 100, 0) / 100 AS y FROM {_SPANS} s GROUP BY ALL) t""")
def _(t):
    return PG.answer_centre(PG.answer_spans(t.fx_refs, t.fx_blocks, t.fx_page_grid), t.fx_page_grid)


@query("j25_item_pages", f"""
SELECT doc_id, question_id, start_page AS page FROM fx_items UNION SELECT doc_id, question_id, end_page FROM fx_items UNION SELECT doc_id, question_id, page FROM {_SPANS} s""")
def _(t):
    return PG.item_pages(t.fx_items, PG.answer_spans(t.fx_refs, t.fx_blocks, t.fx_page_grid))


def _marking_tokens(t):
    # page 4 of each book has no marking box and falls back to the page hint
    return t.fx_blocks.filter("NOT (kind = 'marking_box' AND page = 4)")


@query("j27_item_marking", f"""
WITH i AS (SELECT doc_id, question_id, start_page, end_page FROM fx_items),
 bx AS (SELECT i.doc_id, i.question_id, i.start_page AS page, b.row, {COL('b.token')} AS c1, {COL('b.token', 1)} AS c2 FROM i JOIN fx_blocks b ON b.doc_id = i.doc_id AND b.page IN (i.start_page, i.end_page) AND b.kind = 'marking_box' AND b.page <> 4),
 h AS (SELECT i.doc_id, i.question_id, CASE WHEN h1.hint IS NOT NULL THEN i.start_page ELSE i.end_page END AS page, coalesce(h1.hint, h2.hint) AS hint FROM i LEFT JOIN {_HINTS} h1 ON h1.doc_id = i.doc_id AND h1.page = i.start_page LEFT JOIN {_HINTS} h2 ON h2.doc_id = i.doc_id AND h2.page = i.end_page
  WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.doc_id = i.doc_id AND bx.question_id = i.question_id)),
 hr AS (SELECT doc_id, question_id, page, unnest(generate_series(CAST(regexp_extract(split_part(hint, ':', 1), '([0-9]+)', 1) AS INT), CAST(regexp_extract(split_part(hint, ':', 2), '([0-9]+)', 1) AS INT))) AS row, {COL('hint')} AS c1, {COL('hint', 1)} AS c2 FROM h WHERE hint IS NOT NULL),
 a AS (SELECT doc_id, question_id, page, row, c1, c2 FROM bx UNION ALL SELECT * FROM hr),
 c AS (SELECT a.doc_id, a.question_id, a.page, min(a.row) AS r1, max(a.row) AS r2, min(a.c1) AS c1, max(a.c2) AS c2 FROM a GROUP BY ALL),
 w AS (SELECT a.doc_id, a.question_id, a.page, min(k.row * 100 + k.col) AS rc FROM a JOIN fx_cells k ON k.doc_id = a.doc_id AND k.page = a.page AND k.row = a.row AND k.col BETWEEN a.c1 AND a.c2 AND k.writable GROUP BY ALL)
SELECT c.doc_id, c.question_id, c.page, CASE WHEN w.rc IS NULL THEN {RID('r1', 'c1', 'r1', 'c1')} ELSE concat(chr(CAST(64 + rc % 100 AS INT)), CAST(floor(rc / 100.0) AS INT)) END AS score_range, {RID('r1', 'c1', 'r2', 'c2')} AS score_box_range
FROM c LEFT JOIN w ON w.doc_id = c.doc_id AND w.question_id = c.question_id AND w.page = c.page""")
def _(t):
    return PG.item_marking(t.fx_items, _marking_tokens(t), hints(t), t.fx_cells, t.fx_page_grid)


# ---- grades ---------------------------------------------------------------

@query("pf8_attempted", """
SELECT doc_id, question_id FROM fx_items WHERE coalesce(is_attempted, TRUE) AND trim(coalesce(student_answer, '')) <> ''""")
def _(t):
    return GR.attempted(t.fx_items).select("doc_id", "question_id")


_LATEST = """(SELECT doc_id, CAST(question_id AS INT) AS q, arg_max(coalesce(feedback, '-'), ord) AS feedback, arg_max(marks_awarded, ord) AS marks_awarded, arg_max(max_marks, ord) AS max_marks, arg_max(status, ord) AS status, arg_max(present, ord) AS present FROM fx_evaluations GROUP BY 1, 2)"""


def _g(k: str, old: str) -> str:
    return f"CASE WHEN e.q IS NOT NULL AND (i.doc_id IS NULL OR contains(e.present, '{k}')) THEN e.{k} ELSE {old} END"


_MERGED = f"""(SELECT coalesce(i.doc_id, e.doc_id) AS doc_id, coalesce(i.question_id, e.q) AS question_id, CASE WHEN i.doc_id IS NULL THEN '' ELSE i.student_answer END AS student_answer,
 CASE WHEN i.doc_id IS NULL THEN lower(e.status) NOT IN ('', 'unattempted') ELSE i.is_attempted END AS is_attempted, i.start_page, i.marking_page, i.start_y, {_g('max_marks', 'NULL')} AS max_marks, {_g('marks_awarded', 'i.start_y')} AS marks_awarded,
 {_g('status', 'NULL')} AS status, nullif({_g('feedback', 'NULL')}, '-') AS feedback, i.doc_id IS NULL AS teacher_only, CASE WHEN coalesce(i.question_id, e.q, 0) = 0 THEN 1000000000 ELSE coalesce(i.question_id, e.q) END AS sort_key
 FROM fx_items i FULL JOIN {_LATEST} e ON e.doc_id = i.doc_id AND e.q = i.question_id)"""


def _merged(t):
    items = t.fx_items.select("doc_id", "question_id", "student_answer", "is_attempted", "start_page", "marking_page", "start_y", F.col("start_y").alias("marks_awarded"))
    return items, t.fx_evaluations.withColumn("present", F.split("present", ","))


@query("j8_merge_evaluations", f"SELECT * FROM {_MERGED} m")
def _(t):
    return GR.merge_evaluations(*_merged(t))


@query("so5_teacher_only", f"SELECT doc_id, question_id, is_attempted, status FROM {_MERGED} m WHERE teacher_only")
def _(t):
    return GR.teacher_only_rows(*_merged(t))


@query("s2_item_order", f"SELECT doc_id, question_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sort_key, question_id) AS INT) AS n FROM {_MERGED} m")
def _(t):
    m = GR.merge_evaluations(*_merged(t)).select("doc_id", "question_id", "sort_key")
    return GR.order_items(m).drop("sort_key")


_RUNP = f"""(SELECT doc_id, page, row, start_col, cell_count, {PX('start_col - 1')} AS x1, {PX('end_col')} AS x2, {PY('row - 1')} AS y1, {PY('row')} AS y2 FROM ({_RUNS}) r WHERE cell_count >= 3)"""
_BEST = "(SELECT i.doc_id, i.question_id, arg_min(r, (-r.cell_count, -r.y1, r.row, r.start_col)) AS r FROM fx_items i JOIN {runs} r ON r.doc_id = i.doc_id AND r.page = i.{page} AND r.y1 <= greatest(i.start_y, i.end_y) AND r.y2 >= least(i.start_y, i.end_y) GROUP BY ALL)"


@query("j13_inject_marking", f"""
SELECT i.doc_id, i.question_id, CASE WHEN s.r IS NOT NULL THEN i.start_page WHEN e.r IS NOT NULL THEN i.end_page ELSE i.marking_page END AS marking_page, CASE WHEN s.r IS NOT NULL THEN i.start_page WHEN e.r IS NOT NULL THEN i.end_page END AS marking_box_page,
 round_even((coalesce(s.r, e.r).x1 + coalesce(s.r, e.r).x2) / 2.0 * 100, 0) / 100 AS marking_x, round_even((coalesce(s.r, e.r).y1 + coalesce(s.r, e.r).y2) / 2.0 * 100, 0) / 100 AS marking_y,
 coalesce(s.r, e.r).x1 AS box_x1, coalesce(s.r, e.r).y1 AS box_y1, coalesce(s.r, e.r).x2 AS box_x2, coalesce(s.r, e.r).y2 AS box_y2
FROM fx_items i LEFT JOIN {_BEST.format(runs=_RUNP, page='start_page')} s ON s.doc_id = i.doc_id AND s.question_id = i.question_id LEFT JOIN {_BEST.format(runs=_RUNP, page='end_page')} e ON e.doc_id = i.doc_id AND e.question_id = i.question_id""")
def _(t):
    runs = G.with_percent(G.writable_runs(t.fx_cells, 3), t.fx_page_grid)
    return GR.inject_marking(t.fx_items, runs).select("doc_id", "question_id", "marking_page", "marking_box_page", "marking_x", "marking_y", "box_x1", "box_y1", "box_x2", "box_y2")


_IDX = """CASE WHEN zb AND ob THEN CASE WHEN s < e THEN p WHEN p = m THEN m - 1 WHEN p = m - 1 THEN p WHEN p = s THEN p - 1 ELSE p END WHEN zb THEN p WHEN ob THEN p - 1 ELSE greatest(s - 1, least(e - 1, p)) END"""
_SEEDS = f"""(SELECT a.*, {_IDX} AS pi FROM (SELECT a.doc_id, a.question_id, a.annotation_index, a.y_position_percent AS y, a.x_start_percent AS x1, a.x_end_percent AS x2, i.start_page AS s, i.end_page AS e, i.marking_page AS m, i.start_y AS my, i.end_y AS mx, p,
  p BETWEEN i.start_page - 1 AND i.end_page - 1 AS zb, p BETWEEN i.start_page AND i.end_page AS ob, i.question_id = 7 AS native
  FROM (SELECT *, CAST(page - 2 + (annotation_index % 3) AS INT) AS p FROM fx_annotations) a JOIN fx_items i ON i.doc_id = a.doc_id AND i.question_id = a.question_id) a)"""


@query("w11_reseed", f"""
WITH s AS {_SEEDS}, k AS (SELECT *, NOT native AND pi = m - 1 AS onp FROM s),
 r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, question_id, onp) AS n, row_number() OVER (PARTITION BY doc_id, question_id, onp ORDER BY CASE WHEN y = 0 THEN my ELSE y END, annotation_index) - 1 AS rk FROM k)
SELECT doc_id, question_id, annotation_index, CASE WHEN native THEN p ELSE pi END AS page_index,
 CASE WHEN onp THEN round_even(greatest(6.0::DOUBLE, least(94.0::DOUBLE, my + (rk - (n - 1) / 2.0::DOUBLE) * 16.0::DOUBLE)) * 100, 0) / 100 ELSE y END AS y_position_percent,
 CASE WHEN onp THEN round_even(greatest(5.0::DOUBLE, least(70.0::DOUBLE, mx - 15.0::DOUBLE)) * 100, 0) / 100 ELSE x1 END AS x_start_percent,
 CASE WHEN onp THEN round_even(least(95.0::DOUBLE, greatest(greatest(5.0::DOUBLE, least(70.0::DOUBLE, mx - 15.0::DOUBLE)) + 5.0::DOUBLE, mx + 15.0::DOUBLE)) * 100, 0) / 100 ELSE x2 END AS x_end_percent FROM r""")
def _(t):
    items = t.fx_items.withColumn("marking_x", F.col("end_y")).withColumn("marking_y", F.col("start_y"))
    anns = t.fx_annotations.select("doc_id", "question_id", "annotation_index", (F.col("page") - 2 + F.col("annotation_index") % 3).cast("int").alias("page_index"),
                                   "y_position_percent", "x_start_percent", "x_end_percent", (F.col("question_id") == 7).alias("has_cells"))
    return GR.reseed(items, anns).drop("has_cells")


@query("j24_key_for_item", """
SELECT i.doc_id, i.question_id, k.id AS key_id, k.title AS key_title, k.marks AS key_marks FROM fx_items i LEFT JOIN (
 SELECT *, row_number() OVER (PARTITION BY model_id, n ORDER BY pos) AS rn FROM (SELECT *, TRY_CAST(regexp_replace(question_no, '^Q', '') AS INT) AS n FROM fx_questions) q WHERE n IS NOT NULL) k
 ON k.model_id = i.doc_id AND k.n = i.question_id AND k.rn = 1""")
def _(t):
    items = t.fx_items.select("doc_id", F.col("doc_id").alias("model_id"), "question_id")
    return GR.key_for_item(items, t.fx_questions).drop("model_id")


@query("c25_clamp_marks", "SELECT event_id, least(greatest(round_even(value / 10.0 * 2.0, 0) / 2.0, 0.0), 12.0) AS marks FROM events")
def _(t):
    return t.events.select("event_id", S.clamp_marks(F.col("value") / 10.0, F.lit(12)).alias("marks"))
