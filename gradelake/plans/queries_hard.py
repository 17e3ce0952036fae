"""The same operators on harder input: repeated keys, cut-off text, long ids and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import coords as X
from gradelake.functions import glyphs
from gradelake.operators import catalog as C
from gradelake.operators import cells as CE
from gradelake.operators import grid as G
from gradelake.operators import grading as GR
from gradelake.operators import parse as PA
from gradelake.operators import placement as PL
from gradelake.operators import raster as R
from gradelake.plans.queries_catalog import _BT
from gradelake.plans.queries_cells import _RECTS
from gradelake.plans.queries_quality import _FIT, WIDTH
from gradelake.plans.registry import query


def thrice(df):
    """Every row three times, in reverse order of ``ord``."""
    return df.withColumn("ord", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))))


_THRICE = "(SELECT i.*, o.ord FROM fx_incoming i, (VALUES (1), (2), (3)) o(ord))"


@query("j4_upsert_repeats", f"""
SELECT coalesce(m.id, i.id) AS id, coalesce(m.owner_user_id, i.owner_user_id) AS owner_user_id,
 CASE WHEN i.id IS NOT NULL THEN concat(i.title, ' 3') ELSE m.title END AS title, CASE WHEN i.id IS NOT NULL THEN i.question_count + 3 ELSE 0 END AS question_count,
 CASE WHEN m.id IS NULL THEN i.created_seq + 1 ELSE m.created_seq END AS created_seq
FROM fx_models m FULL JOIN fx_incoming i ON i.id = m.id AND i.owner_user_id = m.owner_user_id""")
def _(t):
    new = thrice(t.fx_incoming).withColumns({
        "title": F.concat_ws(" ", "title", "ord"), "question_count": F.col("question_count") + F.col("ord"), "created_seq": F.col("created_seq") + F.col("ord")})
    return C.upsert_models(t.fx_models.withColumn("question_count", F.lit(0)), new).select("id", "owner_user_id", "title", "question_count", "created_seq")


@query("j4_update_repeats", f"""
SELECT m.id, m.owner_user_id, CASE WHEN i.id IS NOT NULL THEN concat(i.title, ' 3') ELSE m.title END AS title,
 CASE WHEN i.id IS NOT NULL THEN {_BT.format('i.booklet_type')} ELSE m.booklet_type END AS booklet_type
FROM fx_models m LEFT JOIN fx_incoming i ON i.id = m.id AND i.owner_user_id = m.owner_user_id AND EXISTS (SELECT 1 FROM fx_keys k WHERE k.id = m.id AND k.owner_user_id = m.owner_user_id)""")
def _(t):
    changes = thrice(t.fx_incoming).withColumn("title", F.concat_ws(" ", "title", "ord"))
    return C.update_keys(t.fx_keys, t.fx_models, changes)[1].select("id", "owner_user_id", "title", "booklet_type")


_GOOD = """good AS (SELECT c_custkey AS model_id, c_name, ord FROM customer c, (VALUES (1), (2), (3)) o(ord)
 WHERE EXISTS (SELECT 1 FROM fx_keys k WHERE k.id = c_custkey AND k.owner_user_id = c_nationkey))"""


@query("j28_append_repeats", f"""
WITH {_GOOD}, mx AS (SELECT model_id, max(pos) AS top, max(CAST(regexp_extract(id, '^q-eng-([0-9]+)$', 1) AS INT)) AS n FROM fx_questions GROUP BY model_id),
 allq AS (SELECT q.model_id, q.pos, q.id, q.title FROM fx_questions q WHERE q.model_id IN (SELECT model_id FROM good)
  UNION ALL SELECT g.model_id, coalesce(mx.top, 0) + g.ord, concat('q-eng-', lpad(CAST(coalesce(mx.n, 0) + g.ord AS VARCHAR(9)), 3, '0')), concat(g.c_name, ' ', g.ord) FROM good g LEFT JOIN mx ON mx.model_id = g.model_id)
SELECT model_id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY pos) AS INT) AS pos, id, title FROM allq
UNION ALL SELECT model_id, pos, id, title FROM fx_questions WHERE model_id NOT IN (SELECT model_id FROM good)""")
def _(t):
    return _appended(t)[1].select("model_id", "pos", "id", "title")


@query("j28_append_repeats_models", f"""
WITH {_GOOD}, n AS (SELECT model_id, count(*) + (SELECT count(*) FROM fx_questions q WHERE q.model_id = g.model_id) AS n FROM good g GROUP BY model_id)
SELECT m.id, CAST(n.n AS INT) AS question_count FROM fx_models m LEFT JOIN n ON n.model_id = m.id
UNION ALL SELECT n.model_id, CAST(n.n AS INT) FROM n JOIN customer c ON c.c_custkey = n.model_id WHERE NOT EXISTS (SELECT 1 FROM fx_models m WHERE m.id = n.model_id AND m.owner_user_id = c.c_nationkey)""")
def _(t):
    return _appended(t)[0].select("id", "question_count")


def _appended(t):
    new = thrice(t.customer.select(F.col("c_custkey").alias("model_id"), F.col("c_nationkey").alias("owner_user_id"), F.col("c_name").alias("title")))
    return C.append_questions(t.fx_keys, t.fx_models, t.fx_questions, new.withColumn("title", F.concat_ws(" ", "title", "ord")))


@query("j29_replace_repeats", """
WITH n AS (SELECT o_custkey AS model_id, concat('q-eng-', lpad(CAST(1 + o_orderkey % 3 AS VARCHAR(9)), 3, '0')) AS id, max(o_orderkey) AS k FROM orders GROUP BY 1, 2)
SELECT q.model_id, q.pos, q.id, CASE WHEN n.id IS NULL THEN q.title ELSE concat('re ', n.k) END AS title FROM fx_questions q LEFT JOIN n ON n.model_id = q.model_id AND n.id = q.id""")
def _(t):
    new = t.orders.select(
        F.col("o_custkey").alias("model_id"), F.format_string("q-eng-%03d", 1 + F.col("o_orderkey") % 3).alias("id"), F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("re "), "o_orderkey").alias("title"), F.lit("Qx").alias("question_no"), F.lit(None).cast("string").alias("desc_text"),
        F.lit(None).cast("string").alias("instruction_name"), F.lit(1).alias("page_num"), F.lit(9).alias("marks"))
    return C.replace_questions(t.fx_questions, new)[0].select("model_id", "pos", "id", "title")


@query("j8_merge_own_ids", """
WITH i AS (SELECT doc_id, concat(question_id, CASE WHEN question_id % 4 = 0 THEN 'a' ELSE '' END) AS question_id, question_id % 4 = 0 AS odd, question_id AS q FROM fx_items),
 e AS (SELECT doc_id, CAST(question_id AS INT) AS q, arg_max(concat('note ', status, ' ', ord), ord) AS annotations FROM fx_evaluations GROUP BY 1, 2)
SELECT coalesce(i.doc_id, e.doc_id) AS doc_id, coalesce(i.question_id, CAST(e.q AS VARCHAR)) AS question_id, e.annotations, i.doc_id IS NULL AS teacher_only
FROM i FULL JOIN e ON e.doc_id = i.doc_id AND e.q = i.q AND NOT i.odd""")
def _(t):
    items = t.fx_items.select("doc_id", F.concat(F.col("question_id").cast("string"), F.when(F.col("question_id") % 4 == 0, "a").otherwise("")).alias("question_id"),
                              "student_answer", "is_attempted")
    evals = t.fx_evaluations.select("doc_id", "question_id", "ord", "status", F.concat_ws(" ", F.lit("note"), "status", "ord").alias("annotations"),
                                    F.array(F.lit("annotations")).alias("present"))
    return GR.merge_evaluations(items, evals).select("doc_id", "question_id", "annotations", "teacher_only")


@query("c21_cut_feedback", r"""
SELECT doc_id, CAST(doc_id % 50 AS INT) AS question_id, trim(x, ' ' || chr(9) || chr(10) || chr(13)) AS feedback, x AS comment, 1 AS n, 2.5::DOUBLE AS y, TRUE AS is_positive
FROM (SELECT doc_id, translate(text, '{}\', '()/') AS x FROM documents) d""")
def _(t):
    x = F.translate("text", "{}\\", "()/")
    spelled = F.replace(F.replace(x, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(r"\n"))
    raw = F.concat(F.lit('[{"question_id": '), F.col("doc_id") % 50, F.lit(
        ', "annotations": [{"page_index": 1, "y_position_percent": 2.5, "x_start_percent": 3, "x_end_percent": 4, "comment": "'), spelled,
        F.lit('", "is_positive": true}, {"page_index": 2, "comment": "not whole"}], "feedback": "'), spelled)
    out = PA.regex_evaluations(t.documents.select("doc_id", raw.alias("raw")), "raw")
    a = F.element_at("annotations", 1)
    return out.select("doc_id", "question_id", "feedback", a["comment"].alias("comment"), F.size("annotations").alias("n"), a["y_position_percent"].alias("y"), a["is_positive"].alias("is_positive"))


@query("c20_json_escapes", """
SELECT doc_id, text AS student_text, 'pattern' AS source FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents) d""")
def _(t):
    text = F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    quoted = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    body = F.substr(quoted, F.lit(7), F.length(quoted) - 8)  # the string between its quotes, as JSON spells it
    raw = F.concat(F.lit('broken "studentText": "'), body, F.lit('", "marks_awarded": 3 oops'))
    return PA.parse_analysis(t.documents.select("doc_id", raw.alias("raw"), F.lit(8).alias("total")), "raw", "total").select("doc_id", "student_text", "source")


@query("w6_long_labels", """
SELECT model_id, id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY length(label), label, pos) AS INT) AS new_pos
FROM (SELECT model_id, id, pos, concat(1 + marks % 7, repeat('0', 38 + page_num * 3)) AS label FROM fx_questions) q""")
def _(t):
    label = F.concat(F.lit("Q"), 1 + F.col("marks") % 7, F.repeat(F.lit("0"), 38 + F.col("page_num") * 3))
    return C.logical_order(t.fx_questions.withColumn("question_no", label)).select("model_id", "id", "new_pos")


# as many letters as any long takes; six letters and more are beyond every grid, held as 10 ** 9
_DIGITS = f"(SELECT n, n AS n1, {', '.join(f'(n{k - 1} - 1) // 26 AS n{k}' for k in range(2, 15))} FROM (SELECT p_partkey * 4801 + 18270 AS n FROM part) p)"
_LETTER = "CASE WHEN {0} > 0 THEN chr(CAST(65 + ({0} - 1) % 26 AS INT)) ELSE '' END"
_LONG = " || ".join(_LETTER.format(f"n{k}") for k in range(14, 0, -1))
_COLUMN = "CAST(CASE WHEN n6 > 0 THEN 1000000000 ELSE n END AS INT)"


@query("c1_long_columns", f"""
SELECT n, {_LONG} AS letters, {_COLUMN} AS back, 2 AS r1, 1000000000 AS r2, {_COLUMN} AS c2 FROM {_DIGITS} d""")
def _(t):
    j = t.part.select((F.col("p_partkey") * 4801 + 18270).alias("n")).withColumn("letters", X.column_letters("n"))
    b = X.range_bounds(F.concat("letters", F.lit("99999999999:B2")))
    return j.withColumn("b", b).select("n", "letters", X.letters_to_column(F.col("letters")).alias("back"), "b.r1", "b.r2", "b.c2")


@query("c4_expand_in_grid", """
SELECT p_partkey, greatest(0, least(6, p_size % 9 + 2) - greatest(1, p_size % 9) + 1)::INT * 4 AS n FROM part""")
def _(t):
    token = F.concat(F.lit("A"), (F.col("p_size") % 9).cast("string"), F.lit(":ZZZZZZZ"), (F.col("p_size") % 9 + 2).cast("string"))
    cells = X.expand_range(token, F.lit(6), F.lit(4))
    return t.part.select("p_partkey", F.size(F.filter(cells, lambda c: c["row"] >= F.col("p_size") % 9)).alias("n"))


@query("w9_region_means", f"""
SELECT x.doc_id, x.page, x.region_no, round_even(CAST(sum(CAST(round_even(c.score * 1000000, 0) AS BIGINT)) AS DOUBLE) / count(*) / 1000000 * 10000, 0) / 10000 AS mean_score, round_even(CAST(sum(CAST(round_even(c.ink_ratio * 1000000, 0) AS BIGINT)) AS DOUBLE) / count(*) / 1000000 * 10000, 0) / 10000 AS mean_ink_ratio
FROM {_RECTS} x JOIN fx_cells c ON c.doc_id = x.doc_id AND c.page = x.page AND c.row BETWEEN x.row_start AND x.row_end AND c.col BETWEEN x.col_start AND x.col_end GROUP BY ALL""")
def _(t):
    regions = G.writable_regions(G.page_masks(t.fx_cells, t.fx_page_grid))
    return G.region_means(regions, t.fx_cells).select("doc_id", "page", "region_no", "mean_score", "mean_ink_ratio")


def _near(at: str, n: str, margin: str, length: str) -> str:
    edge = f"round_even(({margin} + ({{k}}) * cell_size_pts) / {length} * 100.0::DOUBLE * 1000, 0) / 1000"
    low, high = edge.format(k="k - 1"), edge.format(k="k")
    return f"list_transform(range(1, {n} + 1), lambda k: {{'d': pow(({low} + {high}) / 2.0::DOUBLE - {at}, 2), 'k': k, 'h': {at} BETWEEN {low} AND {high}}})"


@query("j14_nearest_cell", f"""
WITH p AS (SELECT a.doc_id, a.page, a.annotation_index, least(100.0::DOUBLE, x_start_percent * 1.3::DOUBLE) AS x, least(100.0::DOUBLE, y_position_percent) AS y, g.* EXCLUDE (doc_id, page)
  FROM fx_annotations a LEFT JOIN fx_page_grid g ON g.doc_id = a.doc_id AND g.page = a.page AND a.page <> 3),
 n AS (SELECT doc_id, page, annotation_index, {_near('x', 'cols', 'left_margin_pts', 'page_w_pts')} AS xs, {_near('y', 'rows', 'top_margin_pts', 'page_h_pts')} AS ys FROM p),
 f AS (SELECT *, list_filter(xs, lambda c: c.h) AS hx, list_filter(ys, lambda c: c.h) AS hy FROM n)
SELECT doc_id, page, annotation_index, CAST(coalesce(CASE WHEN len(hx) > 0 AND len(hy) > 0 THEN list_min(hy).k ELSE list_min(ys).k END, 1) AS INT) AS anchor_row,
 CAST(coalesce(CASE WHEN len(hx) > 0 AND len(hy) > 0 THEN list_min(hx).k ELSE list_min(xs).k END, 1) AS INT) AS anchor_col FROM f""")
def _(t):
    points = t.fx_annotations.select("doc_id", "page", "annotation_index", (F.col("x_start_percent") * 1.3).alias("x_percent"), F.col("y_position_percent").alias("y_percent"))
    return CE.anchor_cells(points, t.fx_page_grid.filter("page <> 3")).select("doc_id", "page", "annotation_index", "anchor_row", "anchor_col")


@query("j14_loose_cells", """
WITH s AS (SELECT *, least(100.0::DOUBLE, greatest(0.0::DOUBLE, x_percent)) AS x, least(100.0::DOUBLE, greatest(0.0::DOUBLE, y_percent)) AS y FROM fx_spots),
 d AS (SELECT s.doc_id, s.page, s.annotation_index, c.row, c.col, ((x_start_percent + x_end_percent) / 2 - x) ** 2 + ((y_start_percent + y_end_percent) / 2 - y) ** 2 AS d,
  x BETWEEN x_start_percent AND x_end_percent AND y BETWEEN y_start_percent AND y_end_percent AS holds FROM s LEFT JOIN fx_loose_cells c ON c.doc_id = s.doc_id AND c.page = s.page)
SELECT doc_id, page, annotation_index, coalesce(row, 1) AS anchor_row, coalesce(col, 1) AS anchor_col FROM d
QUALIFY row_number() OVER (PARTITION BY doc_id, page, annotation_index ORDER BY holds DESC, d, row, col) = 1""")
def _(t):
    return CE.nearest_cells(t.fx_spots, t.fx_loose_cells).select("doc_id", "page", "annotation_index", "anchor_row", "anchor_col")


@query("src2_image_rasters", """
WITH g AS (SELECT doc_id, page, y, x, value * 3 % 256 AS b, value AS g, 255 - value AS r FROM fx_pixels)
SELECT doc_id, page, CAST(max(y) + 1 AS INT) AS height, CAST(max(x) + 1 AS INT) AS width,
 sha256(string_agg(printf('%02X', CAST((299 * r + 587 * g + 114 * b + 500) // 1000 AS INT)), '' ORDER BY y, x)) AS gray_sha256 FROM g GROUP BY 1, 2""")
def _(t):
    """Colour images in the image source's layout, made of the pixel table, to gray rasters."""
    lines = t.fx_pixels.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y", "x", "value"))).alias("p"), F.max("y").alias("y"), F.max("x").alias("x"))
    text = F.concat_ws("", F.transform("p", lambda p: F.concat(F.lpad(F.hex(p["value"] * 3 % 256), 2, "0"), F.lpad(F.hex(p["value"]), 2, "0"), F.lpad(F.hex(255 - p["value"]), 2, "0"))))
    image = F.struct(F.lit("").alias("origin"), (F.col("y") + 1).cast("int").alias("height"), (F.col("x") + 1).cast("int").alias("width"), F.lit(3).alias("nChannels"), F.unhex(text).alias("data"))
    made, _ = R.rasters_from_images(lines.select("doc_id", "page", image.alias("image")))
    return made.select("doc_id", "page", "height", "width", F.sha2(F.hex("data"), 256).alias("gray_sha256"))


@query("u10_page_rejects", """
SELECT event_id, CAST(user_id % 6 - 1 AS INT) AS page, CASE WHEN user_id % 6 - 1 < 1 THEN concat('Page must be ≥ 1, got ', user_id % 6 - 1)
 WHEN user_id % 3 = 0 THEN concat('Page ', user_id % 6 - 1, ' out of range (1–0)') ELSE concat('Page ', user_id % 6 - 1, ' out of range (1–2)') END AS reason
FROM events WHERE user_id % 6 - 1 < 1 OR user_id % 3 = 0 OR user_id % 6 - 1 > 2""")
def _(t):
    remarks = t.events.select("event_id", F.col("user_id").alias("session_id"), (F.col("user_id") % 6 - 1).cast("int").alias("page"))
    counts = t.events.filter("user_id % 3 <> 0").select(F.col("user_id").alias("session_id"), F.lit(2).alias("n_pages")).distinct()
    return PL.page_rejects(remarks, counts)[1].select("event_id", "page", "reason")


_STRIPPED = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


def _reply(text, key: str):
    """A fenced JSON reply that holds a text."""
    return F.concat(F.lit("```json\n"), F.to_json(F.struct(text.alias(key))), F.lit("\n```"))


@query("c24_named_text", f"SELECT doc_id, {_STRIPPED} AS answer FROM documents WHERE doc_id % 5 <> 0")
def _(t):
    raw = F.when(F.col("doc_id") % 5 == 0, _reply(F.col("text"), "text")).otherwise(_reply(F.col("text"), "answer"))
    return PA.parse_named_text(t.documents.select("doc_id", raw.alias("raw")), "raw", "answer")[0].select("doc_id", "answer")


@query("c24_expanded_answer", f"""
SELECT conv_id, turn, {_STRIPPED} AS answer, CASE turn % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN role ELSE '' END AS diagrams FROM conversations""")
def _(t):
    lists = F.when(F.col("turn") % 3 == 0, F.lit('[" a ", 7, "", "b", null]')).when(F.col("turn") % 3 == 1, F.concat(F.lit('" '), "role", F.lit('"'))).otherwise("{}")
    body = F.to_json(F.struct(F.col("text").alias("answer")))
    raw = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(', "diagramDescriptions": '), lists, F.lit("}"))
    good, _ = PA.parse_expanded_answer(t.conversations.select("conv_id", "turn", raw.alias("raw")), "raw")
    return good.select("conv_id", "turn", "answer", F.array_join("diagrams", "|").alias("diagrams"))


@query("c24_page_text", f"SELECT doc_id, {_STRIPPED} AS text FROM documents WHERE doc_id % 4 <> 3 AND {_STRIPPED} <> ''")
def _(t):
    whole = _reply(F.col("text"), "text")
    bare = F.to_json(F.struct("text"))
    cut = F.substr(bare, F.lit(1), F.length(bare) - 1)  # the closing brace is lost
    raw = F.when(F.col("doc_id") % 4 == 3, F.lit('{"text": " "}')).when(F.col("doc_id") % 4 == 2, cut).otherwise(whole)
    return PA.parse_page_text(t.documents.select("doc_id", raw.alias("raw")), "raw")[0].select("doc_id", "text")


def _structures(t):
    one = F.concat(F.lit('{"section_name": " A ", "questions": [{"question_id": '), "event_id", F.lit('}, 5, {"student_answer": "'), "event_type", F.lit('"}]}'))
    raw = (F.when(F.col("user_id") % 5 == 0, "[]").when(F.col("user_id") % 5 == 1, '{"sections": 3}').when(F.col("user_id") % 5 == 2, '{"sections": [{"questions": []}]}')
           .when(F.col("user_id") % 5 == 3, F.concat(F.lit('{"sections": ['), one, F.lit(', 7, {"questions": [{"question_id": 1}]}]}'))).otherwise("no json"))
    return PA.parse_sections(t.events.select("event_id", raw.alias("raw")), "raw", "event_id")


@query("c24_sections", """
SELECT event_id, 0 AS section_no, 'A' AS section_name, 0 AS pos, event_id AS question_id FROM events WHERE user_id % 5 = 3
UNION ALL SELECT event_id, 0, 'A', 2, NULL FROM events WHERE user_id % 5 = 3
UNION ALL SELECT event_id, 2, 'अज्ञात अनुभाग', 0, 1 FROM events WHERE user_id % 5 = 3""")
def _(t):
    return _structures(t)[0].select("event_id", "section_no", "section_name", "pos", F.expr("try_variant_get(item, '$.question_id', 'bigint')").alias("question_id"))


@query("c24_section_rejects", """
SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'Structure response must be a JSON object.' WHEN 1 THEN 'Structure response missing sections array.'
 WHEN 2 THEN 'No question-answer blocks detected.' ELSE 'invalid JSON' END AS reason FROM events WHERE user_id % 5 <> 3""")
def _(t):
    return _structures(t)[1].select("event_id", "reason")


@query("c15_cells_needed_texts", f"""
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE CAST(greatest(1, ceil({WIDTH("t")} * 11.0::DOUBLE / 1000.0::DOUBLE / 24.0::DOUBLE)) AS INT) END AS cells FROM (SELECT doc_id, trim(text) AS t FROM documents) d""")
def _(t):
    return t.documents.select("doc_id", glyphs.cells_needed("text", 11.0, 24.0).alias("cells"))


@query("c16_comment_fits_texts", f"""
SELECT doc_id, comment = '' OR (fnt * 1.4::DOUBLE <= ah AND fit.ok AND fit.lines * (fnt * 1.4::DOUBLE) <= ah) AS fits FROM (SELECT *, {_FIT} AS fit FROM (
 SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS comment, CAST(14 + doc_id % 3 AS DOUBLE) AS fnt, 24.0::DOUBLE * (4 + doc_id % 60) * 0.95::DOUBLE AS aw, 24.0::DOUBLE * (2 + doc_id % 300) * 0.95::DOUBLE AS ah FROM documents) a) b""")
def _(t):
    k = F.col("doc_id")
    return t.documents.select("doc_id", glyphs.comment_fits("text", (14 + k % 3).cast("double"), 4 + k % 60, 2 + k % 300, F.lit(24.0)).alias("fits"))
