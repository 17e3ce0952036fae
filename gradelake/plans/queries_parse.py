"""Text and model-output parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import scoring as S
from gradelake.functions import text as T
from gradelake.operators import parse as PA
from gradelake.plans.registry import query

# Model replies around whole document texts: fenced, with a trailing comma, sometimes cut.
_RAW_DOC = """concat('Here it is: ', chr(96), chr(96), chr(96), 'json', chr(10), '{"text": "', translate(text, concat(chr(10), chr(13), chr(9), chr(34), chr(92)), '     '), '", "lang": "', lang, '",}', chr(10), chr(96), chr(96), chr(96), ' done')"""
_INNER = """concat('{"text": "', translate(text, concat(chr(10), chr(13), chr(9), chr(34), chr(92)), '     '), '", "lang": "', lang, '",}')"""


def _docs(t):
    t.documents
    return t.spark.sql(f"SELECT doc_id, text, {_RAW_DOC} AS raw FROM documents")


@query("c17_strip_fence", f"SELECT doc_id, trim({_INNER}) AS inner_text FROM documents")
def _(t):
    return _docs(t).select("doc_id", T.strip_fence("raw").alias("inner_text"))


@query("c18_repair_json", rf"SELECT doc_id, regexp_replace({_INNER}, ',\s*([}}\]])', '\1', 'g') AS fixed FROM documents")
def _(t):
    return _docs(t).select("doc_id", T.repair_json("raw", fix_quotes=False).alias("fixed"))


@query("c18_close_open_json", """
SELECT event_id, concat('{"a": [{"b": "', event_type, '"') || '}}' || ']' AS fixed FROM events""")
def _(t):
    return t.events.select("event_id", T.repair_json(F.concat(F.lit('{"a": [{"b": "'), F.col("event_type"))).alias("fixed"))


@query("c24_parse_payload", """
SELECT doc_id, translate(text, concat(chr(10), chr(13), chr(9), chr(34), chr(92)), '     ') AS text, lang FROM documents""")
def _(t):
    good, _bad = PA.parse_payload(_docs(t).select("doc_id", "raw"), "raw", "struct<text:string,lang:string>")
    return good.select("doc_id", "parsed.text", "parsed.lang")


@query("c24_parse_payload_rejects", "SELECT event_id FROM events WHERE event_type = 'error'")
def _(t):
    raw = t.events.select("event_id", F.when(F.col("event_type") == "error", "no json here").otherwise(F.concat(F.lit('{"v": '), F.col("event_id").cast("string"), F.lit("}"))).alias("raw"))
    return PA.parse_payload(raw, "raw", "array<struct<v:bigint>>")[1].select("event_id")


@query("c20_parse_analysis", """
SELECT event_id, event_type AS student_text, least(greatest(round_even(CAST(user_id % 40 AS DOUBLE) / 4 * 2, 0) / 2, 0), 8.0) AS marks_awarded, 0.0::DOUBLE AS confidence_percent, '' AS good_points, 'json' AS source FROM events""")
def _(t):
    out = PA.parse_analysis(t.fx_model_json.withColumn("total", F.lit(8)), "raw", "total")
    return out.select("event_id", "student_text", "marks_awarded", "confidence_percent", "good_points", "source")


@query("c21_parse_analysis_fallback", """
SELECT event_id, event_type AS student_text, least(round_even(CAST(user_id % 40 AS DOUBLE) / 4 * 2, 0) / 2, 8.0) AS marks_awarded, least(CAST(user_id % 150 AS DOUBLE), 100.0) AS confidence_percent, '' AS good_points, 'pattern' AS source FROM events""")
def _(t):
    raw = F.concat(F.lit('studentText broken "studentText": "'), "event_type", F.lit('", "marks_awarded": '), (F.col("user_id") % 40 / 4).cast("string"),
                   F.lit(', "confidencePercent": '), (F.col("user_id") % 150).cast("string"), F.lit(" oops"))
    j = t.events.select("event_id", raw.alias("raw"), F.lit(8).alias("total"))
    return PA.parse_analysis(j, "raw", "total").select("event_id", "student_text", "marks_awarded", "confidence_percent", "good_points", "source")


@query("c20_points_list", """SELECT event_id, concat('• ', event_type, chr(10), '• k', user_id) AS good_points FROM events""")
def _(t):
    raw = F.concat(F.lit('{"goodPoints": ["'), "event_type", F.lit('", "k'), F.col("user_id").cast("string"), F.lit('"]}'))
    return PA.parse_analysis(t.events.select("event_id", raw.alias("raw"), F.lit(8).alias("total")), "raw", "total").select("event_id", "good_points")


@query("c21_regex_evaluations", """
SELECT event_id, 0 AS pos, CAST(1 + user_id % 20 AS INT) AS question_id, event_type AS status, '' AS feedback, 0 AS max_marks, CAST(user_id % 9 AS DOUBLE) AS marks_awarded FROM events
UNION ALL SELECT event_id, 1, CAST(2 + user_id % 20 AS INT), '', 'fine', 10, 50.0 FROM events""")
def _(t):
    raw = F.concat(F.lit('[{"question_id": '), (1 + F.col("user_id") % 20).cast("string"), F.lit(', "status": "'), "event_type", F.lit('", "marks_awarded": '),
                   (F.col("user_id") % 9).cast("string"), F.lit('}, {"question_id": '), (2 + F.col("user_id") % 20).cast("string"), F.lit(', "feedback": "fine", "max_marks": 10, "sta'))
    out = PA.regex_evaluations(t.events.select("event_id", raw.alias("raw")), "raw")
    return out.select("event_id", "pos", "question_id", "status", "feedback", "max_marks", "marks_awarded")


@query("c19_repair_truncated_array", """
SELECT event_id, concat('[{"a": "', event_type, '{"}, {"a": "x}"}]') AS repaired FROM events""")
def _(t):
    raw = F.concat(F.lit('[{"a": "'), "event_type", F.lit('{"}, {"a": "x}"}, {"a": "cut of'))
    return PA.repair_truncated_array(t.events.select("event_id", raw.alias("raw")), "raw").select("event_id", "repaired")


@query("c22_parse_combined_review", """
SELECT event_id, CASE event_id % 3 WHEN 2 THEN '' ELSE event_type END AS final_review, CASE WHEN event_id % 3 = 0 THEN 'imp' ELSE '' END AS overall_improvements, '' AS one_thing_to_write, event_id % 3 = 2 AS rejected FROM events""")
def _(t):
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit('{"final_review": "'), "event_type", F.lit('", "overallImprovements": "imp"}'))).when(
        kind == 1, F.concat(F.lit('oops "finalReview": "'), "event_type", F.lit('" end'))).otherwise("nothing")
    return PA.parse_combined_review(t.events.select("event_id", raw.alias("raw")), "raw").drop("raw")


@query("c23_parse_cover_marks", """
SELECT event_id, 1 AS line_no, CAST(user_id % 12 AS INT) AS question_no, concat(user_id, '.5') AS marks_text, CAST(74 AS DOUBLE) AS x_percent, CAST(30 AS DOUBLE) AS y_percent FROM events
UNION ALL SELECT event_id, 4, 0, 'total', 10.25, 90.0 FROM events""")
def _(t):
    raw = F.concat(F.lit("# head\n"), (F.col("user_id") % 12).cast("string"), F.lit("| "), F.col("user_id").cast("string"), F.lit(".5 |74|30\nbad|1|2|3\n1|2|3\n 0 |total|10.25|90|extra"))
    return PA.parse_cover_marks(t.events.select("event_id", raw.alias("raw")), "raw")


# The operator's rule spelled out: word characters, white space and line ends of Unicode, English and Hindi labels; no text has no label.
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
_LABEL = (rf"(?i)(?:(?:\A|[^{_WORD}])(?:que(?:stion)?|q|प्रश्न){_SPACE}[:.\-]?{_SPACE}[0-9]{{1,3}}(?:[^{_WORD}]|\z)"
          rf"|(?:\A|[\n\r\x{{85}}\x{{2028}}\x{{2029}}]){_SPACE}\([0-9]{{1,3}}\){_SPACE}[:.\-])")


@query("c26_question_number", rf"""
SELECT doc_id, CASE WHEN n BETWEEN 1 AND 500 THEN n END AS n FROM (SELECT doc_id, TRY_CAST(regexp_extract(regexp_extract(t, '{_LABEL}'), '([0-9]{{1,3}})', 1) AS INT) AS n FROM (
 SELECT doc_id, CASE WHEN text IS NOT NULL THEN CASE doc_id % 4 WHEN 0 THEN concat('Question: ', doc_id % 900, ' ', text) WHEN 1 THEN concat('(', doc_id % 90, '): ', text) WHEN 2 THEN concat('q', doc_id % 1000, ' ', text) ELSE text END END AS t FROM documents) x) y""")
def _(t):
    t.documents
    j = t.spark.sql("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('Question: ', doc_id % 900, ' ', text) WHEN 1 THEN concat('(', doc_id % 90, '): ', text)
      WHEN 2 THEN concat('q', doc_id % 1000, ' ', text) ELSE text END AS t FROM documents""")
    return j.select("doc_id", T.question_number("t").alias("n"))


@query("c27_page_body", r"""
SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squeezed, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 40 AS INT) END AS page FROM documents""")
def _(t):
    marked = F.concat(F.lit("=== PAGE 4 ===\n"), "text")
    block = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("P"), (F.col("doc_id") % 40).cast("string"), F.lit("-b1"))).otherwise("x1")
    return t.documents.select("doc_id", T.page_body(marked).alias("body"), T.normalize_ws("text").alias("squeezed"), T.page_from_block_id(block).alias("page"))


@query("c28_strip_p_tags", r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</p\s*>', chr(10) || chr(10), 'gi'), '<p\b[^>]*>', '', 'gi'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def _(t):
    return t.pages.select("page_id", T.strip_p_tags("html").alias("text"))


@query("c28_diagram_list", "SELECT event_id, concat(event_type, '|k') AS diagrams, CASE WHEN event_type = 'error' THEN 1200 ELSE 300 END AS words FROM events")
def _(t):
    raw = F.array(F.concat(F.lit("  "), "event_type", F.lit(" ")), F.lit("  "), F.lit(None).cast("string"), F.lit("k"))
    kind = F.when(F.col("event_type") == "error", " Essay").otherwise("standard")
    return t.events.select("event_id", F.array_join(T.diagram_list(raw), "|").alias("diagrams"), S.word_target(kind).alias("words"))


@query("pf10_normalize_items", """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CAST(1 + user_id % 30 AS INT) WHEN event_id % 7 >= 1 THEN CAST(event_id % 7 AS INT) END AS question_id, event_type <> 'error' AS is_attempted,
 CASE event_id % 6 WHEN 0 THEN 'correction' WHEN 1 THEN 'word_list' WHEN 2 THEN 'word_list' WHEN 3 THEN 'correction' ELSE 'paragraph' END AS answer_type, sp AS start_page, greatest(sp, ep) AS end_page,
 CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE least(value, 100.0) END AS start_y, CASE WHEN event_id % 4 = 0 THEN 100.0 WHEN event_id % 4 = 1 THEN 0.0 ELSE least(value, 100.0) END AS end_y, sp AS marking_page FROM (
 SELECT *, CAST(greatest(1, least(9, event_id % 12)) AS INT) AS sp, CASE WHEN event_id % 5 = 0 THEN CAST(greatest(1, least(9, event_id % 12)) AS INT) ELSE CAST(greatest(1, least(9, user_id % 12)) AS INT) END AS ep FROM events) e""")
def _(t):
    t.events
    raw = t.spark.sql("""SELECT event_id, 9 AS page_count, CAST(event_id % 7 AS STRING) AS question_id,
      CASE WHEN user_id % 3 = 0 THEN concat('Q. ', 1 + user_id % 30, ' why') ELSE 'why' END AS question, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS student_answer,
      ' General ' AS section_name, CASE event_id % 6 WHEN 0 THEN 'Short' WHEN 1 THEN 'word-list' WHEN 2 THEN 'Pairs' WHEN 3 THEN 'line' WHEN 4 THEN 'prose' ELSE 'poem' END AS answer_type,
      CAST(event_id % 12 AS STRING) AS start_page, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(user_id % 12 AS STRING) END AS end_page, CAST(NULL AS STRING) AS marking_page,
      CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(value AS STRING) END AS start_y, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'bad' ELSE CAST(value AS STRING) END AS end_y,
      CAST(NULL AS STRING) AS marking_x, CAST(NULL AS STRING) AS marking_y FROM events""")
    return PA.normalize_items(raw).select("event_id", "question_id", "is_attempted", "answer_type", "start_page", "end_page", "start_y", "end_y", "marking_page")


@query("pf11_page_type", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'WORD_LIST' WHEN 1 THEN 'DUPLICATE' WHEN 2 THEN 'UNKNOWN' END AS page_type FROM events""")
def _(t):
    t.events
    raw = t.spark.sql("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"page_type": "word list"}' WHEN 1 THEN 'It is "Page_Type": "duplicate" I think' WHEN 2 THEN '{"page_type": "poem"}' ELSE 'no idea' END AS raw FROM events""")
    return raw.select("event_id", PA.page_type_from_reply("raw").alias("page_type"))


@query("pf13_normalize_annotations", """
SELECT event_id, 0 AS annotation_index, CAST(greatest(0, least(3, user_id % 9 - 2)) AS INT) AS page_index, value AS y_position_percent, event_type AS comment, TRUE AS is_positive, 'straight' AS line_style FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 2, 0, 0.0, '', TRUE, 'straight' FROM events WHERE event_type <> 'error'""")
def _(t):
    raw = F.concat(F.lit('[{"'), F.when(F.col("event_id") % 2 == 0, "pageIndex").otherwise("page_index"), F.lit('": '), (F.col("user_id") % 9 - 2).cast("string"),
                   F.lit(', "yPositionPercent": '), F.col("value").cast("string"), F.lit(', "comment": "'), "event_type", F.lit('", "is_positive": false}, 5, {"lineStyle": "zigzag"}]'))
    j = t.events.select("event_id", F.when(F.col("event_type") == "error", 0).otherwise(4).alias("page_count"), F.try_parse_json(raw).alias("v"))
    return PA.normalize_annotations(j, "v").select("event_id", "annotation_index", "page_index", "y_position_percent", "comment", "is_positive", "line_style")


@query("pf17_repair_responses", """
SELECT event_id, 1 AS status, 'Smart OCR complete.' AS message, CASE WHEN event_id % 3 = 0 THEN CAST(1 + user_id % 5 AS INT) ELSE 1 END AS page_count, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS n_items,
 CASE event_id % 3 WHEN 0 THEN 'item missing question_id' WHEN 1 THEN 'missing data object|filled pageCount|filled items' ELSE 'root not object — wrapping|filled pageCount|filled items' END AS warnings FROM events""")
def _(t):
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit('{"data": {"pageCount": '), (1 + F.col("user_id") % 5).cast("string"), F.lit(', "items": [{"question_id": 1}, {"x": 2}]}}'))).when(kind == 1, '{"status": 1}').otherwise("[1]")
    out = PA.repair_responses(t.events.select("event_id", raw.alias("raw")), "raw")
    return out.select("event_id", "status", "message", "page_count", F.size("items").alias("n_items"), F.array_join("warnings", "|").alias("warnings"))
