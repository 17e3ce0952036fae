"""Small hand-written cases for rules that are easy to get wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradelake.functions import coords as X
from gradelake.functions import glyphs
from gradelake.functions import text as T
from gradelake.operators import catalog as C
from gradelake.operators import grading as GR
from gradelake.operators import grid as G
from gradelake.operators import parse as PA
from gradelake.operators import quality as Q
from gradelake.operators import zones as Z


def one(spark, column, schema, value):
    return spark.createDataFrame([value], schema).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize("rc,cell", [((1, 1), "A1"), ((1, 26), "Z1"), ((1, 27), "AA1"), ((12, 29), "AC12"), ((70, 49), "AW70"), ((0, 1), None), ((1, 0), None)])
def test_cell_ids(spark, rc, cell):
    assert one(spark, X.cell_id("r", "c"), "r int, c int", rc) == cell


@pytest.mark.parametrize("raw,start,end,marking,index", [
    (1, 1, 1, 1, 0), (0, 1, 1, 1, 0), (2, 2, 2, 2, 1), (1, 2, 2, 2, 1), (1, 1, 2, 1, 1), (2, 1, 2, None, 1), (9, 3, 4, 3, 3), (0, 3, 4, 3, 2), (4, None, None, 4, 3), (3, None, None, 4, 3), (6, None, None, 4, 6)])
def test_annotation_page_index(spark, raw, start, end, marking, index):
    col = GR.annotation_page_index("raw")
    assert one(spark, col, "raw string, start_page int, end_page int, marking_page int", (str(raw), start, end, marking)) == index


def test_reseed_two_annotations_around_the_mark(spark):
    items = spark.createDataFrame([(1, 1, 2, 2, 2, 50.0, 40.0)], "doc_id int, question_id int, start_page int, end_page int, marking_page int, marking_x double, marking_y double")
    anns = spark.createDataFrame([(1, 1, 0, 1, 70.0, 0.0, 10.0, False), (1, 1, 1, 2, 0.0, 0.0, 10.0, False)],
                                 "doc_id int, question_id int, annotation_index int, page_index int, y_position_percent double, x_start_percent double, x_end_percent double, has_cells boolean")
    rows = {r.annotation_index: r for r in GR.reseed(items, anns).collect()}
    assert [rows[1].y_position_percent, rows[0].y_position_percent] == [32.0, 48.0]  # y 0 counts as the mark itself
    assert (rows[0].x_start_percent, rows[0].x_end_percent, rows[0].page_index) == (35.0, 65.0, 1)


def test_merge_keeps_what_the_grade_did_not_mention(spark):
    items = spark.createDataFrame([(1, "1", "a", True, "old"), (1, "x", "b", True, None), (1, "0", "c", True, None)],
                                  "doc_id int, question_id string, student_answer string, is_attempted boolean, feedback string")
    evals = spark.createDataFrame([(1, "1", 1, None, "wrong", ["status"]), (1, "1", 2, None, "ok", ["status", "feedback"]), (1, "7", 1, "f", "", ["feedback"]), (1, "bad", 1, "f", "s", ["status"])],
                                  "doc_id int, question_id string, ord int, feedback string, status string, present array<string>")
    rows = GR.merge_evaluations(items, evals).orderBy("sort_key").collect()
    by_id = {r.question_id: r for r in rows}
    assert by_id["1"].status == "ok" and by_id["1"].feedback is None  # present but null overwrites
    assert by_id["7"].teacher_only and by_id["7"].is_attempted is False and by_id["7"].student_answer == ""
    assert len(rows) == 4 and rows[-1].sort_key == rows[-2].sort_key == 10**9
    assert {r.question_id for r in rows} == {"1", "x", "0", "7"}  # ids stay as they were given


def test_zone_merging(spark):
    cols = "doc_id int, page int, x_start_percent double, x_end_percent double, y_start_percent double, y_end_percent double, score double, row0 int, col0 int, zone_pos int"
    def zone(r, c, s):
        return (1, 1, c * 10.0, c * 10.0 + 10, r * 5.0, r * 5.0 + 5, s, r, c, 1)
    three = Z.merge_zones(spark.createDataFrame([zone(2, 3, 0.9), zone(2, 4, 0.8), zone(2, 5, 0.71)], cols)).collect()
    assert [(z.x_start_percent, z.x_end_percent, z.score) for z in three] == [(30.0, 60.0, 0.78)]
    gap = Z.merge_zones(spark.createDataFrame([zone(2, 3, 0.9), zone(2, 5, 0.8)], cols)).collect()
    assert len(gap) == 2
    tall = Z.merge_zones(spark.createDataFrame([zone(2, 3, 0.9), zone(3, 3, 0.8)], cols)).collect()
    assert [(z.y_start_percent, z.y_end_percent) for z in tall] == [(10.0, 20.0)]


def test_marking_run_choice(spark):
    run = "doc_id int, page int, row int, start_col int, cell_count int, x_start_percent double, x_end_percent double, y_start_percent double, y_end_percent double"
    item = spark.createDataFrame([(1, 1, 1, 1, 11.0, 17.0, 1)], "doc_id int, question_id int, start_page int, end_page int, start_y double, end_y double, marking_page int")
    def pick(rows):
        r = GR.inject_marking(item, spark.createDataFrame([(1, 1, *x) for x in rows], run)).collect()[0]
        return r.box_y1
    assert pick([(1, 1, 4, 0.0, 9.0, 10.0, 12.0), (2, 1, 5, 0.0, 9.0, 14.0, 16.0), (3, 1, 9, 0.0, 9.0, 40.0, 42.0)]) == 14.0
    assert pick([(1, 1, 5, 0.0, 9.0, 10.0, 12.0), (2, 1, 5, 0.0, 9.0, 14.0, 16.0)]) == 14.0
    assert pick([(1, 1, 2, 0.0, 9.0, 10.0, 12.0)]) is None


def clean(spark, **change):
    grid = spark.createDataFrame([(1, 2, 35, 24, 24.0, 9.5, 1.0, 595.0, 842.0)],
                                 "doc_id int, page int, rows int, cols int, cell_size_pts double, left_margin_pts double, top_margin_pts double, page_w_pts double, page_h_pts double")
    blocked = change.pop("blocked", None)
    cells = grid.select("doc_id", "page", F.explode(F.sequence(F.lit(1), F.lit(35))).alias("row")).select("*", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("col"))
    cells = cells.withColumn("writable", ~F.expr(blocked) if blocked else F.lit(True))
    a = {"page": 2, "comment": "well done", "font": 14.0, "range": "G3:K4", "type": "underline", "rows": ["B7:H7"], "extra": {}, "comment_rows": None, **change}
    anns = spark.createDataFrame([(1, 0, 0, a["page"], a["comment"], a["font"], a["range"], a["comment_rows"], (a["type"], a["rows"], a["extra"]))],
                                 f"doc_id int, item_index int, annotation_index int, page int, comment string, comment_font_pts double, comment_range string, comment_rows array<string>, anchor {Q.ANCHOR_SCHEMA}")
    if "second" in change:
        anns = anns.unionByName(anns.withColumn("annotation_index", F.lit(1)).withColumn("comment_range", F.lit(change["second"])))
    items = spark.createDataFrame([(1, 1, 0, 2, change.get("score", "C5:E6"), "B4:F7")], "doc_id int, question_id int, item_index int, marking_page int, score_range string, score_box_range string")
    shapes = ("range", "rows") if a["comment_rows"] else ("range",)
    return sorted(r.invariant for r in Q.validate_layout(items, anns, grid, cells, shapes).collect() for _ in range(r.n))


@pytest.mark.parametrize("change,fires", [
    ({}, []), ({"page": 9}, ["I1"]), ({"range": "Y3:Z4"}, ["I1", "I2"]), ({"range": "bad"}, ["I1"]), ({"blocked": "row = 3 AND col = 8"}, ["I2"]),
    ({"rows": ["B7:Z7"]}, ["I3"]), ({"rows": ["B7", "??", "!"]}, ["I3", "I3"]), ({"type": "none", "rows": ["Z99"]}, []), ({"score": "A1:B2"}, ["I4"]), ({"score": "nope"}, ["I4"]),
    ({"font": 12.0}, ["I5"]), ({"font": 17.0}, ["I5"]), ({"comment": "much " * 60}, ["I6"]), ({"comment": "x" * 60}, ["I6"]), ({"comment": ""}, []),
    ({"second": "K4:L5"}, ["I7"]), ({"second": "L5:M6"}, []), ({"type": "exponent_caret"}, ["I8"]), ({"type": "exponent_caret", "extra": {"missing_word": " "}}, ["I8"]),
    ({"type": "exponent_caret", "extra": {"missing_word": "the"}}, []), ({"type": "curly_brace"}, ["I9"]), ({"type": "curly_brace", "extra": {"side": "left"}}, []),
    ({"range": None, "comment_rows": ["G3:K3", "G4:K4"]}, []), ({"range": None, "comment_rows": ["G3:K3", "G4:Z4"]}, ["I1", "I2"])])
def test_each_invariant_fires_alone(spark, change, fires):
    assert clean(spark, **change) == fires


def test_text_helpers(spark):
    def f(col, v):
        return one(spark, col, "t string", (v,))
    assert f(T.strip_fence("t"), "x ```json\n{\"a\":1}\n``` y") == '{"a":1}'
    assert f(T.strip_fence("t"), "  plain ") == "plain"
    assert f(T.repair_json("t"), '{"a": [1, 2,], "b": "x') == '{"a": [1, 2], "b": "x"}'
    assert f(T.question_number("t"), "Que:7 why") == 7 and f(T.question_number("t"), "प्रश्न 5 क्या") == 5
    assert f(T.question_number("t"), "x\n(3): y") == 3 and f(T.question_number("t"), "Q.900") is None and f(T.question_number("t"), "none 4") is None
    assert f(T.expected_questions("t"), "Q1 a\n12) b\nउ.प्र. 14") == 14
    assert f(T.leading_int("t"), "7.9") == 7 and f(T.leading_int("t"), "True") == 0 and f(T.leading_int("t"), "about 12 marks") == 12 and f(T.leading_int("t"), None) == 0
    assert f(T.strip_p_tags("t"), "<p class='a'>x</p>\n\n<p>y</p >") == "x\n\ny"
    assert f(T.page_body("t"), "=== PAGE 3 ===\n hi ") == "hi" and f(T.page_body("t"), " hi ") == "hi"
    assert f(C.check_level("t"), "HARD") == "Hard" and f(C.check_level("t"), "x") == "" and f(C.check_level("t"), None) == "Moderate"
    assert f(PA.page_type_from_reply("t"), "nothing") is None


def test_widths_match_known_text(spark):
    # "Hello" in 1/1000 em: 722 + 556 + 222 + 222 + 556
    assert one(spark, glyphs.width_units(F.col("t")), "t string", ("Hello",)) == 2278
    assert one(spark, glyphs.width_units(F.col("t")), "t string", ("नम",)) == 2 * 650
    every = "".join(glyphs.HELVETICA_WIDTHS.values())
    assert sorted(every) == [chr(c) for c in range(32, 127)]


def test_truncated_arrays(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}, {"b": "x}'), (2, '[{"a": 1}]'), (3, "junk"), (4, '[{"a": {"c": "\\"}"}}, {"b"')], "id int, raw string")
    got = {r.id: r.repaired for r in PA.repair_truncated_array(df, "raw").collect()}
    assert got == {1: '[{"a": 1}]', 2: '[{"a": 1}]', 3: "junk", 4: '[{"a": {"c": "\\"}"}}]'}


def test_broken_replies_keep_their_annotations(spark):
    text = 'x "studentText": "hi", "annotations": [{"pageIndex": 3, "comment": "c"}, {"page_index": 9, "yPositionPercent": 4.5}, {"pageIndex": oops}] end'
    df = spark.createDataFrame([(1, text, 10, 4)], "id int, raw string, total int, page_count int")
    parsed = PA.parse_analysis(df, "raw", "total")
    rows = PA.normalize_annotations(parsed.select("id", "page_count", "annotations"), "annotations").orderBy("annotation_index").collect()
    assert [(r.page_index, r.comment, r.y_position_percent, r.is_positive) for r in rows] == [(3, "c", 0.0, True), (3, "", 4.5, True)]
    grades = '[{"question_id": 4, "status": "ok", "marks_awarded": 2.5, "annotations": [{"page_index": 1, "y_position_percent": 20.5, "x_start_percent": 3, "x_end_percent": 9, "comment": "a \\"b\\"", "is_positive": false}'
    r = PA.regex_evaluations(spark.createDataFrame([(1, grades)], "id int, raw string"), "raw").collect()[0]
    assert (r.question_id, r.status, r.marks_awarded, r.max_marks, r.start_y_position_percent) == (4, "ok", 2.5, 0, 50.0)
    assert [tuple(a) for a in r.annotations] == [(1, 20.5, 3.0, 9.0, 'a "b"', False)]


def test_export_formats(spark):
    from gradelake.operators.placement import export_placements

    full = spark.createDataFrame([("s", "k", 1, 2, 3, 4.0, 5.0, 6.0, 7.0, "t")], "session_id string, key string, page int, x int, y int, pct_x double, pct_y double, pdf_x double, pdf_y double, text string")
    assert export_placements(full).columns == full.columns
    assert export_placements(full, "minimal").columns == ["session_id", "key", "page", "x", "y", "pct_x", "pct_y"]
    assert export_placements(full, "pdf").columns == ["session_id", "key", "page", "pdf_x", "pdf_y", "text"]
    assert export_placements(full, "normalized").columns == ["session_id", "key", "page", "pct_x", "pct_y", "text"]


def test_table_shapes_parse():
    from pyspark.sql.types import StructType

    from gradelake.schemas import TABLES

    assert all(StructType.fromDDL(ddl).names for ddl in TABLES.values())


def test_flat_cells(spark):
    grid = spark.createDataFrame([(1, 1, 1, 2, 12.0, 0.0, 0.0, 24.0, 12.0)], "doc_id int, page int, rows int, cols int, cell_size_pts double, left_margin_pts double, top_margin_pts double, page_w_pts double, page_h_pts double")
    px = spark.range(0, 12).crossJoin(spark.range(0, 24).withColumnRenamed("id", "x")).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("y"), "x", F.when(F.col("x") < 12, 250).otherwise(13).cast("int").alias("value"))
    rows = {r.col: r for r in G.cell_metrics(px, grid, dpi=72.0).collect()}
    assert rows[1].writable and rows[1].score == 0.9804 and rows[1].ink_ratio == 0.0
    assert not rows[2].writable and rows[2].score == 0.051 and rows[2].ink_ratio == 1.0
