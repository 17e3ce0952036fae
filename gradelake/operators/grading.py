"""Merging of grades into items and re-seeding of annotation positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.coords import round_even
from gradelake.operators.keyed import block_of, last_wins, split_rank

# Columns a grade may overwrite, and columns without meaning for a question the student never answered.
GRADING_KEYS = "max_marks marks_awarded status student_answer_summary feedback annotations answer_span marking".split()
COORDINATES = "start_page end_page marking_page start_y end_y marking_x marking_y".split()
LAST = 10**9


def attempted(items: DataFrame) -> DataFrame:
    """Items with answer text that are not flagged as unattempted."""
    return items.filter(F.coalesce("is_attempted", F.lit(True)) & (F.trim(F.coalesce("student_answer", F.lit(""))) != ""))


def inject_marking(items: DataFrame, runs: DataFrame, min_cells: int = 3) -> DataFrame:
    """Set the marking box to the longest run inside the answer's vertical span.

    Start page first, else end page; ties go to the run lower on the page, then
    row-major. Runs of a page (with percent bounds) travel as one array, bounded
    by the page grid, so the join is on the page key only.
    """
    long_runs = runs.filter(F.col("cell_count") >= min_cells).groupBy("doc_id", "page").agg(F.collect_list(F.struct(
        (-F.col("cell_count")).alias("k1"), (-F.col("y_start_percent")).alias("k2"), "row", "start_col",
        "x_start_percent", "x_end_percent", "y_start_percent", "y_end_percent")).alias("r")).hint("merge")
    first = long_runs.select("doc_id", F.col("page").alias("start_page"), F.col("r").alias("_rs"))
    second = long_runs.select("doc_id", F.col("page").alias("end_page"), F.col("r").alias("_re"))
    lo, hi = F.least("start_y", "end_y"), F.greatest("start_y", "end_y")

    def best(name: str) -> Column:
        return F.array_min(F.filter(name, lambda x: (x["y_start_percent"] <= hi) & (x["y_end_percent"] >= lo)))

    j = items.join(first, ["doc_id", "start_page"], "left").withColumn("_bs", best("_rs")).drop("_rs")
    j = j.join(second, ["doc_id", "end_page"], "left").withColumn("_be", best("_re")).drop("_re")
    run = F.coalesce("_bs", "_be")
    page = F.when(F.col("_bs").isNotNull(), F.col("start_page")).when(F.col("_be").isNotNull(), F.col("end_page"))
    k = j.withColumn("_b", run).withColumn("_p", page)
    put = {"marking_page": F.coalesce("_p", "marking_page"), "marking_box_page": F.col("_p"),
           "marking_x": round_even((F.col("_b.x_start_percent") + F.col("_b.x_end_percent")) / 2.0, 2),
           "marking_y": round_even((F.col("_b.y_start_percent") + F.col("_b.y_end_percent")) / 2.0, 2),
           "box_x1": F.col("_b.x_start_percent"), "box_y1": F.col("_b.y_start_percent"),
           "box_x2": F.col("_b.x_end_percent"), "box_y2": F.col("_b.y_end_percent")}
    for name in ("marking_x", "marking_y"):
        if name in items.columns:
            put[name] = F.coalesce(put[name], F.col(name))
    return k.withColumns(put).drop("_bs", "_be", "_b", "_p")


def merge_evaluations(items: DataFrame, evals: DataFrame, present: str = "present") -> DataFrame:
    """Full outer merge of grades into items by (doc_id, question number).

    The last grade of a question wins (``ord``). A grading column overwrites the
    item only when its key was present in the grade, which is not the same as
    not being null: ``present`` is the array of keys. Items whose id is no
    number stay unmatched and keep their id; grades without an item are appended without
    coordinates. ``sort_key`` puts missing and zero ids last.
    """
    keys = [k for k in GRADING_KEYS if k in evals.columns]
    num = evals.withColumn("_q", F.col("question_id").try_cast("int")).filter("_q IS NOT NULL")
    latest = last_wins(num, ["doc_id", "_q"], "ord")
    e = latest.select("doc_id", "_q", F.lit(True).alias("_graded"), F.col(present).alias("_p"), *[F.col(k).alias(f"e_{k}") for k in keys])
    i = items.withColumn("_q", F.col("question_id").try_cast("int")).withColumn("_item", F.lit(True))
    j = i.join(e, ["doc_id", "_q"], "full")
    teacher_only = F.col("_item").isNull()

    def merged(k: str) -> Column:
        fresh = F.col("_graded") & (F.array_contains("_p", k) | teacher_only)
        old = F.col(k) if k in items.columns else F.lit(None)
        return F.when(F.coalesce(fresh, F.lit(False)), F.col(f"e_{k}")).otherwise(old)

    status = F.lower(F.coalesce("e_status", F.lit(""))) if "status" in keys else F.lit("")
    answer = F.when(teacher_only, "").otherwise(F.col("student_answer"))
    tried = F.when(teacher_only, ~status.isin("", "unattempted")).otherwise(F.col("is_attempted"))
    rest = [c for c in items.columns if c not in {"doc_id", "question_id", "student_answer", "is_attempted", *keys}]
    # coordinates of appended rows are null already: they only exist on the item side
    return j.select(
        "doc_id", F.coalesce("question_id", F.col("_q").cast(items.schema["question_id"].dataType)).alias("question_id"), answer.alias("student_answer"), tried.alias("is_attempted"), *rest,
        *[merged(k).alias(k) for k in keys], teacher_only.alias("teacher_only"),
        F.when(F.coalesce("_q", F.lit(0)) == 0, LAST).otherwise(F.col("_q")).alias("sort_key"))


def teacher_only_rows(items: DataFrame, evals: DataFrame) -> DataFrame:
    """Grades of questions no item has, one per question."""
    return merge_evaluations(items, evals).filter("teacher_only").select("doc_id", "question_id", "is_attempted", "status")


def annotation_page_index(raw, start: str = "start_page", end: str = "end_page", marking: str = "marking_page") -> Column:
    """0-based page index of a page number that may be 0- or 1-based.

    Valid as both: on several pages the 0-based reading wins; on a single page
    the marking page decides, else a number equal to the start page is 1-based.
    Valid as neither: clamped to the answer's pages.
    """
    p = F.coalesce(F.col(raw).try_cast("int"), F.lit(0))
    s, e, m = F.col(start), F.col(end), F.col(marking)
    lo, hi = s - 1, e - 1
    zero, one = p.between(lo, hi), p.between(s, e)
    by_mark = F.when(p == m, m - 1).when(p == m - 1, p)
    single = F.coalesce(by_mark, F.when(p == s, p - 1).otherwise(p))
    inside = (
        F.when(zero & one, F.when(s < e, p).otherwise(single))
        .when(zero, p).when(one, p - 1).otherwise(F.greatest(lo, F.least(hi, p))))
    return F.when(s.isNotNull() & e.isNotNull(), inside).otherwise(F.coalesce(by_mark, p))


def reseed(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """Spread the annotations of the marking page around the marking point.

    Items where any annotation already has cells are left alone, and so are annotations of an item that isn't
    there. ``annotations``:
    doc_id, question_id, annotation_index, page_index, y_position_percent,
    x_start_percent, x_end_percent, has_cells.
    """
    keys = ["doc_id", "question_id"]
    i = items.select(*keys, "start_page", "end_page", "marking_page", "marking_x", "marking_y")
    native = annotations.filter("has_cells").select(*keys).distinct().withColumn("_native", F.lit(True))
    j = annotations.join(i, keys, "left").join(native, keys, "left").withColumn("_keep", F.col("_native").isNotNull()).drop("_native")
    j = j.withColumn("page_index", F.when(F.col("_keep"), F.col("page_index")).otherwise(annotation_page_index("page_index")))
    on_page = ~F.col("_keep") & F.col("marking_y").isNotNull() & F.coalesce(F.col("page_index") == F.col("marking_page") - 1, F.lit(False))
    # an item's annotations come from one grading reply, so the window groups are small
    y = F.coalesce(F.nullif("y_position_percent", F.lit(0.0)), F.col("marking_y"))
    w = Window.partitionBy(*keys, "_on")
    k = j.withColumn("_on", on_page).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_k", F.row_number().over(w.orderBy(y, "annotation_index")) - 1)
    mx = F.coalesce("marking_x", F.lit(50.0))
    x0 = F.greatest(F.lit(5.0), F.least(F.lit(70.0), mx - 15.0))
    x1 = F.least(F.lit(95.0), F.greatest(x0 + 5.0, mx + 15.0))
    ny = F.greatest(F.lit(6.0), F.least(F.lit(94.0), F.col("marking_y") + (F.col("_k") - (F.col("_n") - 1) / 2.0) * 16.0))

    def put(c: str, v: Column) -> Column:
        return F.when(F.col("_on"), round_even(v, 2)).otherwise(F.col(c))

    return k.withColumns({
        "y_position_percent": put("y_position_percent", ny), "x_start_percent": put("x_start_percent", x0),
        "x_end_percent": put("x_end_percent", x1)}).select(*annotations.columns)


def key_for_item(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Answer-key row for each item by question number; a leading Q in the key is ignored."""
    number = F.regexp_replace(F.trim("question_no"), r"(?i)^Q\s*", "").try_cast("int")
    q = questions.withColumn("question_id", number).filter("question_id IS NOT NULL")
    first = q.groupBy("model_id", "question_id").agg(F.min_by(F.struct("id", "title", "marks"), "pos").alias("_k"))
    return items.join(first, ["model_id", "question_id"], "left").select(
        *items.columns, F.col("_k.id").alias("key_id"), F.col("_k.title").alias("key_title"), F.col("_k.marks").alias("key_marks"))


def order_items(items: DataFrame, out: str = "n") -> DataFrame:
    """Number a document's items from 1 by sort key, then question id; numbered in bands of the sort key, so no task sorts a whole document."""
    return split_rank(items, ["doc_id"], ["sort_key", "question_id"], [block_of("sort_key", 64)], out)
