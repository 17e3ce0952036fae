"""Page text and block assembly: duplicates, answers, ids, coverage, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions import coords as X
from gradelake.functions.similarity import at_least_similar
from gradelake.functions.text import expected_questions as expected_in_text
from gradelake.functions.text import normalize_ws, page_body, page_from_block_id
from gradelake.operators.grid import GRID_COLUMNS, P
from gradelake.operators.keyed import block_of, first_wins, null_safe_join, split_rank

# Fixed value: the usual page limit of a scanned booklet, for callers that want one.
BOOKLET_PAGES = 30
PAGE_BLOCK = 512


def page_chains(ocr_pages: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Per page: is it a reset point (not similar to the previous page), with its neighbour's text.

    The previous page is found by an equi join on page - 1, not by a window over
    the document, so one very long document spreads over many tasks.
    """
    body = normalize_ws(page_body("text"))
    cur = ocr_pages.select(*P, "page_type", body.alias("body"), F.contains(page_body("text"), F.lit("[OMITTED:")).alias("marked"))
    prev = cur.select("doc_id", (F.col("page") + 1).alias("page"), F.col("body").alias("p_body"), F.col("marked").alias("p_marked"))
    j = cur.join(prev, P, "left")
    # the cheap bound 2 * min / (la + lb) decides most pairs before the exact ratio is computed
    return j.withColumn("similar", at_least_similar("body", "p_body", threshold))


def dedup_pages(ocr_pages: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Flag pages to omit: classified duplicates, and near copies of a page that was kept.

    In a chain of copies every second page survives. A chain restarts at each
    page that is not similar to the one before or is classified a duplicate, so
    inside a chain the outcome alternates from the restart.
    """
    chain = page_chains(ocr_pages, threshold)
    dup = (F.col("page_type") == "DUPLICATE") & (F.col("page") > 1)
    # pages already marked as omitted stay as they are and count as omitted for the next page
    fixed = dup | F.col("marked") | ~F.coalesce("similar", F.lit(False)) | (F.col("page") == 1) | F.coalesce("p_marked", F.lit(False))
    start_omitted = dup | F.col("marked")
    cut = chain.withColumn("restart", fixed).withColumn("gone", start_omitted)
    # last restart at or before each page: blocks of pages first, then block totals
    here = F.when(F.col("restart"), F.struct(F.col("page").alias("at"), F.col("gone").alias("gone")))
    blocked = cut.withColumn("_blk", block_of("page", PAGE_BLOCK)).withColumn("_r", here)
    inner = Window.partitionBy("doc_id", "_blk").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("_last", F.last("_r", ignorenulls=True).over(inner))
    ends = blocked.groupBy("doc_id", "_blk").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("page"))).alias("_end"))
    outer = Window.partitionBy("doc_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("doc_id", "_blk", F.last("_end", ignorenulls=True).over(outer).alias("_carry"))
    j = null_safe_join(local, carried, ["doc_id", "_blk"], "left")
    start = F.coalesce("_last", "_carry")
    odd = (F.col("page") - start["at"]) % 2 == 1
    omitted = F.when(odd, ~start["gone"]).otherwise(start["gone"])
    reason = (
        F.when(dup, "classified_duplicate").when(~omitted | F.col("marked"), None).otherwise("near_duplicate"))
    return j.select(*P, "page_type", omitted.alias("omitted"), reason.alias("reason"))


def dedup_summary(ocr_pages: DataFrame, flags: DataFrame) -> DataFrame:
    """Kept flag and characters before and after, per page."""
    n = F.length("text")
    return ocr_pages.join(flags.select(*P, "omitted", "reason"), P).select(
        *P, (~F.col("omitted")).alias("kept"), "page_type", n.alias("orig_chars"),
        F.when(F.col("reason").isNull(), n).otherwise(0).alias("after_chars"))


def drop_covers(blocks: DataFrame, ocr_pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of pages that are not covers, and the cover pages."""
    covers = ocr_pages.filter("page_type = 'COVER'").select(*P).distinct()
    return blocks.join(covers, P, "left_anti"), covers


def skipped_pages(docs: DataFrame, items: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """Pages without structured answer content, plus cover pages.

    Items without a section name do not count. Pages are numbers 1..page_count.
    """
    named = items.filter(F.trim(F.coalesce("section_name", F.lit(""))) != "").join(docs, "doc_id")
    end = F.greatest("start_page", F.coalesce("end_page", "start_page"))

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(1), F.least(c, F.col("page_count")))

    covered = named.select("doc_id", F.explode(F.sequence(clamp(F.col("start_page")), clamp(end))).alias("page")).distinct()
    every = docs.filter("page_count >= 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    gaps = every.join(covered, P, "left_anti")
    return gaps.unionByName(covers.select(*P)).distinct() if covers is not None else gaps


def fill_question_ids(items: DataFrame) -> DataFrame:
    """Give items without question_id the smallest unused numbers, in page order.

    ``items`` needs doc_id, question_id, start_page, start_y and pos. The k-th
    free number follows from ranks alone: an id u with i smaller or equal ids in
    use leaves u - i free numbers before it, so ranking free slots and used ids
    together by that value yields the number itself. No id list is collected.
    """
    order = ["start_page", "start_y", "pos"]
    slots = split_rank(items.filter("question_id IS NULL"), ["doc_id"], order,
                       [F.col("start_page"), F.floor(F.col("start_y") * 10.0)], "_k")
    used = items.filter("question_id >= 1").select("doc_id", "question_id").distinct()
    ranked = split_rank(used, ["doc_id"], ["question_id"], [block_of("question_id")], "_i")
    marks = slots.select("doc_id", F.col("_k").alias("_v"), F.lit(0).alias("_f"), F.col("_k").alias("_o"), "pos").unionByName(
        ranked.select("doc_id", (F.col("question_id") - F.col("_i")).cast("int").alias("_v"), F.lit(1).alias("_f"), F.col("_i").alias("_o"),
                      F.lit(None).cast(dict(items.dtypes)["pos"]).alias("pos")))
    given = split_rank(marks, ["doc_id"], ["_v", "_f", "_o"], [block_of("_v")], "_id").filter("_f = 0").select(
        "doc_id", "pos", F.col("_id").alias("_new"))
    return items.join(given, ["doc_id", "pos"], "left").withColumn("question_id", F.coalesce("question_id", "_new")).drop("_new").select(
        *items.columns)


def split_retry(items: DataFrame, halves: DataFrame, expected: DataFrame) -> DataFrame:
    """Use the second pass for documents that came back with too few questions.

    A document is retried when it has fewer than max(1, 80 % of expected) items
    and at least two pages. Of the union of both halves the first row per id
    (page, position, id order) is kept. ``expected``: doc_id, expected, page_count.
    """
    counts = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    short = expected.join(counts, "doc_id", "left").filter(
        (F.col("expected") > 0) & (F.col("page_count") >= 2)
        & (F.coalesce("_n", F.lit(0)) < F.greatest(F.lit(1), F.floor(F.col("expected") * 0.8)))).select("doc_id")
    order = F.struct("start_page", "start_y", F.coalesce("question_id", F.lit(999999)).alias("q"), "pos")
    again = first_wins(halves.join(short, "doc_id", "left_semi").withColumn("_o", order), ["doc_id", "question_id"], "_o").drop("_o")
    return items.join(short, "doc_id", "left_anti").unionByName(again)


def expected_questions(ocr_pages: DataFrame) -> DataFrame:
    """Largest visible question number per document; null when none is seen."""
    return ocr_pages.groupBy("doc_id").agg(F.max(expected_in_text("text")).alias("expected"))


def transcripts(ocr_pages: DataFrame, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Whole-document transcripts and rejected documents.

    A booklet with an empty page, or over ``max_pages`` where the caller sets it, is rejected before any
    text is gathered. Without a limit every whole booklet gets its transcript, which is one row by nature.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    stats = ocr_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(text == "", F.col("page"))).alias("empty_page"))
    reason = F.when(F.lit(max_pages is not None) & (F.col("n") > F.lit(max_pages)), "too_many_pages").when(F.col("empty_page").isNotNull(), "empty_page")
    judged = stats.select("doc_id", reason.alias("reason"), "empty_page")
    good = judged.filter("reason IS NULL").select("doc_id")
    part = F.struct("page", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), text).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n")
    whole = ocr_pages.join(good, "doc_id", "left_semi").groupBy("doc_id").agg(joined.alias("transcript"))
    return whole.withColumn("token_estimate", F.floor(F.length("transcript") / F.lit(4.0)).cast("int")), judged.filter("reason IS NOT NULL")


# ---- blocks to answers ----------------------------------------------------

def resolve_items(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Question and answer text, attempt flag and pages per question from block references.

    ``refs``: doc_id, question_id, ref_kind (question or answer), ref_pos,
    block_ref, is_attempted, stem. ``blocks``: doc_id, block_id, kind, text.
    A question's references come from one structure row, so its texts are few.
    """
    b = blocks.select("doc_id", F.col("block_id").alias("block_ref"), "kind", F.trim(F.coalesce("text", F.lit(""))).alias("t"))
    j = refs.join(b, ["doc_id", "block_ref"], "left")
    is_q, is_a = F.col("ref_kind") == "question", F.col("ref_kind") == "answer"
    hand = is_a & (F.col("kind") == "handwritten_answer")
    page = F.when(is_a & F.col("kind").isNotNull(), page_from_block_id("block_ref"))

    def texts(cond: Column) -> Column:
        item = F.when(cond & (F.col("t") != ""), F.struct("ref_pos", "t"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n")

    g = j.groupBy("doc_id", "question_id").agg(
        texts(is_q).alias("qt"), texts(hand).alias("student_answer"), F.max("stem").alias("stem"),
        F.bool_and(F.coalesce("is_attempted", F.lit(True))).alias("flag"), F.min(page).alias("p1"), F.max(page).alias("p2"))
    stem = F.nullif(F.trim(F.coalesce("stem", F.lit(""))), F.lit(""))
    question = F.concat_ws("\n\n", F.nullif("qt", F.lit("")), stem)
    return g.select(
        "doc_id", "question_id",
        F.when(question == "", F.concat(F.lit("Question "), F.col("question_id").cast("string"))).otherwise(question).alias("question"),
        "student_answer", ((F.col("student_answer") != "") & F.col("flag")).alias("is_attempted"),
        F.coalesce("p1", F.lit(1)).alias("start_page"), F.coalesce("p2", F.lit(1)).alias("end_page"))


def answer_spans(refs: DataFrame, tokens: DataFrame, page_grid: DataFrame) -> DataFrame:
    """Tokens of the handwritten answer blocks per question and page, in reference order.

    ``tokens``: doc_id, block_id, kind, row (token position), token.
    """
    b = tokens.filter("kind = 'handwritten_answer'").select("doc_id", F.col("block_id").alias("block_ref"), "row", "token")
    j = refs.filter("ref_kind = 'answer'").join(b, ["doc_id", "block_ref"]).withColumn("page", page_from_block_id("block_ref"))
    gridded = j.join(page_grid.select(*P), P, "left_semi")
    item = F.struct("ref_pos", "row", "token")
    return gridded.groupBy("doc_id", "question_id", "page").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["token"]).alias("rows"))


def item_marking(items: DataFrame, tokens: DataFrame, hints: DataFrame, cells: DataFrame, page_grid: DataFrame) -> DataFrame:
    """Score box and score cell per item: marking-box blocks on its pages, else the page hint.

    The score cell is the top-left writable cell of the box tokens, else the
    corner of their bounding box. ``items``: doc_id, question_id, start_page, end_page.
    """
    keys = ["doc_id", "question_id"]
    pages = items.select(*keys, "start_page", F.explode(F.array_distinct(F.array("start_page", "end_page"))).alias("page"))
    boxes = pages.join(tokens.filter("kind = 'marking_box'").select(*P, "token"), P).select(
        *keys, F.col("start_page").alias("page"), "token")
    without = items.select(*keys, "start_page", "end_page").join(boxes.select(*keys).distinct(), keys, "left_anti")
    h1 = hints.select("doc_id", F.col("page").alias("start_page"), F.col("hint").alias("h1"))
    h2 = hints.select("doc_id", F.col("page").alias("end_page"), F.col("hint").alias("h2"))
    hinted = without.join(h1, ["doc_id", "start_page"], "left").join(h2, ["doc_id", "end_page"], "left").select(
        *keys, F.when(F.col("h1").isNotNull(), F.col("start_page")).otherwise(F.col("end_page")).alias("page"),
        F.coalesce("h1", "h2").alias("token")).filter("token IS NOT NULL")
    # hints are rectangles: spell them out row by row, block tokens are single rows already
    hint_rows = hinted.withColumn("_b", X.range_bounds("token")).select(
        *keys, "page", F.explode(X.rect_rows("_b.r1", "_b.c1", "_b.r2", "_b.c2")).alias("token"))
    from gradelake.operators.cells import block_cells

    spread = block_cells(boxes.unionByName(hint_rows), page_grid, "token", [*keys, "page"])
    marked = spread.join(cells.select(*P, "row", "col", "writable"), [*P, "row", "col"], "left")
    rc = F.struct("row", "col")
    best = marked.groupBy(*keys, "page").agg(
        F.min("row").alias("r1"), F.min("col").alias("c1"), F.max("row").alias("r2"), F.max("col").alias("c2"),
        F.min(F.when(F.col("writable"), rc)).alias("w"))
    return best.select(
        *keys, "page", F.coalesce(X.cell_id("w.row", "w.col"), X.cell_id("r1", "c1")).alias("score_range"),
        X.rect_range_id("r1", "c1", "r2", "c2").alias("score_box_range"))


def item_pages(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Pages of an item: start, end and answer pages, page 1 when none is known."""
    keys = ["doc_id", "question_id"]
    ends = items.select(*keys, F.explode_outer(F.array_compact(F.array("start_page", "end_page"))).alias("page"))
    both = ends.unionByName(spans.select(*keys, "page"))
    known = both.filter("page IS NOT NULL").distinct()
    return known.unionByName(items.select(*keys).distinct().join(known, keys, "left_anti").withColumn("page", F.lit(1)))


def answer_centre(spans: DataFrame, page_grid: DataFrame) -> DataFrame:
    """Centre percent of the first answer cell per question, with a band of five percent around y.

    Without a usable token the centre is (50, 50).
    """
    keys = ["doc_id", "question_id"]
    first = first_wins(spans.select(*keys, "page", F.element_at("rows", 1).alias("token")), keys, "page")
    j = first.join(page_grid.select(*P, *GRID_COLUMNS), P, "left").withColumn("_t", X.clipped_token("token", "rows", "cols"))

    def centre(k: Column, margin: str, full: str) -> Column:
        return (F.col(margin) + (k - 0.5) * F.col("cell_size_pts")) / F.col(full) * 100.0

    x = F.coalesce(X.round_even(centre(F.col("_t.c1"), "left_margin_pts", "page_w_pts"), 2), F.lit(50.0))
    y = F.coalesce(X.round_even(centre(F.col("_t.row"), "top_margin_pts", "page_h_pts"), 2), F.lit(50.0))
    return j.select(*keys, x.alias("x"), y.alias("y"), F.greatest(F.lit(0.0), y - 5.0).alias("start_y"), F.least(F.lit(100.0), y + 5.0).alias("end_y"))
