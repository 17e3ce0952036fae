"""Layout invariants of graded responses, their telemetry and the corpus report."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from gradelake.functions import coords as X
from gradelake.functions.dominance import overlap_degrees
from gradelake.functions.glyphs import comment_fits
from gradelake.operators.grid import GRID_COLUMNS, P, page_masks
from gradelake.operators.keyed import top_k
from gradelake.schemas import ANCHOR
from gradelake.sources.stages import stored

# Font bounds, default font, anchor types and what each invariant means.
FONT_MIN, FONT_MAX, FONT_DEFAULT = 14.0, 16.0, 14.0
ANCHOR_TYPES = ("ellipse", "tick", "underline", "arrow", "curly_brace", "exponent_caret", "none")
INVARIANTS = {
    "I1": "cell_id out of grid",
    "I2": "comment_range on non-writable cells",
    "I3": "anchor.range out of grid",
    "I4": "score_range outside score_box_range",
    "I5": "comment_font_pts out of [14, 16]",
    "I6": "comment overflows comment_range at chosen font",
    "I7": "two annotations overlap on same page",
    "I8": "exponent_caret missing extra.missing_word",
    "I9": "curly_brace bad extra.side",
}
ANCHOR_SCHEMA = ANCHOR


def normalize_anchor(kind, rows: Column, extra: Column) -> Column:
    """Anchor struct in the wire shape; unknown types become ``none`` without rows or extra."""
    t = F.when(X._c(kind) == "circle", "ellipse").otherwise(X._c(kind))
    known = t.isin(*ANCHOR_TYPES)
    shaped = F.struct(t.alias("type"), F.when(F.size(rows) > 0, rows).alias("rows"), F.when(F.size(extra) > 0, extra).alias("extra"))
    none = F.struct(F.lit("none").alias("type"), F.lit(None).cast("array<string>").alias("rows"),
                    F.lit(None).cast("map<string,string>").alias("extra"))
    return F.when(F.coalesce(known, F.lit(False)), shaped).otherwise(none).cast(ANCHOR_SCHEMA)


def snap_anchor(anchor: str, rows, cols) -> Column:
    """Drop anchor tokens off the grid; an anchor left without tokens becomes ``none``."""
    a = F.col(anchor)
    kept = X.valid_tokens(a["rows"], rows, cols)
    lost = a["rows"].isNotNull() & (F.size(kept) == 0)
    return F.struct(
        F.when(lost & (a["type"] != "none"), "none").otherwise(a["type"]).alias("type"),
        F.when(a["rows"].isNotNull() & ~lost, kept).alias("rows"), a["extra"].alias("extra"))


def _field(name: str):
    return lambda x: x[name]


def check_annotations(annotations: DataFrame, masks: DataFrame, shapes: tuple[str, ...] = ("range",)) -> DataFrame:
    """Join annotations to their page once and derive everything the checks need.

    ``annotations``: doc_id, item_index, annotation_index, page, comment,
    comment_font_pts, comment_range, anchor and, for shapes with 'rows',
    comment_rows. The join is on the page key; a page mask is one row.
    """
    info = masks.select(*P, *GRID_COLUMNS, "mask").withColumn("_grid", F.lit(True))
    j = annotations.join(info, P, "left")
    box = X.range_bounds("comment_range")
    has_range = F.col("comment_range").isNotNull() & (F.col("comment_range") != "")
    boxes = F.when(has_range, F.array(box))
    if "rows" in shapes:
        boxes = F.coalesce(boxes, F.when(F.size("comment_rows") > 0, F.transform("comment_rows", lambda t: X.range_bounds(t))))
    font = F.when(F.col("comment_font_pts").isNull(), FONT_DEFAULT).otherwise(
        F.coalesce(F.col("comment_font_pts").try_cast("double"), F.lit(-1.0)))
    j = j.withColumn("boxes", boxes).withColumn("font", font)
    bad = F.exists("boxes", lambda b: b.isNull())
    whole = F.struct(*[
        pick(F.transform("boxes", _field(n))).alias(n)
        for n, pick in (("r1", F.array_min), ("c1", F.array_min), ("r2", F.array_max), ("c2", F.array_max))])
    usable = F.col("_grid") & F.col("boxes").isNotNull() & ~F.col("unparsed")
    return j.withColumn("unparsed", F.coalesce(bad, F.lit(False))).withColumn("box", F.when(usable, whole))


def annotation_violations(checked: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """I1, I2, I3, I5, I6, I8 and I9, all from one pass over the checked rows. Columns named in ``keep`` go along."""
    box, rows, cols = F.col("box"), F.col("rows"), F.col("cols")
    grid = F.col("_grid").isNotNull()
    goes_on = grid & ~F.col("unparsed")
    off_grid = F.exists("boxes", lambda b: (b["r1"] < 1) | (b["r2"] > rows) | (b["c1"] < 1) | (b["c2"] > cols))

    def blocked(b: Column) -> Column:
        width = b["c2"] - b["c1"] + 1
        return F.exists(F.sequence(b["r1"], b["r2"]),
                        lambda r: F.instr(F.substr(F.element_at("mask", r), b["c1"], width), "0") > 0)

    not_free = off_grid | F.exists("boxes", blocked)
    font_bad = ~F.col("font").between(FONT_MIN, FONT_MAX)
    used_font = F.when(font_bad & (F.col("font") <= 0), FONT_DEFAULT).otherwise(X.clamp("font", FONT_MIN, FONT_MAX))
    n_rows, n_cols = box["r2"] - box["r1"] + 1, box["c2"] - box["c1"] + 1
    text = F.coalesce("comment", F.lit(""))
    overflow = (text != "") & ~comment_fits(text, used_font, n_cols, n_rows, "cell_size_pts")
    kind = F.coalesce(F.col("anchor.type"), F.lit("none"))
    anchored = goes_on & (kind != "none") & (F.size(F.coalesce("anchor.rows", F.array().cast("array<string>"))) > 0)
    extra = F.coalesce(F.col("anchor.extra"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    word, side = F.try_element_at(extra, F.lit("missing_word")), F.try_element_at(extra, F.lit("side"))
    spans = F.transform("anchor.rows", lambda t: F.struct(t.alias("t"), X.range_bounds(t).alias("b")))
    lost = F.filter("_spans", lambda s: s["b"].isNull())
    outside = F.exists("_spans", lambda s: (s["b"]["r1"] < 1) | (s["b"]["r2"] > rows) | (s["b"]["c1"] < 1) | (s["b"]["c2"] > cols))

    def record(no: int, inv: str, cond: Column, detail: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(no).alias("check_no"), F.lit(inv).alias("invariant"), detail.alias("detail")))

    size_text = F.format_string("comment of %d chars overflows %dx%d cells", F.length(text), n_rows, n_cols)
    single = F.array_compact(F.array(
        record(1, "I1", ~grid, F.concat(F.lit("no grid for page "), F.col("page").cast("string"))),
        record(2, "I5", grid & font_bad, F.concat(F.lit("font "), F.col("comment_font_pts").cast("string"))),
        record(3, "I1", grid & F.col("unparsed"), F.concat(F.lit("unparseable range "), F.coalesce("comment_range", F.lit("")))),
        record(4, "I1", box.isNotNull() & off_grid, F.concat(F.lit("off the grid: "), F.coalesce("comment_range", F.lit("")))),
        record(5, "I2", box.isNotNull() & not_free, F.concat(F.lit("not writable: "), F.coalesce("comment_range", F.lit("")))),
        record(6, "I6", box.isNotNull() & overflow, size_text),
        record(8, "I3", anchored & (F.size(lost) == 0) & outside, F.lit("anchor cells out of grid")),
        record(9, "I8", goes_on & (kind == "exponent_caret") & (F.trim(F.coalesce(word, F.lit(""))) == ""), F.lit("missing_word is empty")),
        record(10, "I9", goes_on & (kind == "curly_brace") & ~F.coalesce(side.isin("left", "right"), F.lit(False)),
               F.concat(F.lit("side is "), F.coalesce(side, F.lit("missing")))),
    ))
    per_token = F.when(anchored, F.transform(lost, lambda s: F.struct(
        F.lit(7).alias("check_no"), F.lit("I3").alias("invariant"), F.concat(F.lit("unparseable anchor "), s["t"]).alias("detail"))))
    none = F.array().cast("array<struct<check_no:int,invariant:string,detail:string>>")
    found = F.concat(single, F.coalesce(per_token, none))
    return checked.withColumn("_spans", spans).select(
        *keep, "doc_id", "page", "item_index", "annotation_index", F.explode(found).alias("_v")).select(
        *keep, "doc_id", "_v.invariant", "page", "item_index", "annotation_index", F.lit(1).cast("bigint").alias("n"), "_v.check_no", "_v.detail")


def score_violations(items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """I4: the score range leaves its box, or one of them does not parse. Columns named in ``keep`` go along."""
    given = (F.coalesce("score_range", F.lit("")) != "") & (F.coalesce("score_box_range", F.lit("")) != "")
    j = items.filter(given).withColumn("_s", X.range_bounds("score_range")).withColumn("_b", X.range_bounds("score_box_range"))
    inside = F.coalesce(X.rect_contains(F.col("_b"), F.col("_s")), F.lit(False))
    return j.filter(~inside).select(
        *keep, "doc_id", F.lit("I4").alias("invariant"), F.col("marking_page").alias("page"), "item_index",
        F.lit(None).cast("int").alias("annotation_index"), F.lit(1).cast("bigint").alias("n"), F.lit(0).alias("check_no"),
        F.concat(F.col("score_range"), F.lit(" not inside "), F.col("score_box_range")).alias("detail"))


def overlap_boxes(rects: DataFrame) -> DataFrame:
    """(doc_id, page, r1, c1, r2, c2, n, overlaps): the different boxes of a page, how often each occurs, and how many other boxes it meets.

    ``rects``: doc_id, page, box; rows without a box are left out. Equal boxes become one row in the map tasks, so many annotations at
    one place cost no more than one. The different boxes of a page go to one task, sorted; it reads them as a stream, counts
    a batch of pages at once by a tree over ranked coordinates, and holds no list of pairs. Ranges off the grid count like all others.
    """
    b = F.col("box")
    sides = ["r1", "c1", "r2", "c2"]
    different = rects.filter(b.isNotNull()).groupBy(*P, *[b[x].cast("long").alias(x) for x in sides]).agg(F.count(F.lit(1)).alias("n"))
    schema = StructType([*different.schema.fields, StructField("overlaps", LongType())])
    arrow = to_arrow_schema(schema)

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            found = overlap_degrees(_codes(t), *[t[x].to_numpy() for x in ("r1", "r2", "c1", "c2", "n")])
            yield from t.append_column("overlaps", pa.array(found)).cast(arrow).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            codes = _codes(pa.Table.from_batches([batch]))
            last = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if len(codes) and (codes != codes[-1]).any() else 0
            if last:  # the batch's last page may go on in the next one
                yield from counted([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
            elif held and [held[-1].column(c)[-1] for c in (0, 1)] != [batch.column(c)[0] for c in (0, 1)]:
                yield from counted(held)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from counted(held)

    return different.repartition(*P).sortWithinPartitions(*P).mapInArrow(run, schema)


def _codes(t: pa.Table) -> np.ndarray:
    """A number for each page of a table of (doc_id, page, ...)."""
    doc, page = (np.asarray(t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices, dtype=np.int64) for c in P)
    return doc * (page.max(initial=0) + 1) + page


def overlap_counts(rects: DataFrame) -> DataFrame:
    """Exact number of overlapping pairs per page, without listing pairs."""
    return overlap_boxes(rects).groupBy(*P).agg(F.expr("sum(n * overlaps) div 2").alias("n")).filter("n > 0")


def annotation_overlaps(rects: DataFrame) -> DataFrame:
    """Every row of ``rects`` (doc_id, page, box, and columns that name it) with ``overlaps``, the number of other boxes of its page that it meets.

    Rows without a box have none. The output is as long as the input, however many pairs there are. The counts come back by (page, box), which spreads
    a crowded page over as many keys as it has different boxes. The rows are read twice, so they are stored: boxes are mostly parsed from text.
    """
    rects = stored(rects, "rects")
    found = overlap_boxes(rects)
    key = [F.col("_f.doc_id").eqNullSafe(F.col("doc_id")), F.col("_f.page").eqNullSafe(F.col("page"))]
    side = [F.col(f"_f.{x}") == F.col(f"box.{x}") for x in ("r1", "c1", "r2", "c2")]
    one = found.select(F.struct("doc_id", "page", "r1", "c1", "r2", "c2").alias("_f"), "overlaps")
    return rects.join(one, reduce(lambda x, y: x & y, key + side), "left").select(*rects.columns, F.coalesce("overlaps", F.lit(0)).cast("long").alias("overlaps"))


def colliding_annotations(checked: DataFrame) -> DataFrame:
    """I7 by annotation: those of ``check_annotations`` whose comment meets others on its page, and how many."""
    rects = checked.select(*P, "item_index", "annotation_index", "comment_range", "box")
    return annotation_overlaps(rects).filter("overlaps > 0").drop("box")


def overlap_pairs(rects: DataFrame, limit: int = 200) -> DataFrame:
    """The first ``limit`` overlapping pairs per page in (first, second) order.

    ``rects``: doc_id, page, pos (order on the page), box inside the grid. Of the
    boxes over one cell only the first limit + 1 can take part in such a pair,
    so the cell lists are cut there before pairing; the result is exact.
    """
    b = F.col("box")
    cell = F.explode(F.flatten(F.transform(
        F.sequence(b["r1"], b["r2"]),
        lambda r: F.transform(F.sequence(b["c1"], b["c2"]), lambda c: F.struct(r.alias("r"), c.alias("c"))))))
    spread = rects.filter(b.isNotNull()).select(*P, "pos", "box", cell.alias("cell"))
    early = top_k(spread, [*P, "cell"], [F.col("pos")], limit + 1, "_k").drop("_k")
    # Spark expects one cell a box here; merged, since the cells of all boxes fit no single machine
    other = early.select(*P, "cell", F.col("pos").alias("pos2"), F.col("box").alias("box2")).hint("merge")
    joined = early.join(other, [*P, "cell"]).filter("pos < pos2")
    # each overlapping pair is kept once, at the top-left cell of its intersection
    corner = (F.col("cell.r") == F.greatest("box.r1", "box2.r1")) & (F.col("cell.c") == F.greatest("box.c1", "box2.c1"))
    return top_k(joined.filter(corner), P, [F.col("pos"), F.col("pos2")], limit, "pair_no").select(*P, "pos", "pos2", "pair_no")


def validate_layout(items: DataFrame, annotations: DataFrame, page_grid: DataFrame, cells: DataFrame,
                    shapes: tuple[str, ...] = ("range",)) -> DataFrame:
    """All violations of I1..I9; ``n`` is 1, except I7 which has one row per page with its pair count."""
    return mask_violations(items, annotations, page_masks(cells, page_grid), shapes)


def mask_violations(items: DataFrame, annotations: DataFrame, masks: DataFrame, shapes: tuple[str, ...] = ("range",)) -> DataFrame:
    """``validate_layout`` on page masks that are there already."""
    checked = check_annotations(annotations, masks, shapes)
    crossing = overlap_counts(checked.select(*P, "box")).select(
        "doc_id", F.lit("I7").alias("invariant"), "page", F.lit(None).cast("int").alias("item_index"),
        F.lit(None).cast("int").alias("annotation_index"), "n", F.lit(11).alias("check_no"), F.lit("comment ranges overlap").alias("detail"))
    return annotation_violations(checked).unionByName(score_violations(items)).unionByName(crossing)


def telemetry(violations: DataFrame, items: DataFrame, annotations: DataFrame) -> DataFrame:
    """Counts per invariant, totals and violation rate (4 places) per document."""
    per_inv = [F.coalesce(F.sum(F.when(F.col("invariant") == i, F.col("n"))), F.lit(0)).alias(i.lower()) for i in INVARIANTS]
    v = violations.groupBy("doc_id").agg(*per_inv, F.sum("n").alias("violations"))
    docs = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items_total"))
    anns = annotations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("annotations_total"))
    j = docs.join(anns, "doc_id", "full").join(v, "doc_id", "left")
    zero = {c: 0 for c in ["items_total", "annotations_total", "violations", *[i.lower() for i in INVARIANTS]]}
    filled = j.fillna(zero)
    rate = F.when(F.col("annotations_total") > 0, X.round_even(F.col("violations") / F.col("annotations_total"), 4)).otherwise(0.0)
    return filled.withColumn("violation_rate", rate)


def violation_samples(violations: DataFrame, per_doc: int = 200) -> DataFrame:
    """The first records of each document in checking order."""
    order = [F.col("check_no") == 11, F.col("item_index"), F.col("annotation_index").asc_nulls_first(), F.col("check_no"), F.col("page"), F.col("detail")]
    return top_k(violations, ["doc_id"], order, per_doc, "sample_no")


def corpus_report(violations: DataFrame, annotations: DataFrame) -> DataFrame:
    """Counts per document and invariant, per invariant, and over everything.

    ``pct`` relates to the document's own annotations, else to all; ``passes`` is the promotion gate (under 5 %).
    The overall row is there whatever was found, also for a corpus without violations or annotations.

    Violations and annotations are summed by (document, invariant) once; annotations have no invariant. The three levels are one rollup
    over these sums, told apart by ``grouping_id``.
    """
    long = F.lit(0).cast("long")
    facts = violations.select("doc_id", "invariant", F.col("n").cast("long").alias("n"), long.alias("a")).unionByName(
        annotations.select("doc_id", F.lit(None).cast("string").alias("invariant"), long.alias("n"), (long + 1).alias("a")))
    each = facts.groupBy("doc_id", "invariant").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    own = each.withColumn("own", F.sum("a").over(Window.partitionBy("doc_id")))  # a row per invariant and document
    levels = own.filter("invariant IS NOT NULL").rollup("invariant", "doc_id").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), F.max("own").alias("own")).filter("level < 3")
    total = each.agg(F.coalesce(F.sum("n"), long).alias("n"), F.coalesce(F.sum("a"), long).alias("every"))
    overall = total.select(F.lit(None).cast("string").alias("invariant"), F.lit(None).cast(annotations.schema["doc_id"].dataType).alias("doc_id"),
                           F.lit(3).cast("long").alias("level"), "n", F.lit(None).cast("long").alias("own"), "every")
    # one row: its size is fixed, so broadcasting it is safe
    every = F.broadcast(total.select(F.lit(1).alias("k"), "every"))
    both = levels.withColumn("k", F.lit(1)).join(every, "k").drop("k").unionByName(overall)
    pct = 100.0 * F.col("n") / F.greatest(F.lit(1), F.when(F.col("level") == 0, F.col("own")).otherwise(F.col("every")))
    return both.select(F.when(F.col("level") == 0, "document").when(F.col("level") == 1, "invariant").otherwise("overall").alias("level"), "invariant", "doc_id",
                       "n", X.round_even(pct, 4).alias("pct"), F.when(F.col("level") == 3, pct < 5.0).alias("passes"))


def document_reports(violations: DataFrame, items: DataFrame, annotations: DataFrame, samples: int = 5) -> DataFrame:
    """One row per document: the totals of ``telemetry``, counts by invariant found, and the first ``samples`` violations in checking order.

    ``violations`` is read twice, so hand over a stored table (``stages.stored``). The samples are cut to ``samples`` rows per document before the
    shuffle, and only those are gathered. Documents without violations have an empty map and no samples.
    """
    first = violation_samples(violations, samples).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "sample_no", "invariant", "page", "item_index", "annotation_index", "n", "detail"))).alias("violations_sample"))
    t = telemetry(violations, items, annotations)
    counts = F.map_filter(F.map_from_arrays(F.array(*[F.lit(i) for i in INVARIANTS]), F.array(*[F.col(i.lower()) for i in INVARIANTS])), lambda k, v: v > 0)
    none = F.array().cast(first.schema["violations_sample"].dataType)
    return t.join(first, "doc_id", "left").select("doc_id", "items_total", "annotations_total", counts.alias("counts"), "violation_rate",
                                                  F.coalesce("violations_sample", none).alias("violations_sample"))


# ---- wire shape -----------------------------------------------------------

def answer_span(items: DataFrame, page_grid: DataFrame) -> DataFrame:
    """Top and bottom cell per answer page, from page and percent positions.

    An end position of 0 or null counts as 100 and a null start as 0.
    """
    keys = ["doc_id", "question_id"]
    page = F.explode(F.sequence("start_page", "end_page"))
    spread = items.filter("start_page <= end_page").select(*keys, "start_page", "end_page", "start_y", "end_y", page.alias("page"))
    j = spread.join(page_grid.select(*P, *GRID_COLUMNS), P)
    end_y = F.when(F.coalesce("end_y", F.lit(0.0)) == 0.0, 100.0).otherwise(F.col("end_y"))
    top = F.when(F.col("page") == F.col("start_page"), F.coalesce("start_y", F.lit(0.0))).otherwise(0.0)
    bottom = F.when(F.col("page") == F.col("end_page"), end_y).otherwise(100.0)
    return j.select(*keys, "page", X.cell_at_y(top, "top").alias("top_cell"), X.cell_at_y(bottom, "bottom").alias("bottom_cell"))


def marking_block(items: DataFrame, page_grid: DataFrame) -> DataFrame:
    """Score cell and score box ranges from percent positions.

    ``items``: doc_id, question_id, marking_page, marking_x, marking_y,
    marking_box_page, box_x1, box_y1, box_x2, box_y2. No grid, no block.
    """
    grid = page_grid.select(*P, *GRID_COLUMNS)
    spot = items.withColumn("page", F.col("marking_page")).join(grid, P).select(
        "doc_id", "question_id", F.col("marking_page").alias("page"), X.percent_to_cell("marking_x", "marking_y").alias("score_range"))
    box = items.filter("marking_box_page IS NOT NULL").withColumn("page", F.col("marking_box_page")).join(grid, P).select(
        "doc_id", "question_id",
        X.range_id(X.percent_to_cell("box_x1", "box_y1"), X.percent_to_cell("box_x2", "box_y2")).alias("score_box_range"))
    return spot.join(box, ["doc_id", "question_id"], "left")


def comment_rows(annotations: DataFrame, page_grid: DataFrame) -> DataFrame:
    """Row tokens of each comment: given rows, else from range_id, else from cell_ids.

    Tokens without any in-grid cell are dropped; without a grid given rows stay as they are.
    """
    j = annotations.join(page_grid.select(*P, "rows", "cols"), P, "left")
    ids = F.transform("cell_ids", lambda c: F.struct(X.cell_row(c).alias("r"), X.cell_col(c).alias("c")))
    whole = F.struct(*[pick(F.transform("_ids", _field(n))).alias(a) for a, n, pick in (
        ("r1", "r", F.array_min), ("c1", "c", F.array_min), ("r2", "r", F.array_max), ("c2", "c", F.array_max))])
    from_ids = F.when((F.size("_ids") > 0) & ~F.exists("_ids", lambda x: x["r"].isNull() | x["c"].isNull()), whole)
    k = j.withColumn("_ids", ids).withColumn("_b", F.coalesce(X.range_bounds("range_id"), from_ids))
    # rows beyond the grid hold no in-grid cell, so only grid rows are spelled out
    lo, hi = F.greatest(F.col("_b.r1"), F.lit(1)), F.least(F.col("_b.r2"), F.col("rows"))
    legacy = F.when(lo <= hi, X.rect_rows(lo, F.col("_b.c1"), hi, F.col("_b.c2")))
    kept = F.when(F.col("rows").isNull(), F.col("comment_rows")).otherwise(X.valid_tokens("comment_rows", "rows", "cols"))
    rows = F.when(F.size("comment_rows") > 0, kept).otherwise(X.valid_tokens(legacy, "rows", "cols"))
    return k.withColumn("comment_rows", F.when(F.size(rows) > 0, rows)).select(*annotations.columns)


def response_items(items: DataFrame, annotations: DataFrame, page_grid: DataFrame) -> DataFrame:
    """One row per item with nested answer_span, marking and annotations arrays."""
    keys = ["doc_id", "question_id"]
    spans = answer_span(items, page_grid).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("page", "top_cell", "bottom_cell"))).alias("answer_span"))
    marks = marking_block(items, page_grid).select(*keys, F.struct("page", "score_range", "score_box_range").alias("marking"))
    shaped = comment_rows(annotations, page_grid).select(
        *keys, F.struct("annotation_index", "page", F.coalesce("comment", F.lit("")).alias("comment"),
                        F.coalesce("comment_font_pts", F.lit(FONT_DEFAULT)).alias("comment_font_pts"), "comment_rows").alias("a"))
    anns = shaped.groupBy(*keys).agg(F.array_sort(F.collect_list("a")).alias("annotations"))
    return items.join(spans, keys, "left").join(marks, keys, "left").join(anns, keys, "left")


def adapt_percent_items(items: DataFrame, page_grid: DataFrame) -> DataFrame:
    """Percent-form items in the cell form: adds score_range and score_box_range."""
    return items.join(marking_block(items, page_grid).select("doc_id", "question_id", "score_range", "score_box_range"),
                      ["doc_id", "question_id"], "left")


def adapt_percent_annotations(annotations: DataFrame) -> DataFrame:
    """Percent-form annotations in the cell form: 1-based page, font 14, no anchor."""
    font = F.coalesce(F.nullif(F.col("comment_font_pts").try_cast("double"), F.lit(0.0)), F.lit(FONT_DEFAULT))
    empty = F.lit(None).cast("array<string>")
    return annotations.select(
        "doc_id", "item_index", "annotation_index", F.coalesce(F.col("page_index").try_cast("int") + 1, F.lit(1)).alias("page"),
        F.coalesce("comment", F.lit("")).alias("comment"), font.alias("comment_font_pts"),
        F.nullif("range_id", F.lit("")).alias("comment_range"),
        normalize_anchor(F.lit("none"), empty, F.lit(None).cast("map<string,string>")).alias("anchor"))
