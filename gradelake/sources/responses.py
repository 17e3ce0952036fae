"""Reading and writing of grading responses and remark specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.operators.grid import GRID_COLUMNS
from gradelake.schemas import GRID_VERSION, MESSAGE


def get(v: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def is_object(v: str) -> Column:
    return F.coalesce(F.expr(f"schema_of_variant({v}) LIKE 'OBJECT%'"), F.lit(False))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (doc_id, raw); the document id is the file name without its ending."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("raw"))


def inner_data(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse response text (doc_id, raw); accepts the envelope or the inner object."""
    j = raw.withColumn("_v", F.try_parse_json("raw")).withColumn("_d", get("_v", "$.data", "variant"))
    return j.withColumn("data", F.when(is_object("_d"), F.col("_d")).otherwise(F.col("_v"))).select(*keep, "doc_id", "data")


def parse_responses(raw: DataFrame, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Flatten responses into items, annotations, page_grid and quarantine tables.

    Both annotation forms are read: the cell form (page, comment_rows, anchor)
    and the percent form (page_index, range_id, cell_ids). Columns of ``raw`` named in ``keep`` go along in all tables.
    """
    d = inner_data(raw, keep)
    items = d.select(*keep, "doc_id", F.posexplode(get("data", "$.items", "array<variant>")).alias("item_index", "it"))
    good_items = items.filter(is_object("it"))
    item = good_items.select(
        *keep, "doc_id", "item_index", get("it", "$.question_id", "string").alias("question_id"), get("it", "$.question", "string").alias("question"),
        get("it", "$.student_answer", "string").alias("student_answer"), get("it", "$.is_attempted", "boolean").alias("is_attempted"),
        get("it", "$.section_name", "string").alias("section_name"), get("it", "$.max_marks", "double").alias("max_marks"),
        get("it", "$.marks_awarded", "double").alias("marks_awarded"), get("it", "$.status", "string").alias("status"),
        get("it", "$.start_page", "int").alias("start_page"), get("it", "$.end_page", "int").alias("end_page"),
        get("it", "$.start_y_position_percent", "double").alias("start_y"), get("it", "$.end_y_position_percent", "double").alias("end_y"),
        F.coalesce(get("it", "$.marking.page", "int"), get("it", "$.marking_page", "int")).alias("marking_page"),
        get("it", "$.marking_x_position_percent", "double").alias("marking_x"), get("it", "$.marking_y_position_percent", "double").alias("marking_y"),
        get("it", "$.marking_box_page", "int").alias("marking_box_page"),
        *[get("it", f"$.marking_box_{a}_percent", "double").alias(f"box_{a}") for a in ("x1", "y1", "x2", "y2")],
        get("it", "$.marking.score_range", "string").alias("score_range"), get("it", "$.marking.score_box_range", "string").alias("score_box_range"))
    anns = good_items.select(*keep, "doc_id", "item_index", F.posexplode(get("it", "$.annotations", "array<variant>")).alias("annotation_index", "a"))
    good_anns = anns.filter(is_object("a"))
    page = F.coalesce(get("a", "$.page", "int"), get("a", "$.page_index", "int") + 1, F.lit(1))
    annotation = good_anns.select(
        *keep, "doc_id", "item_index", "annotation_index", page.alias("page"), get("a", "$.comment", "string").alias("comment"),
        get("a", "$.is_positive", "boolean").alias("is_positive"), get("a", "$.comment_font_pts", "string").alias("comment_font_pts"),
        F.coalesce(get("a", "$.comment_range", "string"), get("a", "$.range_id", "string")).alias("comment_range"),
        get("a", "$.comment_rows", "array<string>").alias("comment_rows"), get("a", "$.cell_ids", "array<string>").alias("cell_ids"),
        get("a", "$.y_position_percent", "double").alias("y_position_percent"), get("a", "$.x_start_percent", "double").alias("x_start_percent"),
        get("a", "$.x_end_percent", "double").alias("x_end_percent"), get("a", "$.placement_tier", "int").alias("placement_tier"),
        F.struct(F.coalesce(get("a", "$.anchor.type", "string"), F.lit("none")).alias("type"),
                 F.coalesce(get("a", "$.anchor.rows", "array<string>"), F.when(get("a", "$.anchor.range", "string").isNotNull(),
                            F.array(get("a", "$.anchor.range", "string")))).alias("rows"),
                 get("a", "$.anchor.extra", "map<string,string>").alias("extra")).alias("anchor"),
        *[get("a", f"$.bbox.{b}", "double").alias(b) for b in ("x1_percent", "y1_percent", "x2_percent", "y2_percent")])
    metas = d.select(*keep, "doc_id", F.posexplode(get("data", "$.cellGridMeta", "array<variant>")).alias("pos", "m"))
    typed = metas.select(*keep, "doc_id", "pos", "m", get("m", "$.page", "int").alias("page"), *[
        get("m", f"$.{c}", "int" if c in ("rows", "cols") else "double").alias(c) for c in GRID_COLUMNS])
    complete = F.lit(True)
    for c in ["page", *GRID_COLUMNS]:
        complete = complete & F.col(c).isNotNull()
    bad = [items.filter(~is_object("it")).select(*keep, "doc_id", F.lit("item").alias("part"), F.col("item_index").alias("pos")),
           anns.filter(~is_object("a")).select(*keep, "doc_id", F.lit("annotation").alias("part"), F.col("annotation_index").alias("pos")),
           typed.filter(~complete).select(*keep, "doc_id", F.lit("grid").alias("part"), "pos")]
    return {"items": item, "annotations": annotation, "page_grid": typed.filter(complete).drop("pos", "m"),
            "quarantine": bad[0].unionByName(bad[1]).unionByName(bad[2])}


def read_responses(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_responses(read_texts(spark, path))


def envelopes(docs: DataFrame, items: DataFrame, page_grid: DataFrame, skipped: DataFrame, check_level: str = "Moderate") -> DataFrame:
    """One JSON response per document (doc_id, json).

    ``docs``: doc_id, page_count (documents without items still get an
    envelope); ``items``: doc_id, question_id and a struct ``item``. A response
    holds the items of one booklet, which is what makes its size bounded.
    """
    it = items.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("question_id", F.to_json("item").alias("j")))), lambda x: x["j"]).alias("items"))
    meta = page_grid.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", *GRID_COLUMNS, F.lit(GRID_VERSION).alias("grid_version")))).alias("cellGridMeta"))
    skip = skipped.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("skippedPages"))
    j = docs.join(it, "doc_id", "left").join(meta, "doc_id", "left").join(skip, "doc_id", "left")
    none = F.array().cast("array<int>")
    head = F.to_json(F.struct(F.col("page_count").alias("pageCount"), F.coalesce("skippedPages", none).alias("skippedPages"), "cellGridMeta",
                              F.lit(check_level).alias("checkLevel")))
    body = F.concat(F.lit('"items":['), F.coalesce(F.array_join("items", ","), F.lit("")), F.lit("]"))
    data = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(","), body, F.lit("}"))
    return j.select("doc_id", F.concat(F.lit(f'{{"status":1,"message":"{MESSAGE}","data":'), data, F.lit("}")).alias("json"))


def write_responses(envelope: DataFrame, path: str, buckets: int = 64) -> None:
    """Write envelopes as JSON lines, in folders by document bucket."""
    (envelope.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).select("bucket", F.col("json").alias("value"))
     .write.mode("overwrite").partitionBy("bucket").text(path))


def grid_payload(page_grid: DataFrame, runs: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Page grids with the optional parts asked for; parts not given are never computed."""
    out = page_grid
    for part, name in ((runs, "writable_runs"), (regions, "writable_regions")):
        if part is not None:
            packed = part.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(
                F.struct(*[c for c in ("region_no", "row", "start_col", "range_id", "cell_count") if c in part.columns]))).alias(name))
            out = out.join(packed, ["doc_id", "page"], "left")
    return out


def grid_response(page_grid: DataFrame, runs: DataFrame, regions: DataFrame, cells: DataFrame,
                  include_runs: bool = True, include_regions: bool = True, include_cells: bool = False) -> DataFrame:
    """Page grids with every field of their runs, regions and cells, for readers that need them in one reply.

    A part whose flag is off is neither computed nor named in the result. A page without any has an empty array. Runs go by row and column, regions by
    number and cells by row and column; arrays are bounded by the page grid.
    """
    out = page_grid.select("doc_id", "page", *GRID_COLUMNS)
    for wanted, part, name, order in ((include_runs, runs, "writable_runs", ["row", "start_col"]), (include_regions, regions, "writable_regions", ["region_no"]),
                                      (include_cells, cells, "cells", ["row", "col"])):
        if wanted:
            fields = [c for c in part.columns if c not in ("doc_id", "page", *order)]
            packed = part.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias(name)).hint("merge")
            out = out.join(packed, ["doc_id", "page"], "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))
    return out


def layout_payload(page_grid: DataFrame, runs: DataFrame, regions: DataFrame, max_chars: int = 16000) -> DataFrame:
    """Compact JSON per page; documents over the budget drop their runs and keep regions only.

    Lengths follow ", " and ": " separators, and the brackets around the page list count.
    """
    def tokens(df: DataFrame, order: list[str], name: str) -> DataFrame:
        q = F.concat(F.lit('"'), F.col("range_id"), F.lit('"'))
        return df.groupBy("doc_id", "page").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, q.alias("t")))), lambda x: x["t"]), ", ").alias(name))

    j = page_grid.select("doc_id", "page", "rows", "cols").join(tokens(runs, ["row", "start_col"], "rt"), ["doc_id", "page"], "left").join(
        tokens(regions, ["region_no"], "gt"), ["doc_id", "page"], "left")
    head = F.format_string('{"page": %d, "rows": %d, "cols": %d', "page", "rows", "cols")
    tail = F.concat(F.lit(', "regions": ['), F.coalesce("gt", F.lit("")), F.lit("]}"))
    full = F.concat(head, F.lit(', "writable_runs": ['), F.coalesce("rt", F.lit("")), F.lit("]"), tail)
    k = j.select("doc_id", "page", full.alias("full"), F.concat(head, tail).alias("short"))
    size = k.groupBy("doc_id").agg((F.sum(F.length("full")) + (F.count(F.lit(1)) - 1) * 2 + 2).alias("chars"))
    fits = F.col("chars") <= max_chars
    return k.join(size, "doc_id").select("doc_id", "page", fits.alias("with_runs"), F.when(fits, F.col("full")).otherwise(F.col("short")).alias("payload"))


# ---- remarks ---------------------------------------------------------------

REMARK_FIELDS = ("type severity line from_line line_start line_end x_start x_end x_pct cx cy_line from_x text remark remark_zone zone").split()


def parse_remark_specs(raw: DataFrame) -> DataFrame:
    """Remark specs (doc_id, raw) to one row per remark; of two lists for a page the later wins."""
    from gradelake.operators.layout import page_remarks

    v = raw.withColumn("_v", F.try_parse_json("raw"))
    lists = v.select("doc_id", F.posexplode(get("_v", "$.pages", "array<variant>")).alias("list_no", "p"))
    rows = lists.select("doc_id", "list_no", get("p", "$.page", "int").alias("page"), F.posexplode_outer(get("p", "$.remarks", "array<variant>")).alias("pos", "r"))
    kept = page_remarks(rows).filter("r IS NOT NULL")
    return kept.select("doc_id", "page", "pos", *[get("r", f"$.{f}", "string").alias(f) for f in REMARK_FIELDS])


def read_remark_specs(spark: SparkSession, path: str) -> DataFrame:
    return parse_remark_specs(read_texts(spark, path))


def parse_remarks(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """Polymorphic remark lists to (key, text, category, color) rows; other shapes are rejected.

    Accepts a map of key to text or object, an array of texts or objects, or a
    JSON string of either. Keys fall back from key to id, label and position;
    texts from text to remark (to comment in arrays) to the object itself.
    """
    keep = [c for c in df.columns if c != raw]
    v = df.withColumn("_v0", F.try_parse_json(raw)).withColumn(
        "_v", F.coalesce(F.try_parse_json(get("_v0", "$", "string")), F.col("_v0"))).drop("_v0")
    kind = F.expr("schema_of_variant(_v)")
    j = v.withColumn("_kind", F.when(kind.startswith("OBJECT"), "map").when(kind.startswith("ARRAY"), "list").otherwise("bad"))

    def entries(rows: DataFrame, in_list: bool) -> DataFrame:
        shape = F.expr("schema_of_variant(_e)")
        is_text, is_obj = shape == "STRING", shape.startswith("OBJECT")
        full = F.to_json("_e")
        texts = [F.nullif(get("_e", f"$.{n}", "string"), F.lit("")) for n in (("text", "remark", "comment") if in_list else ("text", "remark"))]
        names = [F.nullif(get("_e", f"$.{n}", "string"), F.lit("")) for n in ("key", "id", "label")] if in_list else []
        key = F.when(is_text, F.col("_key")).otherwise(F.coalesce(*names, F.col("_key")))
        return rows.filter(is_text | is_obj).select(
            *keep, "_pos", key.alias("key"), F.when(is_text, get("_e", "$", "string")).otherwise(F.coalesce(*texts, full)).alias("text"),
            get("_e", "$.category", "string").alias("category"), get("_e", "$.color", "string").alias("color"))

    maps = j.filter("_kind = 'map'").select(*keep, F.posexplode(get("_v", "$", "map<string,variant>")).alias("_pos", "_key", "_e"))
    lists = j.filter("_kind = 'list'").select(*keep, F.posexplode(get("_v", "$", "array<variant>")).alias("_pos", "_e")).withColumn(
        "_key", (F.col("_pos") + 1).cast("string"))
    good = entries(maps, False).unionByName(entries(lists, True))
    return good.withColumnRenamed("_pos", "pos"), j.filter("_kind = 'bad'").select(*keep)


# ---- zones -----------------------------------------------------------------

def zones_to_pages(zones: DataFrame) -> DataFrame:
    """Zone rows to one ordered array per page with a 0-based page index."""
    z = F.struct("zone_pos", "x_start_percent", "x_end_percent", "y_start_percent", "y_end_percent", "score")
    return zones.groupBy("doc_id", (F.col("page") - 1).alias("page_index")).agg(F.array_sort(F.collect_list(z)).alias("free_zones"))


def pages_to_zones(pages: DataFrame) -> DataFrame:
    """Inverse: raw page objects (doc_id, page_index, raw JSON array) to zone rows.

    Entries without all four bounds are dropped, a missing score is 0, row and col become 0.
    """
    z = pages.select("doc_id", (F.col("page_index") + 1).alias("page"), F.posexplode(get_array("raw")).alias("_i", "_z"))
    bounds = {c: get("_z", f"$.{c}", "double") for c in ("x_start_percent", "x_end_percent", "y_start_percent", "y_end_percent")}
    typed = z.select("doc_id", "page", "_i", *[v.alias(k) for k, v in bounds.items()], F.coalesce(get("_z", "$.score", "double"), F.lit(0.0)).alias("score"))
    whole = typed.filter(" AND ".join(f"{k} IS NOT NULL" for k in bounds))
    return whole.withColumns({"row0": F.lit(0), "col0": F.lit(0), "zone_pos": F.col("_i") + 1}).drop("_i")


def get_array(raw: str) -> Column:
    return F.expr(f"try_variant_get(try_parse_json({raw}), '$', 'array<variant>')")
