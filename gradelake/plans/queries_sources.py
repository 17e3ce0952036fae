"""Source, stage, payload, enrichment and streaming-operator queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradelake.operators import grid as G
from gradelake.operators import infer
from gradelake.operators import pages as PG
from gradelake.plans.queries_cells import _RECTS, _RUNS, RID, _regions
from gradelake.plans.registry import query
from gradelake.session import checkpoint_root
from gradelake.sources import files as FI
from gradelake.sources import manifest as MA
from gradelake.sources import responses as RE
from gradelake.sources import stages as ST
from gradelake.streaming import flows

P = ["doc_id", "page"]


def _files(t):
    """File rows made of documents: some no PDFs by name, some empty, some without the PDF header."""
    t.documents
    return t.spark.sql("""SELECT concat('in/', doc_id, CASE WHEN lang = 'de' THEN '.txt' ELSE '.PDF' END) AS path, doc_id,
      CAST(CASE WHEN source = 'web' AND n_chars < 300 THEN '' WHEN n_chars > 800 THEN concat('%PDF-1.7 ', text) ELSE text END AS BINARY) AS content FROM documents""").withColumn("length", F.length("content").cast("bigint"))


_PDF = """(SELECT doc_id, concat('in/', doc_id, CASE WHEN lang = 'de' THEN '.txt' ELSE '.PDF' END) AS path, strlen(c) AS length, CASE WHEN lang = 'de' THEN 'not_pdf' WHEN strlen(c) = 0 THEN 'empty' WHEN strlen(c) > 5000 THEN 'too_large' WHEN substr(c, 1, 4) <> '%PDF' THEN 'no_pdf_header' END AS reason
 FROM (SELECT *, CASE WHEN source = 'web' AND n_chars < 300 THEN '' WHEN n_chars > 800 THEN concat('%PDF-1.7 ', text) ELSE text END AS c FROM documents) d)"""


@query("src1_accepted_pdfs", f"SELECT doc_id, path, length FROM {_PDF} p WHERE reason IS NULL")
def _(t):
    return FI.judge_pdfs(_files(t), max_bytes=5000)[0].select("doc_id", "path", "length")


@query("src1_rejected_pdfs", f"SELECT path, length, reason FROM {_PDF} p WHERE reason IS NOT NULL")
def _(t):
    return FI.judge_pdfs(_files(t), max_bytes=5000)[1]


@query("src2_page_images", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'image/png' ELSE 'image/jpeg' END AS mime FROM events WHERE event_type <> 'error'""")
def _(t):
    head = F.when(F.col("event_type") == "signup", F.unhex(F.lit(FI.PNG_MAGIC))).when(F.col("event_type") == "error", F.unhex(F.lit(""))).otherwise(F.unhex(F.lit(FI.JPEG_MAGIC)))
    coded = t.events.select("event_id", F.base64(F.concat(head, F.when(F.col("event_type") != "error", F.encode(F.col("props"), "UTF-8")).otherwise(F.unhex(F.lit(""))))).alias("b64"))
    return FI.judge_images(FI.images_from_base64(coded, "b64"))[0].select("event_id", "mime")


_RESP = """concat(CASE WHEN page = 3 THEN '' ELSE '{"data": ' END, '{"pageCount": 10, "items": [{"question_id": ', page, ', "student_answer": "a', page_id, '", "start_page": ', page,
 ', "marking": {"page": ', page, ', "score_range": "U18"}, "annotations": [{"page_index": ', page - 1, ', "comment": "c", "range_id": "B2:C3"}, 7, {"page": ', page, ', "comment_rows": ["E6:S6"], "anchor": {"type": "tick", "range": "B7"}}]}, "bad"], "cellGridMeta": [{"page": ', page,
 ', "rows": 35, "cols": 24, "cell_size_pts": 24, "left_margin_pts": 9.5, "top_margin_pts": 1, "page_w_pts": 595, "page_h_pts": 842}, {"page": 99}]}', CASE WHEN page = 3 THEN '' ELSE '}' END)"""


def _responses(t):
    t.fx_page_grid
    return RE.parse_responses(t.spark.sql(f"SELECT page_id AS doc_id, {_RESP} AS raw FROM fx_page_grid"))


@query("src3_items", "SELECT page_id AS doc_id, 0 AS item_index, CAST(page AS VARCHAR) AS question_id, concat('a', page_id) AS student_answer, page AS start_page, page AS marking_page, 'U18' AS score_range FROM fx_page_grid")
def _(t):
    return _responses(t)["items"].select("doc_id", "item_index", "question_id", "student_answer", "start_page", "marking_page", "score_range")


@query("src3_annotations", """
SELECT page_id AS doc_id, 0 AS item_index, 0 AS annotation_index, page, 'B2:C3' AS comment_range, NULL AS comment_rows, 'none' AS anchor, NULL AS anchor_rows FROM fx_page_grid
UNION ALL SELECT page_id, 0, 2, page, NULL, 'E6:S6', 'tick', 'B7' FROM fx_page_grid""")
def _(t):
    return _responses(t)["annotations"].select("doc_id", "item_index", "annotation_index", "page", "comment_range", F.array_join("comment_rows", " ").alias("comment_rows"),
                                               F.col("anchor.type").alias("anchor"), F.array_join("anchor.rows", " ").alias("anchor_rows"))


@query("src3_page_grid_quarantine", """
SELECT page_id AS doc_id, 'grid' AS part, 1 AS pos FROM fx_page_grid UNION ALL SELECT page_id, 'item', 1 FROM fx_page_grid UNION ALL SELECT page_id, 'annotation', 1 FROM fx_page_grid""")
def _(t):
    return _responses(t)["quarantine"]


@query("src4_remark_specs", """
SELECT doc_id, page, pos, type, severity, line FROM (SELECT user_id AS doc_id, 1 AS page, 0 AS pos, 'tick' AS type, 'positive' AS severity, CAST(max(event_id) % 20 AS VARCHAR) AS line FROM events GROUP BY user_id) a
UNION ALL SELECT DISTINCT user_id, 2, 0, 'text', NULL, NULL FROM events""")
def _(t):
    # page 1 is listed twice per document: the second list replaces the first
    last = t.events.groupBy("user_id").agg(F.max("event_id").alias("m"))
    raw = F.concat(F.lit('{"pages": [{"page": 1, "remarks": [{"type": "text"}, {"type": "text"}]}, {"page": 2, "remarks": [{"type": "text"}]}, {"page": 1, "remarks": [{"type": "tick", "severity": "positive", "line": '),
                   (F.col("m") % 20).cast("string"), F.lit("}]}]}"))
    return RE.parse_remark_specs(last.select(F.col("user_id").alias("doc_id"), raw.alias("raw"))).select("doc_id", "page", "pos", "type", "severity", "line")


_POLY = """CASE event_id % 5 WHEN 0 THEN concat('{"a": "', event_type, '"}') WHEN 1 THEN concat('{"k1": {"remark": "', event_type, '", "category": "c"}}')
 WHEN 2 THEN concat('["', event_type, '", "two"]') WHEN 3 THEN concat('[{"label": "L', user_id, '", "comment": "', event_type, '"}]') ELSE '42' END"""


@query("src5_parse_remarks", """
SELECT event_id, 0 AS pos, CASE event_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'k1' WHEN 2 THEN '1' ELSE concat('L', user_id) END AS key, event_type AS text, CASE WHEN event_id % 5 = 1 THEN 'c' END AS category FROM events WHERE event_id % 5 < 4
UNION ALL SELECT event_id, 1, '2', 'two', NULL FROM events WHERE event_id % 5 = 2""")
def _(t):
    t.events
    return RE.parse_remarks(t.spark.sql(f"SELECT event_id, {_POLY} AS raw FROM events"), "raw")[0].select("event_id", "pos", "key", "text", "category")


@query("src5_rejected_remarks", "SELECT event_id FROM events WHERE event_id % 5 = 4")
def _(t):
    t.events
    return RE.parse_remarks(t.spark.sql(f"SELECT event_id, {_POLY} AS raw FROM events"), "raw")[1]


@query("src6_envelopes", """
SELECT d.doc_id, d.page_count AS n_pages, CAST((SELECT count(*) FROM fx_items i WHERE i.doc_id = d.doc_id) AS INT) AS n_items, d.page_count AS n_grids,
 coalesce((SELECT string_agg(page, ',' ORDER BY page) FROM fx_page_grid g WHERE g.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM fx_items i WHERE i.doc_id = g.doc_id AND i.section_name <> '' AND g.page BETWEEN i.start_page AND i.end_page)), '') AS skipped, 1 AS status FROM fx_docs d""")
def _(t):
    items = t.fx_items.select("doc_id", "question_id", F.struct("question_id", "student_answer", "section_name").alias("item"))
    env = RE.envelopes(t.fx_docs, items, t.fx_page_grid, PG.skipped_pages(t.fx_docs, t.fx_items))
    v = env.withColumn("v", F.try_parse_json("json"))

    def at(path: str, kind: str):
        return F.expr(f"try_variant_get(v, '{path}', '{kind}')")

    return v.select("doc_id", at("$.data.pageCount", "int").alias("n_pages"), F.size(at("$.data.items", "array<variant>")).alias("n_items"), F.size(at("$.data.cellGridMeta", "array<variant>")).alias("n_grids"),
                    F.array_join(at("$.data.skippedPages", "array<string>"), ",").alias("skipped"), at("$.status", "int").alias("status"))


@query("src7_resume", """
SELECT d.doc_id FROM fx_docs d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality IS NOT NULL AND l.toxic IS NOT NULL)""")
def _(t):
    return ST.resume(t.fx_docs.select("doc_id"), t.labels, ["quality", "toxic"])


@query("src8_compute_if_absent", """
SELECT sha256(text) AS h, CAST(min(n_chars) AS BIGINT) AS n, CASE WHEN bool_or(lang = 'en') THEN 'cached' ELSE 'fresh' END AS origin FROM documents GROUP BY 1""")
def _(t):
    src = t.documents.withColumn("h", F.sha2(F.encode("text", "UTF-8"), 256)).withColumn("cache_key", ST.content_key("text", 10.0, 300))
    cache = src.filter("lang = 'en'").dropDuplicates(["cache_key"]).select("cache_key", "h", F.col("n_chars").alias("n"), F.lit("cached").alias("origin"))
    out = ST.compute_if_absent(src, cache, lambda df: df.select("cache_key", "h", F.col("n_chars").alias("n"), F.lit("fresh").alias("origin")))
    return out.select("h", "n", "origin")


@query("src9_upgrade_schema", """
SELECT id, coalesce(booklet_type, 'standard') AS booklet_type, 2 AS intro_page FROM fx_models""")
def _(t):
    return ST.upgrade_schema(t.fx_models.drop("intro_page"), {"booklet_type": "standard", "intro_page": 2}).select("id", "booklet_type", "intro_page")


def part_table(t, name: str) -> MA.PartTable:
    return MA.PartTable(t.spark, f"{checkpoint_root(t.spark)}/parts/{name}-{uuid.uuid4().hex}")


@query("src7_run_parts", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN 1 WHEN doc_id % 5 <> 0 THEN 2 END AS made, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN 1 ELSE 2 END AS in_run FROM documents""")
def _(t):
    """Two runs over one manifest: the first does a half and leaves some incomplete, the second what is open; then all parts become one."""
    docs, table = t.documents.select("doc_id"), part_table(t, "runs")

    def stage(n: int, complete):
        return lambda open_: open_.select("doc_id", F.when(complete, n).alias("made"), F.lit(n).alias("in_run"))

    MA.run_parts(table, docs.filter("doc_id % 2 = 0"), stage(1, F.col("doc_id") % 6 != 0), ["made"])
    MA.run_parts(table, docs, stage(2, F.col("doc_id") % 5 != 0), ["made"])
    table.compact(["doc_id"])
    return table.read()


@query("src8_cached_parts", """
SELECT sha256(text) AS h, CAST(min(n_chars) AS BIGINT) AS n, CASE WHEN bool_or(lang = 'en') THEN 'first' ELSE 'second' END AS origin FROM documents GROUP BY 1""")
def _(t):
    """Contents of one language are computed by a first call and found by the second, which adds the others; a third adds nothing."""
    src = t.documents.withColumn("h", F.sha2(F.encode("text", "UTF-8"), 256)).withColumn("cache_key", ST.content_key("text", 10.0, 300))
    table = part_table(t, "cache")

    def work(call: str):
        return lambda df: df.select("cache_key", "h", F.col("n_chars").alias("n"), F.lit(call).alias("origin"))

    for call, rows in (("first", src.filter("lang = 'en'")), ("second", src)):
        MA.cached(rows, table, work(call))
    return MA.cached(src, table, work("third")).select("h", "n", "origin")


@query("src9_schema_versions", """
SELECT id, title, CASE WHEN created_seq % 3 = 0 THEN 'standard' ELSE coalesce(booklet_type, 'standard') END AS booklet_type, CASE WHEN created_seq % 3 = 2 THEN 7 ELSE 2 END AS intro_page FROM fx_models""")
def _(t):
    """Models written by three versions of the schema: without booklet type and first page, without first page, with both."""
    m, table = t.fx_models, part_table(t, "models")
    table.add(m.filter("created_seq % 3 = 0").select("id", "title"))
    table.add(m.filter("created_seq % 3 = 1").select("title", "booklet_type", "id"))
    table.add(m.filter("created_seq % 3 = 2").select("id", "title", "booklet_type", F.lit(7).alias("intro_page")))
    return table.read({"booklet_type": "standard", "intro_page": 2})


@query("u1_enrich_open", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN round_even(value * 2, 0) / 2 END AS marks, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS label, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS tries,
 CASE WHEN event_type = 'error' THEN 'ValueError: no reply' END AS error FROM events""")
def _(t):
    """Replies of a part of the events are there from an earlier run; the rest is called, four at a time per task."""
    src, table = t.events.select("event_id", "event_type", "value"), part_table(t, "replies")
    for rows in (src.filter("event_id % 3 = 0"), src):
        found = infer.enrich_open(rows, table, _grade, ["event_id"], "marks double, label string", attempts=2, in_flight=4)
    return found


@query("src10_pair_by_stem", """
SELECT concat('smart_ocr_response_', p_partkey, '.json') AS name, CAST(p_partkey AS VARCHAR) AS stem, CASE WHEN p_size % 3 = 0 THEN concat(p_partkey, '.pdf') ELSE concat('test_', p_partkey, '.pdf') END AS pdf FROM part WHERE p_size % 3 < 2""")
def _(t):
    t.part
    resp = t.part.select(F.concat(F.lit("smart_ocr_response_"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("name"))
    pdfs = t.spark.sql("""SELECT concat(p_partkey, '.pdf') AS name FROM part WHERE p_size % 3 = 0 UNION ALL SELECT concat('test_', p_partkey, '.pdf') FROM part WHERE p_size % 3 < 2""")
    return FI.pair_by_stem(resp, pdfs)


@query("src11_zones_to_pages", """
SELECT doc_id, page - 1 AS page_index, CAST(count(*) AS INT) AS n, min(col0) * 12.5::DOUBLE AS least_x FROM fx_coarse GROUP BY ALL""")
def _(t):
    z = t.fx_coarse.select(*P, (F.col("row0") * 8 + F.col("col0")).alias("zone_pos"), (F.col("col0") * 12.5).alias("x_start_percent"), (F.col("col0") * 12.5 + 12.5).alias("x_end_percent"),
                           (F.col("row0") * 5.0).alias("y_start_percent"), (F.col("row0") * 5.0 + 5).alias("y_end_percent"), "score")
    return RE.zones_to_pages(z).select("doc_id", "page_index", F.size("free_zones").alias("n"), F.array_min(F.transform("free_zones", lambda f: f["x_start_percent"])).alias("least_x"))


@query("src11_pages_to_zones", """
SELECT user_id AS doc_id, CAST(event_id AS INT) + 1 AS page, value AS x_start_percent, 0.0::DOUBLE AS score, 0 AS row0, 1 AS zone_pos FROM events""")
def _(t):
    raw = F.concat(F.lit('[{"x_start_percent": '), F.col("value").cast("string"), F.lit(', "x_end_percent": 9, "y_start_percent": 1, "y_end_percent": 2}, {"x_start_percent": 1}, 3]'))
    pages = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").cast("int").alias("page_index"), raw.alias("raw"))
    return RE.pages_to_zones(pages).select("doc_id", "page", "x_start_percent", "score", "row0", "zone_pos")


@query("pf20_grid_payload", f"""
SELECT g.doc_id, g.page, g.rows, (SELECT string_agg({RID('row', 'start_col', 'row', 'end_col')}, ' ' ORDER BY row, start_col) FROM ({_RUNS} HAVING count(*) >= 2) r WHERE r.doc_id = g.doc_id AND r.page = g.page) AS runs FROM fx_page_grid g""")
def _(t):
    out = RE.grid_payload(t.fx_page_grid.select(*P, "rows"), G.writable_runs(t.fx_cells))
    return out.select(*P, "rows", F.array_join(F.transform("writable_runs", lambda r: r["range_id"]), " ").alias("runs"))


@query("pf20_grid_response", f"""
WITH r AS (SELECT doc_id, page, string_agg(concat({RID('row', 'start_col', 'row', 'end_col')}, '=', cell_count), ' ' ORDER BY row, start_col) AS runs FROM ({_RUNS} HAVING count(*) >= 2) x GROUP BY ALL),
 g AS (SELECT doc_id, page, string_agg({RID('row_start', 'col_start', 'row_end', 'col_end')}, ' ' ORDER BY region_no) AS regions FROM {_RECTS} x GROUP BY ALL),
 c AS (SELECT doc_id, page, count(*) AS n_cells, count(*) FILTER (WHERE writable) AS n_writable, sha256(string_agg(concat(row, ':', col, ':', CASE WHEN writable THEN 1 ELSE 0 END), ' ' ORDER BY row, col)) AS cells FROM fx_cells GROUP BY ALL)
SELECT p.doc_id, p.page, p.rows, p.page_w_pts, coalesce(runs, '') AS runs, coalesce(regions, '') AS regions, n_cells, n_writable, c.cells FROM fx_page_grid p LEFT JOIN r USING (doc_id, page) LEFT JOIN g USING (doc_id, page) LEFT JOIN c USING (doc_id, page)""")
def _(t):
    out = RE.grid_response(t.fx_page_grid, G.writable_runs(t.fx_cells), _regions(t), t.fx_cells, include_cells=True)
    runs = F.transform("writable_runs", lambda r: F.concat(r["range_id"], F.lit("="), r["cell_count"]))
    cells = F.transform("cells", lambda c: F.concat_ws(":", c["row"], c["col"], c["writable"].cast("int")))
    return out.select(*P, "rows", "page_w_pts", F.array_join(runs, " ").alias("runs"), F.array_join(F.transform("writable_regions", lambda r: r["range_id"]), " ").alias("regions"),
                      F.size("cells").cast("long").alias("n_cells"), F.size(F.filter("cells", lambda c: c["writable"])).cast("long").alias("n_writable"), F.sha2(F.array_join(cells, " "), 256).alias("cells"))


@query("a13_layout_payload", f"""
WITH r AS (SELECT doc_id, page, string_agg(concat('"', {RID('row', 'start_col', 'row', 'end_col')}, '"'), ', ' ORDER BY row, start_col) AS t FROM ({_RUNS} HAVING count(*) >= 2) x GROUP BY ALL),
 g AS (SELECT doc_id, page, string_agg(concat('"', {RID('row_start', 'col_start', 'row_end', 'col_end')}, '"'), ', ' ORDER BY region_no) AS t FROM {_RECTS} x GROUP BY ALL),
 p AS (SELECT q.doc_id, q.page, concat('{{"page": ', q.page, ', "rows": 35, "cols": 24') AS head, concat(', "writable_runs": [', coalesce(r.t, ''), ']') AS runs, concat(', "regions": [', coalesce(g.t, ''), ']}}') AS tail
  FROM fx_page_grid q LEFT JOIN r ON r.doc_id = q.doc_id AND r.page = q.page LEFT JOIN g ON g.doc_id = q.doc_id AND g.page = q.page),
 s AS (SELECT doc_id, sum(length(head) + length(runs) + length(tail)) + (count(*) - 1) * 2 + 2 <= 8600 AS fits FROM p GROUP BY doc_id)
SELECT p.doc_id, p.page, s.fits AS with_runs, concat(head, CASE WHEN s.fits THEN runs ELSE '' END, tail) AS payload FROM p JOIN s ON s.doc_id = p.doc_id""")
def _(t):
    return RE.layout_payload(t.fx_page_grid, G.writable_runs(t.fx_cells), _regions(t), max_chars=8600)


def _grade(row: dict) -> dict:
    """Deterministic stand-in for a model call."""
    if row["event_type"] == "error":
        raise ValueError("no reply")
    return {"marks": round(row["value"] * 2) / 2, "label": row["event_type"].upper()}


@query("u1_enrich", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN round_even(value * 2, 0) / 2 END AS marks, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS label, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS tries,
 CASE WHEN event_type = 'error' THEN 'ValueError: no reply' END AS error FROM events""")
def _(t):
    src = t.events.select("event_id", "event_type", "value")
    return infer.enrich(src, _grade, ["event_id"], "marks double, label string", attempts=2)


@query("u15_expand_ranges_udtf", """
SELECT doc_id, page, annotation_index, unnest(generate_series(5, 19)) :: INT AS col, 8 AS row FROM fx_annotations WHERE anchor_range = 'E8:S8'""")
def _(t):
    from gradelake.functions.udtf import register

    register(t.spark)
    t.fx_annotations
    return t.spark.sql("""SELECT a.doc_id, a.page, a.annotation_index, e.col, e.row FROM fx_annotations a, LATERAL expand_ranges(array(a.anchor_range), 35, 24) e""")


@query("u15_compact_ranges", """
SELECT doc_id, page, concat('E8:S8') AS tokens FROM fx_annotations WHERE anchor_range = 'E8:S8' GROUP BY ALL""")
def _(t):
    from gradelake.operators import cells as CE

    tokens = t.fx_annotations.select(*P, F.col("anchor_range").alias("token"))
    return CE.ranges_payload(CE.compact_ranges(CE.block_cells(tokens, t.fx_page_grid, keep=P))).withColumn("tokens", F.array_join("tokens", " "))


# ---- operators of the streaming flows, on batch input -------------------------

@query("st1_accepted_responses", "SELECT event_id, ts AS received FROM events WHERE event_type <> 'error'")
def _(t):
    raw = F.when(F.col("event_type") == "error", "oops").otherwise(F.concat(F.lit('{"v": "'), "event_type", F.lit('"}')))
    j = t.events.select("event_id", F.col("ts").alias("received"), raw.alias("raw")).withColumn("_v", F.try_parse_json("raw"))
    return j.filter(RE.is_object("_v")).select("event_id", "received")


@query("st2_telemetry_windows", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, CAST(sum(CAST(floor(value / 50) AS INT)) AS BIGINT) AS violations, CAST(sum(user_id % 5) AS BIGINT) AS annotations,
 CASE WHEN sum(user_id % 5) > 0 THEN round_even(sum(CAST(floor(value / 50) AS INT)) / CAST(sum(user_id % 5) AS DOUBLE) * 10000, 0) / 10000 ELSE 0.0 END AS rate FROM events GROUP BY 1""")
def _(t):
    counts = t.events.select(F.col("ts").alias("received"), F.floor(F.col("value") / 50).cast("int").alias("violations"), (F.col("user_id") % 5).alias("annotations"))
    return flows.telemetry_windows(counts)


@query("st3_latest_actions", "SELECT session_id, key, max(ord) AS ord, arg_max(action, ord) AS action, arg_max(page, ord) AS page FROM fx_placements GROUP BY 1, 2")
def _(t):
    log = t.fx_placements
    return flows.merge_placements(log.filter("action = 'place'"), log.filter("action = 'remove'")).select("session_id", "key", "ord", "action", "page")


@query("st4_unique_content", "SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def _(t):
    return flows.stream_dedup(t.documents.select(F.encode("text", "UTF-8").alias("content"))).select("sha256")


@query("t23_stage_status", """
SELECT doc_id, CASE WHEN item_count > 0 THEN 'ok' ELSE 'error' END AS status, item_count * 3 AS elapsed_ms FROM (SELECT d.doc_id, (SELECT count(*) FROM fx_items i WHERE i.doc_id = d.doc_id) AS item_count FROM fx_docs d) x""")
def _(t):
    n = t.fx_docs.join(t.fx_items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")), "doc_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return ST.stage_status(n, F.col("k") > 0, F.col("k") * 3)


@query("flow_grade_report")
def _(t):
    """The main flow end to end: cells, marking boxes, placement, wire shape, invariants, telemetry per document."""
    from gradelake.plans import flow

    return flow.grade_and_check(t.fx_items, t.fx_evaluations.withColumn("present", F.split("present", ",")), t.fx_annotations, t.fx_cells, t.fx_page_grid)


