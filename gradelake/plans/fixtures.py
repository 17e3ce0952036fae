"""Grading tables derived in SQL from the star-schema test tables.

Each view is one statement written once for two dialects: Spark runs it over
temp views, and the oracle gets the same text as common table expressions. The
only placeholder is ``@seq(name, lo, hi)``, which pairs every row with the whole
numbers lo..hi. All views read whole tables, so they grow with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {}

# Pages of answer books: ten pages per book, 35 rows by 24 columns of 24 pt cells.
VIEWS["fx_page_grid"] = """
SELECT page_id, CAST(floor(page_id / 10.0) AS BIGINT) AS doc_id, CAST(page_id % 10 AS INT) + 1 AS page,
 35 AS rows, 24 AS cols, CAST(24.0 AS DOUBLE) AS cell_size_pts, CAST(9.5 AS DOUBLE) AS left_margin_pts,
 CAST(1.0 AS DOUBLE) AS top_margin_pts, CAST(595.0 AS DOUBLE) AS page_w_pts, CAST(842.0 AS DOUBLE) AS page_h_pts
FROM pages"""

VIEWS["fx_docs"] = """
SELECT doc_id, CAST(max(page) AS INT) AS page_count FROM fx_page_grid GROUP BY doc_id"""

VIEWS["fx_cells"] = """
SELECT doc_id, page, r AS row, c AS col, (blk < 6 AND speck <> 0) AS writable,
 CASE WHEN blk < 6 AND speck <> 0 THEN CAST(950 + speck AS DOUBLE) / 1000 ELSE CAST(400 + speck AS DOUBLE) / 1000 END AS score,
 CASE WHEN blk < 6 AND speck <> 0 THEN CAST(0 AS DOUBLE) ELSE CAST(speck AS DOUBLE) / 100 END AS ink_ratio
FROM (SELECT g.doc_id, g.page, r, c,
  (g.page_id * 37 + floor((r - 1) / 5.0) * 101 + floor((c - 1) / 6.0) * 53 + floor((r - 1) / 5.0) * floor((c - 1) / 6.0) * 17) % 10 AS blk,
  (g.page_id * 7 + r * 13 + c * 29) % 41 AS speck
  FROM fx_page_grid g @seq(r,1,35) @seq(c,1,24)) t"""

# One row per row token of a block.
VIEWS["fx_blocks"] = """
SELECT g.doc_id, g.page, concat('p', g.page, '-b', k) AS block_id,
 CASE k WHEN 1 THEN 'header_footer' WHEN 2 THEN 'printed_question' WHEN 3 THEN 'marking_box' ELSE 'handwritten_answer' END AS kind,
 CASE WHEN k = 4 AND g.page_id % 9 = 0 THEN '' ELSE concat('text ', g.page_id, '/', k) END AS text,
 r AS row, CASE k WHEN 1 THEN concat('A', r, ':X', r) WHEN 2 THEN concat('C', r, ':T', r)
  WHEN 3 THEN concat('T', r, ':W', r) ELSE concat('E', r, ':S', r) END AS token
FROM fx_page_grid g @seq(k,1,5) @seq(r,1,30)
WHERE (k = 1 AND r = 1) OR (k = 2 AND r BETWEEN 3 AND 5) OR (k = 3 AND r BETWEEN 18 AND 20)
  OR (k = 4 AND r BETWEEN 8 AND 14) OR (k = 5 AND r BETWEEN 24 AND 30)"""

# Question to block references: question refs (rk 2), answer refs (rk 4, 5) and one dangling ref (rk 6).
VIEWS["fx_refs"] = """
SELECT g.doc_id, g.page AS question_id, CASE rk WHEN 2 THEN 'question' ELSE 'answer' END AS ref_kind, rk AS ref_pos,
 CASE WHEN rk = 6 THEN concat('p', g.page, '-b9') ELSE concat('p', g.page, '-b', rk) END AS block_ref,
 CASE WHEN g.page_id % 5 = 0 THEN NULL ELSE g.page_id % 4 <> 0 END AS is_attempted,
 CASE WHEN g.page_id % 3 = 0 THEN '' ELSE concat('stem ', g.page_id) END AS stem
FROM fx_page_grid g @seq(rk,2,6)
WHERE rk <> 3"""

VIEWS["fx_items"] = """
SELECT doc_id, page AS question_id, page - 1 AS item_index, CASE WHEN page % 5 = 0 THEN '' ELSE 'General' END AS section_name,
 page AS start_page, CASE WHEN page % 3 = 0 THEN page + 1 ELSE page END AS end_page,
 CAST((page_id * 11) % 60 AS DOUBLE) AS start_y, CAST((page_id * 11) % 60 + 30 AS DOUBLE) AS end_y,
 CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('answer ', page_id) END AS student_answer,
 CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id % 5 <> 1 END AS is_attempted, page AS marking_page,
 CASE WHEN page_id % 6 = 0 THEN 'A1:B2' ELSE 'U18:V19' END AS score_range, 'T17:W20' AS score_box_range
FROM fx_page_grid"""

# Grades with repeats (ord); some carry a question number that no item has.
VIEWS["fx_evaluations"] = """
SELECT doc_id, CAST(page + CASE WHEN page_id % 7 = 0 THEN 20 ELSE 0 END AS VARCHAR(9)) AS question_id, e AS ord,
 CAST((page_id + e) % 21 AS DOUBLE) / 4 AS marks_awarded, 10 AS max_marks,
 CASE (page_id + e) % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'wrong' ELSE 'unattempted' END AS status,
 CASE WHEN page_id % 3 = 0 THEN NULL ELSE concat('feedback ', page_id, '.', e) END AS feedback,
 CASE WHEN page_id % 5 = 0 THEN 'max_marks,status' ELSE 'max_marks,marks_awarded,status,feedback' END AS present
FROM fx_page_grid @seq(e,1,2) WHERE e = 1 OR page % 4 = 0"""

VIEWS["fx_annotations"] = """
SELECT g.doc_id, g.page AS question_id, g.page - 1 AS item_index, k - 1 AS annotation_index, g.page,
 concat(chr(CAST(65 + (g.page_id * 3 + k * 5) % 15 AS INT)), 3 + (g.page_id + k * (g.page_id % 4)) % 30, ':',
  chr(CAST(65 + (g.page_id * 3 + k * 5) % 15 + 3 + k * 2 AS INT)), 4 + (g.page_id + k * (g.page_id % 4)) % 30) AS comment_range,
 CAST(12 + (g.page_id + k) % 6 AS DOUBLE) AS comment_font_pts, concat('remark number ', g.page_id, ' part ', k) AS comment,
 CAST((g.page_id * 13 + k * 29) % 100 AS DOUBLE) AS y_position_percent,
 CAST((g.page_id * 17 + k * 23) % 80 AS DOUBLE) AS x_start_percent,
 CAST((g.page_id * 17 + k * 23) % 80 + 20 AS DOUBLE) AS x_end_percent,
 CASE (g.page_id + k) % 5 WHEN 0 THEN 'exponent_caret' WHEN 1 THEN 'curly_brace' WHEN 2 THEN 'underline' WHEN 3 THEN 'tick' ELSE 'none' END AS anchor_type,
 CASE WHEN (g.page_id + k) % 8 = 0 THEN 'Z90:Z90' ELSE 'E8:S8' END AS anchor_range,
 CASE WHEN g.page_id % 2 = 0 THEN 'word' END AS missing_word, CASE WHEN g.page_id % 3 = 0 THEN 'left' ELSE 'top' END AS side,
 CASE (g.page_id + k) % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'gap' END AS preferred_side,
 CASE WHEN (g.page_id + k) % 4 = 3 THEN 'high' ELSE CAST((g.page_id + k) % 4 AS VARCHAR(4)) END AS priority
FROM fx_page_grid g @seq(k,1,4)"""

# One annotation per order line on crowded pages (a page per supplier and line number), many off the usual grid.
_LETTERS = "CASE WHEN {0} <= 26 THEN chr(64 + {0}) ELSE concat(chr(64 + CAST(floor(({0} - 1) / 26.0) AS INT)), chr(65 + ({0} - 1) % 26)) END"
VIEWS["fx_crowd"] = f"""
SELECT doc_id, page, item_index, annotation_index, r1, c1, r1 + h AS r2, c1 + w AS c2,
 concat({_LETTERS.format("c1")}, r1, ':', {_LETTERS.format("(c1 + w)")}, r1 + h) AS comment_range
FROM (SELECT l_suppkey AS doc_id, CAST(l_linenumber AS INT) AS page, l_orderkey AS item_index,
  CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount) AS INT) - 1 AS annotation_index,
  CAST(1 + l_partkey % 90 AS INT) AS r1, CAST(1 + l_orderkey * 7 % 60 AS INT) AS c1, CAST(floor(l_quantity) % 5 AS INT) AS h,
  CAST(floor(l_extendedprice) % 9 AS INT) AS w FROM lineitem) t"""

# Cells of all sizes that overlap and leave gaps, and points on and off them, some on pages without cells.
VIEWS["fx_loose_cells"] = """
SELECT doc_id, page, annotation_index + 1 AS row, item_index AS col, CAST(c1 AS DOUBLE) AS x_start_percent, CAST(c2 + CASE WHEN item_index % 50 = 0 THEN 40 ELSE 1 END AS DOUBLE) AS x_end_percent,
 CAST(r1 AS DOUBLE) AS y_start_percent, CAST(r2 + 1 AS DOUBLE) AS y_end_percent FROM fx_crowd WHERE item_index % 3 <> 0"""
VIEWS["fx_spots"] = """
SELECT doc_id, page + CASE WHEN doc_id % 10 = 3 THEN 100 ELSE 0 END AS page, annotation_index, CAST(item_index * 13 % 120 - 10 AS DOUBLE) AS x_percent,
 CAST((item_index * 7 + r1 * 31) % 111 AS DOUBLE) AS y_percent FROM fx_crowd"""

VIEWS["fx_ocr_pages"] = """
SELECT conv_id AS doc_id, CAST(turn AS INT) + 1 AS page, CASE WHEN turn % 7 = 5 THEN 'DUPLICATE' ELSE 'PARAGRAPH' END AS page_type,
 CASE WHEN turn % 4 IN (1, 2) THEN first_value(text) OVER (PARTITION BY conv_id, CAST(floor(turn / 4.0) AS BIGINT) ORDER BY turn) ELSE text END AS text
FROM conversations"""

VIEWS["fx_keys"] = """
SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'hi' END AS lang, c_nationkey AS owner_user_id,
 CASE c_custkey % 5 WHEN 0 THEN 'essay' WHEN 1 THEN 'custom' WHEN 2 THEN ' Standard ' WHEN 3 THEN 'other' ELSE NULL END AS booklet_type,
 concat('keys/', c_custkey, '.pdf') AS pdf_path, c_custkey AS created_seq
FROM customer"""

VIEWS["fx_models"] = """
SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 7 = 0 THEN 'fr' WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'hi' END AS lang,
 c_nationkey AS owner_user_id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'standard' END AS booklet_type,
 concat('booklets/', c_custkey, '.pdf') AS booklet_pdf_path, 2 AS intro_page, c_custkey AS created_seq
FROM customer WHERE c_mktsegment <> 'MACHINERY'"""

# Booklets processed again: same id, sometimes under another owner.
VIEWS["fx_incoming"] = """
SELECT c_custkey AS id, concat('new ', c_name) AS title, 'en' AS lang,
 CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS owner_user_id,
 CASE WHEN c_custkey % 3 = 0 THEN 'ESSAY' ELSE 'unknown' END AS booklet_type, concat('new/', c_custkey, '.pdf') AS booklet_pdf_path,
 CAST(c_custkey % 9 AS INT) AS question_count, c_custkey + 100000 AS created_seq
FROM customer"""

VIEWS["fx_questions"] = """
SELECT o_custkey AS model_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS pos,
 concat('q-eng-', lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR(9)), 3, '0')) AS id,
 concat('Q', 1 + o_orderkey % 12, CASE o_orderkey % 3 WHEN 1 THEN '(a)' WHEN 2 THEN '(b)' ELSE '' END) AS question_no,
 concat('title ', o_orderkey) AS title, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('desc ', o_orderpriority) END AS desc_text,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('see ', o_orderstatus) END AS instruction_name,
 CAST(o_orderkey % 4 AS INT) AS page_num, CAST(o_orderkey % 4 * 5 AS INT) AS marks
FROM orders"""

VIEWS["fx_patches"] = """
SELECT o_custkey AS model_id, o_orderkey AS ord,
 CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE concat(' q-eng-', lpad(CAST(1 + o_orderkey % 20 AS VARCHAR(9)), 3, '0'), ' ') END AS question_id,
 CAST(1 + o_orderkey % 6 AS INT) AS page_num, CAST(o_orderkey % 15 AS INT) AS marks
FROM orders"""

# Requested orders: reversed; some repeat an id, ask for unknown ids or leave one out.
VIEWS["fx_reorders"] = """
SELECT model_id, n - pos AS pos, CASE WHEN model_id % 5 = 1 AND pos = 2 THEN 'q-eng-001'
  WHEN model_id % 5 = 2 AND pos = 1 THEN 'q-eng-999' ELSE id END AS id
FROM (SELECT model_id, pos, id, marks, count(*) OVER (PARTITION BY model_id) AS n FROM fx_questions) t
WHERE NOT (pos = 1 AND marks = 0)"""

VIEWS["fx_model_json"] = """
SELECT event_id, value, concat(chr(96), chr(96), chr(96), 'json', chr(10), '{"', CASE WHEN event_id % 2 = 0 THEN 'marksAwarded' ELSE 'marks_awarded' END, '": ',
 CAST(CAST(user_id % 40 AS DOUBLE) / 4 AS VARCHAR(20)), ', "', CASE WHEN event_id % 3 = 0 THEN 'studentText' ELSE 'student_text' END, '": "', event_type, '"',
 CASE WHEN event_id % 5 = 0 THEN ',' ELSE '' END, '}', chr(10), chr(96), chr(96), chr(96)) AS raw
FROM events"""

# Coarse 20 x 8 grid scores from the fine cells; exact thousandths.
VIEWS["fx_coarse"] = """
SELECT doc_id, page, CAST(floor((row - 1) / 1.75) AS INT) AS row0, CAST(floor((col - 1) / 3.0) AS INT) AS col0,
 CAST(sum(CAST(round(score * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000 AS score
FROM fx_cells GROUP BY doc_id, page, CAST(floor((row - 1) / 1.75) AS INT), CAST(floor((col - 1) / 3.0) AS INT)"""

# Two by two pixels per cell, gray values 0..255.
VIEWS["fx_pixels"] = """
SELECT doc_id, page, (row - 1) * 2 + dy AS y, (col - 1) * 2 + dx AS x,
 CAST(CASE WHEN writable THEN 250 + (row + col + dx) % 5 ELSE 40 + (row * 7 + col * 3 + dx * 50 + dy * 90) % 200 END AS INT) AS value
FROM fx_cells @seq(dy,0,1) @seq(dx,0,1)"""

# Connected components of handwriting: position and size, three to eight per text line.
VIEWS["fx_components"] = """
SELECT g.doc_id, g.page, ln * 60 + (g.page_id * 3 + ln * 7 + m * 5) % 11 + CASE WHEN (g.page_id + ln) % 6 = 0 THEN -24 ELSE 0 END AS cy,
 CAST(12 + (g.page_id + m * 13) % 40 AS INT) AS w, CAST(11 + (g.page_id * 5 + ln + m * 9) % 50 AS INT) AS h,
 CAST(100 + (g.page_id * 31 + ln * 17 + m * 41) % 900 AS INT) AS area, ln, m
FROM fx_page_grid g @seq(ln,1,20) @seq(m,1,6)"""

VIEWS["fx_lines"] = """
SELECT g.doc_id, g.page, ln AS line, CAST(ln * 80 + (g.page_id * 3 + ln * ln * 7) % 60 AS INT) AS y
FROM fx_page_grid g @seq(ln,1,18)"""

# Ink per pixel row in the three zones of a page.
VIEWS["fx_projections"] = """
SELECT g.doc_id, g.page, zone, y, CAST(CASE WHEN (floor(y / (17.0 + zone * 9)) + g.page_id) % 3 = 0 THEN 300 + y ELSE (y * 7 + g.page_id) % 70 END AS INT) AS ink
FROM fx_page_grid g @seq(zone,1,3) @seq(y,0,399)"""

# Ink per pixel column of some text lines.
VIEWS["fx_col_projections"] = """
SELECT g.doc_id, g.page, ln AS line, x, CAST(CASE WHEN (floor(x / (23.0 + ln)) + g.page_id) % 3 <> 0 THEN 500 + x * 3 ELSE (x + g.page_id) % 9 END AS INT) AS ink,
 CAST(CASE WHEN (floor((x + 3) / (23.0 + ln)) + g.page_id) % 3 <> 0 THEN 100 + x ELSE 0 END AS INT) AS raw_ink
FROM fx_page_grid g @seq(ln,1,4) @seq(x,0,239)"""

VIEWS["fx_remarks"] = """
SELECT g.doc_id, g.page, k - 1 AS pos, CASE k WHEN 1 THEN 'score_circle' WHEN 2 THEN 'tick' WHEN 3 THEN 'underline_remark' WHEN 4 THEN 'exponent_insert'
  WHEN 5 THEN 'curly_brace' ELSE 'sticker' END AS type,
 CASE WHEN (g.page_id + k) % 5 = 0 THEN 'odd' WHEN k % 2 = 0 THEN 'critical' ELSE 'positive' END AS severity,
 CAST(1 + (g.page_id * 3 + k * 4) % 22 AS INT) AS line, CASE WHEN k % 2 = 1 THEN 'gap' END AS remark_zone
FROM fx_page_grid g @seq(k,1,6)"""

# Placement log of a session: later rows win, 'remove' is a tombstone.
VIEWS["fx_placements"] = """
SELECT user_id AS session_id, concat('k', CAST(floor(value / 25.0) AS INT)) AS key, event_id AS ord, ts,
 CASE WHEN event_type = 'error' THEN 'remove' ELSE 'place' END AS action,
 CAST(1 + event_id % 4 AS INT) AS page, CAST(event_id * 37 % 1240 AS INT) AS x, CAST(event_id * 53 % 1754 AS INT) AS y
FROM events"""

_SEQ = re.compile(r"@seq\((\w+),(-?\d+),(-?\d+)\)")


def spark_sql_text(text: str) -> str:
    # Spark drops VARCHAR lengths to STRING in casts
    text = re.sub(r"VARCHAR\(\d+\)", "STRING", text)
    # plain decimal literals would make Spark divide in decimals
    text = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w'])", r"\1D", text)
    return _SEQ.sub(r"LATERAL VIEW explode(sequence(\2, \3)) \1_t AS \1", text)


def duck_sql_text(text: str) -> str:
    return _SEQ.sub(r"CROSS JOIN (SELECT CAST(unnest(generate_series(\2, \3)) AS INT) AS \1) \1_t", text)


def _uses(text: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", text)]


def with_ctes(sql: str) -> str:
    """Put the derived views a statement uses in front of it as CTEs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text):
            if name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ", ".join(f"{name} AS ({duck_sql_text(VIEWS[name])})" for name in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        body = body[5:]
        if body[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {ctes}, {body[10:]}"
        return f"WITH {ctes}, {body}"
    return f"WITH {ctes} {body}"


class Tables:
    """Base tables and derived views of one data folder: ``t.pages``, ``t.fx_cells``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                text = VIEWS[name]
                for dep in _uses(text) + [b for b in BASE if re.search(rf"\b(FROM|JOIN)\s+{b}\b", text)]:
                    getattr(self, dep)
                df = self.spark.sql(spark_sql_text(text))
                if name == "fx_page_grid":
                    # spread the small page table first: everything exploded from it is then already
                    # partitioned by page, and no cell-grain shuffle is needed later
                    df = df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "page")
                    # Spark sizes a table exploded from it as if it still had one row per page, and would send
                    # millions of cells to every executor through the driver: such tables are merged by page instead
                    df = df.hint("merge")
            else:
                raise AttributeError(name)
            df.createOrReplaceTempView(name)
            self._made[name] = df
        return self._made[name]
