"""Catalogue queries: keys, models, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import catalog as C
from gradelake.operators import keyed as K
from gradelake.plans.registry import query

_BT = "CASE WHEN lower(trim(coalesce({0}, 'standard'))) IN ('standard','custom','custom_with_model','essay') THEN lower(trim(coalesce({0}, 'standard'))) ELSE 'standard' END"


@query("j1_list_models", """
SELECT k.id, k.owner_user_id, k.title, k.lang, a.id IS NOT NULL AS has_booklet, coalesce(a.booklet_type, k.booklet_type) AS booklet_type, k.created_seq
FROM fx_keys k LEFT JOIN fx_models a ON a.id = k.id AND a.owner_user_id = k.owner_user_id""")
def _(t):
    return C.list_models(t.fx_keys, t.fx_models)


@query("s1_newest_models", """
SELECT id, has, CAST(rn AS INT) AS rn FROM (SELECT k.id, a.id IS NOT NULL AS has, k.owner_user_id,
 row_number() OVER (PARTITION BY k.owner_user_id ORDER BY k.created_seq DESC, k.id) AS rn
FROM fx_keys k LEFT JOIN fx_models a ON a.id = k.id AND a.owner_user_id = k.owner_user_id) t""")
def _(t):
    listed = C.list_models(t.fx_keys, t.fx_models)
    return C.newest_first(listed, "rn").select("id", F.col("has_booklet").alias("has"), "rn")


@query("pf7_for_owner", "SELECT id, title, lang FROM fx_keys WHERE owner_user_id = 7")
def _(t):
    return C.for_owner(t.fx_keys, 7).select("id", "title", "lang")


@query("pf5_apply_domains", f"""
SELECT id, lower(trim(lang)) AS lang, {_BT.format('booklet_type')} AS booklet_type,
 CASE lower(trim(cl)) WHEN 'hard' THEN 'Hard' WHEN 'moderate' THEN 'Moderate' WHEN '' THEN 'Moderate' ELSE '' END AS check_level,
 CASE WHEN lower(trim(lang)) NOT IN ('en','hi') THEN 'language' WHEN lower(trim(cl)) NOT IN ('hard','moderate','') THEN 'check_level' END AS reject
FROM (SELECT m.id, m.lang, k.booklet_type, CASE m.id % 4 WHEN 0 THEN '' WHEN 1 THEN 'HARD' WHEN 2 THEN ' moderate ' ELSE 'easy' END AS cl
 FROM fx_models m JOIN fx_keys k ON k.id = m.id) t""")
def _(t):
    level = F.expr("CASE m.id % 4 WHEN 0 THEN '' WHEN 1 THEN 'HARD' WHEN 2 THEN ' moderate ' ELSE 'easy' END")
    joined = t.fx_models.alias("m").join(t.fx_keys.alias("k"), F.expr("k.id = m.id"))
    raw = joined.select("m.id", "m.lang", "k.booklet_type", level.alias("check_level"))
    return C.apply_domains(raw).select("id", "lang", "booklet_type", "check_level", "reject")


@query("pf6_resolve_language", """
SELECT r.rid, CASE WHEN asked IN ('en','hi') THEN asked WHEN r.mid IS NOT NULL AND m.lang IN ('en','hi') THEN m.lang WHEN r.mid IS NULL AND asked = '' THEN 'en' END AS resolved,
 CASE WHEN asked IN ('en','hi') THEN NULL WHEN r.mid IS NOT NULL AND m.id IS NULL THEN 'Model not found.'
  WHEN r.mid IS NOT NULL AND coalesce(m.lang, '') NOT IN ('en','hi') THEN 'Model language must be en or hi for OCR.'
  WHEN r.mid IS NULL AND asked <> '' THEN 'language must be en or hi' END AS error
FROM (SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS mid, c.c_nationkey AS owner,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'xx' ELSE 'en' END AS asked FROM orders JOIN customer c ON c.c_custkey = o_custkey) r
LEFT JOIN fx_models m ON m.id = r.mid AND m.owner_user_id = r.owner""")
def _(t):
    t.customer
    t.orders
    req = t.spark.sql("""SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS model_id,
      c.c_nationkey AS owner_user_id, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'xx' ELSE ' EN ' END AS language
      FROM orders JOIN customer c ON c.c_custkey = o_custkey""")
    return C.resolve_language(req, t.fx_models).select("rid", "resolved", "error")


_REQ_SQL = """SELECT o_orderkey AS rid, o_custkey AS model_id, c.c_nationkey AS owner_user_id,
 concat('q-eng-', lpad(CAST(1 + o_orderkey % 13 AS VARCHAR(9)), 3, '0')) AS question_id,
 CASE o_orderkey % 5 WHEN 0 THEN 'easy' WHEN 1 THEN 'HARD' ELSE 'moderate' END AS check_level
 FROM orders JOIN customer c ON c.c_custkey = o_custkey"""


def _requests(t):
    t.customer
    t.orders
    return t.spark.sql(_REQ_SQL.replace("VARCHAR(9)", "STRING"))


@query("j2_question_lookup", f"""
SELECT r.rid, CASE WHEN m.id IS NULL THEN 'Model not found.' WHEN q.id IS NULL THEN 'Question not found for this model.' END AS error,
 CASE WHEN m.id IS NOT NULL THEN q.title END AS title, CASE WHEN m.id IS NOT NULL THEN q.marks END AS marks
FROM ({_REQ_SQL}) r LEFT JOIN fx_models m ON m.id = r.model_id AND m.owner_user_id = r.owner_user_id
LEFT JOIN fx_questions q ON q.model_id = r.model_id AND q.id = r.question_id""")
def _(t):
    return C.question_for(_requests(t).drop("check_level"), t.fx_models, t.fx_questions).select("rid", "error", "title", "marks")


@query("pf9_grading_context", f"""
SELECT rid, error, CASE WHEN error IS NULL THEN CASE check_level WHEN 'HARD' THEN 'Hard' ELSE 'Moderate' END END AS check_level,
 CASE WHEN error IS NULL THEN marks END AS total_marks, CASE WHEN error IS NULL THEN greatest(1, page_num) END AS page_count
FROM (SELECT r.rid, r.check_level, q.marks, q.page_num, CASE WHEN m.id IS NULL THEN 'Model not found.'
  WHEN m.lang NOT IN ('en','hi') THEN 'Model language must be en or hi for analysis.' WHEN q.id IS NULL THEN 'Question not found for this model.'
  WHEN trim(q.title) = '' OR trim(q.desc_text) = '' THEN 'Stored question is missing title or desc.'
  WHEN q.marks < 1 THEN 'Stored question marks must be at least 1 for analysis.' WHEN r.check_level = 'easy' THEN 'checkLevel must be Moderate or Hard.' END AS error
 FROM ({_REQ_SQL}) r LEFT JOIN fx_models m ON m.id = r.model_id AND m.owner_user_id = r.owner_user_id
 LEFT JOIN fx_questions q ON q.model_id = r.model_id AND q.id = r.question_id) t""")
def _(t):
    return C.grading_context(_requests(t), t.fx_models, t.fx_questions).select(
        "rid", "error", "check_level", "total_marks", "page_count")


@query("j3_delete_keys", """
SELECT k.id, k.owner_user_id, k.pdf_path, m.booklet_pdf_path FROM fx_keys k
JOIN (SELECT DISTINCT o_custkey AS id, CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE c_nationkey END AS owner_user_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F') g
 ON g.id = k.id AND g.owner_user_id = k.owner_user_id LEFT JOIN fx_models m ON m.id = k.id AND m.owner_user_id = k.owner_user_id""")
def _(t):
    return C.delete_keys(t.fx_keys, t.fx_models, _doomed(t))[2]


@query("j3_delete_keys_kept_models", """
SELECT m.id, m.owner_user_id, m.title FROM fx_models m WHERE NOT EXISTS (SELECT 1 FROM fx_keys k
JOIN (SELECT DISTINCT o_custkey AS id, CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE c_nationkey END AS owner_user_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F') g
 ON g.id = k.id AND g.owner_user_id = k.owner_user_id WHERE k.id = m.id AND k.owner_user_id = m.owner_user_id)""")
def _(t):
    return C.delete_keys(t.fx_keys, t.fx_models, _doomed(t))[1].select("id", "owner_user_id", "title")


@query("j3_delete_models", """
SELECT m.id, m.owner_user_id, m.booklet_pdf_path FROM fx_models m WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey
 WHERE o_orderstatus = 'F' AND o_custkey = m.id AND CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE c_nationkey END = m.owner_user_id)""")
def _(t):
    return C.delete_models(t.fx_models, _doomed(t))[1]


def _doomed(t):
    owner = F.expr("CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE c_nationkey END")
    return t.orders.filter("o_orderstatus = 'F'").join(t.customer, F.expr("c_custkey = o_custkey")).select(
        F.col("o_custkey").alias("id"), owner.alias("owner_user_id"))


@query("j4_upsert_models", f"""
SELECT coalesce(m.id, i.id) AS id, coalesce(m.owner_user_id, i.owner_user_id) AS owner_user_id,
 CASE WHEN i.id IS NOT NULL THEN i.title ELSE m.title END AS title, CASE WHEN i.id IS NOT NULL THEN i.lang ELSE m.lang END AS lang,
 CASE WHEN i.id IS NOT NULL THEN {_BT.format('i.booklet_type')} ELSE m.booklet_type END AS booklet_type,
 CASE WHEN i.id IS NOT NULL THEN i.booklet_pdf_path ELSE m.booklet_pdf_path END AS booklet_pdf_path,
 CASE WHEN i.id IS NOT NULL THEN i.question_count ELSE 0 END AS question_count,
 CASE WHEN m.id IS NULL THEN 2 ELSE coalesce(m.intro_page, 2) END AS intro_page,
 CASE WHEN m.id IS NULL THEN i.created_seq ELSE m.created_seq END AS created_seq
FROM fx_models m FULL JOIN fx_incoming i ON i.id = m.id AND i.owner_user_id = m.owner_user_id""")
def _(t):
    return C.upsert_models(t.fx_models.withColumn("question_count", F.lit(0)), t.fx_incoming)


@query("j4_update_keys", f"""
SELECT m.id, m.owner_user_id, CASE WHEN i.id IS NOT NULL THEN i.title ELSE m.title END AS title,
 CASE WHEN i.id IS NOT NULL THEN i.lang ELSE m.lang END AS lang,
 CASE WHEN i.id IS NOT NULL THEN CASE WHEN i.id % 2 = 0 THEN {_BT.format('i.booklet_type')} ELSE coalesce(k.booklet_type, 'standard') END ELSE m.booklet_type END AS booklet_type
FROM fx_models m LEFT JOIN fx_incoming i ON i.id = m.id AND i.owner_user_id = m.owner_user_id
LEFT JOIN fx_keys k ON k.id = m.id AND k.owner_user_id = m.owner_user_id""")
def _(t):
    changes = t.fx_incoming.withColumn("booklet_type", F.expr("CASE WHEN id % 2 = 0 THEN booklet_type END"))
    return C.update_keys(t.fx_keys, t.fx_models, changes)[1].select("id", "owner_user_id", "title", "lang", "booklet_type")


_PATCH = """(SELECT model_id, trim(question_id) AS question_id, min(ord) AS ord, arg_max(page_num, ord) AS page_num, arg_max(marks, ord) AS marks
 FROM fx_patches WHERE trim(question_id) <> '' GROUP BY model_id, trim(question_id))"""


@query("j5_bulk_patch", f"""
SELECT q.model_id, q.pos, q.id, coalesce(p.page_num, q.page_num) AS page_num, coalesce(p.marks, q.marks) AS marks
FROM fx_questions q LEFT JOIN {_PATCH} p ON p.model_id = q.model_id AND p.question_id = q.id""")
def _(t):
    return C.bulk_patch(t.fx_questions, t.fx_patches)[0].select("model_id", "pos", "id", "page_num", "marks")


@query("j5_bulk_patch_report", f"""
SELECT p.model_id, p.question_id, p.ord, CASE WHEN q.id IS NULL THEN 'not_found' ELSE 'updated' END AS outcome
FROM {_PATCH} p LEFT JOIN fx_questions q ON p.model_id = q.model_id AND p.question_id = q.id""")
def _(t):
    _, updated, missing = C.bulk_patch(t.fx_questions, t.fx_patches)
    return updated.withColumn("outcome", F.lit("updated")).unionByName(missing.withColumn("outcome", F.lit("not_found")))


_REORDER_CHECK = """(SELECT model_id, CASE WHEN nq = 0 THEN 'Model not found.' WHEN most > 1 THEN 'Invalid order: duplicate ids.'
  WHEN no <> nq THEN 'Invalid order: missing question ids.' WHEN unknown > 0 THEN 'Invalid order: unknown question ids.'
  WHEN missing > 0 THEN 'Invalid order: missing question ids.' END AS error
 FROM (SELECT coalesce(q.model_id, o.model_id) AS model_id, sum(coalesce(q.n, 0)) AS nq, sum(coalesce(o.n, 0)) AS no, max(coalesce(o.n, 0)) AS most,
   count(*) FILTER (WHERE q.n IS NULL) AS unknown, count(*) FILTER (WHERE o.n IS NULL) AS missing
  FROM (SELECT model_id, id, count(*) AS n FROM fx_questions GROUP BY model_id, id) q
  FULL JOIN (SELECT model_id, id, count(*) AS n FROM fx_reorders GROUP BY model_id, id) o ON o.model_id = q.model_id AND o.id = q.id
  GROUP BY 1) s WHERE no > 0)"""


@query("j6_reorder_check", f"SELECT model_id, error FROM {_REORDER_CHECK} c")
def _(t):
    return C.reorder_check(t.fx_questions, t.fx_reorders)


@query("j6_reorder", f"""
WITH good AS (SELECT model_id FROM {_REORDER_CHECK} c WHERE error IS NULL)
SELECT q.model_id, q.id, CAST(row_number() OVER (PARTITION BY q.model_id ORDER BY o.pos) AS INT) AS pos,
 concat('Q', row_number() OVER (PARTITION BY q.model_id ORDER BY o.pos)) AS question_no
FROM fx_questions q JOIN good ON good.model_id = q.model_id JOIN fx_reorders o ON o.model_id = q.model_id AND o.id = q.id
UNION ALL SELECT model_id, id, pos, question_no FROM fx_questions WHERE model_id NOT IN (SELECT model_id FROM good)""")
def _(t):
    return C.reorder(t.fx_questions, t.fx_reorders)[0].select("model_id", "id", "pos", "question_no")


@query("so2_order_ids_missing", """
SELECT q.model_id, q.id FROM fx_questions q WHERE NOT EXISTS (SELECT 1 FROM fx_reorders o WHERE o.model_id = q.model_id AND o.id = q.id)""")
def _(t):
    return t.fx_questions.select("model_id", "id").join(t.fx_reorders.select("model_id", "id"), ["model_id", "id"], "left_anti")


@query("j7_review_rows", """
WITH r AS (SELECT l_orderkey AS request_id, o_custkey AS model_id, concat('q-eng-', lpad(CAST(l_linenumber AS VARCHAR(9)), 3, '0')) AS question_id, l_tax AS marks_awarded
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT r.request_id, r.model_id, r.question_id, r.marks_awarded, q.question_no, q.title, q.marks AS marks_total
FROM r JOIN fx_questions q ON q.model_id = r.model_id AND q.id = r.question_id
WHERE r.request_id NOT IN (SELECT x.request_id FROM r x LEFT JOIN fx_questions y ON y.model_id = x.model_id AND y.id = x.question_id WHERE y.id IS NULL)""")
def _(t):
    t.lineitem
    t.orders
    results = t.spark.sql("""SELECT l_orderkey AS request_id, o_custkey AS model_id,
      concat('q-eng-', lpad(CAST(l_linenumber AS STRING), 3, '0')) AS question_id, l_tax AS marks_awarded
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
    return C.review_rows(results, t.fx_questions)


_INC_Q = """SELECT c_custkey AS model_id, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END AS owner_user_id,
 concat('added ', c_name) AS title, 'd' AS desc_text, 4 AS marks FROM customer"""


@query("j28_append_questions", f"""
WITH inc AS ({_INC_Q}), good AS (SELECT i.* FROM inc i WHERE EXISTS (SELECT 1 FROM fx_keys k WHERE k.id = i.model_id AND k.owner_user_id = i.owner_user_id)),
 mx AS (SELECT model_id, max(pos) AS top, max(CAST(regexp_extract(id, '^q-eng-([0-9]+)$', 1) AS INT)) AS n FROM fx_questions GROUP BY model_id),
 allq AS (SELECT q.model_id, q.pos, q.id, q.title FROM fx_questions q WHERE q.model_id IN (SELECT model_id FROM good)
  UNION ALL SELECT g.model_id, coalesce(mx.top, 0) + 1, concat('q-eng-', lpad(CAST(coalesce(mx.n, 0) + 1 AS VARCHAR(9)), 3, '0')), g.title FROM good g LEFT JOIN mx ON mx.model_id = g.model_id)
SELECT model_id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY pos) AS INT) AS pos, id, title,
 concat('Q', row_number() OVER (PARTITION BY model_id ORDER BY pos)) AS question_no FROM allq
UNION ALL SELECT model_id, pos, id, title, question_no FROM fx_questions WHERE model_id NOT IN (SELECT model_id FROM good)""")
def _(t):
    return _appended(t)[1].select("model_id", "pos", "id", "title", "question_no")


@query("j28_append_models", f"""
WITH inc AS ({_INC_Q}), good AS (SELECT i.* FROM inc i WHERE EXISTS (SELECT 1 FROM fx_keys k WHERE k.id = i.model_id AND k.owner_user_id = i.owner_user_id)),
 n AS (SELECT g.model_id, 1 + (SELECT count(*) FROM fx_questions q WHERE q.model_id = g.model_id) AS n FROM good g)
SELECT m.id, m.title, m.booklet_type, CAST(n.n AS INT) AS question_count FROM fx_models m LEFT JOIN n ON n.model_id = m.id
UNION ALL SELECT k.id, k.title, {_BT.format('k.booklet_type')}, CAST(n.n AS INT) FROM good g JOIN fx_keys k ON k.id = g.model_id LEFT JOIN n ON n.model_id = k.id
 WHERE NOT EXISTS (SELECT 1 FROM fx_models m WHERE m.id = g.model_id AND m.owner_user_id = g.owner_user_id)""")
def _(t):
    return _appended(t)[0].select("id", "title", "booklet_type", "question_count")


def _appended(t):
    t.customer
    return C.append_questions(t.fx_keys, t.fx_models, t.fx_questions, t.spark.sql(_INC_Q))


_NEW_Q = """SELECT o_custkey AS model_id, concat('q-eng-', lpad(CAST(1 + o_orderkey % 15 AS VARCHAR(9)), 3, '0')) AS id, max(o_orderkey) AS k
 FROM orders GROUP BY 1, 2"""


def _replacements(t):
    t.orders
    new = t.spark.sql(_NEW_Q.replace("VARCHAR(9)", "STRING").replace("GROUP BY 1, 2", "GROUP BY 1, 2"))
    return new.select("model_id", "id", F.concat(F.lit("re "), "k").alias("title"), F.lit("Qx").alias("question_no"),
                      F.lit("").alias("desc_text"), F.lit(None).cast("string").alias("instruction_name"),
                      F.lit(1).alias("page_num"), F.lit(9).alias("marks"))


@query("j29_replace_questions", f"""
SELECT q.model_id, q.pos, q.id, CASE WHEN n.id IS NULL THEN q.title ELSE concat('re ', n.k) END AS title,
 CASE WHEN n.id IS NULL THEN q.question_no ELSE 'Qx' END AS question_no, CASE WHEN n.id IS NULL THEN q.instruction_name END AS instruction_name,
 CASE WHEN n.id IS NULL THEN q.marks ELSE 9 END AS marks
FROM fx_questions q LEFT JOIN ({_NEW_Q}) n ON n.model_id = q.model_id AND n.id = q.id""")
def _(t):
    return C.replace_questions(t.fx_questions, _replacements(t))[0].select(
        "model_id", "pos", "id", "title", "question_no", "instruction_name", "marks")


@query("j29_replace_errors", f"""
SELECT n.model_id, n.id, 'Question not found' AS error FROM ({_NEW_Q}) n LEFT JOIN fx_questions q ON n.model_id = q.model_id AND n.id = q.id WHERE q.id IS NULL""")
def _(t):
    return C.replace_questions(t.fx_questions, _replacements(t))[1]


@query("j30_delete_questions", """
WITH kept AS (SELECT q.* FROM fx_questions q WHERE NOT EXISTS (SELECT 1 FROM fx_patches p WHERE p.model_id = q.model_id AND trim(p.question_id) = q.id AND p.marks < 5)),
 hit AS (SELECT DISTINCT q.model_id FROM fx_questions q JOIN fx_patches p ON p.model_id = q.model_id AND trim(p.question_id) = q.id AND p.marks < 5)
SELECT model_id, id, CASE WHEN model_id IN (SELECT model_id FROM hit) THEN CAST(row_number() OVER (PARTITION BY model_id ORDER BY pos) AS INT) ELSE pos END AS pos,
 CASE WHEN model_id IN (SELECT model_id FROM hit) THEN concat('Q', row_number() OVER (PARTITION BY model_id ORDER BY pos)) ELSE question_no END AS question_no FROM kept""")
def _(t):
    ids = t.fx_patches.filter("marks < 5").select("model_id", F.trim("question_id").alias("id"))
    return C.delete_questions(t.fx_questions, ids).select("model_id", "id", "pos", "question_no")


@query("w4_renumber", """
SELECT model_id, id, CAST(row_number() OVER (PARTITION BY model_id ORDER BY pos) AS INT) AS pos,
 concat('Q', row_number() OVER (PARTITION BY model_id ORDER BY pos)) AS question_no FROM (SELECT model_id, pos * 3 AS pos, id FROM fx_questions WHERE marks > 0) t""")
def _(t):
    sparse = t.fx_questions.filter("marks > 0").withColumn("pos", F.col("pos") * 3)
    return C.renumber(sparse).select("model_id", "id", "pos", "question_no")


@query("w5_default_pages_marks", """
SELECT model_id, id, CASE WHEN i <= floor(n / 2.0) THEN 2 ELSE 3 END AS page_num,
 CASE WHEN marks <> 0 THEN marks WHEN i <= floor(n / 2.0) THEN 8 ELSE 12 END AS marks
FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY model_id) AS n FROM fx_questions) t""")
def _(t):
    return C.default_pages_marks(t.fx_questions).select("model_id", "id", "page_num", "marks")


@query("w6_logical_order", """
SELECT model_id, id, CAST(rn AS INT) AS new_pos, concat('q-', lpad(CAST(rn AS VARCHAR(9)), 3, '0')) AS new_id FROM (
 SELECT model_id, id, row_number() OVER (PARTITION BY model_id ORDER BY CAST(regexp_extract(question_no, '([0-9]+)', 1) AS INT),
  regexp_extract(question_no, '\\(([a-z])\\)', 1), pos) AS rn FROM fx_questions) t""")
def _(t):
    return C.logical_order(t.fx_questions).select("model_id", "id", "new_pos", "new_id")


@query("w19_last_wins", """
SELECT model_id, trim(question_id) AS question_id, max(ord) AS ord, arg_max(page_num, ord) AS page_num, arg_max(marks, ord) AS marks
FROM fx_patches GROUP BY 1, 2""")
def _(t):
    return K.last_wins(t.fx_patches.withColumn("question_id", F.trim("question_id")), ["model_id", "question_id"], "ord")


@query("a11_next_question_id", """
SELECT model_id, concat('q-eng-', lpad(CAST(max(CAST(regexp_extract(id, '^q-eng-([0-9]+)$', 1) AS INT)) + 1 AS VARCHAR(9)), 3, '0')) AS next_id
FROM fx_questions GROUP BY model_id""")
def _(t):
    return C.next_question_id(t.fx_questions)


@query("a10_key_text", """
WITH b AS (SELECT model_id, CAST(floor((pos - 1) / 8.0) AS INT) AS part, pos, concat(question_no, '. ', title,
 CASE WHEN desc_text <> '' THEN concat(chr(10), '   Model booklet (ideal answer): ', desc_text) ELSE '' END,
 CASE WHEN instruction_name IS NOT NULL THEN concat(chr(10), '   Instructions (examiner marking key — weigh like the booklet text): ', instruction_name) ELSE '' END,
 chr(10), '   MAX MARKS ALLOWED: ', marks, chr(10)) AS t FROM fx_questions)
SELECT b.model_id, b.part, concat(CASE WHEN b.part = 0 THEN concat('Subject / Paper: ', m.title, chr(10), chr(10)) ELSE '' END, string_agg(b.t, chr(10) ORDER BY b.pos)) AS text
FROM b JOIN fx_models m ON m.id = b.model_id GROUP BY b.model_id, b.part, m.title""")
def _(t):
    titles = t.fx_models.select(F.col("id").alias("model_id"), "title")
    return C.key_text(t.fx_questions, titles, per_part=8)


@query("a10_whole_key_text", """
WITH b AS (SELECT model_id, pos, concat(question_no, '. ', title, CASE WHEN desc_text <> '' THEN concat(chr(10), '   Model booklet (ideal answer): ', desc_text) ELSE '' END,
 CASE WHEN instruction_name IS NOT NULL THEN concat(chr(10), '   Instructions (examiner marking key — weigh like the booklet text): ', instruction_name) ELSE '' END,
 chr(10), '   MAX MARKS ALLOWED: ', marks, chr(10)) AS t FROM fx_questions),
 k AS (SELECT model_id, string_agg(t, chr(10) ORDER BY pos) AS body FROM b GROUP BY model_id)
SELECT id AS model_id, concat('Subject / Paper: ', title, chr(10), CASE WHEN body IS NULL THEN '' ELSE concat(chr(10), body) END) AS text FROM fx_models LEFT JOIN k ON k.model_id = id""")
def _(t):
    return C.whole_key_text(t.fx_questions, t.fx_models.select(F.col("id").alias("model_id"), "title"), per_part=8)


@query("a15_patch_counts", f"""
SELECT p.model_id, count(q.id) AS updated_count, count(*) - count(q.id) AS not_found_count FROM {_PATCH} p LEFT JOIN fx_questions q ON p.model_id = q.model_id AND p.question_id = q.id GROUP BY p.model_id""")
def _(t):
    _, updated, missing = C.bulk_patch(t.fx_questions, t.fx_patches)
    return C.patch_counts(updated, missing)


_RAW_Q = """SELECT l_orderkey AS model_id, l_linenumber AS ln, l_partkey AS pk,
 CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('q', l_partkey) END AS id, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat(' Q', l_linenumber, ' ') END AS question_no,
 CASE WHEN l_partkey % 7 = 0 THEN '   ' ELSE concat(' ', l_returnflag, ' text ') END AS question_text,
 CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN CAST(l_quantity AS VARCHAR(20)) WHEN 3 THEN concat('about ', l_linenumber, ' marks') WHEN 4 THEN 'none' ELSE '7.9' END AS marks
FROM lineitem"""


def _raw_questions(t):
    t.lineitem
    return t.spark.sql(_RAW_Q.replace("VARCHAR(20)", "STRING"))


@query("pf1_normalize_questions", f"""
SELECT model_id, ln, pk, coalesce(id, 'q-eng-001') AS id, coalesce(question_no, 'Q1') AS question_no, '' AS instruction_name, 1 AS page_num,
 CASE WHEN marks IS NULL OR marks = 'true' THEN 0 ELSE coalesce(CAST(trunc(TRY_CAST(marks AS DOUBLE)) AS INT), TRY_CAST(regexp_extract(marks, '([0-9]+)', 1) AS INT), 0) END AS marks
FROM ({_RAW_Q}) r""")
def _(t):
    raw = _raw_questions(t).withColumns({
        "title": F.lit(None).cast("string"), "desc_text": F.lit(None).cast("string"),
        "instruction_name": F.lit(None).cast("string"), "page_num": F.lit(None).cast("string")})
    return C.normalize_questions(raw).select("model_id", "ln", "pk", "id", "question_no", "instruction_name", "page_num", "marks")


@query("pf2_normalize_imported", f"""
SELECT model_id, ln, pk, coalesce(nullif(trim(id), ''), 'q-unknown') AS id, coalesce(nullif(trim(question_no), ''), 'Q?') AS question_no, trim(question_text) AS question_text
FROM ({_RAW_Q}) r WHERE trim(question_text) <> ''""")
def _(t):
    return C.normalize_imported(_raw_questions(t).drop("marks"))


@query("pf3_canonical_questions", f"""
SELECT model_id, ln AS pos, coalesce(id, concat('q-', lpad(CAST(ln AS VARCHAR(9)), 3, '0'))) AS id, coalesce(question_no, concat('Q', ln)) AS question_no,
 question_text AS title, coalesce(marks, '') AS desc_text, '' AS instruction_name, 1 AS page_num, 0 AS marks, '' AS diagrams, pk FROM ({_RAW_Q}) r""")
def _(t):
    raw = _raw_questions(t).select("model_id", F.struct("model_id", "pk").alias("m"), F.col("ln").alias("pos"), F.col("id").alias("question_id"),
                                   "question_no", F.col("question_text").alias("question"), F.col("marks").alias("answer"))
    out = C.canonical_questions(raw.drop("model_id").withColumnRenamed("m", "model_id"))
    return out.withColumn("diagrams", F.array_join("diagrams", ",")).withColumn("pk", F.col("model_id.pk")).withColumn(
        "model_id", F.col("model_id.model_id"))


@query("pf4_instruction_default", "SELECT model_id, id, coalesce(instruction_name, '') AS instruction_name FROM fx_questions")
def _(t):
    return t.fx_questions.select("model_id", "id", C.instruction_default().alias("instruction_name"))


@query("c30_stamp", "SELECT count(*) AS n, count(*) AS ids, TRUE AS stamped FROM customer")
def _(t):
    out = C.stamp(t.customer.select("c_name"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.bool_and(F.col("created_at").isNotNull()).alias("stamped"))
