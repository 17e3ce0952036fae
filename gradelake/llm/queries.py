"""The registered queries of the text operators and, where SQL can state the result, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.decontaminate import decontaminate
from gradelake.llm.exact_dedup import exact_dedup
from gradelake.llm.fill_middle import fill_middle, restored
from gradelake.llm.language_id import languages
from gradelake.llm.line_templates import drop_recurring_lines
from gradelake.llm.near_dedup import near_dedup
from gradelake.llm.packing import pack
from gradelake.llm.pivot_search import top_k
from gradelake.llm.quality_rules import quality_scores
from gradelake.llm.shared import shared_root
from gradelake.llm.sharding import shard_documents
from gradelake.llm.spelling_variants import spelling_variants
from gradelake.llm.substring_dedup import substring_dedup
from gradelake.llm.token_counts import read_vocabulary, token_counts

TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def registered(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@registered("op1_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def _(spark, folder):
    return exact_dedup(documents(spark, folder)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@registered("op5_sharding")
def _(spark, folder):
    placed = shard_documents(documents(spark, folder), 40, f"{shared_root(spark)}/llm/slot-map-{uuid.uuid4().hex}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@registered("op9_packing")
def _(spark, folder):
    return pack(documents(spark, folder))


@registered("op3_decontaminate", f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark),
wins AS (SELECT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) t(i)),
found AS (SELECT doc_id, i, n, item FROM grams JOIN wins USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) t(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""")
def _(spark, folder):
    found = decontaminate(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@registered("op4_substring_dedup")
def _(spark, folder):
    found = substring_dedup(documents(spark, folder))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@registered("op7_quality_rules")
def _(spark, folder):
    return quality_scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@registered("op10_language_id")
def _(spark, folder):
    return languages(documents(spark, folder))


@registered("op2_token_counts")
def _(spark, folder):
    return token_counts(documents(spark, folder), read_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model"))


@registered("op8_near_dedup")
def _(spark, folder):
    return near_dedup(documents(spark, folder)).select("doc_id", "class_id", "class_size", "kept")


_MASK = "array_to_string(list_transform(regexp_extract_all(l, '\\S+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ')"


@registered("op6_line_templates", f"""
WITH l AS (SELECT doc_id, i, unnest.l AS l FROM documents, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {{'l': x, 'i': i}})) t(unnest), LATERAL (SELECT unnest.i) u(i)),
m AS (SELECT doc_id, i, l, {_MASK} AS line FROM l),
e AS (SELECT DISTINCT doc_id, line, string_split(line, ' ') AS t FROM m),
c AS (SELECT *, len(t) AS size, t[1:3] AS head FROM e WHERE len(t) >= 3),
leaf AS (SELECT size, head, count(*) AS total FROM c GROUP BY ALL HAVING count(*) >= 5),
n AS (SELECT size, head, line, t, total, count(*) AS n FROM c JOIN leaf USING (size, head) GROUP BY ALL),
p AS (SELECT size, head, line, n, total, t[k] AS token, k FROM n, unnest(range(1, size + 1)) r(k)),
s AS (SELECT size, head, k, token FROM p WHERE token <> '<*>' GROUP BY size, head, k, token, total HAVING sum(n) >= 5 AND sum(n) >= 0.1 * total),
g AS (SELECT p.size, p.head, line, string_agg(CASE WHEN s.token IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.k) AS template, avg(CASE WHEN s.token IS NULL THEN 0.0 ELSE 1.0 END) AS share
  FROM p LEFT JOIN s ON s.size = p.size AND s.head = p.head AND s.k = p.k AND s.token = p.token WHERE n < 5 GROUP BY p.size, p.head, line),
tm AS (SELECT line, line AS template FROM n WHERE n >= 5 UNION ALL SELECT line, template FROM g WHERE share >= 0.7),
o AS (SELECT template FROM (SELECT DISTINCT doc_id, template FROM e JOIN tm USING (line)) GROUP BY template HAVING count(*) >= 5),
r AS (SELECT DISTINCT line FROM tm JOIN o USING (template))
SELECT doc_id, count(*) AS n_lines, count(r.line) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN r.line IS NULL THEN l END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m LEFT JOIN r USING (line) GROUP BY doc_id""")
def _(spark, folder):
    found = drop_recurring_lines(documents(spark, folder))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@registered("op11_pivot_search", """
WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5""")
def _(spark, folder):
    return top_k(spark.read.parquet(f"{folder}/embeddings.parquet"))


@registered("op12_spelling_variants", """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h FROM counted, crc),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n AS k FROM hashed),
w AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) r(i)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word, n),
form AS (SELECT word, n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM best),
chain AS (SELECT word, form AS root FROM form WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM form WHERE form IS NOT NULL))
SELECT word, n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, word) AS root FROM w LEFT JOIN form USING (word) LEFT JOIN last USING (word)""")
def _(spark, folder):
    return spelling_variants(documents(spark, folder))


@registered("op13_fill_middle", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
  list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('1:' || doc_id), i, 8))::BIGINT) AS h FROM documents),
c AS (SELECT *, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[1:a], '') AS x, array_to_string(w[a + 1:b], '') AS y, array_to_string(w[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""")
def _(spark, folder):
    return fill_middle(documents(spark, folder)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))
