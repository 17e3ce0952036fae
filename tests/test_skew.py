"""Operators on inputs where one key holds most rows, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gradelake.functions import coords as X
from gradelake.operators import catalog as C
from gradelake.operators import keyed as K
from gradelake.operators import pages as PG
from gradelake.operators import quality as Q


def test_split_rank_hot_key(spark):
    # three quarters of the rows on one key, positions with holes
    df = spark.range(40000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 50).otherwise(7).alias("model_id"), (F.col("id") * 3).alias("pos"))
    got = K.split_rank(df, ["model_id"], ["pos"], [K.block_of("pos", 1000)], "n")
    from pyspark.sql import Window

    want = df.withColumn("n", F.row_number().over(Window.partitionBy("model_id").orderBy("pos")))
    assert got.select("model_id", "pos", "n").exceptAll(want).isEmpty()
    assert got.count() == 40000


def test_split_rank_never_gathers_a_whole_key(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("pos"))
    plan = K.split_rank(df, ["k"], ["pos"], [K.block_of("pos", 100)], "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # rows are numbered per (key, block); only the table of block sizes is ordered per key
    assert len(windows) == 2 and sum("row_number()" in w for w in windows) == 1
    assert all("[_at#" in w for w in windows if "row_number()" in w)


def test_split_rank_shuffles_rows_once_and_ranks_nulls(spark):
    df = spark.createDataFrame([(k, p, "x" * 50) for k in (None, 1, 2) for p in [None, *range(40)]], "k int, pos int, body string").repartition(3)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = K.split_rank(df, ["k"], ["pos"], [K.block_of("pos", 16)], "n")
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        rows = [line for line in plan.splitlines() if "Exchange hashpartitioning(_at" in line]
        assert len(rows) == 3  # the rows once; the counts of blocks, and these again as offsets
        assert sorted((r["k"] or 0, r["n"], -1 if r["pos"] is None else r["pos"]) for r in got.collect()) == [(k, i + 1, i - 1) for k in (0, 1, 2) for i in range(41)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_renumber_and_logical_order_hot_model(spark):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.8 else rng.randint(2, 20), i, f"Q{rng.randint(1, 30)}{rng.choice(['', '(a)', 'b', '(B)2'])}", f"q{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "model_id int, pos int, question_no string, id string")
    got = {(r.model_id, r.id): r.new_pos for r in C.logical_order(df).collect()}

    import re

    def key(label):
        parts = re.findall(r"\d+|[a-zA-Z]+", re.sub(r"(?i)^Q\s*", "", label))
        return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in parts]

    by_model: dict = {}
    for m, pos, no, qid in rows:
        by_model.setdefault(m, []).append((key(no), pos, qid))
    for m, qs in by_model.items():
        for n, (_, _, qid) in enumerate(sorted(qs), start=1):
            assert got[(m, qid)] == n


def test_fill_question_ids_hot_document(spark):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        doc = 1 if rng.random() < 0.8 else rng.randint(2, 9)
        rows.append((doc, i, rng.randint(1, 3000) if rng.random() < 0.4 else None, rng.randint(1, 6), round(rng.random() * 100, 3)))
    df = spark.createDataFrame(rows, "doc_id int, pos int, question_id int, start_page int, start_y double")
    got = {(r.doc_id, r.pos): r.question_id for r in PG.fill_question_ids(df).collect()}
    for doc in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == doc]
        used, nxt = {r[2] for r in mine if r[2]}, 1
        for r in sorted((r for r in mine if r[2] is None), key=lambda r: (r[3], r[4], r[1])):
            while nxt in used:
                nxt += 1
            assert got[(doc, r[1])] == nxt
            used.add(nxt)


@pytest.mark.parametrize("seed", [3, 4])
def test_overlap_counts_and_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        page = 1 if rng.random() < 0.7 else rng.randint(2, 4)
        r, c = rng.randint(1, 30), rng.randint(1, 20)
        rows.append((1, page, i, r, c, r + rng.randint(0, 3), c + rng.randint(0, 4)))
    df = spark.createDataFrame(rows, "doc_id int, page int, pos int, r1 int, c1 int, r2 int, c2 int").select(
        "doc_id", "page", "pos", F.struct("r1", "c1", "r2", "c2").alias("box"))
    pairs: dict = {}
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[2] < b[2] and a[3] <= b[5] and b[3] <= a[5] and a[4] <= b[6] and b[4] <= a[6]:
                pairs.setdefault(a[1], []).append((a[2], b[2]))
    assert {r.page: r.n for r in Q.overlap_counts(df).collect()} == {p: len(v) for p, v in pairs.items()}
    got: dict = {}
    for r in Q.overlap_pairs(df, limit=25).collect():
        got.setdefault(r.page, []).append((r.pos, r.pos2))
    assert {p: sorted(v) for p, v in got.items()} == {p: sorted(v)[:25] for p, v in pairs.items()}


def test_dedup_of_one_long_document(spark):
    rng = random.Random(9)
    texts, kinds = [], []
    for _ in range(1500):
        same = texts and rng.random() < 0.6
        texts.append(texts[-1] if same else f"page text number {rng.random()} with some words {rng.random()}")
        kinds.append("DUPLICATE" if rng.random() < 0.1 else "PARAGRAPH")
    rows = [(1, i + 1, k, t) for i, (k, t) in enumerate(zip(kinds, texts))] + [(2, 1, "PARAGRAPH", "a"), (2, 2, "PARAGRAPH", "a")]
    df = spark.createDataFrame(rows, "doc_id int, page int, page_type string, text string")
    got = {(r.doc_id, r.page): r.omitted for r in PG.dedup_pages(df).collect()}
    gone = []
    for i, (k, t) in enumerate(zip(kinds, texts)):
        dup = k == "DUPLICATE" and i > 0
        near = i > 0 and not gone[-1] and t == texts[i - 1]
        gone.append(dup or near)
    assert [got[(1, i + 1)] for i in range(1500)] == gone
    assert (got[(2, 1)], got[(2, 2)]) == (False, True)


def test_last_wins_sends_one_row_per_key_and_partition(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("ord"), (F.col("id") * 2).alias("v"))
    out = K.last_wins(df, ["k"], "ord")
    assert [tuple(r) for r in out.collect()] == [(1, 999, 1998)]
    assert "partial_max_by" in out._jdf.queryExecution().executedPlan().toString()


def test_samples_are_cut_before_the_shuffle(tables):
    from gradelake.plans.queries_quality import violations

    plan = Q.violation_samples(violations(tables), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_no_cartesian_products_in_any_plan(spark):
    from conftest import FOLDER
    from gradelake.plans.registry import spark_queries

    for name, build in spark_queries().items():
        plan = build(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        if name in ("a4_corpus_report",):
            continue  # joins a one-row total
        assert "Join Cross" not in plan and "Join Inner\n" not in plan, name


def test_coordinates_far_letters(spark):
    df = spark.createDataFrame([("ZZ1",), ("AAA7",), ("zzz2",), ("A0",), ("1A",), ("",), (None,), ("B2:A1",), ("A1:B2:C3",)], "t string")
    rows = df.select("t", X.cell_col("t").alias("c"), X.cell_row("t").alias("r"), X.range_bounds("t").alias("b")).collect()
    got = {r.t: (r.c, r.r) for r in rows}
    assert got["ZZ1"] == (702, 1) and got["AAA7"] == (703, 7) and got["zzz2"] == (18278, 2)
    assert got["1A"] == (None, None) and got[""] == (None, None)
    bounds = {r.t: r.b and tuple(r.b) for r in rows}
    assert bounds["B2:A1"] == (1, 1, 2, 2) and bounds["A1:B2:C3"] is None
