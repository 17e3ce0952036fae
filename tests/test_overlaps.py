"""Overlap counts by annotation, crowded pages, and the corpus report."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.functions import coords as X
from gradelake.functions import dominance
from gradelake.functions.dominance import overlap_degrees
from gradelake.operators import quality as Q

RECTS = "doc_id string, page int, annotation_index int, row long, box struct<r1:int,c1:int,r2:int,c2:int>"


def boxes(rng, n, top, most):
    out = []
    for _ in range(n):
        r, c = rng.randint(1, top), rng.randint(1, top)
        out.append((r, c, r + rng.randint(0, most), c + rng.randint(0, most)))
    return out


def meets(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


@pytest.mark.parametrize("n,groups,top,most", [(0, 1, 1, 0), (1, 1, 5, 0), (60, 1, 9, 3), (300, 5, 40, 9), (300, 2, 10**9, 10**8), (250, 40, 4, 4)])
def test_degrees_against_all_pairs(n, groups, top, most):
    rng = random.Random(n)
    found, group, often = boxes(rng, n, top, most), [rng.randrange(groups) for _ in range(n)], [rng.randint(1, 3) for _ in range(n)]
    r1, c1, r2, c2 = np.array(found, dtype=np.int64).reshape(n, 4).T
    got = overlap_degrees(np.array(group, dtype=np.int64), r1, r2, c1, c2, np.array(often, dtype=np.int64))
    assert got.tolist() == [sum(k for b, g, k in zip(found, group, often) if g == group[i] and meets(found[i], b)) - 1 for i in range(n)]


def test_each_annotation_has_its_count(spark):
    rng = random.Random(7)
    rows = [(d, p, i, 5, b) for d in ("a", "b", None) for p in (1, 2, None) for i, b in enumerate(boxes(rng, 40, 12, 4) + [None, (1, 1, 3, 3), (1, 1, 3, 3), (90, 10**9, 95, 10**9)])]
    got = {(r["doc_id"], r["page"], r["annotation_index"]): r["overlaps"] for r in Q.annotation_overlaps(spark.createDataFrame(rows, RECTS).repartition(5)).collect()}
    assert len(got) == len(rows)
    for d, p, i, _, b in rows:
        assert got[(d, p, i)] == (sum(meets(b, o[4]) for o in rows if o[4] and o[:2] == (d, p)) - 1 if b else 0)
    pages = {(r["doc_id"], r["page"]): r["n"] for r in Q.overlap_counts(spark.createDataFrame(rows, RECTS)).collect()}
    assert all(2 * n == sum(v for k, v in got.items() if k[:2] == page) for page, n in pages.items()) and len(pages) == 9
    assert Q.annotation_overlaps(spark.createDataFrame([], RECTS)).collect() == []


def test_a_page_of_100_000_annotations_off_the_grid(spark):
    """Far more pairs than could be listed; ranges lie anywhere up to row 10^8. Runs beside small pages, in small Arrow batches."""
    n = 150_000
    spot = F.struct(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)) + F.lit(1)).cast("int").alias(x) for k, (x, m) in enumerate((("r", 10**8), ("c", 10**5), ("h", 10**7), ("w", 10**4)))])
    crowd = spark.range(n).withColumn("s", spot).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("d"), F.col("id") % 1000)).otherwise("hot").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("annotation_index"),
        F.struct(F.col("s.r").alias("r1"), F.col("s.c").alias("c1"), (F.col("s.r") + F.col("s.h")).alias("r2"), (F.col("s.c") + F.col("s.w")).alias("c2")).alias("box"))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    try:
        got = Q.annotation_overlaps(crowd).select("doc_id", "annotation_index", "overlaps", "box.*").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(got) == n and got["overlaps"].sum() > 3_000_000
    for doc in ("hot", "d3"):
        page = got[got["doc_id"] == doc]
        for _, a in page.head(40).iterrows():
            same = page[(page["r1"] <= a["r2"]) & (page["r2"] >= a["r1"]) & (page["c1"] <= a["c2"]) & (page["c2"] >= a["c1"])]
            assert a["overlaps"] == len(same) - 1


def test_equal_boxes_cost_one_row(spark):
    rects = spark.range(50_000).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.expr("named_struct('r1', 1, 'c1', 1, 'r2', 2, 'c2', 2)").alias("box"))
    assert [r.asDict() for r in Q.overlap_boxes(rects).collect()] == [{"doc_id": "d", "page": 1, "r1": 1, "c1": 1, "r2": 2, "c2": 2, "n": 50_000, "overlaps": 49_999}]
    assert Q.overlap_counts(rects).first()["n"] == 50_000 * 49_999 // 2


def test_colliding_annotations_are_named(spark):
    anns = spark.createDataFrame([("d", 0, i, 1, "x", "14", r, None, None) for i, r in enumerate(["A1:C2", "C2:D9", "ZZ99:AAA100", "F1:F2", "oops", None, "F2:F2", "AAA100:AAA100"])],
                                 "doc_id string, item_index int, annotation_index int, page int, comment string, comment_font_pts string, comment_range string, comment_rows array<string>, "
                                 "anchor struct<type:string,rows:array<string>,extra:map<string,string>>")
    grid = spark.createDataFrame([("d", 1, 20, 20, 24.0, 0.0, 0.0, 500.0, 500.0, ["1" * 20] * 20)],
                                 "doc_id string, page int, rows int, cols int, cell_size_pts double, left_margin_pts double, top_margin_pts double, page_w_pts double, page_h_pts double, mask array<string>")
    got = {r["annotation_index"]: r["overlaps"] for r in Q.colliding_annotations(Q.check_annotations(anns, grid)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 7: 1, 3: 1, 6: 1}


def report(spark, found, annotations):
    v = spark.createDataFrame(found, "doc_id string, invariant string, page int, item_index int, annotation_index int, n long, check_no int, detail string")
    return v, spark.createDataFrame([(d,) for d in annotations], "doc_id string")


def test_report_of_an_empty_and_a_clean_corpus(spark):
    assert [tuple(r) for r in Q.corpus_report(*report(spark, [], [])).collect()] == [("overall", None, None, 0, 0.0, True)]
    assert [tuple(r) for r in Q.corpus_report(*report(spark, [], ["a"] * 3)).collect()] == [("overall", None, None, 0, 0.0, True)]


def test_report_levels_and_samples(spark):
    found = [("a", "I5", 1, 0, i, 1, 2, "font") for i in range(9)] + [("a", "I7", 1, None, None, 4, 11, "x"), ("b", "I4", 2, 3, None, 1, 0, "s"), ("c", "I4", 2, 3, None, 1, 0, "s")]
    v, anns = report(spark, found, ["a"] * 20 + ["b"] * 3 + ["z"] * 7)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in Q.corpus_report(v, anns).collect()}
    assert got == {("document", "I5", "a"): (9, 45.0, None), ("document", "I7", "a"): (4, 20.0, None), ("document", "I4", "b"): (1, 33.3333, None), ("document", "I4", "c"): (1, 100.0, None),
                   ("invariant", "I5", None): (9, 30.0, None), ("invariant", "I7", None): (4, 13.3333, None), ("invariant", "I4", None): (2, 6.6667, None), ("overall", None, None): (15, 50.0, False)}
    items = spark.createDataFrame([("a",), ("b",), ("z",)], "doc_id string")
    reports = {r["doc_id"]: r for r in Q.document_reports(v, items, anns).collect()}
    assert [(s["sample_no"], s["invariant"], s["annotation_index"]) for s in reports["a"]["violations_sample"]] == [(k + 1, "I5", k) for k in range(5)]
    assert reports["a"]["counts"] == {"I5": 9, "I7": 4} and reports["z"]["counts"] == {} and reports["z"]["violations_sample"] == []


def test_report_reads_the_violations_once(spark):
    v, anns = report(spark, [("a", "I5", 1, 0, 0, 1, 2, "font")], ["a"])
    rows = X.range_bounds("detail")  # any marker that shows where the violations are computed
    plan = Q.corpus_report(v.withColumn("n", F.when(rows.isNull(), F.col("n"))), anns)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 1


def test_rects_are_parsed_once(spark):
    """The rows are read twice; whatever makes their boxes runs once."""
    tokens = spark.range(20).selectExpr("id % 2 AS doc_id", "1 AS page", "id AS annotation_index", "concat('A', 1 + id, ':C', 2 + id) AS t")
    found = Q.annotation_overlaps(tokens.select("doc_id", "page", "annotation_index", X.range_bounds("t").alias("box")))
    assert "regexp_extract" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["overlaps"] for r in found.collect()} == {0}


def test_small_and_large_groups_are_counted_alike(monkeypatch):
    rng = random.Random(5)
    group = np.array([0] * 30 + [1] * 3 + [2] * 60 + [0] * 5, dtype=np.int64)
    r1, c1, r2, c2 = np.array(boxes(rng, len(group), 15, 5), dtype=np.int64).T
    often = np.array([rng.randint(1, 3) for _ in group], dtype=np.int64)
    every = []
    for small in (0, 40, 256):
        monkeypatch.setattr(dominance, "SMALL", small)
        every.append(overlap_degrees(group, r1, r2, c1, c2, often).tolist())
    assert every[0] == every[1] == every[2]
