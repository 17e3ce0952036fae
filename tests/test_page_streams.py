"""Page steps read many pages in one stream of batches instead of one call a page."""

from __future__ import annotations

import random

from gradelake.operators import raster as RA
from gradelake.operators import zones as Z

POINTS = "doc_id string, page int, pos int, proximity double, y_pct double, x_pct double"


def picked(rows, n, spacing):
    taken = []
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        if len(taken) < n and all(((r[4] - t[4]) ** 2 + (r[5] - t[5]) ** 2) ** 0.5 >= spacing for t in taken):
            taken.append(r)
    return [(i, round(1.0 - t[3], 4), round(max(0.0, t[4] - 2.5), 2)) for i, t in enumerate(taken, start=1)]


def test_diverse_points_across_batches(spark):
    rng = random.Random(9)
    rows = [(d, p, k, rng.choice([0.0, 0.01, 0.03, 0.2]), rng.uniform(0, 100), rng.uniform(0, 100)) for d in ("a", "b", None) for p in (1, 2, 3) for k in range(50)]
    df = spark.createDataFrame(rows + [("a", 1, 99, None, 1.0, 1.0)], POINTS).repartition(3)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for n, spacing in ((4, 12.0), (10, 0.0), (6, 40.0)):
            out = Z.diverse_points(df, n, spacing, sample_rows=20, sample_cols=8)
            assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
            got = {}
            for r in sorted(out.collect(), key=lambda r: r["pick"]):
                got.setdefault((r["doc_id"], r["page"]), []).append((r["pick"], r["score"], r["y_start_percent"]))
            assert got == {(d, p): picked([r for r in rows if r[:2] == (d, p) and r[3] <= 0.04], n, spacing) for d in ("a", "b", None) for p in (1, 2, 3)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert Z.diverse_points(df.filter("false")).collect() == []


def test_zones_are_found_once_and_sent_once_a_group(spark, tables):
    from gradelake.plans.registry import spark_queries

    plan = spark_queries()["u2_assign_zones"](spark, tables.folder)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "collect_list" not in plan and "Broadcast" not in plan


def test_rasters_are_packed_in_one_step(spark):
    rng = random.Random(2)
    sizes = {("a", 1): (5, 7), ("a", 2): (1, 1), ("b", 1): (40, 300)}
    values = {page: [[rng.randint(0, 255) for _ in range(w)] for _ in range(h)] for page, (h, w) in sizes.items()}
    pixels = [(d, p, y, x, v) for (d, p), lines in values.items() for y, line in enumerate(lines) for x, v in enumerate(line)]
    rng.shuffle(pixels)
    packed = RA.rasters_from_pixels(spark.createDataFrame(pixels, "doc_id string, page int, y int, x int, value int").repartition(3))
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    got = {(r.doc_id, r.page): (r["height"], r["width"], bytes(r["data"])) for r in packed.collect()}
    assert got == {page: (*sizes[page], bytes(v for line in lines for v in line)) for page, lines in values.items()}
    ink = RA.raster_ink(packed).groupBy("doc_id", "page").count().collect()  # pages of different length in one batch
    assert {(r["doc_id"], r["page"]) for r in ink} <= set(sizes)


def test_calls_see_plain_values_and_no_frames(spark):
    from gradelake.operators import infer

    df = spark.createDataFrame([(i, None if i % 3 == 0 else i, None if i % 2 else "x") for i in range(100)], "id long, n long, t string")

    def kinds(row):
        return {"n": type(row["n"]).__name__, "t": type(row["t"]).__name__, "twice": row["n"] and 2 * row["n"]}

    out = infer.enrich(df, kinds, ["id"], "n string, t string, twice double", piece=7, in_flight=3)
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["n"], r["t"], r["twice"], r["error"]) for r in out.collect()}
    assert got == {i: ("NoneType" if i % 3 == 0 else "int", "NoneType" if i % 2 else "str", None if i % 3 == 0 else 2.0 * i, None) for i in range(100)}
