"""Part tables with a manifest, caches, schema versions, and enrichment with calls in flight."""

from __future__ import annotations

import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradelake.operators import infer
from gradelake.sources import manifest as MA


def table(spark) -> MA.PartTable:
    return MA.PartTable(spark, "file:" + tempfile.mkdtemp(prefix="parts-", dir="/tmp"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_only_published_parts_are_seen(spark):
    t = table(spark)
    assert t.read() is None and t.version() == 0 and t.compact() == 0
    one = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    assert t.add(one) == 1 and t.add(one.limit(0)) == 2
    folder = Path(t.path.removeprefix("file:"))
    one.write.parquet(f"{folder}/parts/part-broken")  # a run that ended before its manifest
    (folder / "manifests" / "draft-half").write_bytes(b"[{")
    assert rows(t.read()) == [(1, "a"), (2, None)]
    early = t.parts(1)
    assert t.add(spark.createDataFrame([(3, "c")], "id long, x string")) == 3 and t.parts(1) == early
    assert t.compact() == 4 and len(t.parts()) == 1 and rows(t.read()) == [(1, "a"), (2, None), (3, "c")]


def test_writers_at_once_keep_each_others_parts(spark):
    t, other = table(spark), None
    other = MA.PartTable(spark, t.path)
    one = spark.createDataFrame([(1,)], "id long")
    t.add(one)
    seen = []

    def meanwhile(old):
        if not seen:  # another driver publishes between reading and renaming
            seen.append(other.add(spark.createDataFrame([(2,)], "id long")))
        return [*old, {"name": "none", "schema": one.schema.json(), "run": 9}]

    assert t._publish(meanwhile) == 3 and [p["run"] for p in t.parts()] == [1, 2, 9]


def test_compaction_keeps_the_last_run_of_each_key_and_later_parts(spark):
    t = table(spark)
    for n, ids in enumerate(([1, 2, 3], [2, 2], [3])):
        t.add(spark.createDataFrame([(i, 10 * n + k) for k, i in enumerate(ids)], "id int, v int"))
    t.compact(["id"])
    got = dict(rows(t.read()))
    assert got[1] == 0 and got[3] == 20 and got[2] in (10, 11) and len(rows(t.read())) == 3
    t.add(spark.createDataFrame([(9, 9)], "id int, v int"))
    assert len(t.parts()) == 2 and len(rows(t.read())) == 4
    assert {r["run"] for r in t.read(run="run").collect()} == {3, 4}


def test_schema_versions_with_defaults(spark):
    t = table(spark)
    t.add(spark.createDataFrame([(1, "a")], "id long, title string"))
    t.add(spark.createDataFrame([("essay", 2, "b"), (None, 3, "c")], "booklet_type string, id long, title string"))
    t.add(spark.createDataFrame([(4, "d", None, None, True)], "id long, title string, booklet_type string, intro_page int, flag boolean"))
    t.add(spark.createDataFrame([(5, "e")], "id long, title string"))
    defaults = {"booklet_type": "standard", "intro_page": 2}
    want = {1: ("standard", 2, None), 2: ("essay", 2, None), 3: ("standard", 2, None), 4: ("standard", 2, True), 5: ("standard", 2, None)}
    assert {r["id"]: (r["booklet_type"], r["intro_page"], r["flag"]) for r in t.read(defaults).collect()} == want
    kept = {r["id"]: (r["booklet_type"], r["intro_page"]) for r in t.read(defaults, fill=False).collect()}
    assert kept[3] == (None, 2) and kept[4] == (None, None) and kept[1] == ("standard", 2)
    assert t.read(defaults)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3  # one per schema
    t.compact(defaults=defaults)
    assert {r["id"]: (r["booklet_type"], r["intro_page"], r["flag"]) for r in t.read().collect()} == want


def test_cache_computes_each_content_once(spark):
    t, seen = table(spark), []

    def work(df):
        seen.append(sorted(r["cache_key"] for r in df.collect()))
        return df.select("cache_key", F.upper("x").alias("y"))

    src = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b"), (None, "z")], "cache_key string, x string")
    assert rows(MA.cached(src, t, work)) == [("k1", "A"), ("k2", "B")]
    more = src.unionByName(spark.createDataFrame([("k3", "c")], src.schema)).filter("coalesce(cache_key, '') <> 'k1'")
    assert rows(MA.cached(more, t, work)) == [("k2", "B"), ("k3", "C")]
    MA.cached(more, t, work)
    assert seen == [["k1", "k2"], ["k3"]]
    assert MA.cached(src.limit(0), table(spark), lambda df: df).collect() == []


def test_stage_runs_over_one_manifest(spark):
    t, seen = table(spark), []

    def work(ok):
        def stage(df):
            seen.append(sorted(r.doc_id for r in df.collect()))
            return df.withColumn("items", F.when(ok, F.lit(len(seen))))
        return stage

    docs = spark.range(1, 5).select(F.col("id").alias("doc_id"))
    MA.run_parts(t, docs, work(F.col("doc_id") != 3), ["items"])

    def broken(df):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        MA.run_parts(t, docs, broken, ["items"])
    got = MA.run_parts(t, docs, work(F.lit(True)), ["items"])
    assert seen == [[1, 2, 3, 4], [3]] and rows(got) == [(1, 1), (2, 1), (3, 2), (4, 1)]
    t.compact(["doc_id"])
    assert rows(MA.run_parts(t, docs, broken, ["items"])) == [(1, 1), (2, 1), (3, 2), (4, 1)]  # nothing is open


def slow_model(pause):
    def fn(row):
        import threading

        state = fn.__dict__.setdefault("state", {"lock": threading.Lock(), "active": 0})
        with state["lock"]:
            state["active"] += 1
            peak = state["active"]
        time.sleep(pause)
        with state["lock"]:
            state["active"] -= 1
        return {"twice": 2 * row["id"], "peak": peak}
    return fn


@pytest.mark.parametrize("n", [1, 4])
def test_n_calls_at_once(spark, n):
    src = spark.range(0, 40, 1, 1).withColumn("text", F.lit("x"))
    got = infer.enrich(src, slow_model(0.02), ["id"], "twice long, peak int", in_flight=n, piece=8).collect()
    assert [(r["id"], r["twice"], r["tries"], r["error"]) for r in got] == [(i, 2 * i, 1, None) for i in range(40)]  # in order
    assert max(r["peak"] for r in got) == n


def test_failed_calls_wait_and_end_in_error_rows(spark):
    def fn(row):
        seen = fn.__dict__.setdefault("seen", {})
        seen.setdefault(row["id"], []).append(time.monotonic())
        if row["id"] % 3 == 0 or (row["id"] % 3 == 1 and len(seen[row["id"]]) == 1):
            raise ValueError("busy")
        at = seen[row["id"]]
        return {"pause": at[-1] - at[0]}

    src = spark.range(0, 12, 1, 1)
    got = infer.enrich(src, fn, ["id"], "pause double", attempts=3, in_flight=6, wait=0.05, longest_wait=0.06).collect()
    assert [(r["tries"], r["error"]) for r in got] == [(3, "ValueError: busy"), (2, None), (1, None)] * 4
    assert all(r["pause"] >= 0.05 for r in got if r["tries"] == 2)
    with pytest.raises(ValueError):
        infer.enrich(src, fn, ["id"], "pause double", in_flight=0)


def test_enrichment_goes_on_where_it_broke_off(spark):
    t = table(spark)

    def model(fails):
        def fn(row):
            if row["id"] % 5 == fails:
                raise ValueError("no reply")
            return {"twice": 2 * row["id"], "round": fails}
        return fn

    src = spark.range(0, 20, 1, 2)
    first = infer.enrich_open(src, t, model(1), ["id"], "twice long, round int", attempts=1, in_flight=3)
    assert first.filter("error IS NOT NULL").count() == 4
    again = infer.enrich_open(src.unionByName(spark.range(20, 25)), t, model(9), ["id"], "twice long, round int")
    assert sorted((r["id"], r["twice"], r["round"]) for r in again.collect()) == [(i, 2 * i, 9 if i >= 20 or i % 5 == 1 else 1) for i in range(25)]
