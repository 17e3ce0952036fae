"""Files and streams: reading, writing, resuming, and the streaming flows."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradelake.sources import files as FI
from gradelake.sources import responses as RE
from gradelake.sources import stages as ST
from gradelake.streaming import flows


def folder() -> Path:
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def response(page: int, wrap: bool) -> str:
    inner = {"pageCount": 4, "items": [{"question_id": 2, "student_answer": "s", "marking": {"page": page, "score_range": "C5", "score_box_range": "B4:F7"},
             "annotations": [{"page": page, "comment": "c", "comment_rows": ["G3:K3"], "anchor": {"type": "underline", "rows": ["B7:H7"], "extra": {"k": "v"}}}, "junk"]}],
             "cellGridMeta": [{"page": page, "rows": 35, "cols": 24, "cell_size_pts": 24, "left_margin_pts": 9.5, "top_margin_pts": 1, "page_w_pts": 595, "page_h_pts": 842, "grid_version": "v4"}]}
    return json.dumps({"status": 1, "data": inner} if wrap else inner, indent=1)


def test_scan_pdfs_and_images(spark):
    d = folder()
    (d / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (d / "b.pdf").write_bytes(b"")
    (d / "c.pdf").write_bytes(b"hello")
    (d / "d.txt").write_bytes(b"%PDF")
    (d / "e.pdf").write_bytes(b"%PDF" + b"x" * 100)
    ok, bad = FI.scan_pdfs(spark, str(d), max_bytes=50)
    assert [Path(r.path).name for r in ok.collect()] == ["a.pdf"]
    assert {Path(r.path).name: r.reason for r in bad.collect()} == {"c.pdf": "no_pdf_header", "d.txt": "not_pdf", "e.pdf": "too_large"}
    i = folder()
    (i / "1").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    (i / "2").write_bytes(bytes.fromhex("FFD8FF00"))
    (i / "3").write_bytes(b"")
    good, empty = FI.scan_page_images(spark, str(i))
    assert sorted(r.mime for r in good.collect()) == ["image/jpeg", "image/png"]
    assert empty.count() == 0  # zero-byte files never leave the file source
    rows = spark.createDataFrame([("x.pdf", 0, bytearray())], "path string, length bigint, content binary")
    assert [r.reason for r in FI.judge_pdfs(rows)[1].collect()] == ["empty"] and FI.judge_images(rows)[1].count() == 1


def test_read_responses_both_shapes(spark):
    d = folder()
    (d / "x1.json").write_text(response(2, True))
    (d / "x2.json").write_text(response(3, False))
    parts = RE.read_responses(spark, str(d))
    assert sorted((r.doc_id, r.marking_page, r.score_range) for r in parts["items"].collect()) == [("x1", 2, "C5"), ("x2", 3, "C5")]
    a = parts["annotations"].orderBy("doc_id").collect()
    assert [(r.doc_id, r.page, r.comment_rows, r.anchor.type, r.anchor.extra) for r in a] == [("x1", 2, ["G3:K3"], "underline", {"k": "v"}), ("x2", 3, ["G3:K3"], "underline", {"k": "v"})]
    assert parts["page_grid"].count() == 2 and parts["quarantine"].count() == 2


def test_envelopes_round_trip(spark, tables):
    from gradelake.operators import pages as PG

    items = tables.fx_items.select("doc_id", "question_id", F.struct("question_id", "student_answer").alias("item"))
    env = RE.envelopes(tables.fx_docs, items, tables.fx_page_grid, PG.skipped_pages(tables.fx_docs, tables.fx_items))
    out = str(folder() / "out")
    RE.write_responses(env, out, buckets=4)
    back = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert len(back) == tables.fx_docs.count()
    assert all(b["status"] == 1 and len(b["data"]["cellGridMeta"]) == b["data"]["pageCount"] for b in back)
    assert sum(len(b["data"]["items"]) for b in back) == tables.fx_items.count()
    again = RE.parse_responses(env.select(F.col("doc_id"), F.col("json").alias("raw")))
    assert again["items"].count() == tables.fx_items.count() and again["quarantine"].count() == 0


def test_stage_runs_only_open_documents(spark):
    name = folder().name
    seen = []

    def work(df):
        seen.append(sorted(r.doc_id for r in df.collect()))
        return df.withColumn("items", F.when(F.col("doc_id") != 3, F.lit(1)))

    docs = spark.range(1, 4).select(F.col("id").alias("doc_id"))
    ST.run_stage(spark, name, docs, work, ["items"])
    ST.run_stage(spark, name, docs, work, ["items"])
    ST.run_stage(spark, name, docs.unionByName(spark.range(9, 10).select(F.col("id").alias("doc_id"))), work, ["items"])
    assert seen == [[1, 2, 3], [3], [3, 9]]
    found = ST.run_stage(spark, name, docs, lambda df: work(df).withColumn("items", F.lit(2)), ["items"])
    assert sorted((r.doc_id, r["items"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 2), (9, 1)]  # each document once


def test_shared_folder_is_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from gradelake.session import checkpoint_root

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        checkpoint_root(cluster)


def test_unreadable_stage_table_is_an_error(spark):
    name = folder().name
    docs = spark.range(1, 3).select(F.col("id").alias("doc_id"))
    ST.run_stage(spark, name, docs, lambda df: df.withColumn("items", F.lit(1)), ["items"])
    from gradelake.session import checkpoint_root

    part = next(Path(checkpoint_root(spark).removeprefix("file:") + f"/stages/{name}/run=1").glob("*.parquet"))
    part.write_bytes(b"no parquet")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        ST.run_stage(spark, name, docs, lambda df: df.withColumn("items", F.lit(1)), ["items"]).collect()


def test_streaming_intake_and_rates(spark):
    src, good, bad, ck = (str(folder()) for _ in range(4))
    lines = [{"doc_id": f"d{i}", "received": f"2024-01-01T0{i}:10:00Z", "raw": response(2, True) if i % 3 else "oops"} for i in range(6)]
    (Path(src) / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    stream = flows.stream_responses(spark, src)
    q = stream.writeStream.foreachBatch(flows.intake_batch(good, bad)).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(good).collect()) == ["d1", "d2", "d4", "d5"]
    assert sorted(r.doc_id for r in spark.read.parquet(bad).collect()) == ["d0", "d3"]
    counts = flows.stream_responses(spark, src).select("received", F.lit(2).alias("violations"), F.lit(4).alias("annotations"))
    q = flows.telemetry_windows(counts, late="1 minute").writeStream.format("memory").queryName("rates").outputMode("append").option(
        "checkpointLocation", str(folder())).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("rates").collect()
    assert len(rows) == 5 and {r.rate for r in rows} == {0.5}  # the last window is still open


def test_streaming_dedup(spark):
    src = str(folder())
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:01:00", "b"), ("2024-01-01 00:02:00", "a")], "received string, content string").select(
        F.to_timestamp("received").alias("received"), F.encode("content", "UTF-8").alias("content"))
    rows.write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = flows.stream_dedup(stream).writeStream.format("memory").queryName("uniq").option("checkpointLocation", str(folder())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("uniq").count() == 2
