"""Real streams: violation rates from raw replies, placements in the state store, their log."""

from __future__ import annotations

import datetime as dt
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradelake.operators.grid import page_masks
from gradelake.streaming import flows


def folder() -> Path:
    return Path(tempfile.mkdtemp(prefix="streams-", dir="/tmp"))


def annotation(page, where, font=14, kind="none"):
    return {"page": page, "comment": "ok", "comment_font_pts": font, "comment_range": where, "anchor": {"type": kind}}


def reply(*annotations, score="A1:B2"):
    return json.dumps({"status": 1, "data": {"items": [{"question_id": "1", "marking": {"page": 1, "score_range": score, "score_box_range": "A1:C3"}, "annotations": list(annotations)}, "no object"]}})


REPLIES = [
    ("d1", "10:10", reply(annotation(1, "A1:E5"), annotation(1, "C3:H8"), annotation(1, "K1:L2"))),  # one pair
    ("d1", "10:50", reply(annotation(1, "A1:E5"), annotation(2, "C3:H8"))),  # other pages; page 2 has no grid
    ("d2", "10:20", reply(annotation(1, "A1:E5", 99), annotation(1, "A1:E5", kind="exponent_caret"), score="Z1")),
    ("d3", "10:59", "oops"), ("d3", "11:05", '{"data": {"items": []}}'), ("d4", "11:30", reply(annotation(1, "oops"))), ("d1", "12:15", reply(annotation(1, "A1:E5"))),
    ("d1", "10:15", reply(annotation(1, "A1:E5"), annotation(1, "E5:F6"))),  # arrives late
    ("d1", "19:00", reply(annotation(1, "A1:E5")))]


def rows(replies):
    return "\n".join(json.dumps({"doc_id": d, "received": f"2024-01-01T{at}:00Z", "raw": raw}) for d, at, raw in replies)


@pytest.fixture(scope="module")
def masks(spark):
    grid = spark.createDataFrame([(f"d{i}", 1, 20, 20, 24.0, 0.0, 0.0, 500.0, 500.0) for i in range(1, 5)],
                                 "doc_id string, page int, rows int, cols int, cell_size_pts double, left_margin_pts double, top_margin_pts double, page_w_pts double, page_h_pts double")
    cells = grid.select("doc_id", "page", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("row"), F.lit(True).alias("writable")).withColumn("col", F.explode(F.sequence(F.lit(1), F.lit(20))))
    return page_masks(cells, grid)


def run(spark, src, masks, progress, sink, late):
    q = flows.response_rates(flows.stream_responses(spark, src), masks, late=late).writeStream.format("parquet").option("path", sink).option(
        "checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()


def test_rates_straight_from_replies(spark, masks):
    """Two runs over one checkpoint; the windows equal those of the batch, late replies included, but for the last window, which is still open."""
    src, progress, sink = (str(folder()) for _ in range(3))
    late = "4 hours"
    Path(src, "a.json").write_text(rows(REPLIES[:5]))
    run(spark, src, masks, progress, sink, late)
    Path(src, "b.json").write_text(rows(REPLIES[5:8]))
    run(spark, src, masks, progress, sink, late)
    assert spark.read.schema("window_start timestamp, violations long, annotations long, rate double").parquet(sink).count() == 0
    Path(src, "c.json").write_text(rows(REPLIES[8:]))
    run(spark, src, masks, progress, sink, late)
    got = {r["window_start"]: tuple(r)[1:] for r in spark.read.parquet(sink).collect()}
    batch = {r["window_start"]: tuple(r)[1:] for r in flows.response_rates(spark.read.schema(flows.RESPONSE_SCHEMA).json(src), masks).collect()}
    last = max(batch)
    assert got == {k: v for k, v in batch.items() if k != last} and len(got) == 3
    # 10h: pairs d1 1 + d2 1 + late 1; no grid 1; font 1; caret 1; score 1. 11h: a range that does not parse.
    assert sorted(got.values()) == [(0, 1, 0.0), (1, 1, 1.0), (7, 9, 0.7778)]


def test_replies_beyond_the_watermark_are_left_out(spark, masks):
    src, progress, sink = (str(folder()) for _ in range(3))
    for name, part in (("a", REPLIES[6:7]), ("b", REPLIES[0:1]), ("c", REPLIES[8:])):
        Path(src, f"{name}.json").write_text(rows(part))
        run(spark, src, masks, progress, sink, "10 minutes")
    assert [tuple(r)[1:] for r in spark.read.parquet(sink).collect()] == [(0, 1, 0.0)]  # 10:10 came after 12:15


ACTIONS = "session_id long, key string, ord long, action string, page int, x int, y int, ts timestamp"


def action(key, n, kind, hour, session=1):
    return session, key, n, kind, 1, 10 * n, 20 * n, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour)


class Placements:
    def __init__(self, spark, **how):
        self.spark, self.how, (self.src, self.progress, self.log) = spark, how, (str(folder()) for _ in range(3))

    def send(self, *actions):
        self.spark.createDataFrame(list(actions), ACTIONS).coalesce(1).write.mode("append").parquet(self.src)
        with flows.rocksdb_state(self.spark):
            stream = flows.stream_placements(self.spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(self.src), **self.how)
            q = stream.writeStream.foreachBatch(flows.placements_log(self.log)).option("checkpointLocation", self.progress).outputMode("update").trigger(availableNow=True).start()
            q.awaitTermination()
        return self.state()

    def state(self):
        return {(r["session_id"], r["key"]): (r["ord"], r["action"]) for r in flows.read_placements(self.spark, self.log).collect()}


def test_latest_action_survives_restarts_and_disorder(spark):
    p = Placements(spark, late="100 hours")
    assert p.send(action("a", 5, "place", 5), action("a", 3, "remove", 3), action("b", 1, "place", 1)) == {(1, "a"): (5, "place"), (1, "b"): (1, "place")}
    assert p.send(action("a", 4, "remove", 4), action("b", 2, "remove", 2), action("b", 7, "place", 0, session=2)) == {(1, "a"): (5, "place"), (1, "b"): (2, "remove"), (2, "b"): (7, "place")}
    changes = {r["batch"]: r["n"] for r in spark.read.parquet(p.log).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(changes.values()) == 4  # the older action of a changed nothing
    last = flows.compact_placements(spark, p.log)
    before = p.state()
    broken = Path(p.log, f"base={last + 9}")
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert p.state() == before  # a base without its mark of success is not read
    assert p.send(action("a", 6, "remove", 6))[(1, "a")] == (6, "remove") and p.send(action("a", 1, "place", 5))[(1, "a")] == (6, "remove")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_tombstones_expire(spark):
    p = Placements(spark, late="2 hours", keep_removed_ms=3 * 3600 * 1000)
    p.send(action("a", 5, "place", 0), action("c", 5, "place", 0))
    p.send(action("a", 6, "remove", 1), action("c", 6, "remove", 1))
    p.send(action("c", 7, "place", 2))  # placed again: its timer must not clear it
    assert p.send(action("a", 4, "place", 1.5))[(1, "a")] == (6, "remove")  # before the tombstone goes, an older placement changes nothing
    p.send(action("z", 1, "place", 30))  # the watermark passes the timers
    p.send(action("z", 2, "place", 31))
    p.send(action("a", 3, "place", 30), action("c", 3, "place", 30))
    changes = {(r["key"], r["ord"]) for r in spark.read.parquet(p.log).collect()}
    assert ("a", 3) in changes and ("c", 3) not in changes


def test_a_repeated_batch_gives_the_same_log(spark):
    path = str(folder())
    sink, batch = flows.placements_log(path), spark.createDataFrame([action("a", 1, "place", 0)], ACTIONS).drop("ts")
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(path).count() == 1 and flows.read_placements(spark, path).count() == 1
    with pytest.raises(ValueError):
        flows.read_placements(spark, str(folder()))
