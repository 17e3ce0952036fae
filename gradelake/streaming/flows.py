"""Structured Streaming flows: intake, violation rates, placements, idempotent files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from gradelake.functions.coords import round_even
from gradelake.functions.dominance import overlap_degrees
from gradelake.operators import quality
from gradelake.operators.keyed import last_wins
from gradelake.sources.responses import is_object, parse_responses
from gradelake.sources.stages import finished_parts

RESPONSE_SCHEMA = "doc_id string, received timestamp, raw string"


def stream_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Responses arriving as JSON lines of (doc_id, received, raw)."""
    return spark.readStream.schema(RESPONSE_SCHEMA).json(folder)


def intake_batch(accepted: str, rejected: str):
    """foreachBatch sink: readable responses and rejects go to their own tables."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        # both writes read the batch, so keep it; the id makes a repeated batch overwrite itself
        kept = batch.withColumn("_v", F.try_parse_json("raw")).withColumn("_ok", is_object("_v")).drop("_v").persist()
        kept.filter("_ok").drop("_ok").write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        kept.filter("NOT _ok").drop("_ok").write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        kept.unpersist()

    return sink


def telemetry_windows(counts: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Violations per annotation in tumbling windows; works on batch and streams.

    ``counts``: received, violations, annotations (one row per response).
    """
    return _rates(counts.withWatermark("received", late), "received", width)


def _rates(counts: DataFrame, time: str, width: str) -> DataFrame:
    w = counts.groupBy(F.window(time, width).alias("w")).agg(F.sum("violations").alias("violations"), F.sum("annotations").alias("annotations"))
    rate = F.when(F.col("annotations") > 0, round_even(F.col("violations") / F.col("annotations"), 4)).otherwise(0.0)
    return w.select(F.col("w.start").alias("window_start"), "violations", "annotations", rate.alias("rate"))


@F.arrow_udf(LongType())
def crossing_pairs(boxes: pa.Array) -> pa.Array:
    """How many pairs of boxes of each list meet; all lists of a batch are counted at once."""
    boxes = boxes.fill_null(pa.scalar([], boxes.type)) if boxes.null_count else boxes
    lengths = np.diff(boxes.offsets.to_numpy())
    which = np.repeat(np.arange(len(boxes)), lengths)
    sides = [boxes.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("r1", "r2", "c1", "c2")]
    met = overlap_degrees(which, *sides, np.ones(len(which), dtype=np.int64))
    return pa.array(np.bincount(which, weights=met, minlength=len(boxes)).astype(np.int64) // 2)


def response_rates(raw: DataFrame, masks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Violations per annotation in tumbling windows, straight from incoming replies; works on batch and streams.

    ``raw``: doc_id, received, raw (``RESPONSE_SCHEMA``); ``masks``: the analysed pages (``page_masks``), a table. Replies are parsed and their annotations
    and scores checked row by row. Overlaps need the annotations of a page together: a first aggregation gathers them by (window, reply, page), which
    the size of a reply bounds, and a second one sums the windows. The watermark passes from the first to the second, so a reply may be late
    by ``late``, and a window is handed out once, when it is complete. Replies that cannot be read count nothing. A window with replies but no
    annotations has rate 0.
    """
    keep = ("received", "reply")
    reply = F.struct("doc_id", "received", F.xxhash64("raw").alias("hash"))
    parsed = parse_responses(raw.withWatermark("received", late).withColumn("reply", reply), keep)
    annotations, items = parsed["annotations"], parsed["items"]
    checked = quality.check_annotations(annotations, masks)
    box = F.struct(*[F.col(f"box.{x}").alias(x) for x in ("r1", "r2", "c1", "c2")])
    facts = checked.select(*keep, "page", F.lit(0).cast("long").alias("n"), F.lit(1).alias("a"), F.when(F.col("box").isNotNull(), box).alias("box"))
    for found in (quality.annotation_violations(checked, keep), quality.score_violations(items, keep)):
        facts = facts.unionByName(found.select(*keep, "page", "n", F.lit(0).alias("a")), allowMissingColumns=True)
    pages = facts.groupBy(F.window("received", width).alias("w"), "reply", "page").agg(
        F.sum("n").alias("n"), F.sum("a").alias("annotations"), F.collect_list("box").alias("boxes"))
    counts = pages.select(F.window_time("w").alias("at"), (F.col("n") + crossing_pairs("boxes")).alias("violations"), "annotations")
    return _rates(counts, "at", width)


def merge_placements(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Latest action per (session, key) after a micro-batch; removals stay as tombstones."""
    return last_wins(current.unionByName(batch), ["session_id", "key"], "ord")


PLACED = ("ord", "action", "page", "x", "y")


class LatestAction(StatefulProcessor):
    """The latest action of one (session, key), in one value of the state store.

    An action older than the kept one changes nothing. A removal stays as a tombstone, so that a late placement does not bring the key back,
    until a timer ``keep_ms`` after its time clears it. A newer action leaves the timer without effect.
    """

    def __init__(self, kept: StructType, keep_ms: int):
        self.kept, self.keep_ms = kept, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("latest", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = self.state.get()
        newest = max((r for r in rows), key=lambda r: r["ord"])
        if best is None or newest["ord"] > best[0]:
            values = tuple(newest[c] for c in PLACED)
            expires = int(newest["ts"].timestamp() * 1000) + self.keep_ms if newest["action"] == "remove" else None
            self.state.update((*values, expires))
            if expires is not None:
                self.handle.registerTimer(expires)
            yield Row(**dict(zip(("session_id", "key", *PLACED), (*key, *values))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        best = self.state.get()
        if best is not None and best[-1] is not None and best[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_placements(actions: DataFrame, late: str = "1 hour", keep_removed_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Running latest action per (session, key) of a stream; a row on every change.

    ``actions``: session_id, key, ord, action, page, x, y and ts, the time of the action. Rows later than ``late`` are dropped, as in every
    watermarked stream; tombstones go ``keep_removed_ms`` after their removal, so ``late`` should be shorter. The session must keep its
    state in RocksDB (``rocksdb_state``): state then lives on disk beside the executor and in the checkpoint, not on the heap.
    """
    types = {f.name: f for f in actions.schema}
    kept = StructType([*[StructField(c, types[c].dataType) for c in PLACED], StructField("expires", LongType())])
    out = StructType([types[c] for c in ("session_id", "key", *PLACED)])
    return actions.withWatermark("ts", late).groupBy("session_id", "key").transformWithState(
        LatestAction(kept, keep_removed_ms), out, "Update", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; afterwards the session's own choice holds again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def placements_log(path: str):
    """foreachBatch sink: each micro-batch adds its changes in a folder of its own; a repeated batch overwrites itself.

    Nothing that is there is read or written again, so a batch costs what it brings.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def _parts(spark: SparkSession, path: str) -> tuple[list[str], int, str | None]:
    """The folders that make up the log: the newest finished base, and the finished batches after it; the last batch's number; the base."""
    bases, batches = (dict(finished_parts(spark, path, kind)) for kind in ("base", "batch"))
    base = max(bases, default=-1)
    after = sorted(n for n in batches if n > base)
    return ([bases[base]] if bases else []) + [batches[n] for n in after], max(after, default=base), bases.get(base)


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """The latest action per (session, key) of a log of ``placements_log``; removals are among them."""
    folders, _, _ = _parts(spark, path)
    if not folders:
        raise ValueError(f"no finished batch under {path}")
    return last_wins(spark.read.parquet(*folders), ["session_id", "key"], "ord")


def compact_placements(spark: SparkSession, path: str) -> int:
    """Write all finished batches as one base; readers take it as soon as it is finished. Returns the last batch it holds.

    Batches stay until they are removed by the log's owner; a broken base is never read, because it lacks its mark of success.
    """
    _, last, _ = _parts(spark, path)
    read_placements(spark, path).write.mode("overwrite").parquet(f"{path}/base={last}")
    return last


def stream_dedup(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Each content once, as far as the watermark reaches (``files``: received, content)."""
    hashed = files.withColumn("sha256", F.sha2(F.col("content"), 256))
    return hashed.withWatermark("received", late).dropDuplicatesWithinWatermark(["sha256"]) if files.isStreaming else hashed.dropDuplicates(["sha256"])
