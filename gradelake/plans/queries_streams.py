"""Queries that run as real streams: tables replayed in pieces through the streaming flows, results read back from their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.operators.grid import page_masks
from gradelake.plans.queries_quality import _V, wire_annotations
from gradelake.plans.registry import query
from gradelake.session import checkpoint_root
from gradelake.streaming import flows

FAR = "2200-01-01 00:00:00"


def folder(t, name: str) -> str:
    return f"{checkpoint_root(t.spark)}/streams/{name}-{uuid.uuid4().hex}"


def replayed(t, rows: DataFrame, pieces: int, *spread: str, last: DataFrame | None = None) -> DataFrame:
    """The rows as a stream of ``pieces`` micro-batches, dealt by the hash of ``spread``: in no order. The rows of ``last`` come after all.

    A micro-batch is many files, so neither their writing nor their reading falls to a few tasks.
    """
    path = folder(t, "source")
    rows.repartition(pieces * int(t.spark.conf.get("spark.sql.shuffle.partitions")), *spread).write.parquet(path)
    files = len(t.spark.read.schema(rows.schema).parquet(path).inputFiles())
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // pieces))).parquet(path)


def drained(t, stream: DataFrame) -> DataFrame:
    """Run an append stream to its end into files and read them."""
    path = folder(t, "sink")
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(t, "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


def replies(t) -> DataFrame:
    """The fixture's answer books as incoming replies, one every 17 minutes: doc_id, received, raw."""
    def listed(rows: DataFrame, keys: list[str], order: str, *fields) -> DataFrame:
        """Objects of ``fields`` in order, as one JSON array per key."""
        one = F.struct(order, F.to_json(F.struct(*fields)).alias("j"))
        return rows.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]), ","), F.lit("]")).alias("list"))

    anns = listed(wire_annotations(t), ["doc_id", "item_index"], "annotation_index", "page", "comment", "comment_font_pts", "comment_range", "anchor")
    marking = F.struct(F.col("marking_page").alias("page"), "score_range", "score_box_range").alias("marking")
    items = listed(t.fx_items.join(anns, ["doc_id", "item_index"], "left"), ["doc_id"], "item_index", "question_id", marking, F.try_parse_json("list").alias("annotations"))
    raw = F.concat(F.lit('{"status": 1, "data": {"items": '), F.col("list"), F.lit("}}"))
    return items.select(F.col("doc_id").cast("string").alias("doc_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 1020).alias("received"), raw.alias("raw"))


def masks(t) -> DataFrame:
    return page_masks(t.fx_cells, t.fx_page_grid).withColumn("doc_id", F.col("doc_id").cast("string"))


_RATES = f"""WITH v AS {_V}, n AS (SELECT doc_id, sum(n) AS n FROM v GROUP BY 1), a AS (SELECT doc_id, count(*) AS c FROM fx_annotations GROUP BY 1),
 w AS (SELECT time_bucket(INTERVAL 1 HOUR, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 17 MINUTE) AS window_start, CAST(sum(coalesce(n, 0)) AS BIGINT) AS violations, CAST(sum(c) AS BIGINT) AS annotations
  FROM a LEFT JOIN n USING (doc_id) GROUP BY 1)
SELECT *, round_even(violations / CAST(annotations AS DOUBLE) * 10000, 0) / 10000 AS rate FROM w"""


@query("st2_response_rates", _RATES)
def _(t):
    return flows.response_rates(replies(t), masks(t)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("st2_response_rates_streamed", _RATES)
def _(t):
    """Replies in three micro-batches, in no order; a last reply without annotations, far later, closes all windows."""
    end = t.spark.createDataFrame([("end", FAR, '{"data": {"items": []}}')], "doc_id string, received string, raw string").withColumn("received", F.to_timestamp("received"))
    got = drained(t, flows.response_rates(replayed(t, replies(t), 3, "doc_id", last=end), masks(t), late="36500 days"))
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("st1_intake_stream", """
SELECT event_id, event_type <> 'error' AS accepted FROM events""")
def _(t):
    """Events as replies, some unreadable, through the intake sink; both of its tables are read back."""
    raw = F.when(F.col("event_type") == "error", "oops").otherwise(F.concat(F.lit('{"v": "'), "event_type", F.lit('"}')))
    rows = t.events.select(F.col("event_id").cast("string").alias("doc_id"), F.col("ts").cast("timestamp").alias("received"), raw.alias("raw"))
    good, bad = folder(t, "accepted"), folder(t, "rejected")
    run = replayed(t, rows, 3, "doc_id").writeStream.foreachBatch(flows.intake_batch(good, bad)).option(
        "checkpointLocation", folder(t, "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    found = [t.spark.read.parquet(path).select(F.col("doc_id").cast("long").alias("event_id"), F.lit(ok).alias("accepted")) for path, ok in ((good, True), (bad, False))]
    return found[0].unionByName(found[1])


@query("st3_streamed_actions", """
SELECT session_id, key, max(ord) AS ord, arg_max(action, ord) AS action, arg_max(page, ord) AS page, arg_max(x, ord) AS x, arg_max(y, ord) AS y FROM fx_placements GROUP BY 1, 2""")
def _(t):
    """The placement log in four micro-batches, out of order; changes go to a log that is read after one compaction."""
    path = folder(t, "placements")
    rows = t.fx_placements.withColumn("ts", F.col("ts").cast("timestamp"))
    with flows.rocksdb_state(t.spark):
        run = flows.stream_placements(replayed(t, rows, 4, "ord"), late="36500 days").writeStream.foreachBatch(flows.placements_log(path)).option(
            "checkpointLocation", folder(t, "progress")).outputMode("update").trigger(availableNow=True).start()
        run.awaitTermination()
    flows.compact_placements(t.spark, path)
    return flows.read_placements(t.spark, path)


@query("st4_streamed_contents", "SELECT DISTINCT sha256(coalesce(text, '')) AS sha256 FROM documents")
def _(t):
    rows = t.documents.select(F.timestamp_seconds(F.col("doc_id") + 1704067200).alias("received"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return drained(t, flows.stream_dedup(replayed(t, rows, 3, "received"), late="36500 days").select("sha256"))
