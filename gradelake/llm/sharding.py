"""Shards by fixed virtual slots.

Rows are hashed into a fixed number of slots. Bytes and rows are summed per slot, and a
small versioned table says which shard holds which slot. Balancing never touches rows: it
edits that table, which has as many entries at 100 TB as at 1 MB, and stores the result as
the next version.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.llm.shared import texts

SLOTS = 8192
ROW_BYTES = 16
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, rows long"


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot). The slot comes from id and text checksum, so rows without an id spread too."""
    body = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return body.select("doc_id", (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"), F.crc32("text").alias("text_crc32")).withColumn(
        "vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_weights(rows: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and rows of every slot; at most ``slots`` entries come to the driver, whatever the input."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    return {s: (0, 0) for s in range(slots)} | {r["vslot"]: (r["bytes"], r["rows"]) for r in found}


def first_map(weights: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """Version 1: largest slot first, always to the shard with the fewest bytes."""
    heap = [(0, 0, s) for s in range(shards)]
    held = {}
    for slot in sorted(weights, key=lambda s: (-weights[s][0], s)):
        load, n, shard = heapq.heappop(heap)
        held[slot] = shard
        heapq.heappush(heap, (load + weights[slot][0], n + 1, shard))
    return held


def edited_map(held: dict[int, int], weights: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version: slots move from the fullest to the emptiest shard while that narrows the gap.

    With more shards than the old map knows, the new ones start empty and are filled this way.
    Slots that needn't move stay where they are.
    """
    held, load = dict(held), [0] * shards
    of: list[dict[int, int]] = [{} for _ in range(shards)]
    for slot, shard in held.items():
        load[shard] += weights[slot][0]
        of[shard][slot] = weights[slot][0]
    for _ in range(2 * len(held)):
        full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        movable = [(abs(gap / 2 - w), slot) for slot, w in of[full].items() if 0 < w < gap]
        if not movable:
            break
        slot = min(movable)[1]
        held[slot] = empty
        of[empty][slot] = of[full].pop(slot)
        load[full] -= weights[slot][0]
        load[empty] += weights[slot][0]
    return held


def save_map(spark: SparkSession, folder: str, version: int, held: dict[int, int], weights: dict[int, tuple[int, int]]) -> DataFrame:
    """Store one version of the slot map; earlier versions stay readable."""
    rows = [(version, slot, shard, *weights[slot]) for slot, shard in sorted(held.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")
    return load_map(spark, folder, version)


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/version={version}")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each row's shard, and its place in the shard counted from 0 without gaps.

    A row's place is the number of rows in its shard's earlier slots, from the map, plus its number
    within its slot. So no task ever numbers a whole shard. The map has one row per slot,
    a fixed number, so it can be broadcast.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("_within", within).join(F.broadcast(starts), "vslot").withColumn("slot", F.col("first") + F.col("_within")).drop("first", "_within")


def shard_documents(docs: DataFrame, shards: int, map_folder: str, slots: int = SLOTS) -> DataFrame:
    """(vslot, doc_id, size, text_crc32, shard, slot): shards near equal in bytes.

    A row counts its UTF-8 bytes plus 16; null text counts none and has checksum 0. Rows equal in
    everything are told apart only by their place. An empty table gives no rows and an even map.
    One row larger than a shard's fair share makes its shard larger: rows are never cut.
    Stores map version 1 (largest slot first) and version 2 (after edits), and uses version 2.
    """
    spark = docs.sparkSession
    rows = slotted(docs, slots)
    weights = slot_weights(rows, slots)
    held = first_map(weights, shards)
    save_map(spark, map_folder, 1, held, weights)
    return assign(rows, save_map(spark, map_folder, 2, edited_map(held, weights, shards), weights))
