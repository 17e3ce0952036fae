"""Repeated byte strings by distributed prefix doubling, without a row per byte.

Every window of ``LENGTH`` bytes has one anchor: its byte string of ``SEED`` bytes with the least hash, the last of
equals. Windows that are equal have equal anchors at equal offsets, so the rank of a window starts with
its anchor. A run of neighbouring windows with the same anchor is one row, about 35 bytes
of text. Spark sorts the rows by (rank, content):

* a run whose content stands earlier too is removed as a whole,
* a run whose rank is unique holds no repeat,
* any other run is cut into blocks of windows, aligned to the anchor; each block gets the rank of the pair
  (rank so far, string common to all windows of the block), and the rows are sorted again.

From round to round the common string grows, 32, 69, 93 and 100 bytes, until the rank is unique or the
length is reached. Strings are compared by 64-bit fingerprints within a rank.

Tasks drop what repeats inside their own rows before anything is sent, so a passage that a third of all documents
share sends one row per task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.shared import shared_root, texts, written

LENGTH, SEED, SIZES = 100, 32, (32, 8, 1)
PIECE, FLUSH = 1 << 22, 1 << 21
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
RUNS = "rank long, content long, doc_id long, row long, start long, windows int, offset int"
ARROW = pa.schema([(n, pa.int64()) for n in ("rank", "content", "doc_id", "row", "start")] + [("windows", pa.int32()), ("offset", pa.int32())])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a fixed bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


_BYTES = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class Fingerprints:
    """Fingerprint of any stretch of a byte string, from one sum over powers of an odd base (modulo 2**64)."""

    def __init__(self, data: bytes):
        n = len(data)
        up = np.full(n + 1, _BASE, dtype=np.uint64)
        down = np.full(n + 1, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * np.cumprod(up)[:n])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One rank for a pair of ranks."""
    return mixed(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(b.astype(np.uint64)))


def anchored_runs(fp: Fingerprints, n: int, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(rank, start, windows, offset) of all runs: neighbouring windows whose anchor is the same byte position."""
    if n < length:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    at = np.arange(n - seed + 1)
    value, wide, done = fp.of(at, at + seed), length - seed + 1, 1
    place = at
    while done < wide:  # least of 2, 4, 8 ... neighbours; of equal ones the last
        step = min(done, wide - done)
        left, right = value[:-step], value[step:]
        take = right <= left
        value, place, done = np.where(take, right, left), np.where(take, place[step:], place[:-step]), done + step
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return value[start], start, np.diff(np.concatenate([start, [len(place)]])), place[start] - start


class Rows:
    """Runs gathered by a task. Before they go out, those that repeat an earlier run of the same task are marked
    removed and joined to longer stretches (offset -1)."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, rank, content, doc_id, row, start, windows, offset) -> None:
        n = len(rank)
        self.parts.append((rank.view(np.int64), content.view(np.int64), np.full(n, doc_id), np.full(n, row), start, windows, offset))
        self.held += n

    def out(self) -> pa.RecordBatch:
        rank, content, doc, row, start, windows, offset = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.held = [], 0
        o = np.lexsort((start, row, doc, content, rank))
        again = np.zeros(len(o), dtype=bool)
        again[o[1:]] = (rank[o[1:]] == rank[o[:-1]]) & (content[o[1:]] == content[o[:-1]])
        r = np.flatnonzero(again)
        r = r[np.lexsort((start[r], row[r]))]
        if len(r):
            end = start[r] + windows[r]
            head = np.concatenate([[True], (row[r[1:]] != row[r[:-1]]) | (start[r[1:]] != end[:-1])])
            first = r[head]
            last = np.concatenate([np.flatnonzero(head)[1:] - 1, [len(r) - 1]])
            spread = mixed(row[first].astype(np.uint64)).view(np.int64)
            gone = (spread, spread, doc[first], row[first], start[first], end[last] - start[first], np.full(len(first), -1))
        else:
            gone = tuple(c[:0] for c in (rank, content, doc, row, start, windows, offset))
        cols = [np.concatenate([a[~again], b]) for a, b in zip((rank, content, doc, row, start, windows, offset), gone)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, ARROW)], schema=ARROW)


def first_ranks(length: int, seed: int):
    """Task of the first round: all runs of whole texts (row, doc_id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        for batch in batches:
            for row, doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(0, max(1, len(data) - length + 1), PIECE):  # pieces overlap, so that each window lies in one
                    piece = data[at: at + PIECE + length - 1]
                    fp = Fingerprints(piece)
                    rank, start, windows, offset = anchored_runs(fp, len(piece), length, seed)
                    content = pair(fp.of(start, start + windows + length - 1), offset)
                    rows.add(rank, content, doc_id, row, start + at, windows, offset)
                    if rows.held > FLUSH:
                        yield rows.out()
        if rows.held:
            yield rows.out()

    return run


def next_ranks(length: int, size: int):
    """Task of a later round: open runs of a document (row, doc_id, data, runs), cut into blocks of ``size`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        for batch in batches:
            for row, doc_id, data, runs in zip(*(c.to_pylist() for c in batch.columns)):
                rank, start, windows, offset = (np.array([r[k] for r in runs], dtype=np.int64) for k in ("rank", "start", "windows", "offset"))
                low = int(start.min())
                fp = Fingerprints(data[low: int((start + windows).max()) + length])
                least = (offset - windows + 1) // size  # numbers of the first and last block that the run touches
                blocks = offset // size - least + 1
                of = np.repeat(np.arange(len(rank)), blocks)
                block = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + least[of]
                anchor, top, bottom = (start + offset - low)[of], offset[of], (offset - windows + 1)[of]
                near, far = block * size, block * size + size - 1
                common = fp.of(anchor - near, anchor - far + length)
                high, down = np.minimum(far, top), np.maximum(near, bottom)
                content = pair(pair(fp.of(anchor - high, anchor - down + length), high), down)
                rows.add(pair(pair(rank[of], block), common), content, doc_id, row, anchor - high + low, high - down + 1, high)
                if rows.held > FLUSH:
                    yield rows.out()
        if rows.held:
            yield rows.out()

    return run


def judged(rows: DataFrame) -> DataFrame:
    """Removed runs (offset -1) and runs still open: not the only content of their rank, and the first with it."""
    order = Window.partitionBy("rank", "content").orderBy("doc_id", "row", "start")
    rank = Window.partitionBy("rank")
    seen = rows.withColumn("nth", F.row_number().over(order)).withColumn("mixed", F.min("content").over(rank) != F.max("content").over(rank))
    gone = (F.col("offset") < 0) | (F.col("nth") > 1)
    return seen.filter(gone | F.col("mixed")).select("rank", "doc_id", "row", "start", "windows", F.when(gone, -1).otherwise(F.col("offset")).alias("offset"))


def finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, data, gone in zip(*(c.to_pylist() for c in batch.columns)):
                spans: list[list[int]] = []
                for g in sorted(gone or [], key=lambda g: g["start"]):
                    end = g["start"] + g["windows"] + length - 1
                    if spans and g["start"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([g["start"], end])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": sum(b - a for a, b in spans),
                            "spans": [{"start": a, "end": b} for a, b in spans], "kept_sha256": kept.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=FINISHED)

    return run


FINISHED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                      ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])


def stored(docs: DataFrame) -> DataFrame:
    """The texts as a table bucketed by row number: later rounds join to it without moving texts again."""
    spark = docs.sparkSession
    name = f"llm_texts_{uuid.uuid4().hex}"
    buckets = max(48, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = texts(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                              F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    body.write.option("path", f"{shared_root(spark)}/llm/{name}").bucketBy(buckets, "row").saveAsTable(name)
    return spark.table(name)


def substring_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans, kept_sha256.

    Every byte that lies in a string of ``length`` bytes that also starts earlier is removed: in a smaller doc_id,
    or earlier in the same document. Overlaps count, strings never cross documents, and all are judged on the
    input. ``spans`` are the maximal removed byte ranges, end excluded. Null text is empty; texts shorter than ``length``
    stay whole. A null doc_id is before all others; rows that share an id are in the order of the table,
    so of repeated rows the later ones go. An empty table gives no rows.
    """
    table = stored(docs)
    order_id = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")
    body = table.select("row", order_id, "data")
    rows = body.mapInArrow(first_ranks(length, seed), RUNS)
    removed, found = None, written(judged(rows), "runs")
    for size in (*sizes, 0):
        gone = found.filter("offset < 0").select("row", "start", "windows")
        removed = gone if removed is None else removed.unionByName(gone)
        if not size:
            break
        runs = found.filter("offset >= 0").groupBy("row").agg(F.collect_list(F.struct("rank", "start", "windows", "offset")).alias("runs"))
        rows = body.join(runs.hint("shuffle_hash"), "row").select("row", "doc_id", "data", "runs").mapInArrow(next_ranks(length, size), RUNS)
        found = written(judged(rows), "runs")
    gone = removed.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("gone"))
    final = table.join(gone.hint("shuffle_hash"), "row", "left")
    return final.select("doc_id", "data", "gone").mapInArrow(
        finish(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")
