"""Length buckets with the least padding, and batches of a token budget inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.shared import written

BUDGET, BUCKETS, BLOCKS = 8192, 16, 1024
EXACT, FINE = 4096, 256


def word_count(text: Column) -> Column:
    """Length of a text in words: runs of characters other than white space. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def length_bin(length: Column) -> Column:
    """Histogram cell of a length: exact below ``EXACT``, then ``FINE`` cells per doubling.

    Any 63-bit length falls in one of at most EXACT + 51 * FINE cells, which bounds what the driver gets.
    """
    return F.when(length < EXACT, length).otherwise(F.lit(EXACT) + F.floor(F.log2(length / F.lit(float(EXACT))) * FINE)).cast("int")


def histogram(lengths: DataFrame) -> DataFrame:
    """(cell, n, total, longest) over all rows of ``lengths`` (length)."""
    return lengths.groupBy(length_bin(F.col("length")).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.max("length").alias("longest"))


def boundaries(cells: list[tuple[int, int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """Last cell of each bucket, so that padding every row to its bucket's longest costs least.

    ``cells``: (cell, n, total, longest). best[k][j] is the least padding of the first j cells in k
    buckets; each layer extends the one before. Of equal costs the lower cut is taken.
    """
    cells = sorted(cells)
    if not cells:
        return []
    n = np.concatenate([[0], np.cumsum([c[1] for c in cells])]).astype(float)
    total = np.concatenate([[0], np.cumsum([c[2] for c in cells])]).astype(float)
    longest = np.array([c[3] for c in cells], dtype=float)
    m = len(cells)
    best, cuts = np.full(m + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, m)):
        nxt, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int)
        for j in range(1, m + 1):
            cost = best[:j] + longest[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])
            i = int(cost.argmin())
            nxt[j], cut[j] = cost[i], i
        cuts.append(cut)
        best = nxt
    ends, j = [], m
    for cut in reversed(cuts):
        ends.append(cells[j - 1][0])
        j = cut[j]
    return ends[::-1]


def pack(docs: DataFrame, length: Column | None = None, budget: int = BUDGET, buckets: int = BUCKETS, blocks: int = BLOCKS) -> DataFrame:
    """One row per input row: doc_id, length, bucket, padded, batch, place.

    ``padded`` is the bucket's longest length; a batch of a bucket holds as many rows as fit
    ``budget`` at that length, and at least one, so a longer text is a batch by itself. Batches are
    numbered from 0 in each bucket and only the last one is short. Null and empty texts have length 0
    and go to the first bucket. ``length``: a column of ``docs`` with lengths counted before. Rows equal in everything get different places.
    An empty table gives no rows.

    A bucket may hold most of the corpus: rows are numbered within (bucket, block), and a table of at
    most buckets x blocks counts says where each block starts, so no task numbers a whole bucket.
    """
    rows = docs.select("doc_id", F.coalesce(word_count(F.col("text")) if length is None else length, F.lit(0)).cast("long").alias("length"))
    rows = written(rows, "lengths")  # texts are read once
    cells = [tuple(r) for r in histogram(rows).collect()]
    ends = boundaries(cells, buckets)
    longest = {c[0]: c[3] for c in cells}
    table, b = [], 0
    for cell in sorted(longest):
        table.append((cell, b, longest[ends[b]], max(1, budget // max(1, longest[ends[b]]))))
        b += cell == ends[b]
    plan = docs.sparkSession.createDataFrame(table, "cell int, bucket int, padded long, cap long")
    placed = (rows.withColumn("cell", length_bin(F.col("length"))).join(F.broadcast(plan), "cell").drop("cell")
              .withColumn("block", F.pmod(F.xxhash64("doc_id", "length"), F.lit(blocks)).cast("int")))
    before = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("bucket", "block").count().select("bucket", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("bucket", "block").orderBy("length", "doc_id")) - 1
    at = F.col("first") + F.col("_within")
    return (placed.withColumn("_within", within).join(F.broadcast(starts), ["bucket", "block"])
            .select("doc_id", "length", "bucket", "padded", F.floor(at / F.col("cap")).cast("long").alias("batch"),
                    (at % F.col("cap")).cast("long").alias("place")))
