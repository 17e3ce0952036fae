"""Per-key building blocks that keep working when one key holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def last_wins(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """Keep the row with the largest order value per key.

    max_by() combines on the map side, so a key with very many repeats sends one
    row per input partition instead of all of them.
    """
    return _extreme(df, keys, order, F.max_by)


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the last by ``ord`` where the table has it, else by its place in the table."""
    if "ord" in df.columns:
        return last_wins(df, keys, "ord")
    return last_wins(df.withColumn("_at", F.monotonically_increasing_id()), keys, "_at").drop("_at")


def first_wins(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    return _extreme(df, keys, order, F.min_by)


def _extreme(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(pick(row, order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per key in the given order, numbered from 1.

    The filter sits right on row_number(), so Spark prunes each input partition
    to k rows per key before it shuffles.
    """
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)


def block_of(pos: str | Column, size: int = BLOCK) -> Column:
    c = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(c / F.lit(float(size))).alias("_b")


def split_rank(df: DataFrame, keys: list[str], order: list, blocks: list[Column], out: str) -> DataFrame:
    """row_number() per key computed in pieces, so no task sees a whole large key.

    ``blocks`` must be coarser than ``order``: sorting by the blocks never
    contradicts sorting by ``order``. Each (key, block) is numbered on its own;
    a small table of block sizes per key gives the offset to add. Key and block are one struct, which is equal to
    another also where both hold nulls, so the offsets join rows that lie by it already: the rows are shuffled once.
    """
    names = [f"b{i}" for i in range(len(blocks))]
    cut = df.withColumn("_at", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[b.alias(n) for b, n in zip(blocks, names)]))
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy("_at").orderBy(*order)))
    before = Window.partitionBy(*[f"_at.k{i}" for i in range(len(keys))]).orderBy(*[f"_at.{n}" for n in names]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_at").count().select("_at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    joined = local.join(offsets, "_at", "left")
    return joined.withColumn(out, (F.col("_local") + F.col("_offset")).cast("int")).drop("_local", "_offset", "_at")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join that also matches null keys; right columns are the non-key ones."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def count_per(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
