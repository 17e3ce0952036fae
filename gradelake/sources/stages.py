"""Stage tables: resuming, caching by content, additive schema upgrades."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.session import checkpoint_root


def resume(work: DataFrame, done: DataFrame | None, required: list[str], key: str = "doc_id") -> DataFrame:
    """Documents whose stage output is missing or lacks a required value."""
    if done is None or any(c not in done.columns for c in required):
        return work
    complete = done
    for c in required:
        complete = complete.filter(F.col(c).isNotNull())
    return work.join(complete.select(key), key, "left_anti")


def run_stage(spark: SparkSession, name: str, work: DataFrame, fn: Callable[[DataFrame], DataFrame], required: list[str], key: str = "doc_id") -> DataFrame:
    """Run a stage for open documents only; each run writes its own part of the stage table.

    The table lives in the cluster's checkpoint folder, so a lost executor or a
    restarted job continues from it. A document that was computed more than once shows its last complete run, or its last one
    if none is complete. A table that is there but can't be read is an error.
    """
    path = f"{checkpoint_root(spark)}/stages/{name}"
    runs = _runs(spark, path)
    done = _latest(spark, path, required, key) if runs else None
    todo = resume(work, done, required, key)
    fn(todo).write.mode("overwrite").parquet(f"{path}/run={max(runs, default=0) + 1}")
    return _latest(spark, path, required, key)


def finished_parts(spark: SparkSession, path: str, kind: str) -> list[tuple[int, str]]:
    """(number, folder) of the parts ``kind=number`` under ``path`` that were written to the end; one that broke off is not among them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(conf)
    if not files.exists(where):
        return []
    found = [f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith(f"{kind}=")]
    return [(int(p.getName()[len(kind) + 1:]), p.toString()) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def _runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished runs under ``path``; one that broke off is written again."""
    return [n for n, _ in finished_parts(spark, path, "run")]


def _latest(spark: SparkSession, path: str, required: list[str], key: str) -> DataFrame:
    runs = [f"{path}/run={n}" for n in _runs(spark, path)]
    rows = spark.read.option("basePath", path).parquet(*runs)
    if any(c not in rows.columns for c in required):
        return rows.drop("run")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required], F.lit(True))
    each = rows.groupBy(key, "run").agg(F.bool_and(whole).alias("whole"))
    last = each.groupBy(key).agg(F.max(F.struct("whole", "run"))["run"].alias("run"))
    return rows.join(last, [key, "run"], "left_semi").drop("run")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the checkpoint folder and read it back: what is read several times is computed once, and outlives lost executors."""
    path = f"{checkpoint_root(df.sparkSession)}/stored/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_status(rows: DataFrame, ok: Column, elapsed_ms: Column) -> DataFrame:
    """Status row per document: ok or error, with the time taken."""
    return rows.select("doc_id", F.when(ok, "ok").otherwise("error").alias("status"), elapsed_ms.alias("elapsed_ms"))


def content_key(content: str, cell_size: float, dpi: int) -> Column:
    """Cache key: hash of the bytes with the analysis parameters."""
    return F.concat_ws("_", F.sha2(F.col(content), 256), F.lit(f"cs{cell_size}"), F.lit(f"dpi{dpi}"))


def compute_if_absent(source: DataFrame, cache: DataFrame, fn: Callable[[DataFrame], DataFrame], key: str = "cache_key") -> DataFrame:
    """Cached rows for the source's keys plus freshly computed ones; equal content is computed once."""
    keys = source.select(key).distinct()
    fresh = fn(source.dropDuplicates([key]).join(cache.select(key).distinct(), key, "left_anti"))
    return cache.join(keys, key, "left_semi").unionByName(fresh)


def upgrade_schema(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add missing columns with their default and fill nulls of present ones."""
    new = {c: (F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)) for c, v in defaults.items()}
    return df.withColumns(new)
