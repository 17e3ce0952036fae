"""Batch enrichment with a caller-supplied function (one row in, one reply out)."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradelake.operators.keyed import last_wins
from gradelake.sources.manifest import PartTable


def enrich(df: DataFrame, fn: Callable[[dict], dict], keys: list[str], out_schema: str, attempts: int = 3, piece: int = 32,
           in_flight: int = 1, wait: float = 0.0, longest_wait: float = 30.0) -> DataFrame:
    """Call ``fn`` on every row; a row whose calls all fail becomes an error row.

    ``fn`` gets the row as a dict, None for null, and returns the output columns. The result has
    the keys, the output columns, ``tries`` and ``error`` (null when fine). The
    job never fails because of a bad row.

    A task keeps up to ``in_flight`` calls going, so there are at most that many times the number of tasks at once; with more than one, ``fn`` must bear being
    called from several threads. Calls run ahead of the oldest open one by ``piece`` rows at most, so a slow call holds no more than that in the
    task, and a fast one never waits for a piece to end. Replies keep the order of the rows and are handed on ``piece`` at a time, as soon
    as they are there. A failed call is tried again after ``wait`` seconds, then twice as long, up to ``longest_wait``; only its own thread waits.
    """
    if in_flight < 1 or piece < 1 or attempts < 1:
        raise ValueError("in_flight, piece and attempts start from 1")
    types = dict(df.dtypes)
    names = [part.strip().split()[0] for part in out_schema.split(",")]
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {out_schema}, tries int, error string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def call(row: dict) -> dict:
        error, pause = None, wait
        for n in range(1, attempts + 1):
            try:
                reply = fn(row)
                return {**{k: row[k] for k in keys}, **{k: reply.get(k) for k in names}, "tries": n, "error": None}
            except Exception as e:  # noqa: BLE001 - any failure of the caller's function ends in an error row
                error = f"{type(e).__name__}: {e}"
            if pause and n < attempts:
                time.sleep(pause)
                pause = min(2 * pause, longest_wait)
        return {**{k: row[k] for k in keys}, **{k: None for k in names}, "tries": attempts, "error": error}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                yield from batch.slice(at, piece).to_pylist()

    def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        if in_flight == 1:
            yield from map(call, rows(batches))
            return
        with ThreadPoolExecutor(in_flight) as pool:
            going: deque[Future] = deque()
            try:
                for row in rows(batches):
                    going.append(pool.submit(call, row))
                    if len(going) >= max(piece, in_flight):
                        yield going.popleft().result()
                while going:
                    yield going.popleft().result()
            finally:  # the reader of the task may stop early
                for open_call in going:
                    open_call.cancel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = replies(batches)
        while out := list(islice(source, piece)):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def enrich_open(df: DataFrame, table: PartTable, fn: Callable[[dict], dict], keys: list[str], out_schema: str, **how) -> DataFrame:
    """Enrich the rows that have no finished reply in ``table``, add the new replies to it, and return the newest reply of each row of ``df``.

    A job that broke off, or met errors, is called again and pays only for what is open. Error rows stay in the table until a later reply takes their place.
    """
    def newest() -> DataFrame | None:
        held = table.read(run="_run")
        return None if held is None else last_wins(held.withColumn("_good", F.struct(F.col("error").isNull(), "_run")), keys, "_good").drop("_good", "_run")

    done = newest()
    todo = df if done is None else pending(df, done, keys)
    if done is None or not todo.isEmpty():
        table.add(enrich(todo, fn, keys, out_schema, **how))
    return newest().join(df.select(*keys).distinct(), keys, "left_semi")


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have no finished reply yet; error rows are tried again."""
    return df.join(done.filter("error IS NULL").select(*keys), keys, "left_anti")
