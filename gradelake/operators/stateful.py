"""Sequential steps per key, streamed: sorted rows, one state at a time, bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def run_sequential(rows: DataFrame, headers: DataFrame, keys: list[str], order: list[str], schema: str,
                   start: Callable[[dict], object], step: Callable[[object, dict], dict | None]) -> DataFrame:
    """Fold ``step`` over the rows of each key in order, beginning from its header row.

    Headers (one per key) and rows are shuffled together by key and sorted, the
    header first. The task then reads Arrow batches as a stream and keeps only
    the state of the current key, so a key with very many rows costs time but no
    memory. Rows of a key without a header see ``state`` None.
    """
    hcols = [c for c in headers.columns if c not in keys]
    rcols = [c for c in rows.columns if c not in keys]
    h = F.struct(*[F.col(c) for c in hcols])
    r = F.struct(*[F.col(c) for c in rcols])
    left = headers.select(*keys, F.lit(0).alias("_k"), h.alias("_h"))
    right = rows.select(*keys, F.lit(1).alias("_k"), r.alias("_r"))
    # an explicit number keeps small but compute-heavy shuffles from being merged into one task
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right, allowMissingColumns=True).repartition(tasks, *keys)
    stream = both.sortWithinPartitions(*keys, "_k", *[F.col(f"_r.{c}") for c in order])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for rec in batch.to_pylist():
                key = tuple(rec[k] for k in keys)
                if key != current:
                    current, state = key, None
                if rec["_k"] == 0:
                    state = start(rec["_h"])
                    continue
                row = {**dict(zip(keys, key)), **rec["_r"]}
                result = step(state, row)
                if result is not None:
                    out.append(result)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return stream.mapInArrow(fold, schema)
