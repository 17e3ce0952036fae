"""Table function for SQL users: expand_ranges(tokens, rows, cols)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StructField, StructType

from gradelake.operators.placement import token_cells


@udtf(returnType=StructType([StructField("row", IntegerType()), StructField("col", IntegerType())]))
class ExpandRanges:
    """Distinct in-grid cells of single-row tokens, row-major."""

    def eval(self, tokens: list, rows: int, cols: int) -> Iterator[tuple[int, int]]:
        for r, c in sorted(set(token_cells(tokens, rows, cols))):
            yield r + 1, c + 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("expand_ranges", ExpandRanges)
