"""The SQL of a query states the query's rule on all inputs, also those that the small tables lack."""

from __future__ import annotations

import pytest
from compare import ROOT, compare, duck
from pyspark.sql import functions as F

from gradelake.functions import coords as X
from gradelake.plans.fixtures import BASE
from gradelake.plans.registry import oracle_queries, spark_queries

BASES = ["é", "ß", "न", "1", "_", "-", " ", "́", "‍", " ", "ⓐ", "😀", "\n", "\r", " ", "\u0085", "\x0b", ""]
LABELS = ["q 7", "Q:7", "que.12", "question - 400", "queſtion 8", "प्रश्न 5", "प्रश्न: 501", "(3):", " (44) -", "q 1234", "(3) x", "q0", "que"]


def folder_with(spark, tmp_path, name, rows):
    for t in BASE:
        if t != name:
            (tmp_path / f"{t}.parquet").symlink_to(f"{ROOT}/sf0.001/{t}.parquet")
    rows.toPandas().to_parquet(tmp_path / f"{name}.parquet", index=False)
    return str(tmp_path)


@pytest.mark.parametrize("last", ["part", "documents"])
def test_same_rule(spark, tmp_path, last):
    if last == "part":  # column numbers from four letters to eight, beyond an int
        at = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 9_000_019)
        rows, name = spark.range(1, 4000).select(at.alias("p_partkey")), "c1_long_columns"
    else:  # labels between characters of all kinds, bare ones (every fourth document), and none
        texts = [a + label + b for a in BASES for label in LABELS for b in BASES]
        rows = spark.createDataFrame([(4 * i + 3, x) for i, x in enumerate(texts)] + [(4 * i + i % 3, x) for i, x in enumerate(texts[:400])] + [(-1 - i, None) for i in range(8)],
                                     "doc_id long, text string")
        name = "c26_question_number"
    folder = folder_with(spark, tmp_path, last, rows)
    problems, n = compare(spark, duck(folder), folder, spark_queries()[name], oracle_queries()[name])
    assert n == rows.count() and not problems, problems


def test_letters_of_long_columns(spark):
    got = spark.createDataFrame([(2**31,), (26**7 + 1,), (2**63 - 1,)], "n long").select(X.column_letters("n")).collect()

    def letters(n):
        return letters((n - 1) // 26) + chr(65 + (n - 1) % 26) if n else ""

    assert [r[0] for r in got] == [letters(n) for n in (2**31, 26**7 + 1, 2**63 - 1)]
