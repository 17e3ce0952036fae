"""Long texts are looked at once, and replayed streams are spread over many tasks."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from gradelake.functions import glyphs
from gradelake.operators import parse as PA
from gradelake.plans.queries_streams import replayed


def test_wrapping_looks_at_each_word_once(spark):
    words = glyphs.word_units("ab é\U0001f600 W")
    assert words == [1112, 1300, 944]
    texts = ["", "  ", "ab", "ab cd", "ab  cd\nef", "wide" * 9, None, "i " * 60, "x"]
    df = spark.createDataFrame([(i, t, 12.0 if i != 8 else None) for i, t in enumerate(texts)], "i int, t string, size double")
    got = {r.i: r.fits for r in df.select("i", glyphs.comment_fits("t", F.col("size"), F.lit(2), F.lit(2), F.lit(20.0)).alias("fits")).collect()}
    # 38 points wide, 38 high: two lines of 16.8
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: False, 8: None}
    plan = df.select(glyphs.comment_fits("t", F.lit(12.0), F.lit(2), F.lit(2), F.lit(20.0)))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "translate(" not in plan


def test_page_text_is_parsed_once_for_filter_and_result(spark):
    df = spark.createDataFrame([(1, '{"text": " a "}'), (2, '{"text": " "}'), (3, '{"text": "b"'), (4, None)], "id int, raw string")
    good, bad = PA.parse_page_text(df, "raw")
    assert sorted((r.id, r.text) for r in good.collect()) == [(1, "a"), (3, "b")]
    assert sorted(r.id for r in bad.collect()) == [2, 4]
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2 and "Filter" in plan  # as it stands and repaired, neither in the filter


def test_replayed_batches_have_many_files(spark):
    tables = SimpleNamespace(spark=spark)
    stream = replayed(tables, spark.range(5000).withColumn("received", F.timestamp_seconds("id")), 3, "id")
    seen = []

    def keep(batch, number):
        seen.append((batch.select(F.input_file_name()).distinct().count(), batch.count()))

    stream.writeStream.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(n for _, n in seen) == 5000
    assert min(files for files, _ in seen) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
