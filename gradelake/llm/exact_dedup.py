"""Exact duplicates by content-defined chunk recipes.

A text is cut where its content says so (sentence or line ends, between ``LEAST`` and
``MOST`` characters), so equal texts are always cut alike. Each chunk text crosses the
network once, already deduplicated by its map task, to be given an identifier that is
checked against the bytes: a fingerprint that two different chunks share is not an
identifier. From then on a document is its ordered list of identifiers, a few bytes per
thousand characters, and equal lists are equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import ascii_lower, bucketed, numbered, rows_kept, written

LEAST, MOST = 256, 4096


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, in order; joined they are the text. The second branch takes what has no cut point."""
    pattern = rf"(?s).{{{least},{most}}}?(?:\n|[.!?;] |\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text_sha256, recipe): the ordered chunk fingerprints of each normalised text."""
    body = rows.select("row", "doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("body"))
    return body.select(
        "row", "doc_id", F.sha2("body", 256).alias("text_sha256"),
        F.transform(chunks(F.col("body")), lambda c: F.xxhash64(c)).alias("recipe"))


def ambiguous_fingerprints(rows: DataFrame) -> DataFrame:
    """Fingerprints that stand for more than one chunk text (as good as never any).

    Chunks are deduplicated in the map tasks, by fingerprint and bytes, before they move.
    """
    body = rows.select(ascii_lower(F.coalesce("text", F.lit(""))).alias("body"))
    found = body.select(F.explode(chunks(F.col("body"))).alias("chunk")).select(F.xxhash64("chunk").alias("fp"), "chunk")
    return found.distinct().groupBy("fp").count().filter("count > 1").select("fp")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
    largest doc_id stays (a null id is smallest; among rows with that id, one row). Null text
    counts as empty, and all empty texts are one group. An empty table gives no rows.

    A document that holds an ambiguous fingerprint carries its text hash beside its list, so
    such lists can't be taken for each other. The hot group is counted in the map tasks; the
    join back to its rows is an ordinary equi join, whose large partitions Spark splits.
    """
    return judged(numbered(docs)).drop("row")


def judged(rows: DataFrame) -> DataFrame:
    """``exact_dedup`` of numbered rows (row, doc_id, text), with their number."""
    table = written(recipes(rows), "recipes")
    ambiguous = written(ambiguous_fingerprints(rows), "ambiguous")
    if ambiguous.isEmpty():
        marked = table.withColumn("mark", F.lit(""))
    else:
        doubtful = (table.select("row", F.explode("recipe").alias("fp")).join(ambiguous, "fp", "left_semi")
                    .select("row").distinct().withColumn("doubt", F.lit(True)))
        marked = (table.join(doubtful, "row", "left")
                  .withColumn("mark", F.when(F.col("doubt"), F.col("text_sha256")).otherwise("")).drop("doubt"))
    groups = (marked.groupBy("recipe", "mark")
              .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("last"))
              .filter("n > 1").withColumnsRenamed({"recipe": "g_recipe", "mark": "g_mark"}))
    joined = marked.join(groups, (F.col("recipe") == F.col("g_recipe")) & (F.col("mark") == F.col("g_mark")), "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("last.row"))).alias("kept"), "text_sha256",
        F.size("recipe").alias("n_chunks"), "row")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    table = bucketed(docs, whole=True)
    return rows_kept(table, judged(table.select("row", "doc_id", "text")).filter("kept"), docs.columns)
