"""Recurring lines by a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its first tokens; tokens with
a digit are variable fields. Within a leaf a token stays in the template where enough of the leaf's lines
have it at that place; the other places become fields. A template that enough documents share, and
that is mostly fixed tokens, is boilerplate: its lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import bucketed, written

FIELD = "<*>"
DEPTH, DOCUMENTS, SUPPORT, FIXED, LEAST_TOKENS = 3, 5, 0.1, 0.7, 3


def masked(text: Column) -> Column:
    """Lines of a text, tokens with a digit replaced by the field mark, white space as single blanks. The pattern
    starts at token starts only, so long tokens cost no more than their length; lines without a digit or odd white
    space, nearly all, are only looked at."""
    def line(x: Column) -> Column:
        fields = F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<!\S)[^\s0-9]*+[0-9]\S*", FIELD)).otherwise(x)
        odd = x.contains("  ") | x.contains("\t") | x.contains("\r") | x.contains("\x0b") | x.contains("\f") | x.startswith(" ") | x.endswith(" ")
        return F.when(odd, F.trim(F.regexp_replace(fields, r"\s+", " "))).otherwise(fields)

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line)


def candidates(table: DataFrame, documents: int, depth: int, least_tokens: int) -> DataFrame:
    """(row, line, leaf): the different masked lines of each document whose leaf is seen often enough to hold a template.

    Leaves are counted and matched as numbers, with a line's place in its document; only lines of leaves that are left
    are then read again where their texts lie. All other text never moves.
    """
    lines = F.array_distinct(masked(F.col("text")))
    blanks = F.char_length("line") - F.char_length(F.replace("line", F.lit(" "), F.lit("")))
    leaf = F.xxhash64(blanks, F.substring_index("line", " ", depth)).alias("leaf")
    each = table.select("row", F.posexplode(lines).alias("pos", "line")).filter(blanks >= least_tokens - 1).select("row", "pos", leaf)
    often = each.groupBy("leaf").count().filter(F.col("count") >= documents).select("leaf")
    at = each.join(often, "leaf", "left_semi").groupBy("row").agg(F.collect_list("pos").alias("at"))
    found = table.join(at.hint("shuffle_hash"), "row").select("row", F.explode(F.filter(lines, lambda _, i: F.array_contains("at", i))).alias("line"))
    return found.select("row", "line", leaf)


def templates(found: DataFrame, documents: int, support: float, fixed: float) -> DataFrame:
    """(line, template): template of each candidate line, as far as it is mostly fixed tokens.

    A line that enough documents share is its own template. In any other, a token stays where at least ``documents``
    lines of the leaf, and the share ``support`` of all its lines, have it at that place. A place has at most 1 / ``support``
    such tokens, so those of a leaf go with each of its lines as one short list of numbers.
    """
    counted = written(found.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n")), "lines")
    rare = F.col("n") < documents
    own = counted.filter(~rare).select("line", F.col("line").alias("template"))
    total = counted.groupBy("leaf").agg(F.sum("n").alias("total"), F.bool_or(rare).alias("open")).filter("open")
    placed = counted.join(total, "leaf", "left_semi").select("leaf", "n", F.posexplode(F.split("line", " ")).alias("at", "token"))
    held = (placed.filter(F.col("token") != FIELD).groupBy("leaf", F.xxhash64("at", "token").alias("token")).agg(F.sum("n").alias("held"))
            .filter(F.col("held") >= documents))
    kept = (held.join(total, "leaf").filter(F.col("held") >= support * F.col("total"))
            .groupBy("leaf").agg(F.collect_list("token").alias("kept")))
    shown = F.transform(F.split("line", " "), lambda t, i: F.when(F.array_contains("kept", F.xxhash64(i, t)), t))
    shape = counted.filter(rare).join(kept, "leaf").select("line", shown.alias("shown"))
    share = F.size(F.filter("shown", lambda t: t.isNotNull())) / F.size("shown")
    return own.unionByName(shape.filter(share >= fixed).select("line", F.array_join("shown", " ", FIELD).alias("template")))


def recurring_lines(table: DataFrame, documents: int, depth: int, support: float, fixed: float, least_tokens: int) -> DataFrame:
    """(row, line): the masked lines of each document whose template is found in ``documents`` documents or more."""
    found = written(candidates(table, documents, depth, least_tokens), "candidates")
    named = written(found.join(templates(found, documents, support, fixed), "line").select("row", "line", "template"), "templates")
    often = named.select("row", "template").distinct().groupBy("template").count().filter(F.col("count") >= documents).select("template")
    return named.join(often, "template", "left_semi").select("row", "line")


def drop_recurring_lines(docs: DataFrame, documents: int = DOCUMENTS, depth: int = DEPTH, support: float = SUPPORT, fixed: float = FIXED,
                         least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept (the text of the lines that stay).

    Lines end at line feeds. Every line of a recurring template goes, in all documents, also in exact copies, so
    exact dedup comes before. Lines of fewer than ``least_tokens`` tokens stay. Null and empty texts are one empty line, which
    stays. Repeated rows are documents each for itself. An empty table gives no rows.
    """
    table = bucketed(docs)
    gone = recurring_lines(table, documents, depth, support, fixed, least_tokens).groupBy("row").agg(F.collect_list("line").alias("gone"))
    both = table.join(gone.hint("shuffle_hash"), "row", "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    pairs = F.arrays_zip(lines.alias("line"), masked(F.col("text")).alias("mask"))
    stay = F.transform(F.filter(pairs, lambda x: ~F.array_contains("gone", x["mask"])), lambda x: x["line"])
    out = both.select("doc_id", F.size(lines).cast("long").alias("n_lines"), "text", F.when(F.col("gone").isNotNull(), stay).alias("stay"))
    return out.select("doc_id", "n_lines", F.coalesce(F.col("n_lines") - F.size("stay"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.coalesce(F.array_join("stay", "\n"), "text", F.lit("")).alias("kept"))
