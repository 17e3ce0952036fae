"""Spelling variants by a variable-length gram index.

The gram dictionary starts from pairs of letters. A gram that more than ``common`` places of the vocabulary hold is
extended by one letter, up to five; rarer ones are pruned there. So a word falls into one gram per place, each as long as it must
be to be rare. One edit touches only the grams that cover its place, so per word the largest number of grams over one place bounds
the affected ones: all others of a word stand in each of its near words, at the same place or one place on.
Lists of the index are therefore merged only for a word's rarest grams, one more than may be affected; what meets in a list is verified.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import ascii_lower, texts, written

SHORTEST, LONGEST = 2, 5
#: A gram in more places is extended. Of each length at most EXTENDED grams are, because the limit grows with the vocabulary.
COMMON, EXTENDED = 32, 1 << 18
#: Counters of grams by hash. They only order the grams; any order gives the same pairs.
SLOTS = 1 << 16
LETTERS = "A-Za-z\\u00C0-\\u00FF"


def words(docs: DataFrame, least: int, deletes: int, least_count: int) -> DataFrame:
    """(word, n) of whole texts, with one letter deleted where ``deletes`` divides the hash of id and word (0: nowhere)."""
    found = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                               F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    found = found.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    if deletes:
        found = found.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run")).alias("h"))
        at = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        found = found.select(F.when(F.col("h") % deletes == 0, cut).otherwise(F.col("run")).alias("run"))
    return found.where(F.char_length("run") >= least).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def extended_grams(vocabulary: DataFrame, common: int) -> frozenset[str]:
    """The grams that are extended. Their number is bounded: EXTENDED for each length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(w[p: p + q] for w in batch.column(0).to_pylist() for q in range(SHORTEST, LONGEST) for p in range(len(w) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "places"])

    total = vocabulary.agg(F.coalesce(F.sum(F.char_length("word")), F.lit(0))).first()[0]
    counted = vocabulary.select("word").mapInArrow(run, "gram string, places long").groupBy("gram").agg(F.sum("places").alias("places"))
    return frozenset(counted.where(F.col("places") > max(common, total // EXTENDED)).select("gram").toArrow()["gram"].to_pylist())


def grams(word: str, extended: frozenset[str]) -> list[str]:
    """The gram at each place of a word: extended until it is rare, LONGEST long, or at the word's end."""
    out, size = [], len(word)
    for p in range(size - SHORTEST + 1):
        end = p + SHORTEST
        while end < size and end - p < LONGEST and word[p:end] in extended:
            end += 1
        out.append(word[p:end])
    return out


def affected(word: str, found: list[str], extended: frozenset[str]) -> int:
    """How many of a word's grams one edit can touch: those over one place, or, for a letter added at the end, those that would grow."""
    over = [0] * (len(word) + 1)
    for p, gram in enumerate(found):
        over[p] += 1
        over[p + len(gram)] -= 1
    most = running = 0
    for step in over:
        running += step
        most = max(most, running)
    growing = sum(p + len(g) == len(word) and len(g) < LONGEST and g in extended for p, g in enumerate(found))
    return max(most, growing)


def slot(gram: str) -> int:
    return crc32(gram.encode()) % SLOTS


def gram_counts(vocabulary: DataFrame, extended) -> np.ndarray:
    """How many grams of the vocabulary each counter holds; SLOTS numbers, whatever the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = extended.value, np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for gram, n in Counter(g for w in batch.column(0).to_pylist() for g in grams(w, known)).items():
                total[slot(gram)] += n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["slot", "n"])

    summed = vocabulary.select("word").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return counts


def listed(vocabulary: DataFrame, extended, counts) -> DataFrame:
    """(word, n, gram, place, size): the lists in which each word must be looked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = extended.value, counts.value
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams(word, known)
                rare = sorted((order[slot(g)], g, p) for p, g in enumerate(found))[: affected(word, found, known) + 1]
                out += [(word, n, g, p, len(word)) for _, g, p in rare]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], names=["word", "n", "gram", "place", "size"])

    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, gram string, place int, size int")


def near_pairs(vocabulary: DataFrame, common: int = COMMON) -> DataFrame:
    """(word, n, near, near_n): each ordered pair of words that one inserted, deleted or replaced code point tells apart, once.

    ``vocabulary`` is (word, n), words distinct, not null and of LONGEST + 2 code points at least, where every word keeps a gram.
    Near words of one length share a list at the same place; of a longer and a shorter one, at the same place or one on.
    """
    context = vocabulary.sparkSession.sparkContext
    extended = context.broadcast(extended_grams(vocabulary, common))
    lists = listed(vocabulary, extended, context.broadcast(gram_counts(vocabulary, extended)))
    lists = written(lists, "gram-lists")

    def key(place, size):
        return F.xxhash64("gram", place, size)

    one = lists.select(F.struct(F.col("word").alias("w"), "n").alias("a"), F.explode(F.array(
        F.struct(key(F.col("place"), F.col("size")).alias("list"), F.lit(True).alias("even")),
        F.struct(key(F.col("place"), F.col("size") + 1).alias("list"), F.lit(False).alias("even")),
        F.struct(key(F.col("place") + 1, F.col("size") + 1).alias("list"), F.lit(False).alias("even")))).alias("x")).select("a", "x.*")
    other = lists.select(F.struct(F.col("word").alias("w"), "n").alias("b"), key(F.col("place"), F.col("size")).alias("list"))
    met = one.join(other, "list").where((~F.col("even") | (F.col("a.w") < F.col("b.w"))) & (F.levenshtein("a.w", "b.w", 1) == 1))
    both = met.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return both.select(F.col("p.a.w").alias("word"), F.col("p.a.n").alias("n"), F.col("p.b.w").alias("near"), F.col("p.b.n").alias("near_n")).repartition(
        "word").groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))


def roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root): forms followed to the last. Each step multiplies n by ``ratio``, so their number is bounded by the largest n."""
    steps = max(1, math.ceil(math.log(max(most, 2), ratio)))
    found = written(forms.select("word", F.col("form").alias("root")), "word-roots")
    for _ in range(math.ceil(math.log2(steps))):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = written(found.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "word-roots")
    return found


def spelling_variants(docs: DataFrame, least: int = LONGEST + 2, deletes: int = 31, least_count: int = 2, ratio: int = 10, common: int = COMMON) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, with only A-Z lower-cased, of ``least`` code points or more, found ``least_count``
    times or more. Where ``deletes`` divides the crc32 of ``<doc_id>:<run>``, that run has lost the code point number crc32 % length.
    A word's form is the near word found most often (ties: the least in code-point order), if it is found ``ratio`` times as often as the word.
    Null texts hold no words, a null doc_id counts as an empty string, repeated rows count each; an empty table gives no rows. Other columns are not read.
    """
    if least < LONGEST + 2 or ratio < 2:
        raise ValueError(f"words need {LONGEST + 2} code points or more, and a form at least twice the count of its word")
    vocabulary = written(words(docs, least, deletes, least_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(vocabulary, common).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("own"), best.alias("best"))
    often = -F.col("best.less") >= ratio * F.col("own")
    near = written(near.select("word", "n_near", F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "near-words")
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    root = roots(near.where(F.col("form").isNotNull()), most, ratio)
    return vocabulary.join(near, "word", "left").join(root, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
