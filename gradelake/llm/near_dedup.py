"""Near duplicates by Order MinHash.

The shingles of a text (five words) get the number of their occurrence, so all are
different. One of ``SKETCHES`` sketches takes the ``TAKEN`` shingles with the least hash and keeps them in text
order: texts agree in it when they share these shingles in this order, which follows edit similarity.
Texts that agree in a sketch meet in a bucket. Four shingles a sketch keep apart most texts that share only passages.
A shingle that no other text of any bucket has is shared with none: texts with too many of them leave, and what is left of a text bounds its pairs.
Two of a bucket are a pair only if their lengths and these bounds fit and their signatures, one bit of each of ``BITS`` minimum hashes, differ in few bits;
so texts that share a passage alone are told apart where they meet, before a text moves. In each round every bucket has one centre, first the text
with the least of its own, which is near to the most others, and a member is compared with some of the centres it meets, which joins the large classes without listing their pairs; buckets that
have come to one class leave. Of buckets that then still hold several classes, all pairs of rows of different classes are compared.
Comparison aligns the two shingle sequences within the band that the threshold allows.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gradelake.llm.shared import by_row, numbered, rows_kept, written
from gradelake.llm.wordtext import words

SHINGLE, SKETCHES, TAKEN = 5, 31, 4
#: Texts of up to SHORT shingles have sketches of fewer shingles: of few, four that agree are rare even in near texts.
SHORT, SHORT_SKETCHES, SHORT_TAKEN = 64, 16, 2
#: Similarity of at least LEAST[0] / LEAST[1].
LEAST = (4, 5)
BLOCK = 1 << 13
#: Texts whose words are hashed as one sequence.
TOGETHER = 64
BITS = 128
#: Rounds of centres go on while at least one of WORTH comparisons links; a member is compared with up to TRIES centres a round.
WORTH, TRIES = 16, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
MOST = ~np.uint64(0)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


SEEDS = mixed(np.arange(1, 1025, dtype=np.uint64) * _ODD)


def windows(w: np.ndarray, size: int) -> np.ndarray:
    """One number per run of ``size`` of the numbers ``w``."""
    n = max(0, len(w) - size + 1)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        s = mixed(s + w[k: k + n] * SEEDS[k])
    return s


def labelled_again(s: np.ndarray) -> np.ndarray:
    """``s`` with repeated numbers changed by their occurrence, so that all are different."""
    ordered = np.sort(s)
    again = np.concatenate([[False], ordered[1:] == ordered[:-1]])
    if not again.any():
        return s
    order, at = np.argsort(s, kind="stable"), np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(again, 0, at))
    out = np.empty_like(s)
    out[order] = np.where(again, mixed(ordered + nth.astype(np.uint64) * _ODD), ordered)
    return out


def shingled(texts: list[list[bytes]], size: int) -> Iterator[np.ndarray]:
    """``shingles`` of each text. Their words are hashed as one sequence, since most of the time for a short one is that of the calls."""
    w = mixed(np.fromiter(map(crc32, chain.from_iterable(texts)), np.uint64, sum(map(len, texts))) + _ODD)
    s, at = windows(w, size), 0
    for found in texts:
        n = len(found)
        # windows that reach into the next text are in no slice; a shorter text is one window of its own
        yield labelled_again(s[at: at + n - size + 1]) if n >= size else windows(w[at: at + n], n)[:n]
        at += n


def shingles(found: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """One number per run of ``size`` words, labelled with its occurrence; a shorter text is one shingle."""
    return next(shingled([found], size))


def read(texts: list[str | None], size: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words and shingles of each text, of ``TOGETHER`` texts at a time."""
    for at in range(0, len(texts), TOGETHER):
        found = [words(text) for text in texts[at: at + TOGETHER]]
        yield from zip(found, shingled(found, size))


def sketch(s: np.ndarray, sketches: int = SKETCHES, taken: int = TAKEN, first: int = 0) -> np.ndarray:
    """Sketches number ``first`` and on of a labelled shingle sequence. Long ones are read in blocks; only least hashes are held."""
    seeds, every = SEEDS[first: first + sketches, None], np.arange(sketches)
    held_h, held_at = [], []
    for at in range(0, len(s), BLOCK):
        h = s[None, at: at + BLOCK] * (seeds | np.uint64(1))  # shingles are mixed, so their products are in random order
        for _ in range(min(taken, h.shape[1])):  # a few searches for the least take half the time of a partition
            place = h.argmin(axis=1)
            held_h.append(h[every, place])
            held_at.append(place + at)
            h[every, place] = MOST
    best_at = np.stack(held_at, axis=1)
    if best_at.shape[1] > taken:
        best_at = np.take_along_axis(best_at, np.argsort(np.stack(held_h, axis=1), axis=1)[:, :taken], 1)
    place = np.sort(best_at, axis=1)
    out = seeds[:, 0].copy()
    for k in range(place.shape[1]):
        out = mixed(out * _ODD + s[place[:, k]])
    return out


def buckets(s: np.ndarray, sketches: int, taken: int, least: tuple[int, int]) -> np.ndarray:
    """The sketches by which a text meets others. Of two near texts either both are long, or neither is longer than a near one of ``SHORT`` can be."""
    top, bottom = least
    short = top * len(s) <= bottom * SHORT
    few = [sketch(s, SHORT_SKETCHES, SHORT_TAKEN, sketches)] if short else []
    return np.concatenate([*few, *([sketch(s, sketches, taken)] if len(s) > SHORT else [])])


def aligned(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether the sequences align in enough shingles: common / (all - common) >= least.

    Labelled shingles are unique, so the best alignment is the longest increasing chain of common ones. A match further off the
    diagonal than the number of unmatched shingles that the threshold leaves can't be in such a chain.
    """
    top, bottom = least
    total = len(a) + len(b)
    need = -(-top * total // (top + bottom))
    if min(len(a), len(b)) < need:
        return False
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at_a) < need:
        return False
    band = np.abs(at_a - at_b) <= total - 2 * need
    at_b = at_b[band][np.argsort(at_a[band])]
    if len(at_b) < need:
        return False
    if (np.diff(at_b) > 0).all():
        return True
    chain: list[int] = []
    for x in at_b.tolist():
        k = bisect_left(chain, x)
        chain[k: k + 1] = [x]
    return len(chain) >= need


def signature(s: np.ndarray) -> np.ndarray:
    """One bit of each of ``BITS`` minimum hashes, in two numbers. A bit of two texts differs with probability (1 - J) / 2, J the share of common shingles."""
    seeds = SEEDS[-BITS:, None] | np.uint64(1)
    least = np.full(BITS, MOST)
    for at in range(0, len(s), BLOCK):
        least = np.minimum(least, (s[None, at: at + BLOCK] * seeds).min(axis=1))
    return np.packbits(mixed(least) >> np.uint64(63) == 1).view(np.int64)


def alike(other: str, least: tuple[int, int]) -> Column:
    """Whether the row (n, can, bits_1, bits_2) and the one whose columns begin with ``other`` can be near: by length, by the shingles they can share, and by their
    signatures, which differ in more bits than this with a probability below one in a million where texts are near."""
    p = (1 - least[0] / least[1]) / 2
    limit = math.ceil(BITS * p + 6 * math.sqrt(BITS * p * (1 - p)))
    apart = [F.bit_count(F.col(c).bitwiseXOR(F.col(other + c))) for c in ("bits_1", "bits_2")]
    top, bottom = least
    enough = (top + bottom) * F.least(F.col("can"), F.col(other + "can")) >= top * (F.col("n") + F.col(other + "n"))
    return enough & (apart[0] + apart[1] <= limit)


def sketched(table: DataFrame, size: int, sketches: int, taken: int, least: tuple[int, int]) -> DataFrame:
    """(row, doc_id, same, sketch, n), the last one the number of shingles; ``same`` is equal for texts with equal words; texts without words have none."""
    kind = table.schema["doc_id"].dataType
    schema = pa.schema([("row", pa.int64()), ("doc_id", to_arrow_type(kind)), ("same", pa.string()), ("sketch", pa.list_(pa.int64())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, out, n = [], [], []
            for found, s in read(batch.column(2).to_pylist(), size):
                same.append(hashlib.blake2b(b" ".join(found), digest_size=16).hexdigest() if found else None)
                out.append(buckets(s, sketches, taken, least).view(np.int64) if found else None)
                n.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(schema[1].type), pa.array(same, pa.string()), pa.array(out, schema[3].type),
                                              pa.array(n, pa.int64())], schema=schema)

    return table.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind.simpleString()}, same string, sketch array<long>, n long")


def signed(table: DataFrame, size: int) -> DataFrame:
    """(row, n, can, bits_1, bits_2) of (row, text, n, can), the last two the signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [signature(s) for _, s in read(batch.column(1).to_pylist(), size)]
            one, two = np.array(bits, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3)), pa.array(one), pa.array(two)], names=["row", "n", "can", "bits_1", "bits_2"])

    return table.select("row", "text", "n", "can").mapInArrow(run, "row long, n long, can long, bits_1 long, bits_2 long")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written, and its number of rows, counted on the way."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def compared(pairs: DataFrame, table: DataFrame, size: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose texts are near. The members' texts go to their centre's text, once per pair; the join splits
    the members of a large centre over tasks."""
    centres = table.select("row", "text").join(pairs.select(F.col("a").alias("row")).distinct().hint("shuffle_hash"), "row")
    of = pairs.groupBy(F.col("b").alias("row")).agg(F.collect_list("a").alias("centres"))
    members = (table.select("row", "text").join(of.hint("shuffle_hash"), "row")
               .select(F.explode("centres").alias("a"), F.col("row").alias("b"), F.col("text").alias("text_b")))
    both = members.join(centres.select(F.col("row").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            near = []
            a = batch.column(0).to_pylist()
            for k, (_, s) in enumerate(read(batch.column(3).to_pylist(), size)):
                if a[k] != last:
                    last, known = a[k], shingles(words(batch.column(2)[k].as_py()), size)
                near.append(aligned(known, s, least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return both.mapInArrow(run, "a long, b long, near boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected set. Labels are handed to neighbours and then
    followed to their own label, so chains shorten by half each round; every round is written."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    now = written(now, "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(near, "node").select("node", "label", F.least("label", "near").alias("down"))
        own = now.select(F.col("node").alias("down"), F.col("label").alias("own"))
        after = step.join(own, "down").select("node", F.col("label").alias("was"), F.least("down", "own").alias("label"))
        seen = Observation()
        now = written(after.observe(seen, F.count_if(F.col("label") != F.col("was")).alias("n")).select("node", "label"), "labels")
        if not seen.get["n"]:
            return now


def linked(reps: DataFrame, table: DataFrame, size: int, least: tuple[int, int]) -> DataFrame | None:
    """(node, label) of representatives that are near to another one, or None. ``reps``: (row, n, sketch).

    Only rows that meet another one go on, with their texts. Rounds of centres join the large classes; then all pairs that buckets
    still hold with different labels are compared, so every near pair that agrees in a sketch and in its signature ends in one class.
    """
    member = reps.select("row", F.explode("sketch").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket")
    member, count = counted(member.join(shared, "bucket"), "members")
    if not count:
        return None
    rows = shareable(table.select("row", "text").join(member.select("row").distinct().hint("shuffle_hash"), "row"), reps.drop("sketch"), size, least)
    table = by_row(table.select("row", "text").join(rows.hint("shuffle_hash"), "row"), "meeting")
    member = written(member.join(written(signed(table, size), "signed"), "row"), "members")
    label, tried = starred(member, table, size, least)
    pairs = remaining(written(labelled(member, label), "named"), least)
    pairs, count = counted(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    if not count:
        return label
    near, links = counted(compared(pairs, table, size, least).filter("near").select("a", "b"), "near")
    return joined(near, label) if links else label


def shareable(texts: DataFrame, reps: DataFrame, size: int, least: tuple[int, int]) -> DataFrame:
    """The rows of ``reps`` that can be near to another of ``texts`` (row, text), written, with ``can``: how many of their shingles another text has too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for _, s in read(batch.column(1).to_pylist(), size)]
            row = np.repeat(batch.column(0).to_numpy(), [len(s) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(row)], names=["shingle", "row"])

    held = texts.mapInArrow(run, "shingle long, row long").groupBy("shingle").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("k"))
    own = held.filter("k = 1").groupBy("row").agg(F.count(F.lit(1)).alias("own"))
    top, bottom = least
    met = texts.select("row").join(reps, "row").join(own, "row", "left").withColumn("can", F.col("n") - F.coalesce("own", F.lit(0)))
    return written(met.filter(bottom * F.col("can") >= top * F.col("n")).drop("own"), "shareable")


def starred(member: DataFrame, table: DataFrame, size: int, least: tuple[int, int]) -> tuple[DataFrame | None, DataFrame]:
    """(label, tried) after rounds of centres over ``member`` (row, bucket, n, bits_1, bits_2, can). ``tried``: the pairs (a, b) compared.

    In each round every bucket that holds several labels has one centre, the row with the largest share of shingles that others have, and then other rows by turns. A member
    meets the centres of its buckets that have another label and can be near, and is compared with those it meets in
    most buckets, ``TRIES`` at most. Found links join whole labels, so the graph of a round is only as large as
    what it newly connects. No pair is compared twice. The rounds end when few comparisons link any more.
    """
    label, tried, turn = None, None, 0
    of = ("row", "n", "bits_1", "bits_2", "can", "label")
    while True:
        named = labelled(member, label)
        first = [F.xxhash64("label", F.lit(turn)), F.xxhash64("row", F.lit(turn))] if turn else [-F.col("can") / F.col("n")]
        order = F.struct(*(c.alias(f"by_{k}") for k, c in enumerate(first)), *of)
        centre = named.groupBy("bucket").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.min(order).alias("c")).filter("first != last")
        centre = centre.select("bucket", *(F.col(f"c.{c}").alias(f"c_{c}") for c in of))
        met = (named.join(centre, "bucket").filter((F.col("label") != F.col("c_label")) & alike("c_", least))
               .groupBy("row", F.col("c_row").alias("c")).agg(F.count(F.lit(1)).alias("times")))
        met = met.select("row", "times", F.least("row", "c").alias("a"), F.greatest("row", "c").alias("b"))
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        # a member has as many centres as sketches at most
        best = met.groupBy("row").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("times"), "a", "b"))), 1, TRIES).alias("best"))
        pairs, count = counted(best.select(F.explode("best").alias("best")).select("best.a", "best.b").distinct(), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not count:
            return label, tried
        near, links = counted(compared(pairs, table, size, least).filter("near").select("a", "b"), "near")
        if links:
            label = joined(near, label)
        if WORTH * links < count:
            return label, tried
        turn += 1


def labelled(member: DataFrame, label: DataFrame | None) -> DataFrame:
    """``member`` with the label of each row, its own number where it has none."""
    return member.withColumn("label", F.col("row")) if label is None else member.join(
        label.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))


def remaining(named: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b): all pairs of rows of one bucket that have different labels and can be near. ``named``: (row, bucket, n, bits_1, bits_2, can, label)."""
    held = named.groupBy("bucket").agg(F.min("label").alias("first"), F.max("label").alias("last")).filter("first != last").select("bucket")
    one = named.join(held, "bucket", "left_semi")
    two = one.select(*(F.col(c).alias(c if c == "bucket" else f"b_{c}") for c in one.columns))
    met = one.join(two, (one["bucket"] == two["bucket"]) & (F.col("label") < F.col("b_label")) & alike("b_", least))
    return met.select(F.least("row", "b_row").alias("a"), F.greatest("row", "b_row").alias("b")).distinct()


def joined(near: DataFrame, label: DataFrame | None) -> DataFrame:
    """Labels after the links ``near``, written: each set of labels that they connect takes its least one."""
    if label is None:
        return components(near)
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    known = label.unionByName(ends.join(label, "node", "left_anti").withColumn("label", F.col("node")))
    of_a, of_b = (known.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
    edges = near.join(of_a, "a").join(of_b, "b").filter("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    renamed = components(edges).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(known.join(renamed, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "joined")


def near_dedup(docs: DataFrame, size: int = SHINGLE, sketches: int = SKETCHES, taken: int = TAKEN, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept.

    Two texts are near when their sequences of labelled shingles align in at least ``least`` of all. Classes are
    connected sets of near texts; class_id is the smallest doc_id of the class (null is smallest), whose first row is the one kept.
    Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z; texts with equal words are one class.
    Texts without words, null and empty ones among them, are each a class of their own. A text shorter than a shingle is near to
    equal ones only. Repeated rows are in one class. An empty table gives no rows.

    Every near pair that agrees in a sketch is found. At a similarity of 0.8 a sketch of a long text agrees with probability 0.41 or less, all of 31 miss below once in a million.
    """
    return classes(by_row(numbered(docs), "texts"), size, sketches, taken, least).drop("row")


def keep_one(docs: DataFrame, size: int = SHINGLE, sketches: int = SKETCHES, taken: int = TAKEN, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of ``docs`` that stay, the first of each class, with all their columns."""
    table = by_row(numbered(docs, whole=True), "texts")
    return rows_kept(table, classes(table, size, sketches, taken, least).filter("kept"), docs.columns)


def classes(table: DataFrame, size: int, sketches: int, taken: int, least: tuple[int, int]) -> DataFrame:
    """``near_dedup`` of a ``by_row`` table, with row numbers."""
    seen = written(sketched(table, size, sketches, taken, least), "sketches")
    groups = seen.filter("same is not null").groupBy("same").agg(F.min("row").alias("rep"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    groups = written(groups, "groups")
    label = linked(groups.select(F.col("rep").alias("row"), "n", "sketch"), table, size, least)
    named = groups.select("same", "rep")
    named = named.withColumn("label", F.col("rep")) if label is None else named.join(
        label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    rows = seen.select("row", "doc_id", "same").join(named.select("same", "label"), "same", "left").withColumn("label", F.coalesce("label", "row"))
    rows = written(rows.select("row", "doc_id", "label"), "classes")
    first = rows.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(first, "label").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size",
                                            (F.col("row") == F.col("first.row")).alias("kept"), "row")
