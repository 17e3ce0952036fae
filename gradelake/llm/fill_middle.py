"""Fill-in-middle transformation with content-defined chunk memoization.

A rolling hash over the bytes of a text chooses chunk borders, so passages that texts share become equal chunks.
What a cut needs to know of a chunk is a small summary: its code points, the tokens that start in it, and whether a letter
stands at its first and last place. A task remembers the summaries by the chunk's bytes themselves, so a shared chunk
is read once and verified by content. Adding up the counts of a text's chunks, less one where a
run of letters goes over a border, gives its number of tokens and the chunk that holds a cut; only that chunk is looked into.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gradelake.llm.shared import texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes the rolling hash sees; a border once in 2 ** BORDER_BITS places on average; least and largest bytes of a chunk.
WINDOW, BORDER_BITS, LEAST, LARGEST = 16, 9, 64, 8192
#: Bytes of chunks a task remembers, in two generations.
REMEMBERED = 32 << 20
_STEP = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW bytes that end at each place (of fewer at the start)."""
    h, width, step = data.astype(np.uint32), 1, _STEP
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] * step
        h, width, step = wider, 2 * width, step * step
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks, always between code points. At most LARGEST bytes a chunk, at least LEAST but for the last one."""
    size = len(data)
    if size <= LEAST:
        return [size] if size else []
    with np.errstate(over="ignore"):
        marked = (rolling(data) * _MIX) >> np.uint32(32 - BORDER_BITS) == 0
    starts = (data & 0xC0) != 0x80
    places = (np.flatnonzero(marked[:-1] & starts[1:]) + 1).tolist()
    ends, last = [], 0
    while size - last > LEAST:
        k = bisect_left(places, last + LEAST)
        end = places[k] if k < len(places) else size
        if end - last > LARGEST:
            end = last + LARGEST
            while end - last > LEAST and not starts[end]:
                end -= 1
        ends.append(end)
        last = end
    if last < size:
        ends.append(size)
    return ends


def token_starts(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: begins a code point, is a letter A-Z or a-z, begins a token (as if no letter stood before the chunk)."""
    data = np.frombuffer(chunk, np.uint8)
    lead = (data & 0xC0) != 0x80
    letter = ((data | 32) - np.uint8(97)) < 26
    start = lead.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    return lead, letter, start


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Code points, token starts, letter at the first place, letter at the last place."""
    lead, letter, start = token_starts(chunk)
    return int(np.count_nonzero(lead)), int(np.count_nonzero(start)), bool(letter[0]), bool(letter[-1])


class Summaries:
    """Chunk summaries by content. Two generations, so that what is in use stays when the older one is let go."""

    def __init__(self, remembered: int = REMEMBERED):
        self.young: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.old: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.held, self.remembered, self.read = 0, remembered // 2, 0

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found = summary(chunk)
                self.read += 1
            if self.held + len(chunk) > self.remembered:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = found
            self.held += len(chunk)
        return found

    def cuts(self, text: bytes | None, first: int, second: int) -> tuple[int, int, int]:
        """Tokens of the text, and the code points before its tokens number min and max of first % (n + 1) and second % (n + 1)."""
        text = text or b""
        ends = chunk_ends(np.frombuffer(text, np.uint8))
        chars, tokens, joined, after = [], [], [], False
        for start, end in zip([0, *ends], ends):
            n_chars, n_tokens, head, tail = self.of(text[start:end])
            joined.append(after and head)
            chars.append(n_chars)
            tokens.append(n_tokens - joined[-1])
            after = tail
        before, upto = [0, *accumulate(chars)], list(accumulate(tokens))
        n = upto[-1] if upto else 0

        def at(unit: int) -> int:
            if unit == n:
                return before[-1]
            k = bisect_right(upto, unit)
            lead, _, start = token_starts(text[ends[k - 1] if k else 0: ends[k]])
            here = unit - (upto[k - 1] if k else 0) + joined[k]
            return before[k] + int(np.count_nonzero(lead[: np.flatnonzero(start)[here]]))

        a, b = first % (n + 1), second % (n + 1)
        return n, at(min(a, b)), at(max(a, b))


_SUMMARIES = Summaries()


@F.arrow_udf(StructType([StructField(name, LongType()) for name in ("n", "first", "second")]))
def cut_places(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    got = [_SUMMARIES.cuts(t, a, b) for t, a, b in zip(text.to_pylist(), first.to_pylist(), second.to_pylist())]
    columns = list(zip(*got)) or [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second"])


def draw(doc_id, number: int) -> Column:
    """The number-th group of eight hex digits of the document's hash, from 1, as a whole number."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def fill_middle(docs: DataFrame, plain: int = 10, suffix_first: int = 20) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    Tokens are runs of A-Z and a-z, and each other code point by itself; ``n`` is their number in the whole text. Two of the
    document's hash numbers choose after how many tokens prefix and middle end. ``plain`` per cent of the documents keep their text,
    as do empty texts and those that hold one of the marks; of the rest ``suffix_first`` per cent have form ``spm``, else ``psm``.
    Lengths are in code points and null for ``plain``. A null text counts as empty, a null doc_id as an empty string. Repeated rows
    get equal results, each for itself; an empty table gives no rows. Texts are not shuffled and stay in the JVM but for the cut places.
    """
    body = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = body.select("doc_id", "text", draw("doc_id", 3).alias("third"), draw("doc_id", 4).alias("fourth"), cut_places(
        F.col("text").cast("binary"), draw("doc_id", 1), draw("doc_id", 2)).alias("cut"))
    held = [F.contains("text", F.lit(mark)) for mark in (PREFIX, SUFFIX, MIDDLE)]
    form = F.when((F.col("text") == "") | held[0] | held[1] | held[2] | (F.col("third") % 100 >= 100 - plain), "plain").when(
        F.col("fourth") % 100 < suffix_first, "spm").otherwise("psm")
    a, b, ends = F.col("cut.first"), F.col("cut.second"), F.lit(2**31 - 1)
    parts = {PREFIX: F.substring("text", F.lit(1), a.cast("int")), MIDDLE: F.substring("text", (a + 1).cast("int"), (b - a).cast("int")),
             SUFFIX: F.substring("text", (b + 1).cast("int"), ends)}

    def laid(*order: str) -> Column:
        return F.concat(*[x for mark in order for x in (F.lit(mark), parts[mark])])

    moved = F.col("form") != "plain"
    return found.withColumn("form", form).select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(moved, a).alias("prefix_chars"), F.when(moved, b - a).alias("middle_chars"),
        F.when(F.col("form") == "psm", laid(PREFIX, SUFFIX, MIDDLE)).when(F.col("form") == "spm", laid(SUFFIX, PREFIX, MIDDLE)).otherwise(F.col("text")).alias("output"))


def restored(output, form) -> Column:
    """The text that an output of a form was made from. Null output gives null."""
    out, psm = F.col(output), F.col(form) == "psm"
    parts = F.split(F.substring(out, F.lit(len(PREFIX) + 1), F.lit(2**31 - 1)), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    joined = F.transform(F.array(parts), lambda p: F.concat(F.get(p, F.when(psm, 0).otherwise(1)), F.get(p, F.lit(2)), F.get(p, F.when(psm, 1).otherwise(0))))
    return F.when(F.col(form) == "plain", out).otherwise(joined[0])
