"""Benchmark passages in training text, found by an FM-index per training shard.

A shard is a run of documents of one input partition, about ``SHARD_WORDS`` words. Its task
indexes the words of the shard and looks up all benchmark windows together by backward
search. Words that stand in no pair of neighbours of any window can't be part of an
occurrence; they become separators before the index is built, which leaves it small and
changes no result. Documents are never moved: the only thing sent is the benchmark, in
blocks of bounded size, one pass per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.fm_index import FMIndex
from gradelake.llm.shared import bucketed, numbered, rows_kept, written
from gradelake.llm.wordtext import word_offsets, words

WINDOW, SHARD_WORDS, BLOCK_BYTES = 13, 1 << 20, 16 << 20
SCHEMA = ("row long, doc_id {id}, n_words long, n_hit long, items array<string>, "
          "word_spans array<struct<first:long,last:long>>, byte_spans array<struct<start:long,end:long>>")


class Windows:
    """All windows of a block of benchmark items, as rows of word numbers from 1."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                owners.setdefault(tuple(ids[at: at + size]), set()).add(item)
        self.owners = list(owners.values())
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.rows = np.zeros((len(owners), size), dtype=np.int64)
        for row, w in zip(self.rows, owners):
            row[: len(w)] = w
        self.base = len(self.vocabulary) + 1
        left, right = self.rows[:, :-1].ravel(), self.rows[:, 1:].ravel()
        self.pairs = np.unique((left * self.base + right)[right > 0])
        self.single = np.unique(self.rows[self.lengths == 1, 0])
        self.least = int(self.lengths.min()) if len(owners) else 0


def hits_in_shard(shard: list[list[bytes]], w: Windows) -> list[tuple[np.ndarray, set[str]]]:
    """For each document of a shard the numbers of its hit words, and the items found."""
    none = (np.empty(0, dtype=np.int64), set())
    counts = [len(d) for d in shard]
    starts = np.concatenate([[0], np.cumsum([c + 1 for c in counts])])
    ids = np.zeros(starts[-1], dtype=np.int64)
    for doc, at, n in zip(shard, starts, counts):
        ids[at: at + n] = np.fromiter(map(w.vocabulary.get, doc, repeat(0)), np.int64, n)
    linked = np.zeros(len(ids), dtype=bool)  # a word and the next one stand side by side in a window
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    if len(both) and len(w.pairs):
        code = ids[both] * w.base + ids[both + 1]
        found = w.pairs[np.minimum(np.searchsorted(w.pairs, code), len(w.pairs) - 1)] == code
        linked[both[found]] = True
    live = linked.copy()
    live[1:] |= linked[:-1]
    if len(w.single):
        live |= np.isin(ids, w.single)
    kept = np.flatnonzero(live)
    if not len(kept):
        return [none] * len(shard)
    piece = np.concatenate([[0], np.cumsum(~linked[kept[:-1]])])  # a piece ends where a word isn't linked to the next
    long_enough = np.bincount(piece) >= w.least
    kept, piece = kept[long_enough[piece]], piece[long_enough[piece]]
    if not len(kept):
        return [none] * len(shard)
    at = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    sequence = np.zeros(at[-1] + 1, dtype=np.int64)
    sequence[at] = ids[kept]
    where = np.zeros(len(sequence), dtype=np.int64)
    where[at] = kept
    index = FMIndex(sequence)
    lo, hi = index.search(w.rows, w.lengths)
    which = np.repeat(np.arange(len(lo)), hi - lo)
    if not len(which):
        return [none] * len(shard)
    first = index.locate(np.repeat(lo, hi - lo) + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))
    begin = where[first]
    spans = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(spans, begin, 1)
    np.add.at(spans, begin + w.lengths[which], -1)
    covered = np.flatnonzero(np.cumsum(spans) > 0)
    out, doc_of, doc_of_hit = [none] * len(shard), np.searchsorted(starts, covered, "right") - 1, np.searchsorted(starts, begin, "right") - 1
    for doc in np.unique(doc_of_hit):
        windows = np.unique(which[doc_of_hit == doc])
        out[doc] = (covered[doc_of == doc] - starts[doc], set().union(*(w.owners[k] for k in windows)))
    return out


def runs(at: np.ndarray) -> list[tuple[int, int]]:
    """Sorted numbers as runs (first, last) of neighbours."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist()))


def scan(items: list[tuple[str, str | None]], size: int, shard_words: int, schema: pa.Schema):
    """The task: batches of (row, doc_id, text) in, one row per document out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(items, size)

        def done(rows: list, shard: list) -> pa.RecordBatch:
            out = []
            for (row, doc_id, text), doc, (hit, found) in zip(rows, shard, hits_in_shard(shard, w)):
                spans = runs(hit)
                places = word_offsets(text) if spans else []
                out.append({"row": row, "doc_id": doc_id, "n_words": len(doc), "n_hit": len(hit), "items": sorted(found),
                            "word_spans": [{"first": a, "last": b} for a, b in spans],
                            "byte_spans": [{"start": places[a][0], "end": places[b][1]} for a, b in spans]})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        rows, shard, held = [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                shard.append(words(row[2]))
                held += len(shard[-1])
                if held >= shard_words:
                    yield done(rows, shard)
                    rows, shard, held = [], [], 0
        if rows:
            yield done(rows, shard)

    return run


def merged(parts: DataFrame) -> DataFrame:
    """One row per document from one row per benchmark block: spans that touch are joined, items united."""

    def joined(spans: str, a: str, b: str, gap: int):
        ordered = F.array_sort(F.flatten(F.collect_list(spans)))
        return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)[b] + gap >= s[a]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)[a].alias(a), F.greatest(F.element_at(acc, -1)[b], s[b]).alias(b)))),
        ).otherwise(F.concat(acc, F.array(s))))

    one = parts.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        joined("word_spans", "first", "last", 1).alias("word_spans"), joined("byte_spans", "start", "end", 0).alias("byte_spans"))
    hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    return one.withColumn("n_hit", hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_words: int = SHARD_WORDS,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items, word_spans, byte_spans, contaminated.

    Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z. A window is ``size``
    consecutive words of an item, or all words of a shorter one. A document word inside an occurrence of any
    window is hit; ``contaminated`` when at least a twentieth of the words are. Spans are maximal runs of hit words,
    ends included for words, excluded for UTF-8 bytes. Null and empty texts have no words and are clean; items
    without words are never found; a null item_id is named ``null``; items sharing an id count once. Empty tables
    give no rows, or clean ones. Repeated rows are judged each for itself.

    The benchmark is read in blocks of about ``block_bytes``, chosen by hash, so what a task holds is bounded whatever
    its size; with one block, as usual, no shuffle takes place at all.
    """
    return judged(numbered(docs), benchmark, size, shard_words, block_bytes).drop("row")


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    table = bucketed(docs, whole=True)
    return rows_kept(table, judged(table.select("row", "doc_id", "text"), benchmark, size).filter("not contaminated"), docs.columns)


def judged(body: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``decontaminate`` of numbered rows (row, doc_id, text), with their number."""
    schema = SCHEMA.format(id=dict(body.dtypes)["doc_id"])
    arrow = pa.schema([("row", pa.int64()), ("doc_id", _arrow(body)), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                       ("word_spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                       ("byte_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-held // block_bytes) or 1
    parts = None
    for block in range(blocks):
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()]
        part = body.mapInArrow(scan(rows, size, shard_words, arrow), schema)
        parts = part if parts is None else parts.unionByName(part)
    found = parts if blocks == 1 else merged(written(parts, "hits"))
    share = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select("row", "doc_id", "n_words", "n_hit", "items", "word_spans", "byte_spans", share.alias("contaminated"))


def _arrow(body: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(body.schema["doc_id"].dataType)
