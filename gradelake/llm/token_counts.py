"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton finds every vocabulary piece in a text; dynamic programming carries
the best score and its number of pieces from position to position. Ties are the tokenizer's: of equal
scores the longest last piece wins, and an unknown character is tried only where it is no piece itself,
and wins only with a better score. Scores are added in double precision.

No piece has a word mark behind another character, so a text falls into segments at word marks
that share nothing; a task counts each different segment once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED, LONGEST = 1 << 19, 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; ``worst`` is the least score of all entries, ``bytes_for_unknown``: one piece per byte."""

    pieces: tuple[tuple[str, float], ...]
    worst: float
    bytes_for_unknown: bool


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a piece model file, read on the driver; control, byte and unused entries are never matched."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = tuple((model.id_to_piece(i), model.get_score(i)) for i in ids
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)))
    return Vocabulary(plain, min(model.get_score(i) for i in ids), any(model.is_byte(i) for i in ids))


class Counter:
    """Counts pieces of texts; remembers the counts of short segments."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = vocabulary.worst - UNKNOWN_PENALTY
        self.by_bytes = vocabulary.bytes_for_unknown
        whole = any(MARK in p.lstrip(MARK) for p, _ in vocabulary.pieces)
        self.segments = re.compile(r"(?s).+" if whole else f"{MARK}+[^{MARK}]*")
        self.known: dict[str, int] = {}

    def best(self, segment: str) -> tuple[float, int]:
        """Score and number of pieces of the best path."""
        n = len(segment)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        at = 0  # ends before this are settled
        reached, single = None, False

        def settle(end: int) -> None:
            nonlocal reached, single
            if not single and (reached is None or score[end - 1] + self.unknown > reached):
                reached = score[end - 1] + self.unknown
                pieces[end] = pieces[end - 1] + (len(segment[end - 1].encode("utf-8", "replace")) if self.by_bytes else 1)
            score[end] = reached
            reached, single = None, False

        for last, (length, value) in self.automaton.iter(segment):
            end = last + 1
            while at + 1 < end:
                at += 1
                settle(at)
            start = end - length
            total = score[start] + value
            if reached is None or total > reached:
                reached = total
                pieces[end] = pieces[start] + 1
            single = single or length == 1
        while at < n:
            at += 1
            settle(at)
        return score[n], pieces[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for segment in self.segments.findall(MARK + text.replace(" ", MARK)):
            n = known.get(segment)
            if n is None:
                n = self.best(segment)[1]
                if len(segment) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[segment] = n
            total += n
        return total


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per input row: doc_id, n_chars, n_tokens.

    A text is read as a word mark followed by the text with spaces as marks, whole. Null and empty texts have no tokens.
    Characters that no piece covers count one token per UTF-8 byte where the vocabulary has byte pieces, else one.
    Repeated rows are counted each for itself; an empty table gives no rows.
    The vocabulary, tens of thousands of pieces whatever the corpus, is sent to the tasks.
    """
    body = texts(docs)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = pa.schema([*to_arrow_schema(body.select("doc_id").schema), ("n_tokens", pa.int64()), ("n_chars", pa.int64())])
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            got = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), pa.array([counter.count(t) for t in got], pa.int64()),
                                              pa.array([len(t or "") for t in got], pa.int64())], schema=schema)

    return body.mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_chars long").select("doc_id", "n_chars", "n_tokens")
