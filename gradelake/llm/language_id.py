"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads pieces of ``PIECE`` bytes in both directions, gives every byte a
probability per language, and a document gets the mean over all its bytes. Training is plain numpy,
back through time, on a bounded sample of pieces; tasks get the weights, a few thousand numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.llm.shared import texts
from gradelake.llm.quality_rules import remainder

PIECE, HIDDEN, EMBED, AT_ONCE = 64, 8, 8, 4096
SAMPLE_DOCS, SAMPLE_PIECES = 3000, 6144
#: Least documents and pieces of a language that has them, and most pieces of a document.
LEAST_OF, MOST_OF = 16, 32


def cut(data: bytes, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """All bytes as rows of ``size`` (the last one padded with 0) and the lengths of the rows."""
    n = -(-len(data) // size)
    rows = np.zeros(n * size, dtype=np.uint8)
    rows[: len(data)] = np.frombuffer(data, np.uint8)
    lengths = np.full(n, size)
    if n:
        lengths[-1] = len(data) - (n - 1) * size
    return rows.reshape(n, size), lengths


def fresh(classes: int, rng: np.random.Generator, hidden: int = HIDDEN, embed: int = EMBED) -> dict[str, np.ndarray]:
    def some(*shape):
        return (rng.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(np.float32)

    w = {"embed": some(256, embed) * 16 ** 0.5, "out": some(2 * hidden, classes), "out_b": np.zeros(classes, np.float32)}
    for d in ("f", "b"):
        w |= {f"in_{d}": some(embed, 3 * hidden), f"bias_{d}": np.zeros(3 * hidden, np.float32), f"gates_{d}": some(hidden, 2 * hidden), f"cand_{d}": some(hidden, hidden)}
    return w


def squash(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A smooth step from -1 to 1 that costs a quarter of tanh: x (27 + x^2) / (27 + 9 x^2), flat beyond 3.

    Works in place; the second result is the clipped input, which ``slope`` needs.
    """
    np.clip(x, -3, 3, out=x)
    square = x * x
    out = square + 27
    out *= x
    square *= 9
    square += 27
    out /= square
    return out, x


def slope(x: np.ndarray) -> np.ndarray:
    """Derivative of ``squash`` at a clipped input."""
    return (x * x - 9) ** 2 / (9 * (3 + x * x) ** 2)


def sweep(w: dict[str, np.ndarray], d: str, x: np.ndarray, live: np.ndarray | None, keep: bool):
    """States of one direction, [time, piece, hidden], and what the way back needs. ``x``: [time, piece] bytes."""
    h_n = w[f"cand_{d}"].shape[0]
    table = w["embed"] @ w[f"in_{d}"] + w[f"bias_{d}"]
    table[:, : 2 * h_n] *= 0.5
    gates = 0.5 * w[f"gates_{d}"]
    states = np.empty((len(x), x.shape[1], h_n), dtype=table.dtype)
    h, saved = np.zeros((x.shape[1], h_n), table.dtype), []
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        a = table[x[t]]
        g, g_in = squash(a[:, : 2 * h_n] + h @ gates)  # update and reset gate
        g *= 0.5
        g += 0.5
        z, r = g[:, :h_n], g[:, h_n:]
        rh = r * h
        c, c_in = squash(a[:, 2 * h_n:] + rh @ w[f"cand_{d}"])
        if keep:
            saved.append((t, h, z, r, rh, c, slope(g_in) * 0.25, slope(c_in)))
            c = c.copy()
        c -= h
        c *= z
        c += h
        if live is not None:
            c *= live[t]
        states[t] = h = c
    return states, saved


def probabilities(w: dict[str, np.ndarray], x: np.ndarray, live: np.ndarray | None, keep: bool = False):
    """Language probabilities of every byte, [time, piece, class]. ``live``: 1 for bytes, 0 for padding; None if all are bytes."""
    f, f_saved = sweep(w, "f", x, live, keep)
    b, b_saved = sweep(w, "b", x, live, keep)
    h_n = f.shape[2]
    logits = f @ w["out"][:h_n]
    logits += b @ w["out"][h_n:]
    logits += w["out_b"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(axis=2, keepdims=True)
    return p, np.concatenate([f, b], axis=2) if keep else None, (f_saved, b_saved)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Cross entropy of all live bytes against the language of their document, back through time."""
    p, both, saved = probabilities(w, x, live, True)
    mass = live * weight[None, :, None]
    d_logits = (p - np.eye(p.shape[2], dtype=p.dtype)[y][None]) * mass / mass.sum()
    flat = d_logits.reshape(-1, p.shape[2])
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"], g["out_b"] = both.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
    d_both = d_logits @ w["out"].T
    h_n = both.shape[2] // 2
    for d, steps, d_out in (("f", saved[0], d_both[:, :, :h_n]), ("b", saved[1], d_both[:, :, h_n:])):
        d_table = np.zeros((256, 3 * h_n), both.dtype)
        d_h = np.zeros((x.shape[1], h_n), both.dtype)
        for t, h, z, r, rh, c, g_slope, c_slope in reversed(steps):
            d_new = (d_h + d_out[t]) * live[t]
            d_c = d_new * z * c_slope
            d_rh = d_c @ w[f"cand_{d}"].T
            d_g = np.concatenate([d_new * (c - h), d_rh * h], axis=1) * g_slope
            g[f"cand_{d}"] += rh.T @ d_c
            g[f"gates_{d}"] += h.T @ d_g
            d_h = d_new * (1 - z) + d_rh * r + d_g @ w[f"gates_{d}"].T
            np.add.at(d_table, x[t], np.concatenate([d_g, d_c], axis=1))
        g["embed"] += d_table @ w[f"in_{d}"].T
        g[f"in_{d}"], g[f"bias_{d}"] = w["embed"].T @ d_table, d_table.sum(axis=0)
    return g


def train(rows: np.ndarray, lengths: np.ndarray, y: np.ndarray, classes: int, epochs: int = 5, batch: int = 256, rate: float = 0.01, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights after ``epochs`` passes of Adam; languages count alike, however many pieces they have."""
    rng = np.random.default_rng(seed)
    w = fresh(classes, rng)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    weight = (1 / np.maximum(np.bincount(y, minlength=classes), 1))[y].astype(np.float32)
    total = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), -(-len(y) // batch)):
            live = (np.arange(rows.shape[1])[:, None] < lengths[at][None]).astype(np.float32)[:, :, None]
            g = gradients(w, rows[at].T, live, y[at], weight[at])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k in w:
                v = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                pace = rate * (1 - 0.9 * step / total)
                w[k] = w[k] - pace * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return w


def training_pieces(docs: DataFrame, sample_docs: int, sample_pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """A bounded sample of pieces, and the languages of all rows there are to learn from.

    Each language has an equal part of ``sample_docs`` and ``sample_pieces``, or ``LEAST_OF`` if that is more. Its documents are chosen
    by id hash, all if it has fewer, and its pieces by hash, at most ``MOST_OF`` a document. A last piece below 16 bytes
    counts only where it is the whole text.
    """
    usable = docs.filter((remainder() != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))
    n = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(n)
    if not n:
        return np.empty((0, PIECE), np.uint8), np.empty(0, int), np.empty(0, int), []
    some, most = max(LEAST_OF, sample_docs // len(langs)), max(LEAST_OF, sample_pieces // len(langs))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, some / n[lang]) * (1 << 30)))])
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= share[F.col("lang")]).dropDuplicates(["doc_id", "lang", "text"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, lengths = cut(text.encode("utf-8", "replace"))
                whole = len(rows) if len(rows) == 1 or lengths[-1] >= 16 else len(rows) - 1
                got = nsmallest(MOST_OF, (r[:n].tobytes() for r, n in zip(rows[:whole], lengths)), key=lambda x: (crc32(x), x))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array(got, pa.binary())], names=["lang", "piece"])

    pieces = picked.mapInArrow(run, "lang string, piece binary")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("piece", "lang"), "piece")
    got = pieces.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).orderBy("lang", "nth").collect()
    rows, lengths = np.zeros((len(got), PIECE), np.uint8), np.zeros(len(got), int)
    for k, r in enumerate(got):
        rows[k, : len(r["piece"])] = np.frombuffer(bytes(r["piece"]), np.uint8)
        lengths[k] = len(r["piece"])
    return rows, lengths, np.array([langs.index(r["lang"]) for r in got], dtype=int), langs


def pooled(w: dict[str, np.ndarray], datas: list[bytes], at_once: int = AT_ONCE) -> np.ndarray:
    """Mean probability per language of each byte string; every byte counts, whatever the length."""
    classes = len(w["out_b"])
    total = np.zeros((len(datas), classes))
    rows, lengths, owner, held = [], [], [], 0

    def flush() -> None:
        x, n, of = np.concatenate(rows), np.concatenate(lengths), np.concatenate(owner)
        full = n == PIECE
        for part in (np.flatnonzero(full), np.flatnonzero(~full)):
            for at in range(0, len(part), at_once):
                k = part[at: at + at_once]
                live = None if full[k[0]] else (np.arange(PIECE)[:, None] < n[k][None]).astype(np.float32)[:, :, None]
                p, _, _ = probabilities(w, np.ascontiguousarray(x[k].T), live)
                np.add.at(total, of[k], (p if live is None else p * live).sum(axis=0))

    for k, data in enumerate(datas):
        r, n = cut(data)
        rows.append(r)
        lengths.append(n)
        owner.append(np.full(len(n), k))
        held += len(n)
        if held >= at_once:
            flush()
            rows.clear(), lengths.clear(), owner.clear()
            held = 0
    if held:
        flush()
    return total / np.maximum([[len(d)] for d in datas], 1) if datas else total


def languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_pieces: int = SAMPLE_PIECES) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from rows with a text and a language whose id remainder is not 0. ``score`` is the mean probability of the
    predicted language over all bytes; of equal languages the first by name wins. A null text, or one without a letter, is ``und`` with score 0,
    and so is all when there is nothing to learn from. Repeated rows get equal answers; an empty table
    gives no rows.
    """
    rows, lengths, y, langs = training_pieces(docs.select("doc_id", "text", "lang"), sample_docs, sample_pieces)
    w = train(rows, lengths, y, len(langs)) if langs else None
    body = texts(docs).select("doc_id", (remainder() == 0).alias("held_out"), "text")
    from pyspark.sql.pandas.types import to_arrow_schema

    head = to_arrow_schema(body.select("doc_id", "held_out").schema)
    schema = pa.schema([*head, ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                body = part.column(2).to_pylist()
                spoken = [k for k, t in enumerate(body) if w is not None and t and any(map(str.isalpha, t))]
                p = pooled(w, [body[k].encode("utf-8", "replace") for k in spoken]) if spoken else np.empty((0, 1))
                lang, score = ["und"] * len(body), [0.0] * len(body)
                for k, row in zip(spoken, p):
                    best = int(row.argmax())
                    lang[k], score[k] = langs[best], min(1.0, float(row[best]))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema[0].type), part.column(1).cast(pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=schema)

    return body.mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
