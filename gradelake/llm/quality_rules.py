"""Text quality by a sparse rule ensemble.

Shallow trees are grown on statistics of labelled texts; every path of a tree is a rule, a
conjunction of comparisons. A logistic model with an absolute-value penalty keeps the rules
that matter. Scoring is one Spark expression over the statistics, so no model leaves the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from gradelake.llm.shared import quoted, texts, written

STATS = ("bytes_log", "words_log", "lines_log", "word_bytes", "line_words", "upper_share", "digit_share", "symbol_share", "bar_share",
         "shout_share", "stop_share", "comma_share", "space_share", "wide_share", "new_words", "same_next", "top_word", "new_lines",
         "tail_symbol", "capital_words", "word_spread")
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\=+_`/", np.uint8)
SAMPLE = 20_000
PREFIX = "_stat_"


def statistics(text: str | None) -> list[float]:
    """The numbers of one whole text, in the order of STATS; all 0 for null or empty."""
    data = (text or "").encode("utf-8", "replace")
    n = len(data)
    if not n:
        return [0.0] * len(STATS)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = data.split(b"\n")
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    same = sum(map(bytes.__eq__, words, words[1:]))
    tail = sum(1 for w in words if not (w[-1] >= 128 or 48 <= w[-1] <= 57 or 97 <= (w[-1] | 32) <= 122 or w[-1] in b".,;:!?)\"'"))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), float(sizes.mean()), np.log1p(m / len(lines)), upper / max(1, upper + lower),
        c[48:58].sum() / n, c[_SYMBOLS].sum() / n, c[124] / m, c[33] / m, c[46] / m, c[44] / m, (c[32] + c[10] + c[9]) / n, c[128:].sum() / n,
        len(counts) / m, same / m, max(counts.values(), default=0) / m, len(set(lines)) / len(lines), tail / m,
        sum(map(bytes.isupper, words)) / m, float(sizes.std())]


def measured(docs: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """``docs`` with one column per statistic of its text (names begin with ``prefix``), computed where the rows are."""
    place = docs.columns.index("text")
    n = len(docs.columns)
    schema = pa.schema([*to_arrow_schema(docs.schema), *((prefix + s, pa.float64()) for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(place)], dtype=float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(schema[k].type) for k in range(n)), *(pa.array(v) for v in values.T)], schema=schema)

    return docs.mapInArrow(run, StructType([*docs.schema, *(StructField(prefix + s, DoubleType()) for s in STATS)]))


#: A rule: comparisons (statistic, above, threshold) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, prefix: str = PREFIX) -> Column:
        """The score between 0 and 1 as an expression over the statistics, whose names begin with ``prefix``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = reduce(lambda a, b: a & b, [F.col(prefix + STATS[s]) > v if above else F.col(prefix + STATS[s]) <= v for s, above, v in rule])
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, s] > v) == above for s, above, v in rule])


def grow(x: np.ndarray, cut: list[np.ndarray], binned: np.ndarray, target: np.ndarray, rows: np.ndarray, stats: np.ndarray,
         depth: int, least: int, path: Rule, rules: set[Rule], step: np.ndarray) -> None:
    """Split ``rows`` where squared error falls most; collect the path of every node, and fill leaf means into ``step``."""
    if path:
        rules.add(path)
    t = target[rows]
    best = (1e-9, -1, -1)
    if depth and len(rows) >= 2 * least:
        for s in stats:
            if not len(cut[s]):
                continue
            k = len(cut[s]) + 1
            n = np.cumsum(np.bincount(binned[rows, s], minlength=k))[:-1]
            total = np.cumsum(np.bincount(binned[rows, s], weights=t, minlength=k))[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            if ok.any():
                gain = np.where(ok, total**2 / np.maximum(n, 1) + (t.sum() - total) ** 2 / np.maximum(len(rows) - n, 1) - t.sum() ** 2 / len(rows), -1)
                if gain.max() > best[0]:
                    best = (float(gain.max()), int(s), int(gain.argmax()))
    if best[1] < 0:
        step[rows] = t.mean()
        return
    _, s, k = best
    above = binned[rows, s] > k
    for side in (False, True):
        grow(x, cut, binned, target, rows[above == side], stats, depth - 1, least, (*path, (s, side, float(cut[s][k]))), rules, step)


def over_rows(z: np.ndarray, of: Callable[[int, np.ndarray], np.ndarray], rows: int = 512) -> np.ndarray:
    """The sum of ``of`` over blocks of rows, each in double precision; the whole matrix is never copied."""
    return sum(of(at, z[at: at + rows].astype(float)) for at in range(0, len(z), rows))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 1e-3, rounds: int = 400, seed: int = 7) -> RuleModel:
    """Rules of boosted trees on random halves of rows and statistics, then logistic weights with an L1 penalty.

    With labels of one kind only, or none, the score is a constant.
    """
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(0.0 if len(y) == 0 else (4.0 if y[0] else -4.0), ())
    rng = np.random.default_rng(seed)
    cut = [np.unique(np.quantile(x[:, s], np.linspace(0.01, 0.99, 48))) for s in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cut[s], x[:, s], "left") for s in range(x.shape[1])], axis=1)
    rules: set[Rule] = set()
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    least = max(3, len(y) // 500)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        stats = rng.permutation(x.shape[1])[: x.shape[1] * 2 // 3]
        step = np.zeros(len(y))
        if len(rows):
            grow(x, cut, binned, residual, rows, stats, depth, least, (), rules, step)
        margin += 0.5 * 4 * step
    if not rules:  # too few rows to split
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    kept = sorted(rules)
    # one matrix of single precision, filled and scaled in place: the driver holds no second one
    z = np.empty((len(y), len(kept)), np.float32)
    for k, rule in enumerate(kept):
        z[:, k] = holds(x, rule)
    mean = z.mean(axis=0)
    scale = np.maximum(np.concatenate([part.std(axis=0) for part in np.array_split(z, -(-len(kept) // 64), axis=1)]), np.float32(0.05))
    z -= mean
    z /= scale
    w, v, b, vb, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0.0, 0.0, 1.0
    top = np.ones(z.shape[1])
    for _ in range(20):  # largest curvature, for the step size
        top = over_rows(z, lambda at, part: part.T @ (part @ top))
        top /= np.linalg.norm(top)
    pace = 4 * len(y) / float(over_rows(z, lambda at, part: np.sum((part @ top) ** 2)) + len(y))
    for _ in range(rounds):  # accelerated proximal gradient
        def slope(at: int, part: np.ndarray) -> np.ndarray:
            error = 1 / (1 + np.exp(-(part @ v + vb))) - y[at: at + len(part)]
            return np.append(part.T @ error, error.sum())

        total = over_rows(z, slope)
        new = v - pace * total[:-1] / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - pace * penalty, 0)
        new_b, new_t = vb - pace * total[-1] / len(y), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    weight = w / scale
    used = [(kept[k], float(weight[k])) for k in np.flatnonzero(w)]
    return RuleModel(float(b - (weight * mean).sum()), tuple(used))


def labelled(stats: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample`` documents for which ``learn`` holds: those with the least id hash.

    The bound is what the driver holds: 20,000 rows of 21 numbers. A hash limit set from the count lets through little more than
    that, so tasks don't each send a full sample. A document with several labels counts by its largest, one with several rows by its least.
    """
    names = [PREFIX + s for s in STATS]
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    rows = stats.filter(learn).join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*names, "quality")).alias("r"))
    rows = written(rows.select("doc_id", F.xxhash64("doc_id").alias("hash"), "r.*"), "labelled")
    n = rows.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    near = rows.filter(F.pmod("hash", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.pmod("hash", F.lit(1 << 30)), "doc_id").limit(sample)
    got = near.select(*names, "quality").toPandas().to_numpy(dtype=float).reshape(-1, len(STATS) + 1)
    return got[:, :-1], got[:, -1]


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from labelled rows whose id remainder is not 0. Empty and null texts have all-zero statistics
    and are scored like any other. Without usable labels every score is 0.5. Repeated rows get equal scores;
    an empty table gives no rows. Only the text is read for a score; other columns play no part.
    """
    stats = written(measured(texts(docs)).drop("text"), "statistics")
    model = fit(*labelled(stats, labels, remainder() != 0, sample))
    score = model.column()
    return stats.select("doc_id", (remainder() == 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns. Texts don't move: statistics and
    score are computed beside them. Learns from all labelled rows, or ``sample`` of them."""
    stats = measured(texts(docs)).drop("text")
    model = fit(*labelled(stats, labels, F.lit(True), sample))
    prefix = PREFIX
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return measured(docs, prefix).filter(model.column(prefix) >= threshold).select(*map(quoted, docs.columns))
