"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. The table in the order of these keys is cut into
shelves (one task's share) and annuli (some hundred neighbours of one pivot). A query bounds its distance to the vectors of an annulus
by the triangle inequality, |d(query, pivot) - d(vector, pivot)|, and with the annulus' largest norm also their inner products:
2 <q, v> = |q|^2 + |v|^2 - |q - v|^2. It first searches the shelf where it lies itself, which gives a k-th best score;
then only shelves whose bound reaches that score, and in each of them annuli in the order of their bounds until one falls below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gradelake.llm.shared import written

PIVOTS, SAMPLE = 32, 4096
#: Vectors of an annulus; of a shelf, about; queries that meet one shelf in one task, about.
ANNULUS, SHELF, GROUP = 512, 1 << 15, 1 << 14
#: Relative slack of bounds, far above the rounding of distances in double precision.
SLACK = 1e-6
LONG = 2**63 - 1


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) as doubles, without the vectors that take no part."""
    x = F.col("v")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    body = vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col), lambda c: c.cast("double") * scale).alias("v"))
    return body.where(sound).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of equal length as the rows of a matrix, rounded down."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(len(column), dim))


def fit_pivots(sample: np.ndarray, pivots: int = PIVOTS, rounds: int = 6) -> np.ndarray:
    """Whole-number centres: spread starting points, then a few rounds of moving each to the mean of its vectors."""
    at, near = [0], np.full(len(sample), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        while len(at) < min(pivots, len(sample)):
            near = np.minimum(near, np.nan_to_num(((sample - sample[at[-1]]) ** 2).sum(axis=1), nan=np.inf))
            far = int(near.argmax())
            if not near[far] > 0:
                break
            at.append(far)
        centres = sample[at]
        for _ in range(rounds):
            own = distances(sample, centres).argmin(axis=1)
            moved = [np.round(sample[own == k].mean(axis=0)) if (own == k).any() else c for k, c in enumerate(centres)]
            centres = np.array(moved)
    return centres


def distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances, each from the differences themselves: no cancellation."""
    return np.stack([np.sqrt(((v - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def pivots_of(vectors: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """Pivots for each length of vector, from at most ``sample`` vectors with the least hash of their row. Other lengths have the origin."""
    taken = vectors.select("v", "dim", F.xxhash64("row", "v").alias("h")).orderBy("h").limit(sample).select("v", "dim").toArrow()
    dims = np.array(taken["dim"].to_pylist(), dtype=np.int64)
    lists = taken["v"].combine_chunks()
    return {int(d): fit_pivots(matrix(lists.take(pa.array(np.flatnonzero(dims == d))), int(d)), pivots) for d in set(dims.tolist())}


def keyed(vectors: DataFrame, pivots: dict[int, np.ndarray], query_step: int) -> DataFrame:
    """Adds pivot, distance to it and squared norm, and for the queries their distances to all pivots."""
    kind = vectors.schema["vec_id"].dataType
    schema = pa.schema([("row", pa.int64()), ("vec_id", to_arrow_type(kind)), ("dim", pa.int32()), ("v", pa.list_(pa.float64())),
                        ("pivot", pa.int32()), ("far", pa.float64()), ("norm", pa.float64()), ("to_pivots", pa.list_(pa.float64()))])
    asked = F.coalesce(F.col("vec_id") % query_step == 0, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                v = matrix(part.column("v"), int(d))
                with np.errstate(over="ignore", invalid="ignore"):
                    far = np.nan_to_num(distances(v, pivots.get(int(d), np.zeros((1, int(d))))), nan=np.inf)
                    norm = (v * v).sum(axis=1)
                own = far.argmin(axis=1)
                asks = part.column("asked").to_pylist()
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("vec_id").cast(schema.field("vec_id").type), part.column("dim"), pa.array(list(v), schema.field("v").type),
                    pa.array(own, pa.int32()), pa.array(far[np.arange(len(own)), own]), pa.array(norm),
                    pa.array([row if q else None for q, row in zip(asks, far)], schema.field("to_pivots").type)], schema=schema)

    return vectors.withColumn("asked", asked).mapInArrow(
        run, f"row long, vec_id {kind.simpleString()}, dim int, v array<double>, pivot int, far double, norm double, to_pivots array<double>")


def shelved(rows: DataFrame, shelf: int, annulus: int) -> DataFrame:
    """One row per annulus, in shelves: pivot, least and largest distance, largest norm, ids and vectors.

    The order by (length, pivot, distance, row) is dealt by range, so one pivot's vectors, and any number of equal ones,
    go to as many shelves as they fill. Inside an annulus vectors are in the order of their ids.
    """
    kind = rows.schema["vec_id"].dataType
    ids = to_arrow_type(kind)
    schema = pa.schema([("shelf", pa.int32()), ("dim", pa.int32()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("norm", pa.float64()),
                        ("rows", pa.list_(pa.int64())), ("ids", pa.list_(ids)), ("vectors", pa.binary())])

    def packed(part: pa.Table) -> pa.RecordBatch:
        dim, far = part["dim"][0].as_py(), part["far"].to_numpy()
        part = part.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last
        v = part["v"].combine_chunks().flatten().to_numpy()
        small = v.astype(np.float32)
        data = small if (small == v).all() else v
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((
            part["shelf"][0].as_py(), dim, part["pivot"][0].as_py(), far.min(), far.max(), part["norm"].to_numpy().max(),
            part["row"].to_pylist(), part["vec_id"].to_pylist(), data.tobytes()), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, n = [], None, 0
        for batch in batches:
            keys = list(zip(batch.column("dim").to_pylist(), batch.column("pivot").to_pylist()))
            start = 0
            for i, k in enumerate(keys):
                if k != key or n == annulus:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield packed(pa.Table.from_batches(held))
                    held, key, n, start = [], k, 0, i
                n += 1
            held.append(batch.slice(start))
        if held:
            yield packed(pa.Table.from_batches(held))

    order = ["dim", "pivot", "far", "row"]
    spread = rows.repartitionByRange(shelf, *order).sortWithinPartitions(*order)
    return spread.select("row", "vec_id", "dim", "v", "pivot", "far", "norm", F.spark_partition_id().alias("shelf")).mapInArrow(
        run, f"shelf int, dim int, pivot int, lo double, hi double, norm double, rows array<long>, ids array<{kind.simpleString()}>, vectors binary")


def reach(norm, top, gap):
    """The largest score that a query of squared norm ``norm`` can have with vectors of squared norm up to ``top``, at least ``gap`` away."""
    return (norm + top - gap * gap) / 2 + SLACK * (norm + top) + 1e-3


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: doubles where no partial sum can pass 2^53, else Python's integers."""
    with np.errstate(over="ignore"):
        most = np.sqrt((q * q).sum(axis=1).max(initial=0)) * np.sqrt((v * v).sum(axis=1).max(initial=0))
    if most < 2**52:
        return (q @ v.T).astype(np.int64)
    return np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in v], object).T


class Best:
    """The k best of each query so far: by score, then id, then row."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.found: list[list[tuple]] = [[] for _ in range(queries)]

    def add(self, which: np.ndarray, scores: np.ndarray, own: np.ndarray, ids: list, rows: np.ndarray) -> None:
        """``scores[i]`` of query ``which[i]`` with an annulus in id order; equal scores rank by place."""
        n = scores.shape[1]
        for i, q in enumerate(which.tolist()):
            line = scores[i]
            if line.dtype == np.int64 and n > 4 * self.k:
                edge = np.partition(line, n - self.k - 1)[n - self.k - 1]  # one more, for the query itself
                more = np.flatnonzero(line > edge)
                at = np.concatenate([more, np.flatnonzero(line == edge)[: self.k + 1]])
            else:
                at = np.arange(n)
            new = [(-max(-LONG - 1, min(LONG, int(line[j]))), ids[j] is None, ids[j], int(rows[j])) for j in at.tolist() if rows[j] != own[i] and line[j] >= self.floor[q]]
            if new:
                kept = sorted(self.found[q] + new, key=lambda x: (x[0], x[1], x[3] if x[1] else x[2], x[3]))[: self.k]
                self.found[q] = kept
                if len(kept) == self.k:
                    self.floor[q] = max(self.floor[q], float(-kept[-1][0]))


def searched(asked: DataFrame, shelves: DataFrame, groups: int, k: int, kind) -> DataFrame:
    """Up to ``k`` best of every (query, shelf) asked: (query_id, query_row, vec_id, row, score).

    ``asked`` has shelf, row, vec_id, dim, v, norm, to_pivots and floor, a score below which nothing is wanted.
    Where many queries meet a shelf, they do so in groups: both sides of a task stay bounded.
    """
    ids = to_arrow_type(kind)
    out = pa.schema([("query_id", ids), ("query_row", pa.int64()), ("vec_id", ids), ("row", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[tuple] = []
        dims = np.array(left["dim"].to_pylist(), dtype=np.int64)
        annuli = right.select(["dim", "pivot", "lo", "hi", "norm"]).to_pylist()
        for d in np.unique(dims):
            part = left.take(pa.array(np.flatnonzero(dims == d)))
            rings = [i for i, a in enumerate(annuli) if a["dim"] == d]
            if not rings:
                continue
            q = matrix(part["v"].combine_chunks(), int(d))
            own, norm, to = part["row"].to_numpy(), part["norm"].to_numpy(), np.array(part["to_pivots"].to_pylist(), dtype=np.float64)
            best = Best(len(q), k, part["floor"].to_numpy().copy())
            with np.errstate(over="ignore", invalid="ignore"):
                bounds = np.stack([_bound(norm, to[:, annuli[i]["pivot"]], annuli[i]) for i in rings], axis=1)
            for r in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
                which = np.flatnonzero(bounds[:, r] >= best.floor)
                if not len(which):
                    continue
                row = right.slice(rings[r], 1)
                rows = np.array(row["rows"][0].as_py(), dtype=np.int64)
                data = row["vectors"][0].as_buffer()
                v = np.frombuffer(data, np.float32 if d and len(data) == 4 * d * len(rows) else np.float64).reshape(len(rows), int(d)).astype(np.float64)
                for at in range(0, len(which), 1024):
                    some = which[at: at + 1024]
                    best.add(some, exact_scores(q[some], v), own[some], row["ids"][0].as_py(), rows)
            names = part["vec_id"].to_pylist()
            got += [(names[i], int(own[i]), x[2], x[3], -x[0]) for i, found in enumerate(best.found) for x in found]
        return pa.Table.from_arrays([pa.array([g[c] for g in got], f.type) for c, f in enumerate(out)], schema=out)

    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part")
    asked = asked.select(F.col("shelf").alias("shelf"), group, "row", "vec_id", "dim", "v", "norm", "to_pivots", "floor")
    there = shelves.join(asked.select("shelf", F.col("part").alias("met")).distinct(), "shelf")
    name = kind.simpleString()
    return asked.groupBy("shelf", "part").cogroup(there.groupBy("shelf", "met")).applyInArrow(
        run, f"query_id {name}, query_row long, vec_id {name}, row long, score long")


def _bound(norm: np.ndarray, to: np.ndarray, ring: dict) -> np.ndarray:
    gap = np.maximum(0.0, np.maximum(ring["lo"] - to, to - ring["hi"]))
    return np.nan_to_num(reach(norm, ring["norm"], gap), nan=np.inf, posinf=np.inf, neginf=np.inf)


def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
          pivots: int = PIVOTS, sample: int = SAMPLE, shelf: int = SHELF, annulus: int = ANNULUS, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``query_step`` divides, the ``k`` best of all other rows.

    Components are floor(scale * x), x as double; the score is their integer inner product, exact, ties to the smaller id (null ids last).
    Vectors that are null or hold a null or a component that is not finite, also after scaling, take no part. Vectors of
    different lengths are not compared. A row is never its own partner, but another row with the same id or vector is; such repeated
    queries each get their list. Fewer partners than ``k`` give fewer rows, an empty table none. A score beyond 64 bits
    counts as the nearest long. Other columns are not read.

    Pivots come from at most ``sample`` vectors, which the driver gets; every vector is indexed, and the result does not depend on them.
    """
    whole = whole_vectors(vectors, id_col, vector_col, scale)
    kind = whole.schema["vec_id"].dataType
    rows = written(keyed(whole, pivots_of(whole, pivots, sample), query_step), "pivot-keys")
    n, queries = rows.agg(F.count(F.lit(1)), F.count("to_pivots")).first()
    spark = vectors.sparkSession
    shelves = written(shelved(rows, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // shelf)), annulus), "pivot-shelves")
    groups = max(1, -(-queries // group))
    asked = rows.where(F.col("to_pivots").isNotNull()).drop("pivot", "far")
    home = shelves.select("shelf", F.explode("rows").alias("row"))
    asked = written(asked.join(home, "row"), "pivot-queries")  # with the shelf where each lies
    first = written(searched(asked.withColumn("floor", F.lit(float("-inf"))), shelves, groups, k, kind), "pivot-first")
    floor = first.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("kth"))
    edges = shelves.groupBy("dim", "pivot", "shelf").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("norm").alias("top"))
    reached = asked.join(floor, "row", "left").select(
        "row", "dim", "norm", F.col("shelf").alias("own"), F.coalesce("kth", F.lit(float("-inf"))).alias("floor"), F.posexplode("to_pivots").alias("pivot", "to"))
    gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("to"), F.col("to") - F.col("hi"))
    bound = reach(F.col("norm"), F.col("top"), gap)
    more = reached.join(edges, ["dim", "pivot"]).where((F.col("shelf") != F.col("own")) & (F.isnan(bound) | (bound >= F.col("floor"))))
    more = more.groupBy("row", "shelf").agg(F.max("floor").alias("floor"))
    rest = searched(asked.drop("shelf").join(more, "row"), shelves, groups, k, kind)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
