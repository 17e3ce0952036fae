"""Free zones on a coarse grid and the snapping of annotations to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradelake.functions import coords as X
from gradelake.operators.grid import P, page_parts
from gradelake.operators.keyed import split_rank, top_k
from gradelake.operators.stateful import run_sequential
from gradelake.sources.stages import stored

ZONE_FIELDS = ["x_start_percent", "x_end_percent", "y_start_percent", "y_end_percent", "score", "row0", "col0"]


def free_zones(scores: DataFrame, rows: int = 20, cols: int = 8, min_score: float = 0.70, top_n: int = 15,
               skip_left: int = 2, skip_right: int = 0, skip_top: int = 0, skip_bottom: int = 2) -> DataFrame:
    """Best ``top_n`` empty cells per page, numbered by ``zone_pos``.

    The threshold looks at the unrounded score, the order at the score rounded
    to 4 places, then top first, then row-major.
    """
    r, c = F.col("row0"), F.col("col0")
    inside = (r >= skip_top) & (r < rows - skip_bottom) & (c >= skip_left) & (c < cols - skip_right)
    kept = scores.filter(inside & (F.col("score") >= min_score)).select(
        *P,
        X.round_even(c * 100.0 / cols, 2).alias("x_start_percent"),
        X.round_even(F.least((c + 1) * 100.0 / cols, F.lit(100.0)), 2).alias("x_end_percent"),
        X.round_even(r * 100.0 / rows, 2).alias("y_start_percent"),
        X.round_even(F.least((r + 1) * 100.0 / rows, F.lit(100.0)), 2).alias("y_end_percent"),
        X.round_even("score", 4).alias("score"), "row0", "col0")
    order = [F.col("score").desc(), F.col("y_start_percent"), F.col("row0"), F.col("col0")]
    return top_k(kept, P, order, top_n, "zone_pos")


def _merge_pass(zones: DataFrame, line: list[str], step: str, first: list[str], last: str) -> DataFrame:
    """Join neighbours along ``step``; the score folds left as round((a + b) / 2, 4)."""
    w = Window.partitionBy(*P, *line).orderBy(step)
    island = zones.withColumn("_isl", F.col(step) - F.row_number().over(w))
    scores = F.transform(F.array_sort(F.collect_list(F.struct(F.col(step).alias("k"), F.col("score").alias("v")))), lambda x: x["v"])
    tail = F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(1)))
    fold = F.when(F.size("_s") == 1, F.element_at("_s", 1)).otherwise(
        F.aggregate(tail, F.element_at("_s", 1), lambda a, b: X.round_even((a + b) / 2.0, 4)))
    return (
        island.groupBy(*P, *line, "_isl")
        .agg(*[F.min_by(f, step).alias(f) for f in first], F.max_by(last, step).alias(last), F.min(step).alias(step),
             scores.alias("_s"))
        .withColumn("score", fold).drop("_isl", "_s"))


def merge_zones(zones: DataFrame) -> DataFrame:
    """Merge neighbours in a row into bands, then bands starting in one column into strips.

    Groups are bounded by the coarse grid. ``zone_pos`` is renewed: score
    descending, then top first, then start column, then row.
    """
    bands = _merge_pass(zones.select(*P, *ZONE_FIELDS), ["row0"], "col0",
                        ["x_start_percent", "y_start_percent", "y_end_percent"], "x_end_percent")
    strips = _merge_pass(bands, ["col0"], "row0", ["x_start_percent", "x_end_percent", "y_start_percent"], "y_end_percent")
    w = Window.partitionBy(*P).orderBy(F.col("score").desc(), "y_start_percent", "col0", "row0")
    return strips.select(*P, *ZONE_FIELDS).withColumn("zone_pos", F.row_number().over(w))


def page_free_zones(scores: DataFrame, rows: int = 20, cols: int = 8, min_score: float = 0.70, top_n: int = 15,
                    merge: bool = True) -> DataFrame:
    """Over-fetch twice the zones, merge, keep the best ``top_n``."""
    zones = free_zones(scores, rows, cols, min_score, top_n * 2)
    return (merge_zones(zones) if merge else zones).filter(F.col("zone_pos") <= top_n)


def clamp_params(df: DataFrame) -> DataFrame:
    """Bounds of a free-space request: 4-40 rows, 4-20 columns, score 0-1."""
    return df.withColumns({
        "rows": X.clamp("rows", 4, 40), "cols": X.clamp("cols", 4, 20), "min_score": X.clamp("min_score", 0.0, 1.0)})


def zones_by_page(zones: DataFrame) -> DataFrame:
    """Zones of a page as one ordered array (a page has at most a few dozen)."""
    z = F.struct("zone_pos", "x_start_percent", "x_end_percent", "y_start_percent", "y_end_percent", "score",
                 ((F.col("y_start_percent") + F.col("y_end_percent")) / 2.0).alias("y"))
    return zones.groupBy(*P).agg(F.array_sort(F.collect_list(z)).alias("zones"))


def snap_nearest(annotations: DataFrame, zones: DataFrame, max_shift: float = 30.0) -> DataFrame:
    """Move each annotation to the zone of its page with the nearest vertical centre.

    The zones of a page travel as one array, so an annotation stays one row.
    """
    j = annotations.join(zones_by_page(zones), P, "left")
    near = F.filter(
        F.transform("zones", lambda z: F.struct(F.abs(z["y"] - F.col("y_position_percent")).alias("d"),
                                                z["zone_pos"].alias("k"), z.alias("z"))),
        lambda s: s["d"] <= max_shift)
    best = F.array_min(near)["z"]
    hit = F.col("_z").isNotNull()
    moved = {
        "y_position_percent": F.when(hit, X.round_even("_z.y", 2)).otherwise(F.col("y_position_percent")),
        "x_start_percent": F.when(hit, F.col("_z.x_start_percent")).otherwise(F.col("x_start_percent")),
        "x_end_percent": F.when(hit, F.col("_z.x_end_percent")).otherwise(F.col("x_end_percent")),
        "snapped": hit, "snap_score": F.col("_z.score"),
    }
    return j.withColumn("_z", best).drop("zones").withColumns(moved).drop("_z")


def snap_counts(snapped: DataFrame) -> DataFrame:
    """Snapped and total annotations per document."""
    return snapped.groupBy("doc_id").agg(
        F.count_if("snapped").alias("snapped"), F.count(F.lit(1)).alias("annotations"))


def zone_counts(pages: DataFrame, zones: DataFrame) -> DataFrame:
    """Pages and free zones per document (doc_id, page_count, total_zones), pages without zones included. ``pages``: doc_id, page."""
    n = zones.groupBy(*P).agg(F.count(F.lit(1)).alias("n"))
    return pages.select(*P).join(n, P, "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_zones"))


def assign_zones(annotations: DataFrame, zones: DataFrame, gap: float = 8.0, cap: int = 2, max_shift: float = 35.0,
                 scope: str = "item_index") -> DataFrame:
    """Capacity-aware zone choice per (doc, item, page), top to bottom.

    As long as any zone has room an annotation is placed, so exactly the first
    cap x zones annotations of a group are. Only those enter the sequential
    step; all later ones are unsnapped without further work. The turn of an
    annotation is counted in bands of its height on the page, so a group with
    very many annotations is never sorted in one task.
    """
    keys = ["doc_id", scope, "page"]
    cols = ["annotation_index", "y_position_percent"]
    slim = annotations.select(*keys, *cols).withColumn("_y", F.coalesce("y_position_percent", F.lit(50.0)))
    ranked = split_rank(slim, keys, ["_y", "annotation_index"], [F.floor(F.col("_y") * 10.0)], "_turn")
    # read twice; merged, since a file of a few megabytes unpacks to far more
    bundle = stored(zones_by_page(zones).withColumn("_room", F.size("zones") * cap), "zones").hint("merge")
    first = ranked.join(bundle.select(*P, "_room"), P).filter(F.col("_turn") <= F.col("_room"))
    types = dict(annotations.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "annotation_index"]) + ", z_y double, z_x1 double, z_x2 double, z_score double"

    def start(h: dict) -> tuple[list, list, list]:
        zs = sorted(h["zones"], key=lambda z: (z["y_start_percent"], z["zone_pos"]))
        return zs, [0] * len(zs), []

    def place(state: tuple[list, list, list], row: dict) -> dict:
        zs, used, ys = state
        k = choose_zone(zs, used, ys, row["y"], gap, cap, max_shift)
        used[k] += 1
        z = zs[k]
        ys.append(z["y"])
        return {**{c: row[c] for c in [*keys, "annotation_index"]}, "z_y": round(z["y"], 2), "z_x1": z["x_start_percent"], "z_x2": z["x_end_percent"],
                "z_score": round(z["score"], 4)}

    turns = first.select(*keys, "annotation_index", F.col("_y").alias("y"), "_turn")
    # zones come once for each group, ahead of its rows
    headers = slim.select(*keys).distinct().join(bundle.select(*P, "zones"), P).select(*keys, "zones")
    placed = run_sequential(turns, headers, keys, ["_turn"], schema, start, place)
    hit = F.col("z_y").isNotNull()
    return annotations.join(placed, [*keys, "annotation_index"], "left").withColumns({
        "y_position_percent": F.coalesce("z_y", "y_position_percent"),
        "x_start_percent": F.coalesce("z_x1", "x_start_percent"), "x_end_percent": F.coalesce("z_x2", "x_end_percent"),
        "snapped": hit, "snap_score": F.col("z_score")}).drop("z_y", "z_x1", "z_x2", "z_score")


def _third(y: float) -> int:
    return 0 if y < 33.0 else (2 if y > 67.0 else 1)


def choose_zone(zs, used, ys, y, gap, cap, max_shift) -> int:
    """Index of the zone for one annotation; some zone must have room."""
    room = [k for k in range(len(zs)) if used[k] < cap]
    spaced = [k for k in room if all(abs(zs[k]["y"] - p) >= gap for p in ys)]
    reach = [k for k in spaced if abs(zs[k]["y"] - y) <= max_shift]
    if reach:
        def value(k):
            same = 15.0 if _third(zs[k]["y"]) == _third(y) else 0.0
            return same + (max_shift - abs(zs[k]["y"] - y)) + zs[k]["score"] * 5.0
        return max(reach, key=lambda k: (value(k), -k))
    floor = max(ys) + gap if ys else 0.0
    below = [k for k in spaced if zs[k]["y"] >= floor]
    if below or spaced:
        return (below or spaced)[0]
    return min(room, key=lambda k: (abs(zs[k]["y"] - y), k))


def diverse_points(candidates: DataFrame, n: int = 10, spacing: float = 12.0, max_prox: float = 0.04,
                   sample_rows: int = 30, sample_cols: int = 15) -> DataFrame:
    """Up to n clear points per page, each at least ``spacing`` from the others.

    ``candidates`` (doc_id, page, pos, proximity, y_pct, x_pct) come from a fixed
    sample grid, so a page has at most sample_rows x sample_cols of them.
    """
    types = dict(candidates.select(*P).dtypes)
    schema = (f"doc_id {types['doc_id']}, page {types['page']}, pick int, x_start_percent double, x_end_percent double, "
              "y_start_percent double, y_end_percent double, score double")
    half_h, half_w = 50.0 / sample_rows, 50.0 / sample_cols

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def clear(taken: list[tuple], y: np.ndarray, x: np.ndarray, near: np.ndarray) -> None:
        """Take the first points that keep their distance from all taken ones."""
        free = np.ones(len(y), dtype=bool)
        for ty, tx, _ in taken:
            free &= np.sqrt((y - ty) ** 2 + (x - tx) ** 2) >= spacing
        while len(taken) < n and free.any():
            k = int(free.argmax())
            taken.append((float(y[k]), float(x[k]), float(near[k])))
            free &= np.sqrt((y - y[k]) ** 2 + (x - x[k]) ** 2) >= spacing
            free[k] = False  # also without spacing

    def shaped(done: list[tuple]) -> pa.RecordBatch:
        out = [(doc, page, i, round(max(0.0, x - half_w), 2), round(min(100.0, x + half_w), 2), round(max(0.0, y - half_h), 2),
                round(min(100.0, y + half_h), 2), round(1.0 - near, 4))
               for (doc, page), taken in done for i, (y, x, near) in enumerate(taken, start=1)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # the last page may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x, near = (batch[c].to_numpy(zero_copy_only=False) for c in ("y_pct", "x_pct", "proximity"))
            for lo, hi in page_parts(batch):
                at = (batch["doc_id"][lo].as_py(), batch["page"][lo].as_py())
                if not done or done[-1][0] != at:
                    done.append((at, []))
                clear(done[-1][1], y[lo:hi], x[lo:hi], near[lo:hi])
            yield shaped(done[:-1])
            done = done[-1:]
        yield shaped(done)

    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = candidates.filter(F.col("proximity") <= max_prox).select(*P, "proximity", "pos", "y_pct", "x_pct").repartition(tasks, *P)
    return near.sortWithinPartitions(*P, "proximity", F.col("pos").asc_nulls_last()).mapInArrow(pick, schema)


def otsu(pixel_hist: DataFrame) -> DataFrame:
    """Otsu threshold per page from a histogram (doc_id, page, value 0..255, n)."""
    up = Window.partitionBy(*P).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*P)
    n, v = F.col("n").cast("double"), F.col("value").cast("double")
    steps = pixel_hist.withColumns({
        "wb": F.sum(n).over(up), "sb": F.sum(n * v).over(up), "w": F.sum(n).over(whole), "s": F.sum(n * v).over(whole)})
    wf = F.col("w") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    between = F.when((F.col("wb") > 0) & (wf > 0), F.col("wb") * wf * gap * gap)
    best = F.max_by("value", F.struct("between", -F.col("value")))
    return steps.withColumn("between", between).groupBy(*P).agg(
        F.coalesce(F.when(F.max("between").isNotNull(), best), F.lit(128)).alias("threshold"))


def pixel_histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*P, "value").agg(F.count(F.lit(1)).alias("n"))


def free_boxes(zones: DataFrame, sizes: DataFrame) -> DataFrame:
    """Zones in content percent to PDF point boxes."""
    j = zones.join(sizes.select(*P, "page_w_pts", "page_h_pts"), P)
    box: Column = X.content_percent_to_pdf("x_start_percent", "y_start_percent", "x_end_percent", "y_end_percent", "page_w_pts", "page_h_pts")
    return j.withColumn("_b", box).select(*zones.columns, "_b.pdf_x1", "_b.pdf_y1", "_b.pdf_x2", "_b.pdf_y2")
