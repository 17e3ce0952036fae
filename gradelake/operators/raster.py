"""Page rasters: ink masks, cell metrics, ink proximity and components.

A raster row is (doc_id, page, height, width, data), data holding one gray byte
per pixel. One page is decoded at a time inside a task; Spark spreads the pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from gradelake.functions import coords as X
from gradelake.operators.grid import GRID_COLUMNS, P, RULES, connected_labels


def rasters_from_pixels(pixels: DataFrame) -> DataFrame:
    """Pack a pixel table into one raster per page (for tests and small pages); y and x start from 0, values lie in 0..255.

    The pixels of a page are gathered once, as numbers that sort by y, x and value. Height and width are the number of
    pixel rows and the most pixels of a row.
    """
    place = F.shiftleft(F.col("y").cast("long"), 40) + F.shiftleft(F.col("x").cast("long"), 8) + F.col("value")
    page = pixels.groupBy(*P).agg(F.collect_list(place).alias("l"))
    return page.withColumn("_r", _raster("l")).select(*P, "_r.height", "_r.width", "_r.data")


@F.arrow_udf(StructType([StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("data", BinaryType())]))
def _raster(places: pa.Array) -> pa.Array:
    ends = np.asarray(places.offsets)
    every = places.values.to_numpy()
    height, width, data = [], [], []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        place = np.sort(every[lo:hi])
        first = np.flatnonzero(np.diff(place >> 40, prepend=-1))
        height.append(len(first))
        width.append(int(np.diff(first, append=hi - lo).max(initial=0)))
        data.append((place & 255).astype(np.uint8).tobytes())
    return pa.StructArray.from_arrays([pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(data, pa.binary())], ["height", "width", "data"])


#: Weights of red, green and blue in a gray value, in thousandths.
GRAY = (299, 587, 114)


@F.arrow_udf(BinaryType())
def gray_bytes(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
    """One gray byte per pixel of images stored row by row as gray, BGR or BGRA bytes; what is transparent shows white. Null where the bytes don't fit the size."""
    def gray(raw: bytes | None, h: int, w: int, n: int) -> bytes | None:
        if raw is None or h <= 0 or w <= 0 or n not in (1, 3, 4) or len(raw) != h * w * n:
            return None
        if n == 1:
            return raw
        v = np.frombuffer(raw, np.uint8).reshape(-1, n).astype(np.int32)
        y = (v[:, 2] * GRAY[0] + v[:, 1] * GRAY[1] + v[:, 0] * GRAY[2] + 500) // 1000
        if n == 4:
            y = (y * v[:, 3] + 255 * (255 - v[:, 3]) + 127) // 255
        return y.astype(np.uint8).tobytes()

    return pa.array([gray(*x) for x in zip(data.to_pylist(), height.to_pylist(), width.to_pylist(), channels.to_pylist())], pa.binary())


def rasters_from_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page rasters from rows (doc_id, page, image), ``image`` as Spark's image source gives it, and the rows that are no image.

    One image becomes one row; pixels are never rows. Rejects have doc_id, page, origin and the reason:
    ``bad_name`` without a document or page, ``no_image`` where the bytes could not be decoded.
    """
    gray = gray_bytes("image.data", "image.height", "image.width", "image.nChannels")
    named = F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    made = images.filter(named & (F.col("image.height") > 0)).select(*P, "image.height", "image.width", gray.alias("data"))
    reason = F.when(~named, "bad_name").when(F.coalesce(F.col("image.height"), F.lit(-1)) <= 0, "no_image")
    return made, images.select(*P, F.col("image.origin").alias("origin"), reason.alias("reason")).filter("reason IS NOT NULL")


def _per_page(df: DataFrame, schema: str, fn: Callable[[dict, np.ndarray], dict[str, np.ndarray] | None], most: int = 50_000) -> DataFrame:
    """Apply fn(row, gray) to each raster; fn gives equally long columns without doc_id and page. Pages are handed on ``most`` rows at a time."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def handed(pages: list[tuple], parts: list[dict[str, np.ndarray]], sizes: list[int]) -> pa.RecordBatch:
        at = pa.array(np.repeat(np.arange(len(pages)), sizes))
        keys = {k: pa.array([p[i] for p in pages], type=arrow.field(k).type).take(at) for i, k in enumerate(P)}
        return pa.RecordBatch.from_arrays(
            [keys[f.name] if f.name in keys else pa.array(np.concatenate([p[f.name] for p in parts]), type=f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, parts, sizes = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                gray = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"])
                cols = fn(row, gray)
                if cols is None:
                    continue
                pages.append((row["doc_id"], row["page"]))
                parts.append(cols)
                sizes.append(len(next(iter(cols.values()))))
                if sum(sizes) >= most:
                    yield handed(pages, parts, sizes)
                    pages, parts, sizes = [], [], []
        if pages:
            yield handed(pages, parts, sizes)

    return df.mapInArrow(run, schema)


def _keys(df: DataFrame) -> str:
    types = dict(df.dtypes)
    return f"doc_id {types['doc_id']}, page {types['page']}"


def spread(mask: np.ndarray) -> np.ndarray:
    """True where any of the 3 x 3 neighbours is True."""
    p = np.pad(mask, 1)
    rows = p[:-2] | p[1:-1] | p[2:]
    return rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:]


def shrink(mask: np.ndarray) -> np.ndarray:
    """True where all 3 x 3 neighbours are True; the outside counts as False."""
    p = np.pad(mask, 1)
    rows = p[:-2] & p[1:-1] & p[2:]
    return rows[:, :-2] & rows[:, 1:-1] & rows[:, 2:]


def clean_ink(gray: np.ndarray, below: float) -> np.ndarray:
    """Dark pixels grown by one, then closed (grown and shrunk) to fill small gaps."""
    return shrink(spread(spread(gray / 255.0 < below)))


def box_sums(values: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Sums over the boxes between neighbouring row and column edges."""
    table = np.zeros((values.shape[0] + 1, values.shape[1] + 1), dtype=np.int64)
    table[1:, 1:] = values.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    corner = table[np.ix_(ys, xs)]
    return corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]


def raster_cells(rasters: DataFrame, page_grid: DataFrame, dpi: float = 300.0, min_score: float = RULES["v4"]["min_score"],
                 max_ink: float = RULES["v4"]["max_ink"], ink_below: float = RULES["v4"]["ink_below"]) -> DataFrame:
    """Score, ink ratio and writable flag per cell from page rasters."""
    scale = dpi / 72.0

    def metrics(row, gray):
        h, w = gray.shape
        ys = np.clip([int((row["top_margin_pts"] + k * row["cell_size_pts"]) * scale) for k in range(row["rows"] + 1)], 0, h)
        xs = np.clip([int((row["left_margin_pts"] + k * row["cell_size_pts"]) * scale) for k in range(row["cols"] + 1)], 0, w)
        wide = gray.astype(np.int64)
        n = (np.diff(ys)[:, None] * np.diff(xs)[None, :]).astype(np.float64)
        some = np.where(n > 0, n, 1.0)
        mean = box_sums(wide, ys, xs) / some / 255.0
        var = np.maximum(0.0, box_sums(wide * wide, ys, xs) / some / 65025.0 - mean * mean)
        score = np.where(n > 0, np.clip(mean - np.sqrt(var), 0.0, 1.0), 0.0)
        ink = np.where(n > 0, box_sums(clean_ink(gray, ink_below), ys, xs) / some, 1.0)
        r, c = np.indices(score.shape)
        return {"row": (r + 1).ravel().astype(np.int32), "col": (c + 1).ravel().astype(np.int32), "score": np.round(score.ravel(), 4),
                "ink_ratio": np.round(ink.ravel(), 4), "writable": ((score >= min_score) & (ink <= max_ink)).ravel()}

    j = rasters.join(page_grid.select(*P, *GRID_COLUMNS), P)
    return _per_page(j, f"{_keys(rasters)}, row int, col int, score double, ink_ratio double, writable boolean", metrics)


def otsu_threshold(gray: np.ndarray) -> int:
    """Gray level that best separates dark from light; the first of equal ones."""
    n = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    wb, sb = n.cumsum(), (n * np.arange(256)).cumsum()
    wf = wb[-1] - wb
    ok = (wb > 0) & (wf > 0)
    if not ok.any():
        return 128
    gap = np.where(ok, sb / np.where(ok, wb, 1) - (sb[-1] - sb) / np.where(ok, wf, 1), 0.0)
    return int(np.argmax(np.where(ok, wb * wf * gap * gap, -1.0)))


def blur(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, cut at four sigma, with mirrored edges."""
    radius = int(4.0 * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    kernel = np.exp(-0.5 * (x / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(values, pad, mode="symmetric")
        values = np.apply_along_axis(lambda v: np.convolve(v, kernel, mode="valid"), axis, wide)
    return values


def raster_proximity(rasters: DataFrame, dpi: float = 150.0, clearance_pt: float = 20.0, sample_rows: int = 30, sample_cols: int = 15) -> DataFrame:
    """Nearness to ink (0 far, 1 on ink) at a fixed grid of sample points in the content area."""
    sigma = dpi / 72.0 * clearance_pt

    def sample(row, gray):
        h, w = gray.shape
        near = blur((gray <= otsu_threshold(gray)).astype(np.float64), sigma)
        inner = near[int(h * X.CONTENT_TOP):int(h * X.CONTENT_BOTTOM), int(w * X.CONTENT_LEFT):int(w * X.CONTENT_RIGHT)]
        r, c = (a.ravel() for a in np.indices((sample_rows, sample_cols)))
        py, px = (inner.shape[0] * (r + 0.5) / sample_rows).astype(int), (inner.shape[1] * (c + 0.5) / sample_cols).astype(int)
        return {"pos": (r * sample_cols + c).astype(np.int32), "proximity": inner[py, px],
                "y_pct": (r + 0.5) / sample_rows * 100.0, "x_pct": (c + 0.5) / sample_cols * 100.0}

    return _per_page(rasters, f"{_keys(rasters)}, pos int, proximity double, y_pct double, x_pct double", sample)


def adaptive_ink(gray: np.ndarray, size: int = 31, offset: float = 10.0) -> np.ndarray:
    """Pixels darker than the mean of their neighbourhood by more than an offset."""
    half = size // 2
    p = np.pad(gray.astype(np.int64), half, mode="edge")
    t = np.zeros((p.shape[0] + 1, p.shape[1] + 1), dtype=np.int64)
    t[1:, 1:] = p.cumsum(axis=0).cumsum(axis=1)
    total = t[size:, size:] - t[:-size, size:] - t[size:, :-size] + t[:-size, :-size]
    return gray <= np.rint(total / (size * size)) - offset


def raster_ink(rasters: DataFrame) -> DataFrame:
    """Ink pixels as a table (y, x, value 255), input of the projections."""

    def pixels(row, gray):
        y, x = np.nonzero(adaptive_ink(gray))
        return {"y": y.astype(np.int32), "x": x.astype(np.int32), "value": np.full(len(y), 255, np.int32)}

    return _per_page(rasters, f"{_keys(rasters)}, y int, x int, value int", pixels)


def raster_components(rasters: DataFrame) -> DataFrame:
    """Connected ink components with centre, size and area, input of text_lines()."""

    def parts(row, gray):
        ink = adaptive_ink(gray)
        label = connected_labels(ink, 8)[ink]
        y, x = np.nonzero(ink)
        ids, at = np.unique(label, return_inverse=True)
        k = len(ids)
        area = np.bincount(at, minlength=k)
        lo_y, hi_y, lo_x, hi_x = np.full(k, 1 << 30), np.full(k, -1), np.full(k, 1 << 30), np.full(k, -1)
        np.minimum.at(lo_y, at, y), np.maximum.at(hi_y, at, y), np.minimum.at(lo_x, at, x), np.maximum.at(hi_x, at, x)
        cy = np.bincount(at, weights=y, minlength=k) / np.maximum(area, 1)
        return {"cy": cy, "w": (hi_x - lo_x + 1).astype(np.int32), "h": (hi_y - lo_y + 1).astype(np.int32), "area": area.astype(np.int32)}

    return _per_page(rasters, f"{_keys(rasters)}, cy double, w int, h int, area int", parts)


def raster_free_rects(rasters: DataFrame, grow: int = 8, open_: int = 15, min_area: int = 2000, min_fill: float = 0.35) -> DataFrame:
    """Bounding rectangles of large free areas away from ink."""

    def widen(mask, n):
        out = mask
        for _ in range(n):
            out = spread(out)
        return out

    def rects(row, gray):
        h, w = gray.shape
        free = ~widen(adaptive_ink(gray), grow // 2)
        n = open_ // 2
        free = ~widen(~free, n) if n else free
        free = widen(free, n)
        label = connected_labels(free, 8)[free]
        y, x = np.nonzero(free)
        out = []
        for lab in np.unique(label):
            sel = label == lab
            y1, y2, x1, x2 = y[sel].min(), y[sel].max() + 1, x[sel].min(), x[sel].max() + 1
            area = int((y2 - y1) * (x2 - x1))
            if area >= min_area and sel.sum() / area >= min_fill:
                out.append((x1, y1, x2, y2, area, round((x1 + x2) / 2 / w * 100, 2), round((y1 + y2) / 2 / h * 100, 2)))
        if not out:
            return None
        cols = list(zip(*out))
        names = ["x1", "y1", "x2", "y2", "area", "cx", "cy"]
        return {n_: np.array(v, dtype=np.float64 if n_ in ("cx", "cy") else np.int32) for n_, v in zip(names, cols)}

    return _per_page(rasters, f"{_keys(rasters)}, x1 int, y1 int, x2 int, y2 int, area int, cx double, cy double", rects)
