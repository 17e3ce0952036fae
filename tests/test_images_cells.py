"""Image files to rasters to cells; nearest cells on rectangles of any kind."""

from __future__ import annotations

import random
import struct
import tempfile
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from gradelake.operators import cells as CE
from gradelake.operators import raster as R
from gradelake.sources import files as FI


def png(pixels: np.ndarray) -> bytes:
    """(height, width) gray or (height, width, 3 or 4) colour."""
    kind = {2: 0, 3: {3: 2, 4: 6}.get(pixels.shape[-1])}[pixels.ndim]
    lines = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def jpeg(spark, path: str, level: int, size: int) -> None:
    awt, io = spark._jvm.java.awt.image.BufferedImage, spark._jvm.javax.imageio.ImageIO
    image = awt(size, size, 1)
    for y in range(size):
        for x in range(size):
            image.setRGB(x, y, level * 0x010101)
    io.write(image, "jpg", spark._jvm.java.io.File(path))


def test_image_files_come_out_as_cells(spark):
    root, rng = Path(tempfile.mkdtemp(prefix="images-", dir="/tmp")), np.random.default_rng(3)
    gray = rng.integers(0, 256, (60, 80))
    gray[:30] = 250
    colour, clear = rng.integers(0, 256, (40, 50, 3)), rng.integers(0, 256, (20, 30, 4))
    for name, data in {"book a/1.png": png(gray), "book a/02.png": png(colour), "b/3.png": png(clear), "b/7.png": b"no image", "b/cover.png": png(gray), "b/9.png": png(gray)[:60]}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    jpeg(spark, str(root / "b/4.jpg"), 200, 16)
    made, rejects = R.rasters_from_images(FI.read_page_images(spark, str(root)))
    got = {(r["doc_id"], r["page"]): r for r in made.collect()}
    assert set(got) == {("book a", 1), ("book a", 2), ("b", 3), ("b", 4)}
    assert sorted((r["doc_id"] or "", r["page"] or 0, r["reason"]) for r in rejects.collect()) == [("", 0, "bad_name"), ("b", 7, "no_image"), ("b", 9, "no_image")]
    r = got[("book a", 1)]
    assert (r["height"], r["width"]) == (60, 80) and np.array_equal(np.frombuffer(r["data"], np.uint8).reshape(60, 80), gray)
    want = (colour @ np.array([299, 587, 114]) + 500) // 1000
    assert np.array_equal(np.frombuffer(got[("book a", 2)]["data"], np.uint8).reshape(40, 50), want)
    want = ((clear[..., :3] @ np.array([299, 587, 114]) + 500) // 1000 * clear[..., 3] + 255 * (255 - clear[..., 3]) + 127) // 255
    assert np.array_equal(np.frombuffer(got[("b", 3)]["data"], np.uint8).reshape(20, 30), want)
    flat = np.frombuffer(got[("b", 4)]["data"], np.uint8)
    assert len(flat) == 256 and abs(int(flat.max()) - 200) <= 2 and abs(int(flat.min()) - 200) <= 2

    grid = spark.createDataFrame([("book a", 1, 3, 4, 20.0, 0.0, 0.0, 80.0, 60.0)],
                                 "doc_id string, page int, rows int, cols int, cell_size_pts double, left_margin_pts double, top_margin_pts double, page_w_pts double, page_h_pts double")
    one = spark.createDataFrame([("book a", 1, 60, 80, bytes(gray.astype(np.uint8).tobytes()))], "doc_id string, page int, height int, width int, data binary")
    cells = [sorted(map(tuple, R.raster_cells(x, grid, 72.0).select("row", "col", "score", "ink_ratio").collect())) for x in (made.filter("doc_id = 'book a' AND page = 1"), one)]
    assert cells[0] == cells[1] and len(cells[0]) == 12


CELL = "doc_id string, page int, row int, col int, x_start_percent double, x_end_percent double, y_start_percent double, y_end_percent double"
SPOT = "doc_id string, page int, n int, x_percent double, y_percent double, row int, best string"


def closest(cells, doc, page, x, y):
    x, y = min(100.0, max(0.0, x or 0.0)), min(100.0, max(0.0, y or 0.0))
    there = [c for c in cells if c[:2] == (doc, page) and None not in c[4:]]
    ranked = sorted((not (c[4] <= x <= c[5] and c[6] <= y <= c[7]), ((c[4] + c[5]) / 2 - x) ** 2 + ((c[6] + c[7]) / 2 - y) ** 2, c[2], c[3]) for c in there)
    return ranked[0][2:] if ranked else (1, 1)


def test_nearest_cells_on_random_rectangles(spark):
    rng = random.Random(11)
    cells, spots = [], []
    for page, spread in ((1, 100), (2, 3), (3, 100), (4, 100)):
        for k in range(120 if page < 4 else 1):
            x, y, w, h = rng.uniform(-5, spread), rng.uniform(-5, spread), rng.choice([0, 0.01, 1, 5, 60]) * rng.random(), rng.choice([0, 0.01, 1, 5, 60]) * rng.random()
            cells.append(("d", page, k // 10, k % 10, x, x + w, y, y + h))
    cells += [("d", 1, 99, 99, None, 1.0, 0.0, 100.0), ("d", 3, 0, 1, 50.0, 50.0, 50.0, 50.0), ("d", 3, 0, 0, 50.0, 50.0, 50.0, 50.0), ("d", 3, 98, 98, 150.0, 180.0, 150.0, 180.0)]
    for n in range(500):
        spots.append(("d", rng.randint(1, 5), n, rng.choice([rng.uniform(-20, 130), 50.0, 0.0, 100.0]), rng.uniform(-20, 130), 7, "x"))
    spots += [("d", 1, 900, None, None, 7, "x"), (None, 1, 901, 5.0, 5.0, 7, "x"), ("d", None, 902, 5.0, 5.0, 7, "x"), spots[0], spots[0]]
    got = CE.nearest_cells(spark.createDataFrame(spots, SPOT).repartition(5), spark.createDataFrame(cells, CELL).repartition(3)).collect()
    assert len(got) == len(spots)
    for r in got:
        assert (r["anchor_row"], r["anchor_col"]) == closest(cells, r["doc_id"], r["page"], r["x_percent"], r["y_percent"]), r
    assert CE.nearest_cells(spark.createDataFrame([], SPOT), spark.createDataFrame(cells, CELL)).collect() == []
    assert {(r["anchor_row"], r["anchor_col"]) for r in CE.nearest_cells(spark.createDataFrame(spots, SPOT), spark.createDataFrame([], CELL)).collect()} == {(1, 1)}


def test_nearest_cells_has_no_cross_join(spark):
    plan = CE.nearest_cells(spark.createDataFrame([("d", 1, 0, 5.0, 5.0, 7, "x")], SPOT), spark.createDataFrame([("d", 1, 1, 1, 0.0, 1.0, 0.0, 1.0)], CELL))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_nearest_cells_on_crowded_pages(spark, monkeypatch):
    """Pages spread over bins and pages in one stream give the same, together in one table."""
    rng = random.Random(12)
    cells = [("d", page, k // 10, k % 10, x, x + rng.choice([0, 1, 30]), y, y + rng.choice([0, 1, 30]))
             for page, many in ((1, 90), (2, 20), (3, 0)) for k in range(many) for x, y in [(rng.randint(0, 99), rng.randint(0, 99))]]
    cells = [(*c[:4], *map(float, c[4:])) for c in cells] + [(None, 1, 5, 5, 0.0, 100.0, 0.0, 100.0)]
    spots = [("d", rng.randint(1, 3), n, float(rng.randint(-5, 110)), float(rng.randint(-5, 110)), 7, "x") for n in range(300)] + [(None, 1, 900, 5.0, 5.0, 7, "x")]
    monkeypatch.setattr(CE, "PAGE_CELLS", 50)
    for most in (1_000_000, 110):  # then page 2 or 3 may be crowded by its points
        monkeypatch.setattr(CE, "PAGE_POINTS", most)
        got = CE.nearest_cells(spark.createDataFrame(spots, SPOT).repartition(3), spark.createDataFrame(cells, CELL).repartition(3)).collect()
        assert len(got) == len(spots)
        for r in got:
            assert (r["anchor_row"], r["anchor_col"]) == (closest(cells, r["doc_id"], r["page"], r["x_percent"], r["y_percent"]) if r["doc_id"] else (1, 1)), r


def test_nearest_cells_moves_a_point_once(spark):
    spots = spark.range(300).selectExpr("id % 3 AS doc_id", "1 AS page", "double(id % 100) AS x_percent", "double(id % 90) AS y_percent")
    cells = spark.range(60).selectExpr("id % 3 AS doc_id", "1 AS page", "int(id) AS row", "1 AS col", "double(id) AS x_start_percent", "id + 5D AS x_end_percent",
                                       "double(id) AS y_start_percent", "id + 5D AS y_end_percent")
    plan = CE.nearest_cells(spots, cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Join" not in plan
