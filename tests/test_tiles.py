"""Work by tiles against whole planes, and quantiles against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import grid, pixels, tiles

r = random.Random(31)


def plane(spark, shapes, share=1.0):
    """Planes of random values, with a part of their cells; the last row of each is short."""
    rows = [(k, y, x, r.random()) for k, (h, w) in enumerate(shapes) for y in range(h) for x in range(w if y < h - 1 else w // 2 + 1) if r.random() < share]
    return rows, spark.createDataFrame(rows, "image_id long, y int, x int, v double")


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "EDGE", 7)
    monkeypatch.setattr(tiles, "TIMES_REACH", 1)


def test_wide_gaussian(spark, small_tiles):
    """Each line is mirrored at its own ends; lines shorter than the kernel too."""
    rows, df = plane(spark, [(30, 41), (5, 60), (1, 1)])
    for sigma in (2.5, 6.0):
        w = np.array(grid.gaussian_kernel(sigma))
        radius = len(w) // 2
        cells = {(k, y, x): v for k, y, x, v in rows}
        for axis in (2, 1):
            lines = {}
            for c in sorted(cells):
                lines.setdefault((c[0], c[3 - axis]), []).append(c)
            cells |= {c: float(v) for line in lines.values() for c, v in zip(line, np.convolve(np.pad([cells[c] for c in line], radius, "symmetric"), w, "valid"))}
        got = {(x.image_id, x.y, x.x): x.v for x in tiles.by_tile(df, radius, tiles.convolved(list(w))).collect()}
        assert got.keys() == cells.keys() and max(abs(got[c] - cells[c]) for c in cells) < 1e-12


def test_morphology(spark, small_tiles):
    rows, df = plane(spark, [(23, 31), (3, 40)], 0.8)
    for radius in (1, 4, 9):
        offsets, cells = set(grid.ellipse_offsets(radius)), {(k, y, x): v for k, y, x, v in rows}
        for f, pick in ((grid.dilate, max), (grid.erode, min)):
            want = {(k, y, x): pick(cells[k, y + dy, x + dx] for dy, dx in offsets if (k, y + dy, x + dx) in cells) for k, y, x in cells}
            assert {(x.image_id, x.y, x.x): x.v for x in f(df, radius).collect()} == want


def test_components_over_tiles(spark, small_tiles):
    """Snakes, spirals and noise that go over many tiles."""
    cells = {(0, y, x) for y in range(40) for x in range(40) if y % 2 == 0 or x == (39 if y % 4 == 1 else 0)}
    cells |= {(1, y, x) for y in range(50) for x in range(35) if r.random() < 0.45} | {(2, k, 60 - k) for k in range(61)} | {(3, k, k) for k in range(61)}
    df = spark.createDataFrame([*cells], "image_id long, y int, x int")
    for diagonal in (True, False):
        want, left = {}, set(cells)
        for c in sorted(cells):
            if c in left:
                todo = [c]
                left.discard(c)
                while todo:
                    k, y, x = at = todo.pop()
                    want[at] = c[1:]
                    near = {(k, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if diagonal or not dy or not dx} & left
                    left -= near
                    todo += near
        assert {(x.image_id, x.y, x.x): tuple(x.component) for x in grid.connected_components(df, diagonal).collect()} == want


def test_quantiles(spark, monkeypatch):
    monkeypatch.setattr(pixels, "BINS", 8)  # many rounds
    values = [(k, c, v) for k, n in enumerate((1, 2, 3, 500)) for c in "rg" for v in [r.choice([r.random(), r.random() * 1e-9, 0.5, 7.0, -3.0]) for _ in range(n)]] + [(9, "r", None)]
    df = spark.createDataFrame(values, "image_id long, channel string, v double")
    for share in (0.0, 0.3, 0.99, 1.0):
        got = {(x.image_id, x.channel): x.value for x in pixels.quantiles(df, share).collect()}
        assert len(got) == 8
        for (k, c), v in got.items():
            assert v == pytest.approx(np.quantile([x for a, b, x in values if (a, b) == (k, c)], share), abs=1e-12)
    assert pixels.quantiles(df.limit(0), 0.5).count() == 0


def test_no_planes(spark):
    none = spark.createDataFrame([], "image_id long, y int, x int, v double")
    assert grid.dilate(none, 3).count() == grid.gaussian_smooth(none, 9.0).count() == grid.connected_components(none).count() == 0
    assert grid.gaussian_smooth(none.withColumn("c", F.lit("r")), 9.0, ("image_id", "c")).columns == ["image_id", "c", "y", "x", "v"]


def test_small_planes_are_worked_on_together(spark, monkeypatch):
    """Many planes of few shapes, also with null ids and struct ids, take few calls; rows come in several batches and are cut anywhere."""
    monkeypatch.setattr(tiles, "ROWS", 300)
    rows, df = plane(spark, [(3 + k % 2, 5) for k in range(60)])
    calls = spark.sparkContext.accumulator(0)

    def counted(a, reach, _):
        calls.add(1)
        return a[:, reach : a.shape[1] - reach, reach : a.shape[2] - reach] + 1

    keyed = df.select(F.struct(F.when(F.col("image_id") > 0, F.col("image_id")).alias("k"), F.lit("c").alias("c")).alias("image_id"), "y", "x", "v")
    got = {(x.image_id.k or 0, x.y, x.x): x.v for x in tiles.by_tile(keyed, 2, counted).collect()}
    assert got == {(k, y, x): v + 1 for k, y, x, v in rows} and calls.value < 30


def test_lines_are_filtered_in_batches(spark):
    """Lines of several lengths, with cells that aren't there left out and nulls; no expression that is evaluated value by value."""
    rows = [(k, 0, x, None if (k, x) == (2, 5) else r.random()) for k, n in enumerate((1, 2, 9, 9, 30)) for x in range(n) if x != 3]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, v double")
    out = grid.gaussian_smooth(df, 1.0)
    assert "pmod" not in out._jdf.queryExecution().executedPlan().toString()
    got, w = {(x.image_id, x.x): x.v for x in out.collect()}, np.array(grid.gaussian_kernel(1.0))
    for k in range(5):
        line = [(x, v) for i, _, x, v in rows if i == k]
        wide = np.pad(np.array([np.nan if v is None else v for _, v in line]), len(w) // 2, "symmetric")
        for (x, _), v in zip(line, np.convolve(wide, w, "valid")):
            assert got[k, x] is None if np.isnan(v) else got[k, x] == pytest.approx(v, abs=1e-12)
