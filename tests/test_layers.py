"""Layers whose edits read neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.functions import color
from pixelframe.operators import grid, tiles
from pixelframe.plans import grade


def test_layer_stack_blurs_and_adds_clarity(spark):
    df = spark.range(144).select(F.lit("a").alias("image_id"), (F.col("id") / 12).cast("int").alias("y"), (F.col("id") % 12).cast("int").alias("x"), *[(F.pmod(F.col("id") * k, F.lit(17)) / 17).alias(c) for k, c in zip((5, 7, 3), "rgb")])
    mask = df.select("image_id", F.lit("background").alias("layer"), "y", "x", F.lit(1.0).alias("v"))
    values = lambda d: {(r.y, r.x): (r.r, r.g, r.b) for r in d.collect()}
    for p in ({"blur": 28, "exposure": 10}, {"clarity": 40}):
        got = values(grade.layer_stack(df, mask, [{"layer": "background", "params": p}]))
        want = values(grade.grade_masked(df, mask, "background", p))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
        assert any(abs(got[k][0] - v[0]) > 0.01 for k, v in values(df).items())


def _smooth(a, sigma):
    """Each line of a plane, the last of which may be short (NaN), mirrored at its own ends."""
    w = np.array(grid.gaussian_kernel(sigma))
    for axis in (1, 0):
        out = np.full(a.shape, np.nan)
        for k in range(a.shape[1 - axis]):
            at = (k, slice(None)) if axis == 1 else (slice(None), k)
            line = a[at][~np.isnan(a[at])]
            out[at][: len(line)] = np.convolve(np.pad(line, len(w) // 2, "symmetric"), w, "valid")
        a = out
    return a


def _slopes(a):
    y, x = (np.pad(a, 1, constant_values=np.nan)[k] for k in ((slice(None), slice(1, -1)), (slice(1, -1), slice(None))))
    gy, gx = (y[2:] - y[:-2]) * 0.5, (x[:, 2:] - x[:, :-2]) * 0.5
    return np.sqrt(np.nan_to_num(gx) ** 2 + np.nan_to_num(gy) ** 2) + 0 * a


def _contrast(a, amount, detail, base, edge):
    clip = lambda v: np.clip(v, 0, 1)
    m = clip(_smooth(clip(0.35 + clip(1 - _smooth(_slopes(a), 1.0) * edge) * 0.65), 0.8))
    fine, coarse = _smooth(a, detail), _smooth(a, base)
    return clip(a * (1 - m) + clip(a + (fine - coarse) * amount * 0.85 + (a - fine) * amount * 0.35) * m)


@pytest.mark.parametrize("p", [{"blur": 20, "exposure": 10, "dehaze": 60}, {"blur": 5, "clarity": 40, "dehaze": 30}, {"clarity": 40}])
def test_edits_go_over_the_edges_of_tiles(spark, monkeypatch, p):
    """Blur, local contrast and dehaze, one after the other, on pictures of several tiles, against whole planes in NumPy."""
    monkeypatch.setattr(tiles, "EDGE", 8)
    monkeypatch.setattr(tiles, "TIMES_REACH", 1)
    g, clip, rows, want = np.random.default_rng(7), lambda v: np.clip(v, 0, 1), [], {}
    for image, (height, width) in {"a": (90, 120), "b": (1, 1), "c": (70, 3)}.items():
        a = {c: g.random((height, width)) for c in "rgbv"}
        for v in a.values():
            v[-1, width // 2 + 1 :] = np.nan  # a short last row
        rows += [(image, y, x, *[float(a[c][y, x]) for c in "rgbv"]) for y in range(height) for x in range(width) if not np.isnan(a["r"][y, x])]
        effect = lambda kind, v=a["v"]: clip(_smooth(clip((v - color.profile("background", kind)[1]) / (1 - color.profile("background", kind)[1])) ** color.profile("background", kind)[0], color.profile("background", kind)[2]))
        rgb = {c: a[c] for c in "rgb"}
        if p.get("blur"):
            rgb = {c: clip(v * (1 - effect("broad")) + _smooth(v, 1 + p["blur"] / 100 * 12) * effect("broad")) for c, v in rgb.items()}
        rgb = {c: clip(v * 2 ** (p.get("exposure", 0) / 100)) for c, v in rgb.items()}
        if p.get("clarity"):
            rgb = {c: _contrast(v, p["clarity"] / 100, *grade.CLARITY["background"]) for c, v in rgb.items()}
        if p.get("dehaze"):
            luma = clip(sum(k * rgb[c] for k, c in zip(color.LUMA, "rgb")))
            m = clip(_smooth(clip(1 - luma * 1.15), 2.2) * effect("detail"))
            rgb = {c: clip(v * (1 - m) + clip(v + (v - _smooth(v, 7.0)) * (p["dehaze"] / 100 * 0.85)) * m) for c, v in rgb.items()}
        for c, v in rgb.items():
            v = clip(a[c] * (1 - effect("blend")) + v * effect("blend"))
            want |= {(image, y, x, c): v[y, x] for y in range(height) for x in range(width) if not np.isnan(v[y, x])}
    df = spark.createDataFrame(rows, "image_id string, y int, x int, r double, g double, b double, v double")
    out = grade.grade_masked(df.drop("v"), df.select("image_id", "y", "x", "v"), "background", p).collect()
    assert len(out) == len(rows)
    got = {(r.image_id, r.y, r.x, c): r[c] for r in out for c in "rgb"}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
