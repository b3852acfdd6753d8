"""Landmark sets, bodies and effect masks against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import masks
from pixelframe.plans import grade

BOX = "image_id string, det_id int, x double, y double, w double, h double"
SET = "image_id string, set_id int, x1 double, y1 double, x2 double, y2 double"


def misfit(b, s):
    dx, dy = (s[2] + s[4]) * 0.5 - (b[2] + b[4] * 0.5), (s[3] + s[5]) * 0.5 - (b[3] + b[5] * 0.5)
    return math.sqrt(dx * dx + dy * dy) + abs(s[4] - s[2] - b[4]) * 0.25 + abs(s[5] - s[3] - b[5]) * 0.20


def test_nearest_landmarks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(masks, "FEW_SETS", 8)
    r = random.Random(3)
    place = lambda wide: (r.uniform(-wide, wide), r.uniform(-wide, wide))
    boxes, sets = [], []
    for image, n in (("many", 400), ("few", 5), ("one place", 30)):
        for k in range(120):
            boxes.append((image, k, *place(300), r.uniform(0, 60), r.uniform(0, 60)))
        for k in range(n):
            x, y = (7.0, -7.0) if image == "one place" else place(200)
            sets.append((image, k, x, y, x + r.choice((5.0, 20.0, 50.0)), y + r.choice((5.0, 30.0))))
    boxes += [("many", 900, 1e7, -1e7, 5.0, 5.0), ("many", 901, *sets[5][2:4], sets[5][4] - sets[5][2], sets[5][5] - sets[5][3]), ("no sets", 1, 0.0, 0.0, 1.0, 1.0), ("many", 902, None, 0.0, 1.0, 1.0)]
    sets += [("many", 1000 + k, *sets[k][2:]) for k in range(50)] + [("many", -1, None, 0.0, 1.0, 1.0)]  # repeated ones
    got = {(x.image_id, x.det_id): (x.set_id, x.score) for x in masks.nearest_landmarks(spark.createDataFrame(boxes, BOX), spark.createDataFrame(sets, SET)).collect()}
    want = {}
    for b in boxes:
        fits = [(misfit(b, s), s[1]) for s in sets if s[0] == b[0] and None not in b and None not in s]
        if fits:
            want[b[:2]] = min(fits)[::-1]
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def test_nearest_landmarks_of_empty_tables(spark):
    assert masks.nearest_landmarks(spark.createDataFrame([], BOX), spark.createDataFrame([], SET)).count() == 0


def gauss(a, sigma):
    radius = max(3, round(sigma * 6) | 1) // 2
    w = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    w /= w.sum()
    for axis in (1, 0):
        a = np.apply_along_axis(lambda v: np.convolve(np.pad(v, radius, "symmetric"), w, "valid"), axis, a)
    return a


def test_scene_masks_with_and_without_faces(spark):
    height, width = 12, 20
    cells = [(i, layer, y, x, ((x * 7 + y * 3) % 11) / 10) for i in ("a", "b") for layer in ("face", "hair") for y in range(6) for x in range(8)]
    faces = [("a", 5.0, 0.0, 3.0, 3.0), ("a", 12.0, 1.0, 2.0, 2.0), ("c", 9.0, 2.0, 2.0, 3.0), ("b", None, 1.0, 1.0, 1.0)]
    got = masks.scene_masks(spark.createDataFrame([*cells, ("b", "face", 50, 50, 1.0)], "image_id string, layer string, y int, x int, v double"), spark.createDataFrame(faces, "image_id string, x double, y double, w double, h double"), width, height).collect()
    assert len(got) == 3 * height * width
    for image in "abc":
        own = [f for f in faces if f[0] == image and None not in f]
        s = np.zeros((height, width))
        for i, layer, y, x, v in cells:
            if i == image:
                s[y, x] = max(s[y, x], v * {"face": 1.0, "hair": 0.95}[layer] * (1.0 if own else 0.85))
        for _, x, y, w, h in own:
            for yy in range(height):
                for xx in range(width):
                    total = 0
                    for up, wide, high, weight in ((2.05, 1.35, 2.75, 0.55), (1.28, 1.55, 0.88, 0.75), (1.85, 1.18, 1.75, 0.85)):
                        rx, ry = max(1, round(w * wide)), max(1, round(h * high))
                        total += weight * (((xx - round(x + w * 0.5)) / rx) ** 2 + ((yy - round(y + h * up)) / ry) ** 2 <= 1)
                    s[yy, xx] = max(s[yy, xx], min(1.0, total))
        back = gauss(1 - gauss(s, 2.0), 2.0)
        for r in (r for r in got if r.image_id == image):
            assert r.background == pytest.approx(back[r.y, r.x], abs=1e-9) and r.subject == pytest.approx(1 - back[r.y, r.x], abs=1e-9)


def test_background_layer_equals_plain_loops(spark):
    """Blur under the broad mask, and dehaze where the picture is dark; the kernels reach beyond what is written out, so go by tile."""
    height, width = 14, 18
    rgb = np.random.default_rng(5).random((height, width, 3))
    mask = np.random.default_rng(6).random((height, width))
    rows = [("a", y, x, *map(float, rgb[y, x])) for y in range(height) for x in range(width)]
    df = spark.createDataFrame(rows, "image_id string, y int, x int, r double, g double, b double")
    m = spark.createDataFrame([("a", y, x, float(mask[y, x])) for y in range(height) for x in range(width) if x > 2], "image_id string, y int, x int, v double")
    plane = np.where(np.arange(width) > 2, mask, 0.0)
    broad, blend, detail = gauss(plane**0.65, 1.6), gauss(plane**0.85, 1.2), gauss(np.clip((plane - 0.04) / 0.96, 0, 1) ** 1.25, 0.9)
    both = lambda a, b, w: np.clip(a * (1 - w[..., None]) + b * w[..., None], 0, 1)
    blurred = lambda a, sigma: np.stack([gauss(a[..., k], sigma) for k in range(3)], -1)
    edited = both(rgb, blurred(rgb, 1 + 0.4 * 12), broad)
    dark = gauss(np.clip(1 - (edited @ [0.2126, 0.7152, 0.0722]) * 1.15, 0, 1), 2.2)
    clear = np.clip(edited + (edited - blurred(edited, 7.0)) * 0.8 * 0.85, 0, 1)
    want = both(rgb, both(edited, clear, np.clip(dark * detail, 0, 1)), blend)
    for r in grade.grade_masked(df, m, "background", {"blur": 40, "dehaze": 80}).collect():
        assert (r.r, r.g, r.b) == pytest.approx(tuple(want[r.y, r.x]), abs=1e-9)
    stack = grade.layer_stack(df, m.withColumn("layer", F.lit("background")), [{"layer": "background", "params": {"dehaze": 80}, "opacity": 0.0}])
    assert {(r.y, r.x): r.r for r in stack.collect()} == {(y, x): float(rgb[y, x, 0]) for y in range(height) for x in range(width)}


def _plan(df):
    """The plan as it is before it runs, with all that is small broadcast."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_made_from_images_are_not_broadcast(spark):
    full = spark.createDataFrame([(i, y, x, 0.1 * y) for i in (1, 2) for y in range(4) for x in range(4)], "image_id long, y int, x int, v double")
    cells = full.select("image_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(5))))
    out = masks.merge_views(full, full.where("y < 3"), (1, 1), cells.withColumn("weight", F.lit(0.5)))
    assert "Broadcast" not in _plan(out)
    got = {(r.y, r.x): r.v for r in out.where("image_id = 2").collect()}
    assert len(got) == 4 * 4 + 3 and got[0, 0] == 0.0 and got[2, 2] == pytest.approx(0.2 * 0.5 + 0.1 * 0.5) and got[3, 4] == pytest.approx(0.2 * 0.5)


def test_instance_mask_of_rows_and_of_columns_equals_plain_loops(spark):
    """Both forms of prototypes, with missing rows, images whose best is below the threshold, and without any score."""
    r = random.Random(7)
    preds = [(i, k, r.uniform(0, 32), r.uniform(0, 32), r.uniform(0, 20), r.uniform(0, 20), [r.random() * (0.15 if i == 2 else 1.0), 0.1], [r.uniform(-2, 2), r.uniform(-2, 2)][: 1 + k % 2]) for i in (1, 2) for k in range(9)]
    preds.append((3, 0, 9.0, 9.0, 9.0, 9.0, [None, None], [1.0, 1.0]))
    cells = {(i, y, x): [None if (y + x + q) % 5 == 0 else r.uniform(-1, 1) for q in (0, 1)] for i in (1, 2, 3) for y in range(8) for x in range(8)}
    p = spark.createDataFrame(preds, "image_id int, pred_id int, cx double, cy double, w double, h double, scores array<double>, coeffs array<double>")
    rows = spark.createDataFrame([(i, q, y, x, v) for (i, y, x), vs in cells.items() for q, v in enumerate(vs) if v is not None], "image_id int, proto_id int, y int, x int, v double")
    columns = spark.createDataFrame([(*k, *vs) for k, vs in cells.items()], "image_id int, y int, x int, p0 double, p1 double")
    want = {}
    for i in (1, 2):
        own = [q for q in preds if q[0] == i]
        kept = [q for q in own if max(q[6]) > 0.2] or [max(own, key=lambda q: (max(q[6]), -q[1]))]
        for _, _, cx, cy, w, h, scores, coeffs in kept:
            x1, y1 = (min(max((c - s * 0.5) * 0.25, 0.0), 7.0) for c, s in ((cx, w), (cy, h)))
            x2, y2 = (min(max((c + s * 0.5) * 0.25, low + 1), 8.0) for c, s, low in ((cx, w, x1), (cy, h, y1)))
            for (j, y, x), vs in cells.items():
                terms = [c * v for c, v in zip(coeffs, vs) if v is not None]
                if j == i and terms:
                    v = 1 / (1 + math.exp(-sum(terms))) * max(scores) if x1 <= x < x2 and y1 <= y < y2 else 0.0
                    want[j, y, x] = max(v, want.get((j, y, x), 0.0))
    for proto in (rows, columns):
        out = masks.instance_mask(p, proto, (8, 8), (32, 32))
        assert "BroadcastHashJoin" not in _plan(out)
        assert {(q.image_id, q.y, q.x): q.v for q in out.collect()} == pytest.approx(want, abs=1e-12)


def test_nearest_landmarks_in_parts_makes_no_rows_for_cells(spark, monkeypatch):
    """Boxes and sets in several parts, of which each meets each; nothing but the tables is dealt out, and nothing is written before."""
    monkeypatch.setattr(masks, "PART", 150)
    monkeypatch.setattr(masks, "cut", None, raising=False)
    r = random.Random(9)
    boxes = [("a", k, r.uniform(-90, 90), r.uniform(-90, 90), r.uniform(0, 9), r.uniform(0, 9)) for k in range(400)]
    sets = [("a", k, x, y, x + 4.0, y + 4.0) for k in range(320) for x, y in [(float(r.randint(-9, 9)), float(r.randint(-9, 9)))]]
    got = {x.det_id: (x.score, x.set_id) for x in masks.nearest_landmarks(spark.createDataFrame(boxes, BOX), spark.createDataFrame(sets, SET)).collect()}
    assert len(got) == 400
    for b in boxes:
        score, set_id = min((misfit(b, s), s[1]) for s in sets)
        assert got[b[1]] == (pytest.approx(score, abs=1e-12), set_id)
