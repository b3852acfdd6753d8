"""What keeps queries in proportion on larger tables."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from pixelframe.functions import color
from pixelframe.operators import masks, tiles
from pixelframe.plans import grade

BOXES = "image_id long, det_id long, x double, y double, w double, h double"


def _largest_method(df) -> int:
    """Bytes of the largest generated method: the JVM doesn't compile those of more than 8,000."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())))


@pytest.fixture
def planned(spark):
    """Plans that show all their generated code."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def _pixels(spark):
    return spark.range(0, 1200, 1, 4).select((F.col("id") % 3).alias("image_id"), (F.col("id") / 60).cast("int").alias("y"), F.pmod((F.col("id") / 3).cast("int"), F.lit(20)).alias("x"), *[F.when(F.col("id") > 5, F.pmod(F.col("id") * k, F.lit(97)) / 97).alias(c) for k, c in zip((5, 7, 3), "rgb")])


def test_chains_of_steps_are_compiled(planned):
    px = _pixels(planned)
    graded = grade.grade_global(px, {"exposure": 20, "temperature": 40, "shadows": 10, "vibrance": 30, "saturation": 10, "vignette": 35})
    assert _largest_method(graded) < 8000
    mask = px.select("image_id", "y", "x", F.lit(0.5).alias("v"))
    assert _largest_method(grade.grade_masked(px, mask, "subjects", {"exposure": 30, "saturation": 25, "warmth": -30})) < 8000


def test_zone_chords_hold_the_pixels_of_the_ellipse(planned):
    boxes = [(1, k, *b) for k, b in enumerate([(3.0, 4.0, 20.0, 30.0), (-40.0, 5.0, 30.0, 12.0), (50.0, -9.0, 51.0, 9.0), (60.0, 60.0, 1.0, 1.0), (-300.0, 10.0, 5.0, 5.0), (10.0, 30.0, 25.0, 25.0)])]
    boxes = planned.createDataFrame(boxes, BOXES)
    want = set()
    for e in masks.ellipses(boxes).collect():
        want |= {(e.det_id, e.zone, y, x) for y in range(48) for x in range(64) if ((x - e.cx) / e.rx) * ((x - e.cx) / e.rx) + ((y - e.cy) / e.ry) * ((y - e.cy) / e.ry) <= 1}
    chords = masks.zone_chords(boxes, 64, 48)
    assert _largest_method(chords) < 8000
    rows = chords.collect()
    assert len({(r.det_id, r.zone, r.y) for r in rows}) == len(rows)  # one a row of pixels
    assert {(r.det_id, r.zone, r.y, x) for r in rows for x in range(r.x1, r.x2 + 1)} == want
    pixels = [tuple(r) for r in masks.zone_pixels(boxes, 64, 48).select("det_id", "zone", "y", "x").collect()]
    assert len(pixels) == len(want) and set(pixels) == want


def test_nine_places_round_as_the_sql_does(spark):
    import duckdb

    values = [0.0, 0.5, 1 / 1024, 3 / 1024, -1 / 1024, 5e-10, 4.9999999999999994e-10, -932312.3854944794, 897915.1854975804, 999999.9999999999, 123456789.12345679, 1e300, float("inf"), None]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(color.nine_places(F.col("v")).alias("v")).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(v, 9) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
    halves = [0.5, 1.5, 2.5, -0.5, -1.5, -0.3, 7.49999]
    got = [r.v for r in spark.createDataFrame([(v,) for v in halves], "v double").select(color.half_even(F.col("v")).alias("v")).collect()]
    assert list(map(repr, got)) == ["0.0", "2.0", "2.0", "0.0", "-2.0", "0.0", "7.0"]


def test_frames_of_a_scene_are_dealt_to_tasks(planned):
    """Many images of a row each become many cells: they aren't all in one task, and bodies are made where their image is."""
    boxes = planned.range(0, 50, 1, 1).select(F.col("id").alias("image_id"), F.lit(3.0).alias("x"), F.lit(2.0).alias("y"), F.lit(2.0).alias("w"), F.lit(2.0).alias("h"))
    none = planned.createDataFrame([], "image_id long, layer string, y int, x int, v double")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        masks.body_cells(boxes, 16, 12).explain()
    assert out.getvalue().count("Exchange") == 1 and "Exchange hashpartitioning(image_id" in out.getvalue()
    planned.conf.set("spark.sql.adaptive.enabled", "true")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        masks.scene_masks(none, boxes, 16, 12).explain()
    assert "REPARTITION_BY_NUM" in out.getvalue()


def test_edits_that_read_neighbours_share_one_deal(planned):
    """Blur and dehaze read what was dealt for the masks: the shuffles are those of the join with the mask and one by tile, and nothing is computed twice."""
    px = _pixels(planned)
    mask = px.select("image_id", "y", "x", F.lit(0.5).alias("v"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        grade.grade_masked(px, mask, "background", {"blur": 20, "exposure": 10, "clarity": 30, "dehaze": 60}).explain()
    plan = out.getvalue()
    assert 1 <= plan.count("Exchange") <= 3 and plan.count("Range (") == 2


def test_small_pictures_are_sent_once(planned):
    """What a filter reads beyond a picture's first row and column is no tile to which cells are sent."""
    dealt = tiles.deal(_pixels(planned), 40)
    assert dealt.count() == tiles.trim(dealt, 40).count() == 1200
    moved = tiles.deal(_pixels(planned).withColumn("y", F.col("y") - 300), 40)  # places below 0 have tiles, too
    assert moved.count() > 1200 and sorted(tiles.trim(moved, 40).select("y", "x", "image_id").collect()) == sorted(_pixels(planned).select(F.col("y") - 300, "x", "image_id").collect())
