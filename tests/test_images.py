"""Known values and whole runs on images made here."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pixelframe.functions import color
from pixelframe.operators import grid, masks, pixels
from pixelframe.plans import grade
from pixelframe.sources import files
from pixelframe.streaming import ledger_stream


def png(path, rows):
    """Write an RGB image of 8-bit rows."""
    h, w = len(rows), len(rows[0])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    png(d / "a.png", [[(255, 0, 10), (1, 2, 3)], [(4, 5, 6), (7, 8, 9)], [(0, 0, 0), (255, 255, 255)]])
    png(d / "b.PNG", [[(128, 128, 128)]])
    (d / "broken.png").write_bytes(b"no image")
    (d / "notes.txt").write_text("x")
    return d


def test_listing_and_pixels(spark, folder):
    assert [r.path.rsplit("/", 1)[1] for r in files.list_images(spark, str(folder)).collect()] == ["a.png", "b.PNG", "broken.png"]
    rows = {(r.y, r.x): (round(r.r * 255), round(r.g * 255), round(r.b * 255)) for r in files.read_pixels(spark, str(folder)).where("image_id LIKE '%a.png'").collect()}
    assert rows == {(0, 0): (255, 0, 10), (0, 1): (1, 2, 3), (1, 0): (4, 5, 6), (1, 1): (7, 8, 9), (2, 0): (0, 0, 0), (2, 1): (255, 255, 255)}


def test_batch_run_skips_what_is_done(spark, folder, tmp_path):
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "log"), "h", {"exposure": 10})
    first = {r.source_path.rsplit("/", 1)[1]: r.status for r in grade.batch_run(*args).collect()}
    assert first == {"a.png": "success", "b.PNG": "success", "broken.png": "error"}
    again = {r.source_path.rsplit("/", 1)[1]: r.status for r in grade.batch_run(*args).collect()}
    assert again == {"a.png": "skipped", "b.PNG": "skipped", "broken.png": "error"}


def test_batch_run_decodes_pending_images_only(spark, folder, tmp_path, monkeypatch):
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "log"), "h", {"exposure": 10})
    (folder / "broken.png").unlink()
    asked, read = [], files.read_pixels
    monkeypatch.setattr(files, "read_pixels", lambda spark, paths: asked.extend(paths) or read(spark, paths))
    monkeypatch.setattr(grade, "STEP_IMAGES", 1)
    assert [r.status for r in grade.batch_run(*args).collect()] == ["success"] * 2 and len(asked) == 2
    assert [r.status for r in grade.batch_run(*args).collect()] == ["skipped"] * 2 and len(asked) == 2
    png(folder / "c[1].png", [[(9, 9, 9)]])
    assert sorted(r.status for r in grade.batch_run(*args).collect()) == ["skipped", "skipped", "success"] and len(asked) == 3
    assert {r.image_id.rsplit("/", 1)[1]: r.n for r in grade.stored_pixels(spark, str(tmp_path / "out")).groupBy("image_id").agg(F.count("r").alias("n")).collect()} == {"a.png": 6, "b.PNG": 1, "c[1].png": 1}
    assert all("image=" not in str(d) for d in (tmp_path / "out").rglob("*"))


def test_batches_are_kept_apart(spark, folder, tmp_path):
    def run(preset, exposure):
        out = grade.batch_run(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "log"), preset, {"exposure": exposure})
        return {r.source_path.rsplit("/", 1)[1]: r.status for r in out.collect()}

    def stored():
        return grade.stored_pixels(spark, str(tmp_path / "out"))

    assert run("h", 10)["a.png"] == "success" == run("g", 20)["a.png"]
    pixels = stored()
    assert pixels.select("batch").distinct().count() == 2 and pixels.groupBy("batch", "image_id", "y", "x").count().where("count > 1").count() == 0
    (folder / "a.png").write_bytes(b"broken since")
    assert run("f", 30) == {"a.png": "error", "b.PNG": "success", "broken.png": "error"}  # though other batches have its pixels
    for d in (tmp_path / "out" / "pixels").glob("batch=*"):
        d.rename(tmp_path / d.name)  # outputs that are gone are made again
    (tmp_path / "out" / "pixels" / "_SUCCESS").unlink(missing_ok=True)
    assert run("g", 20)["b.PNG"] == "success"


def test_a_run_that_broke_off_is_repeated(spark, folder, tmp_path):
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "log"), "h", {"exposure": 10})
    grade.batch_run(*args)
    (tmp_path / "log").rename(tmp_path / "lost")  # as if it had ended before its records were written
    again = {r.source_path.rsplit("/", 1)[1]: r.status for r in grade.batch_run(*args).collect()}
    assert again == {"a.png": "success", "b.PNG": "success", "broken.png": "error"}
    assert grade.stored_pixels(spark, str(tmp_path / "out")).groupBy("image_id", "y", "x").count().where("count > 1").count() == 0


def test_bell_fills_the_frame(spark):
    import math

    boxes = spark.createDataFrame([("i", 1, 2.0, 3.0, 4.0, 2.0)], "image_id string, det_id int, x double, y double, w double, h double")
    got = {(r.y, r.x): r.v for r in masks.gaussian_weight(boxes, 30, 20, F.col("w") / 4, F.col("h") / 4).collect()}
    assert len(got) == 600 and all(abs(v - math.exp(-((x - 4) ** 2 / 2 + (y - 4) ** 2 / 0.5))) < 1e-12 for (y, x), v in got.items())


def test_new_images_come_once(spark, folder, tmp_path):
    work, state, log = (str(tmp_path / k) for k in ("work", "state", "records"))
    name = lambda p: p.rsplit("/", 1)[1]
    done = lambda: spark.createDataFrame([("k", r.path, f"out/{name(r.path).split('.')[0]}_enhanced.jpg", "success") for r in files.list_images(spark, str(folder)).collect()], "batch_key string, source_path string, output_path string, status string")
    outputs = lambda: spark.createDataFrame([("out/a_enhanced.jpg",)], "path string")
    args = {"batch_key": "k", "done": done, "outputs": outputs}
    ledger_stream.new_images(spark, str(folder), work, state, log, **args)
    png(folder / "c.png", [[(1, 1, 1)]])
    ledger_stream.new_images(spark, str(folder), work, state, log, **args)
    ledger_stream.new_images(spark, str(folder), work, state, log, **args)
    assert sorted((name(r.source_path), r.status) for r in spark.read.parquet(work).collect()) == [("a.png", "skipped"), ("b.PNG", "pending"), ("broken.png", "pending"), ("c.png", "pending")]
    assert [name(r.source_path) for r in files.scan_ledger(spark, log).collect()] == ["a.png"]


def test_job_states_are_replayed_and_compacted(spark, tmp_path):
    states = ledger_stream.JobStates(spark, str(tmp_path), every=2)
    rows = lambda *x: spark.createDataFrame(list(x), "job_id long, success long")
    for k, batch in enumerate([[(1, 1), (2, 1)], [(1, 2)], [(3, 1)], [(1, 3), (3, 2)], [(2, 5)]]):
        states.upsert(rows(*batch), k)
        states.upsert(rows(*batch), k)  # a replay
    assert sorted(tuple(r) for r in states.read().collect()) == [(1, 3), (2, 5), (3, 2)]
    assert sorted(d.name for d in (tmp_path / "whole").glob("upto=*")) == ["upto=2", "upto=4"]


def test_bad_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"global_params": {"exposure": 25}, "meta": {"name": "x"}}')
    (tmp_path / "b.json").write_text("no json")
    rows = {r.path.rsplit("/", 1)[1]: r.preset for r in files.scan_presets(spark, str(tmp_path)).collect()}
    assert rows["a.json"].global_params == {"exposure": 25.0} and rows["b.json"].meta is None
    jobs = tmp_path / ".batch_jobs"
    jobs.mkdir()
    (jobs / "j1.json").write_text('{\n"mode": "batch"}')
    (jobs / "j2.json").write_text("{")
    assert [(r.job_id, r.mode) for r in files.scan_jobs(spark, str(jobs)).collect()] == [("j1", "batch")]


def _plane(spark, rows):
    return spark.createDataFrame([(1, y, x, float(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, y int, x int, v double")


def test_constant_plane_stays(spark):
    flat = _plane(spark, [[0.25] * 5] * 4)
    assert all(abs(r.v - 0.25) < 1e-12 for r in grid.gaussian_smooth(flat, 3.0).collect())
    assert grid.open_close(_plane(spark, [[0] * 6] * 6)).where("v > 0").count() == 0


def test_open_close_takes_off_what_is_thin(spark, tmp_path):
    """The query closes a gap, and then opens: a cell that stands out goes, though it hangs together with what stays, and so do corners."""
    from pixelframe.plans import mask_queries

    plane = ["........", "..#.....", "..####..", "..#.###.", "..####..", "..####..", "........", "........"]
    want = ["........", "........", "...###..", "..#####.", "..####..", "...##...", "........", "........"]
    masks = [(1, 0, [0.4 if c == "#" else -0.4 for row in plane for c in row])]
    spark.createDataFrame(masks, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.y, r.x): r.v for r in mask_queries.open_close(spark, str(tmp_path)).collect()}
    assert ["".join(".#"[int(got[y, x])] for x in range(8)) for y in range(8)] == want


def test_islands_and_holes(spark):
    ring = [[0, 0, 0, 0, 0], [0, 1, 1, 1, 0], [0, 1, 0, 1, 0], [0, 1, 1, 1, 0], [0, 0, 0, 0, 1]]
    filled = {(r.y, r.x): r.v for r in grid.fill_holes(_plane(spark, ring)).collect()}
    assert filled[2, 2] == 1 and filled[0, 0] == 0
    parts = grid.connected_components(_plane(spark, ring).where("v = 1"))
    assert {r.component for r in parts.collect()} == {(1, 1)}
    assert {r.component for r in grid.connected_components(_plane(spark, ring).where("v = 1"), diagonal=False).collect()} == {(1, 1), (4, 4)}


def test_boxes(spark):
    boxes = spark.createDataFrame([(1, 1, 5.2, 6.1, 10.4, 12.3), (1, 2, 1.0, 1.0, 20.0, 18.0)], "image_id long, det_id long, x double, y double, w double, h double")
    ranked = masks.rank_detections(boxes, 32, 32).orderBy("place").collect()
    assert [(r.x, r.y, r.w, r.h) for r in ranked] == [(1, 1, 20, 18), (5, 6, 11, 13)]


@pytest.mark.parametrize("kelvin,tint", [(3200, 0), (5500, 20), (7500, -30), (9000, 10)])
def test_white_balance_there_and_back(spark, kelvin, tint):
    k, t = color.kelvin_tint_of(*color.gains_of(F.lit(kelvin), F.lit(tint)))
    r = spark.range(1).select(k.alias("k"), t.alias("t")).first()
    assert abs(r.k - kelvin) <= 150 and abs(r.t - tint) <= 6


def test_histogram_counts_every_pixel(spark, folder):
    bins = pixels.histogram(files.read_pixels(spark, str(folder)), pixels.CHANNELS)
    assert {(r.channel, r.n) for r in bins.where("image_id LIKE '%a.png'").groupBy("channel").agg(F.sum("n").alias("n")).collect()} == {(c, 6) for c in pixels.CHANNELS}


def test_identities_return_their_input(spark):
    df = spark.range(1)
    assert color.saturation(df, 0) is df and color.apply_gains(df, (1, 1, 1)) is df and color.apply_curve(df, [(0, 0), (1, 1)]) is df


def test_written_images_are_read_back(spark, tmp_path):
    rows = [("a b", 0, 0, 1.0, 0.5, 0.0), ("a b", 1, 2, 0.2, None, 2.0), ("c+1", 0, 0, 0.0, 1.0, 0.0), (None, 0, 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image_id string, y int, x int, r double, g double, b double")
    for _ in range(2):  # writing again leaves the same files
        written = files.write_png(df, str(tmp_path / "out"))
    assert sorted((r.name, r.height, r.width) for r in written.collect()) == [("a b", 2, 3), ("c+1", 1, 1)]
    assert sorted(f.name for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")) == ["a b.png", "c+1.png"]
    got = {(r.image_id.rsplit("/", 1)[1], r.y, r.x): tuple(round(v * 255) for v in (r.r, r.g, r.b)) for r in files.read_pixels(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 7 and got["a b.png", 0, 0] == (255, 127, 0) and got["a b.png", 1, 2] == (51, 0, 255) and got["a b.png", 0, 1] == (0, 0, 0) and got["c+1.png", 0, 0] == (0, 255, 0)


def test_wide_filters_of_channels(spark):
    df = spark.range(900).select(F.concat(F.lit("i"), F.lit("1")).alias("image_id"), (F.col("id") / 30).cast("int").alias("y"), (F.col("id") % 30).cast("int").alias("x"), *[F.lit(0.5).alias(c) for c in "rgb"])
    out = grade.by_channel(df, lambda v: grid.gaussian_smooth(v, 8.0)).collect()
    assert len(out) == 900 and all(abs(v - 0.5) < 1e-9 for r in out for v in (r.r, r.g, r.b))


def test_images_are_joined_before_their_pixels_are_unpacked(spark):
    from pixelframe.plans import pixel_queries

    out = pixel_queries.image_pixels(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "MapInArrow" in plan and plan.rindex("MapInArrow") < plan.index("Join")
    assert out.schema["image_id"].dataType.simpleString() == "bigint"
