"""Composite jobs: the global grade, grades under a mask, layer stacks, and the batch run."""

from __future__ import annotations

import hashlib
import uuid
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.functions import color
from pixelframe.functions.color import clip
from pixelframe.operators import catalogue, grid, ledger, masks, pixels, tiles
from pixelframe.sources import files
from pixelframe.sources.shared import cut, new_path

PLACE = ["image_id", "y", "x"]


def by_channel(df: DataFrame, f) -> DataFrame:
    """f, which takes and gives a plane (image_id, y, x, v), for each of r, g, b; all channels go through it together."""
    long = df.select(*PLACE, F.explode(F.create_map(*[x for c in "rgb" for x in (F.lit(c), F.col(c))])).alias("c", "v"))
    plane = long.select(F.struct("image_id", "c").alias("image_id"), "y", "x", "v")
    done = f(plane).groupBy(F.col("image_id.image_id").alias("image_id"), "y", "x")
    return done.agg(*[F.max(F.when(F.col("image_id.c") == c, F.col("v"))).alias(c) for c in "rgb"])


def grade_global(df: DataFrame, p: dict[str, float], temp_k: float = 6500, tint: float = 0, curve: list | None = None, mixer: dict | None = None) -> DataFrame:
    """The global chain in its order: white balance, exposure, warmth and tint, tones, curve, local contrast, saturation twice,
    mixer, sharpening, denoising, glow, vignette. What is zero adds no step; neighbours are only read for the five that need them."""
    df = df.select(*PLACE, "r", "g", "b")
    size = pixels.sizes(df)  # of the source: what is graded isn't computed again for it
    if temp_k != 6500 or tint:
        df = color.apply_gains(df, color.gains_of(F.lit(temp_k), F.lit(tint)))
    df = color.exposure(df, p.get("exposure", 0))
    df = color.tint(color.warmth(df, p.get("temperature", 0)), p.get("tint", 0))
    df = color.band_tone(df, *[p.get(k, 0) for k in ("blacks", "shadows", "midtones", "highlights", "whites")])
    if curve:
        df = color.apply_curve(df, curve)
    if p.get("clarity"):
        df = by_channel(df, lambda v: grid.local_contrast(v, p["clarity"], 1.8, 9.0, 2.4))
    df = color.saturation(df, p.get("vibrance", 0) * 0.5 + p.get("saturation", 0) * 0.5)
    df = color.saturation(df, p.get("vibrance", 0) * 0.5)
    df = color.color_mixer(df, mixer or {})
    if p.get("sharpness", 0) > 0:
        levels = df.select(*PLACE, *[color.quantize(F.col(c)).cast("double").alias(c) for c in "rgb"])
        sharp = by_channel(levels, lambda v: grid.sharpen(v, 1 + p["sharpness"] / 100 * 3))
        df = sharp.select(*PLACE, *[(F.col(c) / 255).alias(c) for c in "rgb"])
    if p.get("noise_red", 0) > 0:
        df = by_channel(df, lambda v: grid.gaussian_smooth(v, p["noise_red"] / 100 * 3))
    if p.get("glow", 0) > 0:
        df = by_channel(df, lambda v: grid.glow(v, p["glow"]))
    if p.get("vignette"):
        dims = df.join(size, "image_id")
        df = color.vignette(dims, p["vignette"], F.col("width"), F.col("height")).drop("width", "height")
    return df.select(*PLACE, "r", "g", "b")


# By layer, the sigmas of detail and base and the edge strength of its local contrast; "" for other layers.
CLARITY = {"": (1.6, 6.0, 2.2), "subjects": (1.6, 6.8, 2.3), "background": (2.0, 10.0, 1.8), "face": (1.5, 7.0, 2.6)}


#: What dehaze takes for the haze: the picture smoothed by this sigma.
HAZE = 7.0


def _blur_sigma(p: dict[str, float]) -> float:
    return 1 + p["blur"] / 100 * 12


def _kinds(p: dict[str, float]) -> list[str]:
    """The effect masks that a layer's edits need: to mix it in, and for edits that have a mask of their own."""
    return ["blend"] + ["broad"] * (p.get("blur", 0) > 0) + ["detail"] * (p.get("dehaze", 0) > 0)


def layer_reach(p: dict[str, float], layer: str) -> int:
    """Cells to each side that a layer's edits read: those of each, as one follows the other."""
    blur = grid.reach(_blur_sigma(p)) if p.get("blur", 0) > 0 else 0
    clarity = grid.contrast_reach(*CLARITY.get(layer, CLARITY[""])[:2]) if p.get("clarity") else 0
    return blur + clarity + (grid.reach(HAZE) if p.get("dehaze", 0) > 0 else 0)


def _take(df: DataFrame, new) -> DataFrame:
    """df with new(channel) as its channels, without _new_r, _new_g, _new_b."""
    return df.withColumns({c: new(c) for c in "rgb"}).drop("_new_r", "_new_g", "_new_b")


def edit_layer(df: DataFrame, p: dict[str, float], layer: str, at) -> DataFrame:
    """A layer's own edits, before it is mixed in: blur (under its broad mask), exposure, local contrast, saturation, warmth and dehaze (under
    its detail mask where it is dark). at(kind) is the column of an effect mask; df's other columns are kept.

    Where layer_reach isn't 0, df is dealt by tile with so many cells around, and so is the result: all edits are made where the tile is.
    """
    if p.get("blur", 0) > 0:
        m = at("broad")
        df = grid.smooth_dealt(df, {f"_new_{c}": (c, _blur_sigma(p)) for c in "rgb"})
        df = _take(df, lambda c: clip(F.col(c) * (1 - m) + F.col(f"_new_{c}") * m))
    if p.get("exposure"):
        df = color.exposure(df, p["exposure"])
    if p.get("clarity"):
        df = grid.contrast_dealt(df, "rgb", p["clarity"], *CLARITY.get(layer, CLARITY[""]))
    df = color.warmth(color.saturation(df, p.get("saturation", 0)), p.get("warmth", 0))
    if p.get("dehaze", 0) > 0:
        df = df.withColumn("_dark", clip(1 - color.luma(F.col("r"), F.col("g"), F.col("b")) * 1.15))
        df = grid.smooth_dealt(df, {f"_new_{c}": (c, HAZE) for c in "rgb"} | {"_dark": ("_dark", 2.2)})
        m = clip(F.col("_dark") * at("detail"))
        clear = lambda c: clip(F.col(c) + (F.col(c) - F.col(f"_new_{c}")) * (p["dehaze"] / 100 * 0.85))
        df = _take(df, lambda c: clip(F.col(c) * (1 - m) + clear(c) * m)).drop("_dark")
    return df


def _masked(df: DataFrame, mask: DataFrame) -> DataFrame:
    return df.join(mask.select(*PLACE, F.col("v").alias("_m")), PLACE, "left").withColumn("_m", F.coalesce("_m", F.lit(0.0)))


def _of_images(df: DataFrame, near: int) -> DataFrame:
    """df; if neighbours are read, without pixels of no image, which have none."""
    return df.where("image_id IS NOT NULL") if near else df


def _before(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_{c}": F.col(c) for c in "rgb"})


def grade_masked(df: DataFrame, mask: DataFrame, layer: str, p: dict[str, float]) -> DataFrame:
    """A layer's edits mixed in under its effect mask, the smoothed confidence curve of mask (image_id, y, x, v; 0 where it has no cell).

    Pixels and masks are dealt by tile once, for the masks' smoothing and for all edits that read neighbours.
    """
    wanted, near = {f"_{k}": ("_m", layer, k) for k in _kinds(p)}, layer_reach(p, layer)
    far = near + masks.effect_reach(wanted)
    df = tiles.deal(_masked(_of_images(df.select(*PLACE, "r", "g", "b"), near), mask), far)
    df = edit_layer(_before(masks.effects_dealt(df, wanted).drop("_m")), p, layer, lambda kind: F.col(f"_{kind}"))
    return tiles.trim(df, far).select(*PLACE, *[clip(F.col(f"_{c}") * (1 - F.col("_blend")) + F.col(c) * F.col("_blend")).alias(c) for c in "rgb"])


def layer_stack(df: DataFrame, planes: DataFrame, layers: list[dict]) -> DataFrame:
    """Layers over each other, in order: each {layer, params, opacity (in [0, 1]), mode}.

    The masks, planes (image_id, layer, y, x, v), become columns first, so that all layers take one join, and all their effect masks one pass of smoothing.
    """
    layers = [x for x in layers if x.get("opacity", 1.0) > 0]
    if not layers:
        return df.select(*PLACE, "r", "g", "b")
    names = list(dict.fromkeys(x["layer"] for x in layers))
    column = {n: f"_m{k}" for k, n in enumerate(names)}
    wide = planes.where(F.col("layer").isin(names)).groupBy(*PLACE).agg(*[F.max(F.when(F.col("layer") == n, F.col("v"))).alias(column[n]) for n in names])
    df = df.select(*PLACE, "r", "g", "b").join(wide, PLACE, "left").fillna(0.0, list(column.values()))
    kinds = {(x["layer"], k) for x in layers for k in [*_kinds(x["params"]), *color.composite_kinds(x["layer"], x.get("mode", "normal"))]}
    df = masks.effect_masks(df, {f"{column[n]}_{k}": (column[n], n, k) for n, k in sorted(kinds)}, ("r", "g", "b"))
    for x in layers:
        at = lambda kind, m=column[x["layer"]]: F.col(f"{m}_{kind}")
        mode = x.get("mode", "normal")
        own, full = at("blend"), color.composite_of(at, x["layer"], mode, x.get("opacity", 1.0))
        near = layer_reach(x["params"], x["layer"])
        df = edit_layer(_before(tiles.deal(_of_images(df, near), near) if near else df), x["params"], x["layer"], at)
        df = tiles.trim(df, near) if near else df
        df = df.withColumns({c: clip(F.col(f"_{c}") * (1 - own) + F.col(c) * own) for c in "rgb"})
        df = df.withColumns({c: clip(F.col(f"_{c}") * (1 - full) + color.blend(F.col(f"_{c}"), F.col(c), mode) * full) for c in "rgb"}).drop("_r", "_g", "_b")
    return df.select(*PLACE, "r", "g", "b")


def _read(what, path: str, otherwise: DataFrame) -> DataFrame:
    """what(path), or otherwise where nothing is at path."""
    try:
        df = what(path)
        df.schema  # noqa: B018
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return otherwise


#: Images that one step of a batch run grades and commits; their paths are all that the driver holds.
STEP_IMAGES = 2000
MANIFEST = "batch string, image_id string, run string, bucket int, pixels long, at timestamp"


def committed(spark: SparkSession, out: str) -> DataFrame:
    """(batch, image_id, run, bucket, pixels): the last commit of each image in each batch."""
    rows = _read(lambda x: spark.read.schema(MANIFEST).parquet(x), f"{out}/manifest", spark.createDataFrame([], MANIFEST))
    last = rows.groupBy("batch", "image_id").agg(F.max_by(F.struct("run", "bucket", "pixels"), "at").alias("last"))
    return last.select("batch", "image_id", "last.*")


def stored_pixels(spark: SparkSession, out: str) -> DataFrame:
    """The pixels of a store, with their batch, as the manifest has them: what a run that broke off has left doesn't count, nor what a later run replaced."""
    pixels = spark.read.parquet(f"{out}/pixels")
    return pixels.join(committed(spark, out).select("batch", "image_id", "run"), ["batch", "image_id", "run"], "left_semi").drop("run", "bucket")


def batch_run(spark: SparkSession, folder: str, out: str, log: str, preset_hash: str, p: dict[str, float], suffix: str = "_enhanced", output_format: str = "jpeg", job_id: str = "", buckets: int = 64) -> DataFrame:
    """Grade a folder's images that haven't succeeded before in this batch, store their pixels, and append a record for each.

    A batch is a preset, suffix and format. An image is skipped if a record says that it succeeded and the store has it; only the others are
    read and decoded. They are graded in steps of STEP_IMAGES: pixels go to out/pixels/batch=.../bucket=..., a
    fixed number of folders a batch; then out/manifest says which images of this run are whole, and the log gets their records.
    A run that broke off is taken up where it was: what it hasn't committed doesn't count (see stored_pixels). An image that can't be read
    becomes a record with an error. Returns the records.
    """
    key = f'{{"format": "{output_format}", "preset_hash": "{preset_hash}", "suffix": "{suffix}"}}'
    batch, run = hashlib.sha256(key.encode()).hexdigest()[:16], uuid.uuid4().hex
    store, records = f"{out}/pixels", new_path(spark, "records")
    plan = catalogue.plan_outputs(files.list_images(spark, folder).select("path"), out, suffix, output_format).withColumn("batch_key", F.lit(key))
    plan = plan.select("batch_key", "source_path", "output_path")
    done = _read(lambda x: files.scan_ledger(spark, x), log, spark.createDataFrame([], files.LEDGER))
    # A bucket whose folder is gone has none of its images.
    there = _read(lambda x: spark.read.parquet(x).select(F.col("bucket").cast("int")).distinct(), f"{store}/batch={batch}", spark.createDataFrame([], "bucket int"))
    kept = committed(spark, out).where(F.col("batch") == batch).join(there, "bucket", "left_semi")
    stored = plan.join(kept.select(F.col("image_id").alias("source_path")), "source_path", "left_semi").select(F.col("output_path").alias("path"))
    work = cut(ledger.pending_work(plan, done, stored))

    def record(judged: DataFrame) -> None:
        """judged: batch_key, source_path, output_path, status."""
        status = F.col("status")
        have = {
            "batch_key": F.col("batch_key"), "error": F.when(status == "error", "cannot read image"), "job_id": F.lit(job_id), "output_format": F.lit(output_format),
            "output_path": F.col("output_path"), "preset_hash": F.lit(preset_hash), "reason": F.when(status == "skipped", "already completed"),
            "source_path": F.col("source_path"), "status": status, "suffix": F.lit(suffix), "ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        }
        rows = cut(judged.select(*[have.get(c, F.lit(None).cast("string")).alias(c) for c in files.LEDGER_FIELDS]))
        files.append_ledger(rows, log)
        rows.write.mode("append").parquet(records)

    record(work.where("status = 'skipped'"))
    todo = work.where("status = 'pending'").select("batch_key", "source_path", "output_path")
    paths = todo.toLocalIterator()
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int")
    while step := list(islice(paths, STEP_IMAGES)):
        graded = grade_global(files.read_pixels(spark, [r.source_path for r in step]), p)
        graded = graded.select("*", F.lit(run).alias("run"), F.lit(batch).alias("batch"), bucket.alias("bucket")).repartition("bucket")
        graded.write.mode("append").partitionBy("batch", "bucket").parquet(store)
        planned = spark.createDataFrame(step, todo.schema)
        mine = _read(lambda x: spark.read.schema("image_id string, run string, bucket int").parquet(x).where(F.col("run") == run), f"{store}/batch={batch}", spark.createDataFrame([], "image_id string, run string, bucket int"))
        whole = mine.join(planned.select(F.col("source_path").alias("image_id")), "image_id", "left_semi").groupBy("image_id", "bucket").agg(F.count(F.lit(1)).alias("pixels"))
        whole = cut(whole.select(F.lit(batch).alias("batch"), "image_id", F.lit(run).alias("run"), "bucket", "pixels", F.current_timestamp().alias("at")))
        whole.write.mode("append").parquet(f"{out}/manifest")
        good = whole.select(F.col("image_id").alias("source_path"), F.lit("success").alias("ok"))
        record(planned.join(good, "source_path", "left").withColumn("status", F.coalesce("ok", F.lit("error"))).drop("ok"))
    return spark.read.schema(files.LEDGER).parquet(records)
