"""The catalogue of presets and the plans of files: predicates, projections, hashes, search and facets."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.sources.files import is_image, stem

# Sliders by layer (key, least, most, default), layers in their order, and the ranges of settings.
SLIDERS = {
    "global": (
        ("exposure", -200, 200, 0),
        ("temperature", -100, 100, 0),
        ("tint", -100, 100, 0),
        ("highlights", -100, 100, 0),
        ("shadows", -100, 100, 0),
        ("whites", -100, 100, 0),
        ("blacks", -100, 100, 0),
        ("midtones", -100, 100, 0),
        ("clarity", -100, 100, 0),
        ("sharpness", 0, 100, 0),
        ("noise_red", 0, 100, 0),
        ("vibrance", -100, 100, 0),
        ("saturation", -100, 100, 0),
        ("glow", 0, 100, 0),
        ("vignette", -100, 100, 0),
    ),
    "subjects": (
        ("exposure", -150, 150, 0),
        ("clarity", -100, 100, 0),
        ("saturation", -100, 100, 0),
        ("warmth", -100, 100, 0),
    ),
    "background": (
        ("blur", 0, 100, 0),
        ("exposure", -150, 150, 0),
        ("clarity", -100, 100, 0),
        ("saturation", -100, 100, 0),
        ("warmth", -100, 100, 0),
        ("dehaze", 0, 100, 0),
    ),
    "face": (
        ("exposure", -150, 150, 0),
        ("highlights", -100, 100, 0),
        ("shadows", -100, 100, 0),
        ("smile", -100, 100, 0),
        ("eye_open", -100, 100, 0),
        ("brow_lift", -100, 100, 0),
        ("mouth_open", -100, 100, 0),
        ("jaw_relax", -100, 100, 0),
        ("refine", 0, 100, 0),
        ("refine_fidelity", 0, 100, 65),
        ("clarity", -100, 100, 0),
        ("saturation", -100, 100, 0),
        ("sharpness", 0, 100, 0),
        ("smooth", 0, 100, 0),
        ("glow", 0, 100, 0),
    ),
    "skin": (
        ("exposure", -150, 150, 0),
        ("smooth", 0, 100, 0),
        ("clarity", -100, 100, 0),
        ("saturation", -100, 100, 0),
        ("warmth", -100, 100, 0),
        ("glow", 0, 100, 0),
        ("blemish", 0, 100, 0),
    ),
    "eyes": (
        ("brightness", -100, 100, 0),
        ("clarity", -100, 100, 0),
        ("saturation", -100, 100, 0),
        ("whites", 0, 100, 0),
        ("sharpen", 0, 100, 0),
        ("iris_pop", 0, 100, 0),
    ),
    "lips": (
        ("brightness", -100, 100, 0),
        ("saturation", -100, 100, 0),
        ("warmth", -100, 100, 0),
        ("smooth", 0, 100, 0),
        ("gloss", 0, 100, 0),
        ("hue_shift", -100, 100, 0),
    ),
    "hair": (
        ("brightness", -100, 100, 0),
        ("highlights", -100, 100, 0),
        ("saturation", -100, 100, 0),
        ("shine", 0, 100, 0),
        ("warmth", -100, 100, 0),
        ("clarity", -100, 100, 0),
    ),
}
LAYER_ORDER = ("background", "subjects", "hair", "skin", "face", "eyes", "lips")
OUTPUT_EXTENSIONS = {"jpeg": ".jpg", "png": ".png", "tiff": ".tiff"}
RANGES = {"strength": (0.0, 200.0, 100.0), "feather": (0.0, 40.0, 0.0), "expand": (-40.0, 40.0, 0.0), "wb_temp_k": (2000.0, 12000.0, 6500.0), "wb_tint": (-150.0, 150.0, 0.0), "gain": (0.25, 4.0, 1.0), "mixer": (-100.0, 100.0, 0.0)}
ENUMS = {"input_profile": ("auto", "ignore"), "raw_white_balance": ("camera", "auto"), "raw_colorspace": ("srgb", "adobe", "prophoto", "xyz", "raw"), "working_space": ("srgb", "linear"), "output_transform": ("srgb", "gamma22", "gamma18", "linear"), "icc_policy": ("srgb", "preserve_source", "none")}
MIN_CROP = 0.05


def sliders(spark: SparkSession) -> DataFrame:
    """The dimension of sliders: layer, key, least, most, default (65 rows)."""
    rows = [(layer, key, *map(float, values)) for layer, each in SLIDERS.items() for key, *values in each]
    return spark.createDataFrame(rows, "layer string, key string, least double, most double, default double")


def supported_files(listing: DataFrame) -> DataFrame:
    return listing.where(is_image(F.col("path"))).orderBy("path")


def plan_outputs(listing: DataFrame, folder: str, suffix: str, output_format: str) -> DataFrame:
    """source_path and output_path of each supported file, and collides: whether another source has the same output."""
    out = F.concat(F.lit(folder.rstrip("/") + "/"), stem(F.col("path")), F.lit(suffix + OUTPUT_EXTENSIONS[output_format]))
    plan = listing.where(is_image(F.col("path"))).select(F.col("path").alias("source_path"), out.alias("output_path"))
    twice = plan.groupBy("output_path").agg((F.count(F.lit(1)) > 1).alias("collides"))
    return plan.join(twice, "output_path").select("source_path", "output_path", "collides")


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spaces; numbers as Python writes them. Null for null and for text that isn't JSON."""

    def canon(each: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"))
            except ValueError:
                return None

        return pd.Series([one(t) for t in each], dtype=object)

    return F.pandas_udf(canon, "string", F.PandasUDFType.SCALAR)(text)


def batch_identity(canonical: Column, suffix: str, output_format: str) -> tuple[Column, Column]:
    """(preset_hash, batch_key) of a preset's canonical JSON."""
    hashed = F.sha2(canonical, 256)
    key = F.concat(F.lit(f'{{"format": "{output_format}", "preset_hash": "'), hashed, F.lit(f'", "suffix": "{suffix}"}}'))
    return hashed, key


def preset_params_long(presets: DataFrame, dimension: DataFrame) -> DataFrame:
    """(preset_id, layer, key, value) for every slider: the preset's value cut to int, else the default. params: map by layer of maps by key."""
    grid = presets.select("preset_id", "params").crossJoin(F.broadcast(dimension))
    value = F.element_at(F.element_at("params", F.col("layer")), F.col("key"))
    return grid.select("preset_id", "layer", "key", F.coalesce(value, F.col("default")).cast("long").alias("value"))


def clamped(value: Column, kind: str, whole: str = "") -> Column:
    """A number or its text within RANGES[kind]; the default for what is no number. whole: "round" (half to even) or "cut"."""
    least, most, default = RANGES[kind]
    number = F.coalesce(value.try_cast("double"), F.lit(default))
    number = F.least(F.greatest(F.when(F.isnan(number), F.lit(default)).otherwise(number), F.lit(least)), F.lit(most))
    return F.bround(number).cast("long") if whole == "round" else number.cast("long") if whole == "cut" else number


def clamped_crop(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    bound = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    w, h = bound(w, F.lit(MIN_CROP), F.lit(1.0)), bound(h, F.lit(MIN_CROP), F.lit(1.0))
    return bound(x, F.lit(0.0), 1 - w), bound(y, F.lit(0.0), 1 - h), w, h


def normal_choice(value: Column, setting: str) -> Column:
    """value if it is among the setting's choices, else the first of them."""
    return F.when(value.isin(*ENUMS[setting]), value).otherwise(F.lit(ENUMS[setting][0]))


def normal_meta(name: Column, category: Column, tags: Column, path: Column) -> tuple[Column, Column, Column]:
    """(name, category, tags): trimmed and defaulted; tags: comma-separated text to a list without empty ones."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    split = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.coalesce(blank(name), F.nullif(stem(path), F.lit("")), F.lit("Untitled")), F.lower(F.coalesce(blank(category), F.lit("general"))), split


def search_presets(catalogue: DataFrame, needle: str = "", category: str = "all") -> DataFrame:
    """The presets of a category in whose name, category, tags or file name the text stands; catalogue: name, category, tags, path."""
    text = F.lower(F.concat_ws(" ", "name", "category", F.array_join("tags", " "), F.regexp_extract("path", "([^/]*)$", 1)))
    out = catalogue if category == "all" else catalogue.where(F.col("category") == category)
    return out.where(F.contains(text, F.lit(needle.strip().lower()))) if needle.strip() else out


def layer_order(order: Column) -> Column:
    """The known layers as given, repeats too, and then the missing ones in the default order; the default for none."""
    default = F.array(*map(F.lit, LAYER_ORDER))
    known = F.filter(F.coalesce(order, F.array().cast("array<string>")), lambda x: F.array_contains(default, x))
    return F.when(F.size(known) == 0, default).otherwise(F.concat(known, F.array_except(default, known)))


def active_layers(presets: DataFrame, mask_stats: DataFrame) -> DataFrame:
    """(preset_id, image_id, seq, layer, opacity) of the layers that will run.

    presets: preset_id, image_id, layer_order, options (map by layer: enabled, opacity). A layer runs if it
    is enabled, has opacity, and its mask (mask_stats: image_id, layer, max) is above 0.01 somewhere.
    """
    each = presets.select("preset_id", "image_id", "options", F.posexplode(layer_order(F.col("layer_order"))).alias("seq", "layer"))
    option = F.element_at("options", F.col("layer"))
    share = F.least(F.greatest(F.coalesce(option.opacity, F.lit(100.0)) / 100, F.lit(0.0)), F.lit(1.0))
    running = each.withColumn("opacity", share).where(F.coalesce(option.enabled, F.lit(True)) & (F.col("opacity") > 0))
    return running.join(mask_stats.where(F.col("max") > 0.01).select("image_id", "layer"), ["image_id", "layer"], "left_semi").select("preset_id", "image_id", "seq", "layer", "opacity")


def is_identity(curve: Column, mixer: Column, gains: Column, crop: Column) -> Column:
    """Whether a preset changes nothing: curve array<struct<x, y>>, mixer array<int>, gains and crop array<double>."""
    straight = (F.size(curve) == 2) & (F.get(curve, F.lit(0)).y == 0) & (F.get(curve, F.lit(1)).y == 1)
    neutral = F.forall(gains, lambda v: F.abs(v - 1) < 1e-4)
    whole = F.forall(F.zip_with(crop, F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), lambda a, b: F.abs(a - b)), lambda d: d < 1e-6)
    return straight & F.forall(mixer, lambda v: v == 0) & neutral & whole


def facets(catalogue: DataFrame) -> DataFrame:
    """place, category, n: "all" first, then the categories by name."""
    each = catalogue.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    every = catalogue.agg(F.lit("all").alias("category"), F.count(F.lit(1)).alias("n")).withColumn("place", F.lit(0))
    return every.unionByName(each.withColumn("place", F.lit(1))).orderBy("place", "category")


def layer_sets(a: Column, b: Column) -> tuple[Column, Column]:
    """(union, difference) of two lists of layers, without repeats, in order."""
    return F.array_union(a, b), F.array_except(a, b)
