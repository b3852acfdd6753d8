"""Operators on pixel tables (image_id, y, x, r, g, b): statistics, geometry, look-up tables and comparisons."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelframe.functions import color
from pixelframe.functions.color import clip
from pixelframe.sources.shared import cut

CHANNELS = ("red", "green", "blue", "luma")


def level(v: Column) -> Column:
    """8-bit level as histograms have it, rounded half to even."""
    return color.half_even(clip(v) * 255).cast("int")


def _levels(pixels: DataFrame) -> DataFrame:
    q = pixels.select("image_id", *[level(F.col(c)).alias(c) for c in "rgb"])
    y = F.bround(F.col("r") * color.LUMA[0] + F.col("g") * color.LUMA[1] + F.col("b") * color.LUMA[2])
    return q.withColumn("y", clip(y, 0.0, 255.0).cast("int"))


def _bins(pixels: DataFrame, channels: dict[str, str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("channel"), F.col(c).alias("bin")) for name, c in channels.items()]))
    return _levels(pixels).select("image_id", each.alias("s")).groupBy("image_id", "s.channel", "s.bin").agg(F.count(F.lit(1)).alias("n"))


def histogram(pixels: DataFrame, channels: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """image_id, channel, bin, n for all 256 bins. The counts are packed by image and channel, and unpacked densely: no join."""
    columns = dict(zip(CHANNELS, "rgby"))
    counts = _bins(pixels, {c: columns[c] for c in channels}).groupBy("image_id", "channel").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    dense = counts.select("image_id", "channel", "m", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"))
    return dense.select("image_id", "channel", "bin", F.coalesce(F.element_at("m", F.col("bin")), F.lit(0)).alias("n"))


def clip_fractions(pixels: DataFrame) -> DataFrame:
    """By image, the shares of level 0 (shadow) and 255 (highlight) of each channel and of luma."""
    share = lambda c, v: F.avg(F.when(F.col(c) == v, 1.0).otherwise(0.0))
    return _levels(pixels).groupBy("image_id").agg(*[share(c, v).alias(f"{name}_{kind}") for name, c in zip(CHANNELS, "rgby") for kind, v in (("shadow", 0), ("highlight", 255))])


def gray_world(pixels: DataFrame) -> DataFrame:
    """By image, the gains that make the mean of linear light neutral."""
    means = pixels.groupBy("image_id").agg(*[F.avg(color.srgb_to_linear(F.col(c))).alias(c) for c in "rgb"])
    return means.select("image_id", *[v.alias(f"gain_{c}") for c, v in zip("rgb", color.neutral_gains(F.col("r"), F.col("g"), F.col("b")))])


#: Bins of one round of quantiles.
BINS = 4096


def quantiles(values: DataFrame, share: float) -> DataFrame:
    """(image_id, channel, value): the exact quantile of each channel's values (image_id, channel, v), mixed linearly between its two neighbours in rank.

    Values are counted in BINS bins between 0 and 1, those beyond in the first and last; of the bins that hold the two ranks, the span from their
    least to their greatest value is cut into bins again, until it is one value. So a group's state is its bins, however many
    values it has; 8-bit sources take one round. Nulls don't count.
    """
    group = ["image_id", "channel"]

    def counted(rows: DataFrame, keys: list[str], low: Column, high: Column, *more: str) -> DataFrame:
        """By bin, how many values it has, its ends, and how many are in the bins before it."""
        at = F.floor(clip((F.col("v") - low) / (high - low)) * BINS).cast("int")
        bins = rows.groupBy(*keys, *more, F.least(at, F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy(*keys)
        return bins.withColumns({"before": F.sum("n").over(w.orderBy("bin")) - F.col("n"), "total": F.sum("n").over(w)})

    values = values.where("v IS NOT NULL")
    bins = counted(values, group, F.lit(0.0), F.lit(1.0))
    place = (F.col("total") - 1) * F.lit(share)
    first = F.floor(place).cast("long")
    ranks = F.array(F.struct(first.alias("rank"), (1 - (place - first)).alias("weight")), F.struct((first + 1).alias("rank"), (place - first).alias("weight")))
    found = bins.withColumn("r", F.explode(ranks)).select(*group, "r.rank", "r.weight", "before", "n", "low", "high").where("rank >= before AND rank < before + n")
    found = cut(found.select(*group, "weight", F.monotonically_increasing_id().alias("target"), (F.col("rank") - F.col("before")).alias("rank"), "low", "high"))
    done = []
    while True:
        done.append(found.where("low = high").select(*group, "weight", F.col("low").alias("value")))
        open_ = found.where("low < high")
        if open_.isEmpty():
            break
        inside = values.join(open_.withColumnsRenamed({"low": "from", "high": "to"}), group).where("v BETWEEN from AND to")
        bins = counted(inside, ["target"], F.col("from"), F.col("to"), *group, "weight", "rank", "from", "to").where("rank >= before AND rank < before + n")
        found = cut(bins.select(*group, "weight", "target", (F.col("rank") - F.col("before")).alias("rank"), "low", "high"))
    every = done[0]
    for x in done[1:]:
        every = every.union(x)
    return every.groupBy(*group).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))


def white_patch(pixels: DataFrame, share: float = 0.99, accuracy: int | None = None) -> DataFrame:
    """By image, the gains that bring each channel's percentile of linear light to the highest. accuracy: approximate, for huge images."""
    if accuracy:
        tops = pixels.groupBy("image_id").agg(*[F.percentile_approx(color.srgb_to_linear(F.col(c)), share, accuracy).alias(c) for c in "rgb"])
    else:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), color.srgb_to_linear(F.col(c)).alias("v")) for c in "rgb"])).alias("s")
        found = quantiles(pixels.select("image_id", each).select("image_id", "s.*"), share)
        tops = found.groupBy("image_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in "rgb"])
    tops = tops.select("image_id", *[F.greatest(c, F.lit(color.EPS)).alias(c) for c in "rgb"])
    most = F.greatest("r", "g", "b")
    return tops.select("image_id", *[clip(most / F.col(c), 0.25, 4.0).alias(f"gain_{c}") for c in "rgb"])


def sizes(pixels: DataFrame) -> DataFrame:
    """image_id, width, height."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def neutral_sample(pixels: DataFrame, picks: DataFrame, radius: int = 2) -> DataFrame:
    """By pick (pick_id, image_id, px, py): the mean of its neighbourhood and the (Kelvin, tint) that make it neutral."""
    near = pixels.join(picks, "image_id").where((F.abs(F.col("x") - F.col("px")) <= radius) & (F.abs(F.col("y") - F.col("py")) <= radius))
    means = near.groupBy("pick_id", "image_id").agg(*[F.avg(c).alias(c) for c in "rgb"])
    gains = color.neutral_gains(*[color.srgb_to_linear(F.col(c)) for c in "rgb"])
    means = means.withColumns({f"_{c}": v for c, v in zip("rgb", gains)})
    kelvin, tint = color.kelvin_tint_of(F.col("_r"), F.col("_g"), F.col("_b"))
    return means.select("pick_id", "image_id", "r", "g", "b", kelvin.alias("temp_k"), tint.alias("tint"))


def crop(pixels: DataFrame, dims: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The pixels inside a normalised box (x, y, w, h), with places counted from its corner; bounds round half to even, at least one pixel."""
    cx, cy, cw, ch = (F.lit(float(v)) for v in box)
    d = dims
    x0 = F.greatest(F.lit(0), F.least(F.col("width") - 1, F.bround(cx * F.col("width")).cast("int")))
    y0 = F.greatest(F.lit(0), F.least(F.col("height") - 1, F.bround(cy * F.col("height")).cast("int")))
    d = d.withColumn("x0", x0).withColumn("y0", y0)
    d = d.withColumn("x1", F.greatest(F.col("x0") + 1, F.least(F.col("width"), F.bround((cx + cw) * F.col("width")).cast("int"))))
    d = d.withColumn("y1", F.greatest(F.col("y0") + 1, F.least(F.col("height"), F.bround((cy + ch) * F.col("height")).cast("int"))))
    inside = pixels.join(d, "image_id").where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    return inside.select("image_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "r", "g", "b")


def flip(pixels: DataFrame, dims: DataFrame, horizontal: bool = True, vertical: bool = False) -> DataFrame:
    d = pixels.join(dims, "image_id")
    x = F.col("width") - 1 - F.col("x") if horizontal else F.col("x")
    y = F.col("height") - 1 - F.col("y") if vertical else F.col("y")
    return d.select("image_id", y.alias("y"), x.alias("x"), "r", "g", "b")


def aspect_crop(dims: DataFrame, aspect: float, floor: float = 0.05) -> DataFrame:
    """By image, the largest centred box (normalised) of an aspect ratio; the whole frame for none."""
    frame = F.col("width") / F.col("height")
    w = clip(F.when(F.lit(aspect) >= frame, F.lit(1.0)).otherwise(aspect / frame), floor, 1.0)
    h = clip(F.when(F.lit(aspect) >= frame, frame / aspect).otherwise(F.lit(1.0)), floor, 1.0)
    if aspect <= 0:
        w = h = F.lit(1.0)
    return dims.select("image_id", ((1 - w) / 2).alias("x"), ((1 - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


# The colours of skin.
SKIN = [("hsv", {"h": (0, 25), "s": (20, 255), "v": (60, 255)}), ("hsv", {"h": (0, 20), "s": (10, 180), "v": (40, 200)}), ("ycrcb", {"y": (0, 255), "cr": (133, 173), "cb": (77, 127)})]


def color_range_mask(pixels: DataFrame, ranges=tuple(SKIN)) -> DataFrame:
    """image_id, y, x, v: 1 where the colour is in one of the ranges, else 0."""
    q = [color.quantize(F.col(c)) for c in "rgb"]
    spaces = pixels.withColumn("_hsv", color.rgb_to_hsv8(*q)).withColumn("_ycrcb", color.rgb_to_ycrcb8(*q))
    return spaces.select("image_id", "y", "x", F.when(color.in_ranges(spaces, list(ranges)), 1.0).otherwise(0.0).alias("v"))


def apply_presets(pixels: DataFrame, presets: DataFrame, work: DataFrame) -> DataFrame:
    """The pixels of each image under each preset (preset_id, exposure in %) that work (preset_id, image_id) orders for it.

    Presets are joined to the work list, and that to the pixels by image; how many there are doesn't matter.
    """
    factors = presets.select("preset_id", F.pow(F.lit(2.0), F.col("exposure") / 100).alias("_k"))
    both = pixels.join(work.select("preset_id", "image_id").distinct().join(factors, "preset_id"), "image_id")
    return both.select("preset_id", "image_id", "y", "x", *[clip(F.col(c) * F.col("_k")).alias(c) for c in "rgb"])


def lut1d_lookup(pixels: DataFrame, luts: DataFrame) -> DataFrame:
    """Each channel's entry, by its level cut off, in its image's LUT (image_id, lut array<double> of 256)."""
    joined = pixels.join(luts, "image_id")
    return joined.select("image_id", "y", "x", *[F.element_at("lut", (color.quantize(F.col(c)) + 1).cast("int")).alias(c) for c in "rgb"])


def lut3d_trilinear(pixels: DataFrame, luts: DataFrame, domain: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Pixels (with lut_id) through 3-D LUTs (lut_id, size, ri, gi, bi, r, g, b), mixed from the 8 lattice corners around each colour.

    The corners are looked up in the LUT packed as one array, which is joined once by lut_id.
    """
    packed = luts.groupBy("lut_id", "size").agg(F.array_sort(F.collect_list(F.struct("ri", "gi", "bi", F.array("r", "g", "b").alias("c")))).alias("cells"))
    at = {c: clip((F.col(c) - domain[0]) / max(domain[1] - domain[0], 1e-6)) * (F.col("size") - 1) for c in "rgb"}
    df = pixels.join(packed, "lut_id").withColumns({f"_{c}": v for c, v in at.items()})
    df = df.withColumns({f"_{c}0": F.floor(f"_{c}") for c in "rgb"}).withColumns({f"_{c}d": F.col(f"_{c}") - F.floor(f"_{c}") for c in "rgb"})
    total = [F.lit(0.0)] * 3
    for corner in product((0, 1), repeat=3):
        place, weight = F.lit(0), F.lit(1.0)
        for c, up in zip("rgb", corner):
            place = place * F.col("size") + F.least(F.col(f"_{c}0") + up, F.col("size") - 1)
            weight = weight * (F.col(f"_{c}d") if up else 1 - F.col(f"_{c}d"))
        cell = F.get(F.col("cells"), place.cast("int")).c
        total = [t + weight * F.get(cell, F.lit(k)) for k, t in enumerate(total)]
    return df.select("image_id", "y", "x", *[clip(t).alias(c) for c, t in zip("rgb", total)])


def compare_split(original: DataFrame, edited: DataFrame, dims: DataFrame, position: float) -> DataFrame:
    """The original left of a share of the width (half-even), the edited image right of it."""
    at = F.least(F.greatest(F.bround(position * F.col("width")), F.lit(0)), F.col("width"))
    both = original.alias("o").join(edited.alias("e"), ["image_id", "y", "x"]).join(dims.select("image_id", at.alias("_at")), "image_id")
    return both.select("image_id", "y", "x", *[F.when(F.col("x") < F.col("_at"), F.col(f"o.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in "rgb"])


def edge_guard(pixels: DataFrame, strength: float = 2.5) -> DataFrame:
    """image_id, y, x, v: 1 less strength times the gradient of luma, whose differences across the border are 0."""
    y = pixels.select("image_id", "y", "x", color.luma(F.col("r"), F.col("g"), F.col("b")).alias("l"))
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    across = lambda w: F.coalesce((F.lead("l").over(w) - F.lag("l").over(w)) * 0.5, F.lit(0.0))
    y = y.withColumn("gx", across(row)).withColumn("gy", across(column))
    return y.select("image_id", "y", "x", clip(1 - F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) * strength).alias("v"))
