"""Colour: Column builders for values, and DataFrame steps that grade the columns r, g, b.

A step that is an identity returns its input. Steps that use hue put it in a column of its own first, so
that it is computed once. 8-bit colour spaces follow their defining formulas, rounded half to even.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import inf, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Luma weights, ranges and the model of white balance, centres of the mixer's hue bands.
LUMA = (0.2126, 0.7152, 0.0722)
MIN_K, MAX_K, NEUTRAL_K, TINT_MAX, TINT_STRENGTH, EPS = 2000, 12000, 6500, 150, 0.5, 1e-4
BANDS = {"red": 0.0, "orange": 30.0, "yellow": 60.0, "green": 120.0, "aqua": 180.0, "blue": 240.0, "purple": 270.0, "magenta": 300.0}
WHITE = (0.950456, 1.0, 1.088754)
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))


def clip(v: Column, least=0.0, most=1.0) -> Column:
    return F.least(F.greatest(v, F.lit(least)), F.lit(most))


def half_even(v: Column) -> Column:
    """A double as a whole number, ties to even. F.bround goes through a decimal made of the number's text for each value; this is one
    instruction. Adding 0 makes -0 a plain 0."""
    return F.rint(v) + F.lit(0.0)


def nine_places(v: Column) -> Column:
    """A double rounded to 9 places, ties away from 0, in doubles: F.round goes through a decimal made of the number's text for each value.

    Numbers from a million up, where such a product has few bits left, and those that aren't finite go through F.round.
    """
    n = F.floor(F.abs(v) * 1e9 + 0.49999999999999994)  # the number before 0.5: the sum of a smaller fraction isn't rounded up
    return F.when(F.abs(v) < 1e6, F.when(v < 0, -n).otherwise(n) / 1e9).otherwise(F.round(v, 9))


def srgb_to_linear(v: Column) -> Column:
    v = clip(v)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    v = clip(v)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def working_to_display(v: Column, transform: str = "srgb", working_space: str = "srgb") -> Column:
    if working_space != "linear" and transform == "srgb":
        return clip(v)
    linear = clip(v) if working_space == "linear" else srgb_to_linear(v)
    if transform in ("gamma22", "gamma18"):
        return F.pow(clip(linear), F.lit(1 / (2.2 if transform == "gamma22" else 1.8)))
    return linear if transform == "linear" else linear_to_srgb(linear)


def display_to_working(v: Column, working_space: str = "srgb") -> Column:
    return srgb_to_linear(v) if working_space == "linear" else clip(v)


def quantize(v: Column) -> Column:
    """To 8 bits, cutting off."""
    return F.floor(clip(v) * 255)


def luma(r: Column, g: Column, b: Column) -> Column:
    return clip(r * LUMA[0] + g * LUMA[1] + b * LUMA[2])


def rgb_to_hsv8(r: Column, g: Column, b: Column) -> Column:
    """struct<h, s, v> of 8-bit values: h 0 to 179, s and v 0 to 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, F.lit(0.0)).when(top == r, 30 * (g - b) / d).when(top == g, 60 + 30 * (b - r) / d).otherwise(120 + 30 * (r - g) / d)
    h = half_even(h)
    s = F.when(top == 0, F.lit(0.0)).otherwise(half_even(255 * d / top))
    return F.struct(F.when(h < 0, h + 180).otherwise(h).cast("double").alias("h"), s.cast("double").alias("s"), top.cast("double").alias("v"))


def hsv8_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """r, g, b in [0, 1], of 8-bit steps."""
    x = h / 30
    k = F.floor(x)
    f, sat = x - k, s / 255
    p, q, t = v * (1 - sat), v * (1 - sat * f), v * (1 - sat * (1 - f))
    k = F.pmod(k, F.lit(6))
    pick = lambda a: half_even(F.element_at(F.array(*a), (k + 1).cast("int"))) / 255
    return [pick(a) for a in ((v, q, p, p, t, v), (t, v, v, q, p, p), (p, p, t, v, v, q))]


def rgb_to_ycrcb8(r: Column, g: Column, b: Column) -> Column:
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return F.struct(half_even(y).alias("y"), half_even(clip((r - y) * 0.713 + 128, 0.0, 255.0)).alias("cr"), half_even(clip((b - y) * 0.564 + 128, 0.0, 255.0)).alias("cb"))


def _cube_root(t: Column) -> Column:
    return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct<l, a, b> of sRGB values in [0, 1]; l 0 to 100."""
    lin = [srgb_to_linear(c) for c in (r, g, b)]
    x, y, z = (sum((m * c for m, c in zip(row, lin)), F.lit(0.0)) / w for row, w in zip(XYZ, WHITE))
    fx, fy, fz = _cube_root(x), _cube_root(y), _cube_root(z)
    return F.struct(F.when(y > 0.008856, 116 * fy - 16).otherwise(903.3 * y).alias("l"), (500 * (fx - fy)).alias("a"), (200 * (fy - fz)).alias("b"))


def rgb_to_lab8(r: Column, g: Column, b: Column) -> Column:
    """8-bit Lab of 8-bit values: l in 0 to 255, a and b offset by 128."""
    lab = rgb_to_lab(r / 255, g / 255, b / 255)
    whole = lambda v: half_even(clip(v, 0.0, 255.0))
    return F.struct(whole(lab.l * 255 / 100).alias("l"), whole(lab.a + 128).alias("a"), whole(lab.b + 128).alias("b"))


def lab8_to_rgb(l8: Column, a8: Column, b8: Column) -> list[Column]:
    """r, g, b in [0, 1], of 8-bit steps."""
    lightness = l8 * 100 / 255
    fy = (lightness + 16) / 116
    y = F.when(lightness > 8, fy * fy * fy).otherwise(lightness / 903.3)
    fy = F.when(lightness > 8, fy).otherwise(7.787 * y + 16 / 116)
    back = lambda f: F.when(f > 0.206893, f * f * f).otherwise((f - 16 / 116) / 7.787)
    xyz = [back(fy + (a8 - 128) / 500) * WHITE[0], y, back(fy - (b8 - 128) / 200) * WHITE[2]]
    return [half_even(linear_to_srgb(sum((m * c for m, c in zip(row, xyz)), F.lit(0.0))) * 255) / 255 for row in RGB]


def blackbody(kelvin: Column) -> list[Column]:
    """Linear r, g, b of a temperature."""
    return [srgb_to_linear(clip(c, 0.0, 255.0) / 255) for c in _black_levels(clip(kelvin.cast("double"), 1000.0, 40000.0) / 100)]


def _black_levels(t: Column) -> tuple[Column, Column, Column]:
    """Levels, not yet clipped, of a temperature in hundreds of Kelvin."""
    red = F.when(t <= 66, F.lit(255.0)).otherwise(329.698727446 * F.pow(t - 60, F.lit(-0.1332047592)))
    green = F.when(t <= 66, 99.4708025861 * F.log(t) - 161.1195681661).otherwise(288.1221695283 * F.pow(t - 60, F.lit(-0.0755148492)))
    blue = F.when(t >= 66, F.lit(255.0)).when(t <= 19, F.lit(0.0)).otherwise(138.5177312231 * F.log(F.greatest(t - 10, F.lit(1.0))) - 305.0447927307)
    return red, green, blue


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _neutral() -> list[float]:
    """blackbody(NEUTRAL_K), as numbers."""
    t = NEUTRAL_K / 100
    levels = 255.0, 99.4708025861 * log(t) - 161.1195681661, 138.5177312231 * log(t - 10) - 305.0447927307
    return [((v / 255 + 0.055) / 1.055) ** 2.4 for v in levels]


def _red_blue(kelvin: Column) -> Column:
    """struct<red, blue>: gains, green being 1."""

    def gains(s: Column) -> Column:
        ref = _neutral()
        green = ref[1] / F.greatest(s.g, F.lit(EPS))
        return F.struct((ref[0] / F.greatest(s.r, F.lit(EPS)) / green).alias("red"), (ref[2] / F.greatest(s.b, F.lit(EPS)) / green).alias("blue"))

    def linear(s: Column) -> Column:
        return F.struct(*[let(clip(s[c], 0.0, 255.0) / 255, srgb_to_linear).alias(c) for c in "rgb"])

    return let(let(clip(kelvin.cast("double"), 1000.0, 40000.0) / 100, lambda t: F.struct(*[v.alias(c) for c, v in zip("rgb", _black_levels(t))])), lambda s: let(linear(s), gains))


def gains_of(kelvin: Column, tint: Column) -> list[Column]:
    """White-balance gains of (Kelvin, tint), both clamped and rounded half to even."""
    s = _red_blue(F.bround(clip(kelvin.cast("double"), float(MIN_K), float(MAX_K))))
    red, blue = s.red, s.blue
    green = 1 - F.bround(clip(tint.cast("double"), float(-TINT_MAX), float(TINT_MAX))) / TINT_MAX * TINT_STRENGTH
    return [clip(v, 0.25, 4.0) for v in (red, green, blue)]


def kelvin_tint_of(r: Column, g: Column, b: Column) -> list[Column]:
    """(Kelvin, tint) whose gains are nearest to given ones: 40 bisections on red against blue, tint from what green is left."""
    r, g, b = (clip(v, 0.25, 4.0) for v in (r, g, b))
    target = r / F.greatest(b, F.lit(EPS))

    def halve(s: Column, _: Column) -> Column:
        def choose(x: Column) -> Column:
            below = x.s.red / F.greatest(x.s.blue, F.lit(EPS)) < target
            return F.struct(F.when(below, x.mid).otherwise(s.lo).alias("lo"), F.when(below, s.hi).otherwise(x.mid).alias("hi"))

        return let((s.lo + s.hi) / 2, lambda mid: let(F.struct(mid.alias("mid"), _red_blue(mid).alias("s")), choose))

    start = F.struct(F.lit(float(MIN_K)).alias("lo"), F.lit(float(MAX_K)).alias("hi"))
    kelvin = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda s: (s.lo + s.hi) / 2)

    def tint_at(s: Column) -> Column:
        scale = F.sqrt(F.greatest(F.lit(EPS), s.red / F.greatest(r, F.lit(EPS)) * (s.blue / F.greatest(b, F.lit(EPS)))))
        return (1 - scale * g) / TINT_STRENGTH * TINT_MAX

    both = let(kelvin, lambda k: F.struct(F.bround(clip(k, float(MIN_K), float(MAX_K))).cast("long").alias("k"), F.bround(clip(let(_red_blue(k), tint_at), float(-TINT_MAX), float(TINT_MAX))).cast("long").alias("t")))
    return [both.k, both.t]


def neutral_gains(r: Column, g: Column, b: Column) -> list[Column]:
    """Gains that make linear r, g, b neutral at equal brightness."""
    each = [F.greatest(v, F.lit(EPS)) for v in (r, g, b)]
    target = (each[0] + each[1] + each[2]) / 3
    return [clip(target / v, 0.25, 4.0) for v in each]


def _rgb(df: DataFrame, values: list[Column]) -> DataFrame:
    return df.withColumns(dict(zip("rgb", values)))


def _each(df: DataFrame, f) -> DataFrame:
    return _rgb(df, [f(F.col(c)) for c in "rgb"])


def _apart(df: DataFrame) -> DataFrame:
    """df as it is, the steps so far being generated code of their own: the JVM doesn't compile methods of more than 8,000 bytes, which a
    chain of steps soon has. A lambda isn't generated code, so what comes after it is a new method."""
    return df.withColumn("r", let(F.col("r"), lambda v: v))


def exposure(df: DataFrame, ev_percent: float) -> DataFrame:
    return _each(df, lambda v: clip(v * 2 ** (ev_percent / 100)))


def apply_gains(df: DataFrame, gains: list[Column] | tuple[float, float, float]) -> DataFrame:
    """Gains in linear light. Fixed gains of 1 change nothing."""
    if not any(isinstance(v, Column) for v in gains):
        gains = [min(4.0, max(0.25, float(v))) for v in gains]
        if all(abs(v - 1) < 1e-4 for v in gains):
            return df
    return _rgb(df, [linear_to_srgb(clip(srgb_to_linear(F.col(c)) * k)) for c, k in zip("rgb", gains)])


def with_hsv(df: DataFrame) -> DataFrame:
    return df.withColumn("_hsv", rgb_to_hsv8(*[quantize(F.col(c)) for c in "rgb"]))


def _from_hsv(df: DataFrame, h: Column, s: Column, v: Column) -> DataFrame:
    """h, s, v are cut to whole numbers."""
    out = df.withColumn("_to", F.struct(F.floor(h).alias("h"), F.floor(s).alias("s"), F.floor(v).alias("v")))
    return _apart(_rgb(out, hsv8_to_rgb(F.col("_to.h"), F.col("_to.s"), F.col("_to.v"))).drop("_hsv", "_to"))




def _parts() -> tuple[Column, Column, Column]:
    return F.col("_hsv.h"), F.col("_hsv.s"), F.col("_hsv.v")


def saturation(df: DataFrame, delta: float) -> DataFrame:
    if delta == 0:
        return df
    df, (h, s, v) = with_hsv(df), _parts()
    return _from_hsv(df, h, clip(s * (1 + delta / 100), 0.0, 255.0), v)


def hue_shift(df: DataFrame, delta: float) -> DataFrame:
    if delta == 0:
        return df
    df, (h, s, v) = with_hsv(df), _parts()
    return _from_hsv(df, F.pmod(h + delta * 0.9, F.lit(180.0)), s, v)


def warmth(df: DataFrame, delta: float) -> DataFrame:
    """Warmer or cooler around hue 18, more for saturated mid tones."""
    if delta == 0:
        return df
    w = delta / 100
    df, (h, s, v) = with_hsv(df), _parts()
    away = F.abs(h - 18)
    focus = clip(1 - F.least(away, 180 - away) / 48) * clip(s / 255, 0.15, 1.0) * clip(1 - F.abs(v / 255 - 0.58) * 1.6, 0.25, 1.0)
    df = df.withColumn("_w", clip(focus))
    k = F.col("_w")
    out = _from_hsv(df, F.pmod(h - 6 * w * k, F.lit(180.0)), clip(s * (1 + 0.10 * w * k) * (1 + 0.04 * w), 0.0, 255.0), clip(v * (1 + 0.05 * w * k), 0.0, 255.0))
    return out.drop("_w")


def tint(df: DataFrame, delta: float) -> DataFrame:
    """Green to magenta in Lab, more for colourful mid tones."""
    if delta == 0:
        return df
    r, g, b = (clip(F.col(c)) for c in "rgb")
    mean = (r + g + b) / 3
    spread = F.sqrt(((r - mean) * (r - mean) + (g - mean) * (g - mean) + (b - mean) * (b - mean)) / 3)
    df = df.withColumn("_lab", rgb_to_lab8(*[quantize(F.col(c)) for c in "rgb"])).withColumn("_sd", spread)
    weight = clip(clip(F.col("_sd") * 4, 0.12, 1.0) * clip(1 - F.abs(F.col("_lab.l") / 255 - 0.55) * 1.4, 0.25, 1.0))
    df = df.withColumn("_a", F.floor(clip(F.col("_lab.a") + delta / 100 * 9 * weight, 0.0, 255.0)))
    return _rgb(df, lab8_to_rgb(F.col("_lab.l"), F.col("_a"), F.col("_lab.b"))).drop("_lab", "_sd", "_a")


def band_lut(blacks: float, shadows: float, midtones: float, highlights: float, whites: float) -> list[float]:
    """256 entries of the piecewise linear curve through six knots."""
    unit = lambda v: max(0.0, min(1.0, v))
    y = [max(0.0, blacks / 100), unit(0.1 + shadows / 200), unit(0.3 + midtones / 200), unit(0.7 + highlights / 200), unit(0.9 + whites / 200), min(1.0, 1 + whites / 400)]
    return [float(v) for v in np.interp(np.linspace(0, 1, 256), [0.0, 0.1, 0.3, 0.7, 0.9, 1.0], y)]


def normal_curve(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Points clamped and sorted by x, the ends moved to x 0 and 1, inner ones closer than 0.001 to a neighbour left out; a straight line for fewer than two."""
    try:
        each = sorted(((min(1.0, max(0.0, float(x))), min(1.0, max(0.0, float(y)))) for x, y in points), key=lambda p: p[0])
    except (TypeError, ValueError):
        each = []
    if len(each) < 2:
        return [(0.0, 0.0), (1.0, 1.0)]
    out, last = [(0.0, each[0][1])], (1.0, each[-1][1])
    for x, y in each[1:-1]:
        if x - out[-1][0] > 1e-3 and 1 - x > 1e-3:
            out.append((x, y))
    return [*out, last]


def curve_lut(points: list[tuple[float, float]], size: int = 256) -> list[float]:
    """A monotone cubic through the points, sampled at equal steps; for one curve. curve_luts makes many on Spark."""
    pts = normal_curve(points)
    x, y = np.array(pts).T
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    slope = np.concatenate([d[:1], np.zeros(len(pts) - 2), d[-1:]])
    for k in range(1, len(pts) - 1):
        if d[k - 1] * d[k] > 0:
            a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            slope[k] = (a + b) / (a / d[k - 1] + b / d[k])
    at = np.linspace(0, 1, size)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(pts) - 2)
    t = (at - x[k]) / h[k]
    value = (2 * t**3 - 3 * t**2 + 1) * y[k] + (t**3 - 2 * t**2 + t) * h[k] * slope[k] + (3 * t**2 - 2 * t**3) * y[k + 1] + (t**3 - t**2) * h[k] * slope[k + 1]
    return [float(v) for v in np.clip(value, 0, 1)]


def look_up(lut: list[float], v: Column) -> Column:
    """The entry at a value's 8-bit level, from a literal array."""
    return F.element_at(F.lit(lut), (quantize(v) + 1).cast("int"))


def apply_lut(df: DataFrame, lut: list[float]) -> DataFrame:
    """A tone curve with the colours' relations kept: 85 % by the gain of luma, 15 % by channel."""
    df = _each(df, clip).withColumn("_y", luma(F.col("r"), F.col("g"), F.col("b")))
    df = df.withColumn("_gain", look_up(lut, F.col("_y")) / F.greatest(F.col("_y"), F.lit(1e-4)))
    return _each(df, lambda v: clip(v * F.col("_gain") * 0.85 + look_up(lut, v) * 0.15)).drop("_y", "_gain")


def band_tone(df: DataFrame, blacks=0, shadows=0, midtones=0, highlights=0, whites=0) -> DataFrame:
    return apply_lut(df, band_lut(blacks, shadows, midtones, highlights, whites))


def apply_curve(df: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    return df if normal_curve(points) == [(0.0, 0.0), (1.0, 1.0)] else apply_lut(df, curve_lut(points))


def color_mixer(df: DataFrame, bands: dict[str, dict[str, int]]) -> DataFrame:
    """Hue, saturation and luminance by hue band: weights fall off as a raised cosine over 45 degrees, and below a saturation of 0.15."""
    used = {k: v for k, v in bands.items() if k in BANDS and any(v.get(p) for p in ("hue", "sat", "lum"))}
    if not used:
        return df
    df, (h, s, v) = with_hsv(df), _parts()
    gate = clip(s / 255 / 0.15)
    sums = {p: F.lit(0.0) for p in ("hue", "sat", "lum")}
    for name, change in used.items():
        away = F.abs(h * 2 - BANDS[name])
        away = F.least(away, 360 - away)
        weight = F.when(away < 45, 0.5 * (1 + F.cos(F.lit(np.pi) * away / 45))).otherwise(F.lit(0.0)) * gate
        for p, scale in (("hue", 0.30), ("sat", 0.01), ("lum", 0.01)):
            if change.get(p):
                sums[p] = sums[p] + weight * float(change[p]) * scale
    df = df.withColumn("_mix", F.struct(*[c.alias(p) for p, c in sums.items()]))
    hue = clip(F.pmod(h * 2 + F.col("_mix.hue"), F.lit(360.0)) / 2, 0.0, 179.0)
    return _from_hsv(df, hue, clip(s / 255 * (1 + F.col("_mix.sat"))) * 255, clip(v / 255 * (1 + F.col("_mix.lum") * 0.5)) * 255).drop("_mix")


def vignette(df: DataFrame, amount: float, width: Column, height: Column) -> DataFrame:
    """Darker towards the corners, or brighter for a negative amount (in %). width and height: of the row's image."""
    if amount == 0:
        return df
    dx, dy = (F.col("x") - width / 2) / (width / 2), (F.col("y") - height / 2) / (height / 2)
    mask = 1 - clip(F.sqrt(dx * dx + dy * dy) * abs(amount) / 100)
    df = df.withColumn("_v", 2 - mask if amount < 0 else mask)
    return _each(df, lambda v: clip(v * F.col("_v"))).drop("_v")


def blend(base: Column, layer: Column, mode: str) -> Column:
    if mode == "overlay":
        return clip(F.when(base <= 0.5, 2 * base * layer).otherwise(1 - 2 * (1 - base) * (1 - layer)))
    if mode == "soft_light":
        return clip((1 - 2 * layer) * (base * base) + 2 * layer * base)
    return layer


def confidence(v: Column, power: float = 1.0, floor: float = 0.0) -> Column:
    out = clip(v)
    if floor:
        out = clip((out - floor) / max(1e-6, 1 - floor))
    return clip(F.pow(out, F.lit(float(power)))) if power != 1 else out


# By layer, (power, floor) and the smoothing's sigma of each effect mask; "" for other layers.
PROFILES = {
    "": {"broad": (0.8, 0.0, 1.0), "blend": (1.1, 0.0, 0.8), "detail": (1.7, 0.10, 0.6), "strict": (2.4, 0.18, 0.5)},
    "skin": {"broad": (0.7, 0.0, 1.2), "blend": (0.95, 0.0, 0.9), "detail": (1.5, 0.08, 0.7), "strict": (2.0, 0.14, 0.6)},
    "background": {"broad": (0.65, 0.0, 1.6), "blend": (0.85, 0.0, 1.2), "detail": (1.25, 0.04, 0.9), "strict": (1.7, 0.08, 0.8)},
    "subjects": {"broad": (0.75, 0.0, 1.2), "blend": (0.95, 0.0, 1.0), "detail": (1.4, 0.06, 0.8), "strict": (1.9, 0.12, 0.7)},
    "face": {"broad": (0.75, 0.0, 1.1), "blend": (1.0, 0.0, 0.9), "detail": (1.6, 0.10, 0.7), "strict": (2.1, 0.16, 0.6)},
    "eyes": {"broad": (1.2, 0.06, 0.8), "blend": (1.5, 0.10, 0.7), "detail": (2.1, 0.16, 0.5), "strict": (2.8, 0.22, 0.4)},
    "lips": {"broad": (1.2, 0.06, 0.8), "blend": (1.5, 0.10, 0.7), "detail": (2.1, 0.16, 0.5), "strict": (2.8, 0.22, 0.4)},
    "hair": {"broad": (0.9, 0.03, 1.0), "blend": (1.1, 0.06, 0.9), "detail": (1.8, 0.12, 0.6), "strict": (2.2, 0.16, 0.5)},
}


def profile(layer: str, kind: str) -> tuple[float, float, float]:
    return PROFILES.get(layer, PROFILES[""])[kind]


def effect_mask(v: Column, layer: str, kind: str) -> Column:
    """A mask's confidence curve for a layer's effect, before smoothing."""
    power, floor, _ = profile(layer, kind)
    return confidence(v, power, floor)


def composite_kinds(layer: str, mode: str) -> dict[str, float]:
    """The effect masks that make up a layer's composite mask, and their shares."""
    if mode == "overlay":
        return {"detail" if layer in ("face", "skin", "hair") else "strict": 1.0}
    if mode == "soft_light":
        return {"detail": 1.0} if layer in ("eyes", "lips") else {"blend": 0.7, "broad": 0.3}
    return {"blend": 1.0}


def composite_of(at: Callable[[str], Column], layer: str, mode: str, opacity: float) -> Column:
    """The mask under which a layer is blended, of its effect masks by kind; opacity in [0, 1] acts non-linearly."""
    if opacity <= 0:
        return F.lit(0.0)
    base = reduce(lambda a, b: a + b, [at(k) if share == 1 else at(k) * share for k, share in composite_kinds(layer, mode).items()])
    if opacity >= 0.999:
        return clip(base)
    return clip(confidence(base, 1 + (1 - opacity) * 1.6, max(0.0, 0.25 - opacity * 0.20)) * opacity)


def composite_mask(v: Column, layer: str, mode: str, opacity: float) -> Column:
    """composite_of effect masks before smoothing."""
    return composite_of(lambda kind: effect_mask(v, layer, kind), layer, mode, opacity)


def in_ranges(df: DataFrame, ranges: list[tuple[str, dict[str, tuple[float, float]]]]) -> Column:
    """Whether a row's colour lies in one of the ranges: ("hsv" or "ycrcb", {part: (least, most)}). df needs _hsv and _ycrcb columns."""
    hit = F.lit(False)
    for space, parts in ranges:
        inside = F.lit(True)
        for part, (least, most) in parts.items():
            inside = inside & F.col(f"_{space}.{part}").between(least, most if most != inf else 255)
        hit = hit | inside
    return hit
