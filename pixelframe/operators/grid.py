"""Neighbourhood operators on planes (image_id, y, x, v): smoothing, morphology, components, resampling.

A separable filter of one plane packs each row in an array, filters it in Arrow batches and unpacks it, and then does
the same with columns: two shuffles, no join. Wide filters, filters of several columns, morphology and components go tile by tile
(operators.tiles): one shuffle, in which cells near an edge are sent twice. Filters of columns that follow each other (smooth_dealt,
contrast_dealt) share one.
"""

from __future__ import annotations

from functools import partial
from math import exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.color import clip
from pixelframe.operators import tiles
from pixelframe.sources.shared import cut

CELLS = ("image_id", "y", "x")
#: Up to this radius a kernel is applied to packed lines; wider ones are applied tile by tile.
WRITTEN_OUT = 12


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights that sum to 1, of odd size about 6 sigma, at least 3."""
    radius = max(3, round(sigma * 6) | 1) // 2
    raw = [exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def _along(plane: DataFrame, axis: str, f, by: tuple[str, ...]) -> DataFrame:
    """f of each line's values (array ordered by axis)."""
    other = "y" if axis == "x" else "x"
    lines = plane.groupBy(*by, other).agg(F.array_sort(F.collect_list(F.struct(axis, "v"))).alias("s"))
    values = lines.select(*by, other, F.transform("s", lambda c: c[axis]).alias(axis), F.transform("s", lambda c: c["v"]).alias("v"))
    done = values.select(*by, other, F.explode(F.arrays_zip(axis, f(F.col("v")).alias("v"))).alias("z"))
    return done.select(*by, other, F.col(f"z.{axis}").alias(axis), F.col("z.v").alias("v"))


def _filtered(values: np.ndarray, lengths: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """Lines that lie one after the other, each filtered by weights and mirrored at its ends, ends included, as often as needed."""
    out, starts, radius = np.empty(len(values)), np.cumsum(lengths) - lengths, len(weights) // 2
    for n in np.unique(lengths[lengths > 0]):  # lines of one length together
        at = starts[lengths == n][:, None] + np.arange(n)
        line = np.pad(values[at], ((0, 0), (radius, radius)), "symmetric")
        out[at] = sum(w * line[:, k : k + n] for k, w in enumerate(weights))
    return out


def _slope(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Central differences of lines that lie one after the other; those across an end, or with what isn't there, are 0."""
    out = np.zeros(len(values))
    out[1:-1] = (values[2:] - values[:-2]) * 0.5
    last = np.cumsum(lengths) - 1
    out[last] = out[last - lengths + 1] = 0.0
    return np.where(np.isnan(out), 0.0, out)


def _convolved(weights: list[float]):
    w = tuple(weights)

    def f(lines: pa.Array) -> pa.Array:
        flat, lengths = lines.flatten(), pc.fill_null(pc.list_value_length(lines), 0).to_numpy()
        out = _filtered(flat.to_numpy(zero_copy_only=False).astype(float), lengths, w)
        # What a null is part of is null.
        lost = _filtered(flat.is_null().to_numpy(zero_copy_only=False).astype(float), lengths, (1.0,) * len(w)) > 0 if flat.null_count else None
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(out, pa.float64(), mask=lost))

    return F.arrow_udf(f, "array<double>")


def gaussian_smooth(plane: DataFrame, sigma: float, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """A plane smoothed by a Gaussian, mirrored at its border. sigma <= 0 changes nothing."""
    if sigma <= 0:
        return plane.select(*by, "y", "x", "v")
    weights = gaussian_kernel(sigma)
    if len(weights) // 2 > WRITTEN_OUT:
        return tiles.by_tile(plane, len(weights) // 2, tiles.convolved(weights), by).select(*by, "y", "x", "v")
    f = _convolved(weights)
    return _along(_along(plane, "x", f, by), "y", f, by).select(*by, "y", "x", "v")


def reach(sigma: float) -> int:
    """Cells that a Gaussian reads to each side."""
    return len(gaussian_kernel(sigma)) // 2


def smooth_dealt(dealt: DataFrame, made: dict[str, tuple[str, float]], by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Rows dealt by tile with the columns of made {name: (column, sigma)}, each a column smoothed. Nothing is shuffled."""
    fs = {sigma: partial(_filtered, weights=tuple(gaussian_kernel(sigma))) for _, sigma in made.values()}
    return tiles.through(dealt, {name: (c, fs[sigma], fs[sigma]) for name, (c, sigma) in made.items()}, by)


def ellipse_offsets(radius: int) -> list[tuple[int, int]]:
    """(dy, dx) of the ellipse inscribed in a square of 2 * radius + 1: in each row, as wide as the half-even rounded chord."""
    out = []
    for dy in range(-radius, radius + 1):
        reach = round(radius * (max(0.0, radius * radius - dy * dy) / (radius * radius)) ** 0.5) if radius else 0
        out += [(dy, dx) for dx in range(-reach, reach + 1)]
    return out


def dilate(plane: DataFrame, radius: int) -> DataFrame:
    """The maximum over an ellipse; cells outside the plane don't count."""
    if radius <= 0:
        return plane.select(*CELLS, "v")
    chords = {dy: dx for dy, dx in ellipse_offsets(radius)}  # of each row, the last is the widest
    return tiles.by_tile(plane, radius, tiles.highest(chords)).select(*CELLS, "v")


def erode(plane: DataFrame, radius: int) -> DataFrame:
    """The minimum over an ellipse; cells outside the plane don't count."""
    if radius <= 0:
        return plane.select(*CELLS, "v")
    return dilate(plane.select(*CELLS, (-F.col("v")).alias("v")), radius).select(*CELLS, (-F.col("v")).alias("v"))


def scaled_radius(value: float, height: int, width: int) -> int:
    return int(min(96, max(1, round(abs(value) * max(1.0, float(min(height, width, 1800))) / 1000))))


def scaled_sigma(value: float, height: int, width: int) -> float:
    return min(72.0, max(0.35, value * max(1.0, float(min(height, width, 1800))) / 1000))


def adjust_mask(plane: DataFrame, height: int, width: int, strength: float = 100.0, feather: float = 0.0, expand: float = 0.0) -> DataFrame:
    """Expand or contract, feather, and scale a mask, in that order; settings below 0.5 do nothing."""
    out = plane.select(*CELLS, clip(F.col("v")).alias("v"))
    if abs(expand) >= 0.5:
        out = (dilate if expand > 0 else erode)(out, scaled_radius(expand, height, width))
    if feather >= 0.5:
        out = gaussian_smooth(out, scaled_sigma(feather, height, width))
    return out.select(*CELLS, clip(F.col("v") * (strength / 100)).alias("v"))


def _gradient(plane: DataFrame) -> DataFrame:
    """The central-difference gradient; differences across the border are 0."""
    across = lambda v: F.transform(v, lambda _, k: F.coalesce((F.get(v, k + 1) - F.when(k > 0, F.get(v, k - 1))) * 0.5, F.lit(0.0)))
    gx, gy = _along(plane, "x", across, ("image_id",)), _along(plane, "y", across, ("image_id",))
    both = gx.select(*CELLS, F.col("v").alias("gx")).join(gy.select(*CELLS, F.col("v").alias("gy")), list(CELLS))
    return both.select(*CELLS, F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("v"))


def guard(plane: DataFrame, strength: float, blur_sigma: float) -> DataFrame:
    """Edge protection: 1 less strength times the smoothed gradient."""
    return gaussian_smooth(_gradient(plane), blur_sigma).select(*CELLS, clip(1 - F.col("v") * strength).alias("v"))


def _planes(**planes: DataFrame) -> DataFrame:
    """The planes side by side, each under its name."""
    out = None
    for name, df in planes.items():
        df = df.select(*CELLS, F.col("v").alias(name))
        out = df if out is None else out.join(df, list(CELLS))
    return out


def _contrasted(a: float, v: Column, fine: Column, coarse: Column, mask: Column) -> Column:
    """Detail of both bands added to v under a mask."""
    wide, near = (0.85, 0.35) if a > 0 else (0.65, 0.20)
    m = clip(mask)
    return clip(v * (1 - m) + clip(v + (fine - coarse) * a * wide + (v - fine) * a * near) * m)


def local_contrast(plane: DataFrame, amount: float, detail_sigma: float = 1.6, base_sigma: float = 6.0, edge_strength: float = 2.2) -> DataFrame:
    """Detail of two scales added (or taken off, for a negative amount in %), less at edges."""
    a = amount / 100
    if a == 0:
        return plane.select(*CELLS, "v")
    mask = gaussian_smooth(guard(plane, edge_strength, 1.0).select(*CELLS, clip(0.35 + F.col("v") * 0.65).alias("v")), 0.8)
    df = _planes(v=plane, fine=gaussian_smooth(plane, detail_sigma), coarse=gaussian_smooth(plane, base_sigma), m=mask)
    return df.select(*CELLS, _contrasted(a, *map(F.col, ("v", "fine", "coarse", "m"))).alias("v"))


def contrast_reach(detail_sigma: float = 1.6, base_sigma: float = 6.0) -> int:
    """Cells that local contrast reads to each side: those of its widest band, or of the guard (a difference, smoothed twice)."""
    return max(reach(detail_sigma), reach(base_sigma), 1 + reach(1.0) + reach(0.8))


def contrast_dealt(dealt: DataFrame, columns: str, amount: float, detail_sigma: float = 1.6, base_sigma: float = 6.0, edge_strength: float = 2.2) -> DataFrame:
    """Rows dealt by tile, with local_contrast of each of columns in its place. Nothing is shuffled."""
    a = amount / 100
    if a == 0:
        return dealt
    fine, coarse = (partial(_filtered, weights=tuple(gaussian_kernel(sigma))) for sigma in (detail_sigma, base_sigma))
    bands = {"fine": (fine, fine), "coarse": (coarse, coarse), "gx": (_slope, None), "gy": (None, _slope)}
    at = lambda k, c: f"_{k}_{c}"
    df = tiles.through(dealt, {at(k, c): (c, *fs) for k, fs in bands.items() for c in columns})
    df = df.withColumns({at("m", c): F.sqrt(F.col(at("gx", c)) * F.col(at("gx", c)) + F.col(at("gy", c)) * F.col(at("gy", c))) for c in columns})
    df = smooth_dealt(df.drop(*[at(k, c) for k in ("gx", "gy") for c in columns]), {at("m", c): (at("m", c), 1.0) for c in columns})
    df = df.withColumns({at("m", c): clip(0.35 + clip(1 - F.col(at("m", c)) * edge_strength) * 0.65) for c in columns})
    df = smooth_dealt(df, {at("m", c): (at("m", c), 0.8) for c in columns})
    df = df.withColumns({c: _contrasted(a, F.col(c), *[F.col(at(k, c)) for k in ("fine", "coarse", "m")]) for c in columns})
    return df.drop(*[at(k, c) for k in ("fine", "coarse", "m") for c in columns])


def detail_blend(plane: DataFrame, low_sigma: float, detail_sigma: float, detail_mix: float, edge_sigma: float = 0.0, edge_weight: float = 0.0) -> DataFrame:
    """A low band plus a share of the detail, and of an edge residual: skin and blemish smoothing, and blur (no detail)."""
    bands = {"v": plane, "low": gaussian_smooth(plane, low_sigma), "mid": gaussian_smooth(plane, detail_sigma)}
    if edge_weight:
        bands["edge"] = gaussian_smooth(plane, edge_sigma)
    df = _planes(**bands)
    out = F.col("low") + (F.col("v") - F.col("mid")) * detail_mix
    return df.select(*CELLS, clip(out + (F.col("v") - F.col("edge")) * edge_weight if edge_weight else out).alias("v"))


def glow(plane: DataFrame, amount: float, sigma: float = 20.0) -> DataFrame:
    df = _planes(v=plane, bloom=gaussian_smooth(plane, sigma))
    return df.select(*CELLS, clip(F.col("v") + F.col("bloom") * (amount / 100 * 0.35)).alias("v"))


def connected_components(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """image_id, y, x, component of set cells (image_id, y, x): the least (y, x) reachable, as a struct.

    Components are found inside each tile first. Only labels of cells at the edges of tiles are linked; they
    spread over the links by rounds with pointer jumping until nothing changes. Every round is cut.
    """
    edge = tiles.EDGE
    found = tiles.by_tile(cells.select(*CELLS).distinct().withColumn("v", F.lit(0.0)), 0, tiles.labelled(diagonal))
    place = F.col("v").cast("long")
    found = cut(found.select(*CELLS, F.struct(F.shiftright(place, 26).cast("int").alias("y"), place.bitwiseAND(F.lit(tiles.WIDE - 1)).cast("int").alias("x")).alias("label")))
    bottom, right = F.pmod("y", F.lit(edge)) == edge - 1, F.pmod("x", F.lit(edge)) == edge - 1
    step = lambda dy, dx: F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
    sides = (-1, 0, 1) if diagonal else (0,)
    over = F.array_distinct(F.concat(F.when(bottom, F.array(*[step(1, d) for d in sides])).otherwise(F.array().cast("array<struct<dy:int,dx:int>>")), F.when(right, F.array(*[step(d, 1) for d in sides])).otherwise(F.array().cast("array<struct<dy:int,dx:int>>"))))
    if diagonal:  # down to the left, over a tile's left edge
        over = F.when(F.pmod("x", F.lit(edge)) == 0, F.array_union(over, F.array(step(1, -1)))).otherwise(over)
    near = found.where(F.size(over) > 0).select("image_id", F.col("label").alias("a"), "y", "x", F.explode(over).alias("o"))
    near = near.select("image_id", "a", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    at_edge = bottom | right | (F.pmod("y", F.lit(edge)) == 0) | (F.pmod("x", F.lit(edge)) == 0)
    links = near.join(found.where(at_edge), list(CELLS)).where("a <> label").select("image_id", "a", F.col("label").alias("b")).distinct()
    links = cut(links.union(links.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    if links.isEmpty():
        return found.withColumnRenamed("label", "component")
    labels = links.select("image_id", F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    while True:
        least = links.join(labels.select("image_id", F.col("id").alias("b"), "label"), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = labels.join(least, ["image_id", "id"]).select("image_id", "id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select("image_id", F.col("id").alias("label"), F.col("label").alias("up"))
        new = cut(moved.join(up, ["image_id", "label"]).select("image_id", "id", "old", F.least("label", "up").alias("label")))
        labels = new.select("image_id", "id", "label")
        if new.where("label < old").isEmpty():
            break
    whole = labels.select("image_id", F.col("id").alias("label"), F.col("label").alias("component"))
    return found.join(whole, ["image_id", "label"], "left").select(*CELLS, F.coalesce("component", "label").alias("component"))


def component_stats(components: DataFrame, min_area: int = 16, keep_largest: int = 0) -> DataFrame:
    """image_id, component, area, kept: areas below min_area go, and all but the keep_largest by area, then component, downwards."""
    from pyspark.sql.window import Window

    areas = components.groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("area"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(F.col("area") >= min_area), F.desc("area"), F.desc("component")))
    kept = F.col("area") >= min_area
    return areas.withColumn("kept", kept & (place <= keep_largest) if keep_largest else kept)


def fill_holes(plane: DataFrame) -> DataFrame:
    """A binary plane in which every 0 that isn't 4-connected with a 0 at (0, 0) becomes 1."""
    zero = connected_components(plane.where("v = 0"), diagonal=False)
    sea = zero.where("component.y = 0 AND component.x = 0").select(*CELLS, F.lit(0.0).alias("sea"))
    return plane.join(sea, list(CELLS), "left").select(*CELLS, F.when((F.col("v") != 0) | F.col("sea").isNull(), 1.0).otherwise(0.0).alias("v"))


def open_close(plane: DataFrame, zone: DataFrame | None = None, close_radius: int = 1, open_radius: int = 0, min_area: int = 16, keep_largest: int = 0, threshold: float = 0.35) -> DataFrame:
    """A region mask made clean: zone, threshold, closing, opening, holes filled, small components left out."""
    work = plane.select(*CELLS, clip(F.col("v")).alias("v"))
    if zone is not None:
        work = work.join(zone.select(*CELLS, clip(F.col("v")).alias("z")), list(CELLS)).select(*CELLS, (F.col("v") * F.col("z")).alias("v"))
    work = work.select(*CELLS, F.when(F.col("v") > threshold, 1.0).otherwise(0.0).alias("v"))
    if close_radius:
        work = erode(dilate(work, close_radius), close_radius)
    if open_radius:
        work = dilate(erode(work, open_radius), open_radius)
    work = cut(fill_holes(work))
    parts = connected_components(work.where("v = 1"))
    kept = parts.join(component_stats(parts, min_area, keep_largest).where("kept"), ["image_id", "component"], "left_semi")
    return work.join(kept.select(*CELLS, F.lit(1.0).alias("k")), list(CELLS), "left").select(*CELLS, F.coalesce("k", F.lit(0.0)).alias("v"))


def downsample(pixels: DataFrame, dims: DataFrame, most: int, columns: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Images whose longer side exceeds most, scaled down to it by area averages; others as they are. dims: image_id, width, height."""
    scale = F.least(F.lit(1.0), most / F.greatest("width", "height"))
    scale = F.when(scale >= 0.999, F.lit(1.0)).otherwise(scale)
    size = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * scale)).cast("int")
    df = pixels.join(dims.select("image_id", "width", "height", size("width").alias("nw"), size("height").alias("nh")), "image_id")

    def shares(at: str, n: str, m: str) -> Column:
        """The target cells that a source cell overlaps, with the overlap's length in target cells."""
        low, high = F.col(at) * F.col(m) / F.col(n), (F.col(at) + 1) * F.col(m) / F.col(n)
        first, last = F.floor(low).cast("int"), F.least(F.ceil(high).cast("int"), F.col(m)) - 1
        return F.transform(F.sequence(first, F.greatest(first, last)), lambda k: F.struct(k.alias("k"), (F.least(high, (k + 1).cast("double")) - F.greatest(low, k.cast("double"))).alias("s")))

    df = df.withColumn("tx", F.explode(shares("x", "width", "nw"))).withColumn("ty", F.explode(shares("y", "height", "nh")))
    weight = F.col("tx.s") * F.col("ty.s")
    sums = [(F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in columns]
    return df.where(weight > 1e-12).groupBy("image_id", F.col("ty.k").alias("y"), F.col("tx.k").alias("x")).agg(*sums)


def mask_resize(plane: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Bilinear scaling with cells aligned at their centres; every target cell mixes its four nearest source cells."""

    def stretched(n: int, m: int):
        def f(v: Column) -> Column:
            def at(k: Column) -> Column:
                pos = clip((k + 0.5) * (n / m) - 0.5, 0.0, n - 1.0)
                low = F.floor(pos).cast("int")
                t = pos - low
                return F.get(v, low) * (1 - t) + F.get(v, F.least(low + 1, F.lit(n - 1))) * t

            return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), at)

        return f

    rows = plane.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("s")).select("image_id", "y", F.posexplode(stretched(width, new_width)(F.transform("s", lambda c: c.v))).alias("x", "v"))
    columns = rows.groupBy("image_id", "x").agg(F.array_sort(F.collect_list(F.struct("y", "v"))).alias("s"))
    return columns.select("image_id", "x", F.posexplode(stretched(height, new_height)(F.transform("s", lambda c: c.v))).alias("y", "v")).select(*CELLS, "v")


def sharpen(plane: DataFrame, factor: float) -> DataFrame:
    """8-bit levels (v) moved away from their 3 x 3 average (centre 5 of 13) by a factor; the border is kept."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(5 if dy == dx == 0 else 1).alias("k")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    spread = plane.select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), "v", F.explode(offsets).alias("o"))
    own = F.max(F.when((F.col("o.dy") == 0) & (F.col("o.dx") == 0), F.col("v")))
    near = spread.groupBy("image_id", (F.col("cy") + F.col("o.dy")).alias("y"), (F.col("cx") + F.col("o.dx")).alias("x")).agg(F.sum(F.col("v") * F.col("o.k")).alias("s"), F.count(F.lit(1)).alias("n"), own.alias("own"))
    smooth = F.when(F.col("n") == 9, F.floor(F.col("s") / 13 + 0.5)).otherwise(F.col("own"))
    return near.where("own IS NOT NULL").select(*CELLS, F.floor(clip(smooth + (F.col("own") - smooth) * factor, 0.0, 255.0) + 0.5).alias("v"))
