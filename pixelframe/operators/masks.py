"""Operators on soft masks (image_id, layer, y, x, v), class scores and detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelframe.functions import color
from pixelframe.functions.color import clip
from pixelframe.operators import grid, nearest, tiles

# The classes of each region, the zones of a face box (centre and radii in box units), and weights of features.
REGIONS = {"face": tuple(range(1, 14)), "skin": (1,), "brows": (2, 3), "eyes": (4, 5), "lips": (11, 12, 13), "hair": (17,)}
ZONES = {"face": (0.5, 0.5, 0.64, 0.74), "skin": (0.5, 0.55, 0.55, 0.62), "eye_band": (0.5, 0.36, 0.52, 0.17), "left_eye": (0.33, 0.36, 0.16, 0.10), "right_eye": (0.67, 0.36, 0.16, 0.10), "lips": (0.5, 0.76, 0.24, 0.12), "hair": (0.5, 0.15, 0.95, 0.65)}
FEATURES = {"face": 1.0, "skin": 0.9, "hair": 0.95, "eyes": 0.55, "lips": 0.55}
# The parts of the body below a face's box (centre and radii in box units), and their weights.
BODY = {"body": (0.5, 2.05, 1.35, 2.75), "shoulders": (0.5, 1.28, 1.55, 0.88), "torso": (0.5, 1.85, 1.18, 1.75)}
BODY_WEIGHTS = {"body": 0.55, "shoulders": 0.75, "torso": 0.85}
CELLS = ("image_id", "y", "x")


def mask_stats(masks: DataFrame, by: tuple[str, ...] = ("image_id", "layer")) -> DataFrame:
    """Mean, max and the percentages of cells above 0.10 and 0.50, over all cells."""
    v = clip(F.col("v"))
    over = lambda t: F.avg(F.when(v > t, 1.0).otherwise(0.0)) * 100
    return masks.groupBy(*by).agg(F.avg(v).alias("mean"), F.max(v).alias("max"), over(0.10).alias("over_10"), over(0.50).alias("over_50"))


def mask_bbox(masks: DataFrame, threshold: float = 0.10, by: tuple[str, ...] = ("image_id", "layer")) -> DataFrame:
    """The box of cells above the threshold, its ends exclusive; nulls where there is none."""
    hit = clip(F.col("v")) > threshold
    only = lambda c: F.when(hit, F.col(c))
    return masks.groupBy(*by).agg(F.min(only("x")).alias("x1"), F.min(only("y")).alias("y1"), (F.max(only("x")) + 1).alias("x2"), (F.max(only("y")) + 1).alias("y2"))


def mask_union(masks: DataFrame, by: tuple[str, ...] = ("image_id", "layer")) -> DataFrame:
    """The cellwise maximum over faces."""
    return masks.groupBy(*by, "y", "x").agg(F.max("v").alias("v"))


def class_probs(scores: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """scores with p (softmax over a pixel's classes) and top (whether it is the likeliest, the lowest id on ties).

    A pixel's few classes are packed in an array: one shuffle, no sort by window.
    """
    packed = scores.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("class_id", "score"))).alias("s"))
    best = F.array_max(F.transform("s", lambda x: x.score))
    packed = packed.withColumn("best", best).withColumn("e", F.transform("s", lambda x: F.exp(x.score - F.col("best"))))
    packed = packed.withColumn("total", F.greatest(F.aggregate("e", F.lit(0.0), lambda a, v: a + v), F.lit(1e-8)))
    first = F.element_at(F.filter("s", lambda x: x.score == F.col("best")), 1).class_id
    each = packed.select(*by, "total", first.alias("first"), F.explode(F.arrays_zip("s", "e")).alias("z"))
    return each.select(*by, F.col("z.s.class_id").alias("class_id"), F.col("z.s.score").alias("score"), (F.col("z.e") / F.col("total")).alias("p"), (F.col("z.s.class_id") == F.col("first")).alias("top"))


def _in_region(class_id: Column) -> Column:
    """The regions that a class belongs to."""
    return F.array_compact(F.array(*[F.when(class_id.isin(*ids), F.lit(r)) for r, ids in REGIONS.items()]))


def region_masks(probs: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """By region, the sum of its classes' probabilities, at most 1."""
    each = probs.select(*by, "p", F.explode(_in_region(F.col("class_id"))).alias("region"))
    return each.groupBy(*by, "region").agg(F.least(F.sum("p"), F.lit(1.0)).alias("v"))


def label_mask(labels: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """By region, 1 if a pixel's label (class_id) is one of its classes, else 0."""
    regions = F.array(*map(F.lit, REGIONS))
    each = labels.select(*by, F.explode(regions).alias("region"), _in_region(F.col("class_id")).alias("of"))
    return each.groupBy(*by, "region").agg(F.max(F.when(F.array_contains("of", F.col("region")), 1.0).otherwise(0.0)).alias("v"))


def instance_mask(predictions: DataFrame, prototypes: DataFrame, mask_size: tuple[int, int], input_size: tuple[int, int], least: float = 0.20) -> DataFrame:
    """image_id, y, x, v from predictions (image_id, pred_id, cx, cy, w, h, scores, coeffs) and prototypes (image_id, proto_id, y, x, v, or
    one row a cell: image_id, y, x, p0, p1, ..., with null for a missing row).

    Predictions with a class score above least count, or else the best one. Each one's mask is the sigmoid
    of its prototypes' sum, inside its box, times its score; cells take the maximum. The predictions that count are packed, a row
    an image, and hashed; each cell then has its value in place, so neither cells of one row nor pairs of predictions and cells are shuffled.
    """
    mh, mw = mask_size
    sx, sy = mw / max(float(input_size[1]), 1.0), mh / max(float(input_size[0]), 1.0)
    x1 = clip((F.col("cx") - F.col("w") * 0.5) * sx, 0.0, mw - 1.0)
    y1 = clip((F.col("cy") - F.col("h") * 0.5) * sy, 0.0, mh - 1.0)
    x2 = F.least(F.greatest((F.col("cx") + F.col("w") * 0.5) * sx, x1 + 1), F.lit(float(mw)))
    y2 = F.least(F.greatest((F.col("cy") + F.col("h") * 0.5) * sy, y1 + 1), F.lit(float(mh)))
    score = F.array_max("scores")
    one = F.struct((-score).alias("less"), "pred_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), "coeffs", F.size("coeffs").alias("n"), clip(score).alias("share"))
    packed = predictions.groupBy("image_id").agg(F.collect_list(one).alias("all"))
    over, best = F.filter("all", lambda p: -p.less > least), F.array_min(F.filter("all", lambda p: p.less.isNotNull()))
    packed = packed.select("image_id", F.when(F.size(over) > 0, over).otherwise(F.array_compact(F.array(best))).alias("kept"))
    if "proto_id" in prototypes.columns:
        own = F.struct(F.col("proto_id").alias("i"), F.col("v").alias("v"))
        cells = prototypes.where("proto_id >= 0").groupBy("image_id", "y", "x").agg(F.collect_list(own).alias("protos")).withColumn("first", F.array_min(F.transform("protos", lambda q: q.i)))
        logit = lambda p: F.aggregate(F.transform("protos", lambda q: F.get(p.coeffs, q.i) * q.v), F.lit(None).cast("double"), lambda a, t: F.coalesce(a + t, a, t).cast("double"))
    else:
        names = sorted((c for c in prototypes.columns if c[0] == "p" and c[1:].isdigit()), key=lambda c: int(c[1:]))
        first = F.coalesce(*[F.when(F.col(c).isNotNull(), int(c[1:])) for c in names])
        cells = prototypes.select("image_id", "y", "x", *names, first.alias("first"))

        def logit(p: Column) -> Column:
            terms = [F.get(p.coeffs, F.lit(int(c[1:]))) * F.col(c) for c in names]
            return F.when(F.coalesce(*terms).isNotNull(), reduce(lambda a, t: a + t, [F.coalesce(t, F.lit(0.0)) for t in terms]))

    def value(p: Column) -> Column:
        """The value of a prediction in a cell; null where none of its coefficients has a prototype."""
        inside = (F.col("x") >= p.x1) & (F.col("x") < p.x2) & (F.col("y") >= p.y1) & (F.col("y") < p.y2)
        return F.when(p.n > F.col("first"), F.when(inside, clip(1 / (1 + F.exp(-logit(p))) * p.share)).otherwise(F.lit(0.0)))

    v = F.array_max(F.transform("kept", value))
    return cells.join(packed.hint("shuffle_hash"), "image_id").select("image_id", "y", "x", v.alias("v")).where("v IS NOT NULL")


def face_count(detections: DataFrame) -> DataFrame:
    return detections.groupBy("image_id").agg(F.count(F.lit(1)).alias("faces"))


def effect_reach(wanted: dict[str, tuple[str, str, str]]) -> int:
    """Cells to each side that effect masks read."""
    return max((grid.reach(color.profile(layer, kind)[2]) for _, layer, kind in wanted.values()), default=0)


def effects_dealt(dealt: DataFrame, wanted: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Rows dealt by tile, with the columns of wanted (see effect_masks). Nothing is shuffled."""
    curves = dealt.withColumns({name: color.effect_mask(F.col(c), layer, kind) for name, (c, layer, kind) in wanted.items()})
    smooth = grid.smooth_dealt(curves, {name: (name, color.profile(layer, kind)[2]) for name, (_, layer, kind) in wanted.items()})
    return smooth.withColumns({name: clip(F.col(name)) for name in wanted})


def effect_masks(table: DataFrame, wanted: dict[str, tuple[str, str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """image_id, y, x, the columns of keep, and one column for each of wanted {name: (mask column, layer, kind)}: the mask under the
    layer's confidence curve of that kind, smoothed by its sigma. table has a row for every cell of its images.

    All of them, of however many layers, are smoothed in one pass, tile by tile.
    """
    far = effect_reach(wanted)
    columns = dict.fromkeys([*(c for c, _, _ in wanted.values()), *keep])
    dealt = tiles.deal(table.select(*CELLS, *columns), far)
    return tiles.trim(effects_dealt(dealt, wanted), far).select(*CELLS, *wanted, *keep)


def _feature(layer: Column) -> Column:
    return reduce(lambda a, kv: a.when(layer == kv[0], kv[1]), FEATURES.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)


def scene_partition(masks: DataFrame, face_counts: DataFrame | None = None) -> DataFrame:
    """image_id, y, x, subject, background: the weighted maximum of feature masks, less without faces (image_id, faces), and what is left.

    See scene_masks for the form that has bodies and smooth edges.
    """
    top = masks.groupBy("image_id", "y", "x").agg(F.max(clip(F.col("v") * _feature(F.col("layer")))).alias("u"))
    if face_counts is None:
        subject = F.col("u") * 0.85
    else:
        top = top.join(face_counts, "image_id", "left")
        subject = F.when(F.coalesce("faces", F.lit(0)) > 0, F.col("u")).otherwise(F.col("u") * 0.85)
    return top.select("image_id", "y", "x", subject.alias("subject"), (1 - subject).alias("background"))


def body_cells(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, y, x, v: the bodies below faces (image_id, x, y, w, h), where there are any.

    For one face a cell has the sum of the weights of the ellipses that hold it, at most 1; of several faces the highest counts. Each
    face's cells are made from the bounds of its ellipses and weighed in place. Boxes are dealt by image before, so that a task has
    cells of its own images only, not some of all.
    """
    whole = lambda v: F.bround(v).cast("long")
    size = lambda v: F.greatest(F.lit(1), whole(v))
    x, y, w, h = (F.col(c) for c in "xywh")
    e = boxes.repartition("image_id").select("image_id", *[F.struct(whole(x + w * a).alias("cx"), whole(y + h * b).alias("cy"), size(w * c).alias("rx"), size(h * d).alias("ry")).alias(n) for n, (a, b, c, d) in BODY.items()])
    bound = lambda least, f, c, r, sign: f(least, *[F.col(f"{n}.{c}") + F.col(f"{n}.{r}") * sign for n in BODY])
    first = lambda c, r: F.greatest(F.lit(0), bound(F.lit(1 << 40), F.least, c, r, -1))
    last = lambda c, r, n: F.least(F.lit(n - 1), bound(F.lit(-1), F.greatest, c, r, 1))
    e = e.select("*", first("cx", "rx").alias("x1"), first("cy", "ry").alias("y1"), last("cx", "rx", width).alias("x2"), last("cy", "ry", height).alias("y2")).where("x1 <= x2 AND y1 <= y2")
    e = e.withColumn("y", F.explode(F.sequence("y1", "y2"))).withColumn("x", F.explode(F.sequence("x1", "x2")))
    off = lambda n, c: (F.col(c) - F.col(f"{n}.c{c}")) / F.col(f"{n}.r{c}")
    v = reduce(lambda a, b: a + b, [F.when(off(n, "x") * off(n, "x") + off(n, "y") * off(n, "y") <= 1, weight).otherwise(0.0) for n, weight in BODY_WEIGHTS.items()])
    cells = e.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), clip(v).alias("v")).where("v > 0")
    return cells.groupBy(*CELLS).agg(F.max("v").alias("v"))


def scene_masks(masks: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, y, x, subject, background over the whole frame of each image that has feature masks (image_id, layer, y, x, v) or faces
    (image_id, x, y, w, h): the higher of bodies and weighted features, which count less without faces, smoothed; and what is left, smoothed again.

    Masks without a cell count as 0 there; cells outside the frame and boxes with nulls don't count. Frame, features and bodies meet in one aggregation.
    """
    nothing = F.lit(None).cast("double")
    boxes = boxes.select("image_id", "x", "y", "w", "h").dropna()
    images = masks.select("image_id", F.lit(0).alias("face")).union(boxes.select("image_id", F.lit(1))).groupBy("image_id").agg(F.max("face").alias("face"))
    # A row of an image becomes a frame of cells: as many short rows as one task likes to read would be too many cells for it.
    images = images.repartition(max(4 * images.sparkSession.sparkContext.defaultParallelism, int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "image_id")
    frame = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    inside = masks.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    parts = [
        frame.select(*CELLS, "face", F.lit(0.0).alias("u"), F.lit(0.0).alias("body")),
        inside.select(*CELLS, F.lit(None).cast("int"), clip(F.col("v") * _feature(F.col("layer"))), nothing),
        body_cells(boxes, width, height).select(*CELLS, F.lit(None).cast("int"), nothing, "v"),
    ]
    cells = reduce(DataFrame.union, parts).groupBy(*CELLS).agg(F.max("face").alias("face"), F.max("u").alias("u"), F.max("body").alias("body"))
    subject = F.greatest("body", F.when(F.col("face") > 0, F.col("u")).otherwise(F.col("u") * 0.85))
    sigma = max(2.0, width * 0.010)
    smooth = grid.gaussian_smooth(cells.select(*CELLS, subject.alias("v")), sigma)
    background = grid.gaussian_smooth(smooth.select(*CELLS, (1 - clip(F.col("v"))).alias("v")), sigma)
    return background.select(*CELLS, (1 - clip(F.col("v"))).alias("subject"), clip(F.col("v")).alias("background"))


def rank_detections(detections: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes in whole pixels inside the frame, with place by area, larger first and then by det_id, from 0."""
    x = clip(F.floor("x").cast("double"), 0.0, width - 1.0)
    y = clip(F.floor("y").cast("double"), 0.0, height - 1.0)
    w, h = F.greatest(F.lit(1.0), F.least(width - x, F.ceil("w"))), F.greatest(F.lit(1.0), F.least(height - y, F.ceil("h")))
    boxes = detections.select("image_id", "det_id", *[v.cast("long").alias(c) for c, v in (("x", x), ("y", y), ("w", w), ("h", h))])
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(F.col("w") * F.col("h")), "det_id")) - 1
    return boxes.withColumn("place", place.cast("long"))


def target_face(ranked: DataFrame, index: int | None) -> DataFrame:
    """By image, the ranked box at an index, which is clamped; the first for none."""
    last = F.count(F.lit(1)).over(Window.partitionBy("image_id")) - 1
    return ranked.withColumn("_at", F.least(F.greatest(F.lit(index or 0), F.lit(0)), last)).where("place = _at").drop("_at")


def expanded_box(boxes: DataFrame, width: int, height: int, x_scale: float, y_scale: float, up_scale: float | None = None) -> DataFrame:
    """boxes with x1, y1, x2, y2 of the box padded by shares of its size and cut at the frame."""
    up = y_scale if up_scale is None else up_scale
    x, y, w, h = (F.col(c) for c in "xywh")
    ends = {"x1": F.greatest(F.lit(0), F.floor(x - w * x_scale)), "y1": F.greatest(F.lit(0), F.floor(y - h * up)), "x2": F.least(F.lit(width), F.ceil(x + w + w * x_scale)), "y2": F.least(F.lit(height), F.ceil(y + h + h * y_scale))}
    return boxes.withColumns({k: v.cast("long") for k, v in ends.items()})


def padded_box(boxes: DataFrame, width: int, height: int, pad_x: float = 0.32, pad_y: float = 0.38) -> DataFrame:
    """boxes (x1, y1, x2, y2) padded by shares of their size, rounded half to even."""
    px, py = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")) * pad_x, F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")) * pad_y
    whole = lambda v: F.bround(v).cast("long")
    return boxes.withColumns({"x1": F.greatest(F.lit(0), whole(F.col("x1") - px)), "y1": F.greatest(F.lit(0), whole(F.col("y1") - py)), "x2": F.least(F.lit(width), whole(F.col("x2") + px)), "y2": F.least(F.lit(height), whole(F.col("y2") + py))})


def ellipses(boxes: DataFrame, zones: dict[str, tuple[float, float, float, float]] = ZONES) -> DataFrame:
    """image_id, det_id, zone, cx, cy, rx, ry of each box's zones, in whole pixels (half to even)."""
    whole = lambda v: F.bround(v).cast("long")
    one = lambda z, a, b, c, d: F.struct(F.lit(z).alias("zone"), whole(F.col("x") + F.col("w") * a).alias("cx"), whole(F.col("y") + F.col("h") * b).alias("cy"), F.greatest(F.lit(1), whole(F.col("w") * c)).alias("rx"), F.greatest(F.lit(1), whole(F.col("h") * d)).alias("ry"))
    return boxes.select("image_id", "det_id", F.explode(F.array(*[one(z, *v) for z, v in zones.items()])).alias("e")).select("image_id", "det_id", "e.*")


def zone_chords(boxes: DataFrame, width: int, height: int, zones: dict[str, tuple[float, float, float, float]] = ZONES) -> DataFrame:
    """image_id, det_id, zone, y, x1, x2: the first and last pixel of each zone in each row where it has any. Rows are made from each ellipse's
    own bounds, and their ends from its equation: no join, and no row for a pixel.

    A pixel k columns from the centre is inside if (k / rx)^2 + dy^2 <= 1, in doubles. The root says how many k's are, but for its
    rounding, so its neighbours are tried as well.
    """
    e = ellipses(boxes, zones)
    low, high = F.greatest(F.lit(0), F.col("cy") - F.col("ry")), F.least(F.lit(height - 1), F.col("cy") + F.col("ry"))
    e = e.where(low <= high).withColumn("y", F.explode(F.sequence(low, high)))
    dy = (F.col("y") - F.col("cy")) / F.col("ry")
    e = e.select("image_id", "det_id", "zone", "y", "cx", "rx", (dy * dy).alias("d2"))
    e = e.withColumn("k", F.floor(F.sqrt(1 - F.col("d2")) * F.col("rx")))
    inside = lambda k: (k / F.col("rx")) * (k / F.col("rx")) + F.col("d2") <= 1
    k = F.col("k") + F.when(inside(F.col("k") + 1), 1).when(inside(F.col("k")), 0).otherwise(-1)
    e = e.select("image_id", "det_id", "zone", "y", "cx", k.alias("k"))
    ends = F.struct(F.greatest(F.lit(0), F.col("cx") - F.col("k")).alias("x1"), F.least(F.lit(width - 1), F.col("cx") + F.col("k")).alias("x2"))
    # Exploded, so that the filter stays behind the steps before: pushed under them it would be all of them written into one expression.
    return e.select("image_id", "det_id", "zone", "y", F.explode(F.array(ends)).alias("e")).select("image_id", "det_id", "zone", "y", "e.x1", "e.x2").where("x1 <= x2")


def zone_pixels(boxes: DataFrame, width: int, height: int, zones: dict[str, tuple[float, float, float, float]] = ZONES) -> DataFrame:
    """image_id, det_id, zone, y, x inside each zone. What only counts or sums pixels reads zone_chords."""
    return zone_chords(boxes, width, height, zones).select("image_id", "det_id", "zone", "y", F.explode(F.sequence("x1", "x2")).alias("x"))


def _misfit(box: str = "", landmarks: str = "") -> Column:
    """How ill a box (x, y, w, h) and the bounds of landmarks (x1, y1, x2, y2) fit: the distance of centres and shares of the differences in size."""
    x, y, w, h = (F.col(box + c) for c in "xywh")
    x1, y1, x2, y2 = (F.col(landmarks + c) for c in ("x1", "y1", "x2", "y2"))
    dx, dy = (x1 + x2) * 0.5 - (x + w * 0.5), (y1 + y2) * 0.5 - (y + h * 0.5)
    return F.sqrt(dx * dx + dy * dy) + F.abs(x2 - x1 - w) * 0.25 + F.abs(y2 - y1 - h) * 0.20


#: Images of up to so many different landmark sets are joined with their boxes; others are dealt in parts of up to PART boxes and sets. The results are the same.
FEW_SETS, PART = 64, 65_536
SIDES = ("x1", "y1", "x2", "y2")


def nearest_landmarks(boxes: DataFrame, landmarks: DataFrame) -> DataFrame:
    """For each box (image_id, det_id, x, y, w, h), the landmark set (image_id, set_id, x1, y1, x2, y2) of the image that fits best: of equal
    ones the lowest set_id. Boxes and sets with nulls don't count; a box of an image without sets has no row.

    Where an image has many sets, they and its boxes are dealt in parts, and each part of boxes meets each part of sets in a group of its
    own, so that a task's memory is bounded. There both are cut into leaves by the four numbers that a fit is made of (centre and weighted
    size); a leaf that can't hold a better fit is passed over (operators.nearest). What is shuffled is the tables themselves, once for each
    PART of the other side.
    """
    boxes = boxes.select("image_id", "det_id", "x", "y", "w", "h").dropna(subset=["image_id", "x", "y", "w", "h"])
    sets = landmarks.dropna(subset=["image_id", *SIDES]).groupBy("image_id", *SIDES).agg(F.min("set_id").alias("set_id"))
    sets = sets.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("image_id")))
    few, many = sets.where(F.col("n") <= FEW_SETS).drop("n"), sets.where(F.col("n") > FEW_SETS)
    best = F.min(F.struct(_misfit().alias("score"), "set_id")).alias("b")
    out = boxes.join(few, "image_id").groupBy("image_id", "det_id").agg(best).union(_in_parts(boxes, many))
    return out.select("image_id", "det_id", "b.set_id", "b.score")


def _in_parts(boxes: DataFrame, sets: DataFrame) -> DataFrame:
    """image_id, det_id, b for the images of sets, which have n, how many an image has."""
    parts = lambda n: F.ceil(n / PART).cast("int")
    counts = boxes.groupBy("image_id").agg(parts(F.count(F.lit(1))).alias("bs")).join(sets.groupBy("image_id").agg(parts(F.first("n")).alias("ss")), "image_id")
    both = boxes.join(counts, "image_id").select(*boxes.columns, F.pmod(F.xxhash64("det_id"), "bs").cast("int").alias("bp"), F.explode(F.sequence(F.lit(0), F.col("ss") - 1)).alias("sp"))
    dealt = sets.join(counts, "image_id").select("image_id", *SIDES, "set_id", F.pmod(F.xxhash64("set_id"), "ss").cast("int").alias("sp"), F.explode(F.sequence(F.lit(0), F.col("bs") - 1)).alias("bp"))
    kinds = dict(boxes.select("image_id", "det_id").dtypes + sets.select("set_id").dtypes)
    # Both may come of one table: the names of columns are different on either side.
    group = ["_image", "bp", "sp"]
    dealt = _doubles(dealt, SIDES).select(F.col("image_id").alias("_image"), F.col("bp").alias("_bp"), F.col("sp").alias("_sp"), "set_id", *SIDES)
    found = _doubles(both, "xywh").withColumn("_image", F.col("image_id").alias("_image")).groupBy(*group).cogroup(dealt.groupBy("_image", "_bp", "_sp")).applyInArrow(nearest.of_group, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", score double")
    return found.groupBy("image_id", "det_id").agg(F.min(F.struct("score", "set_id")).alias("b"))


def _doubles(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def mask_blend(original: DataFrame, edited: DataFrame, mask: DataFrame) -> DataFrame:
    """original * (1 - m) + edited * m; where the mask (image_id, y, x, v) has no row, m is 0."""
    cells = ["image_id", "y", "x"]
    both = original.alias("o").join(edited.alias("e"), cells).join(mask.select(*cells, "v"), cells, "left")
    m = F.coalesce("v", F.lit(0.0))
    return both.select(*cells, *[clip(F.col(f"o.{c}") * (1 - m) + F.col(f"e.{c}") * m).alias(c) for c in "rgb"])


def merge_views(full: DataFrame, part: DataFrame, offset: tuple[int, int], weights: DataFrame) -> DataFrame:
    """A mask found in a part of the frame, moved by offset (x, y), mixed into the frame's: weights (image_id, y, x, weight) up to 0.9.

    Where the part has no cell the frame's stays; where the frame has none, it is 0. Weights are as many as cells, and often made from a short
    list of images, by whose size they would be broadcast: they are sorted and merged.
    """
    cells = ["image_id", "y", "x"]
    moved = part.select("image_id", (F.col("y") + offset[1]).alias("y"), (F.col("x") + offset[0]).alias("x"), F.col("v").alias("part"))
    both = full.select(*cells, F.col("v").alias("full")).join(moved, cells, "full").join(weights.hint("merge"), cells, "left")
    f = clip(F.coalesce("full", F.lit(0.0)))
    w = clip(F.coalesce("weight", F.lit(0.0)), 0.0, 0.9)
    return both.select(*cells, F.when(F.col("part").isNull(), f).otherwise(clip(f * (1 - w) + clip(F.col("part")) * w)).alias("v"))


def gaussian_weight(boxes: DataFrame, width: int, height: int, sx: Column, sy: Column) -> DataFrame:
    """image_id, det_id, y, x, v: a bell around each box's centre, of widths sx and sy, over the whole frame."""
    centre = [(F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy")]
    b = boxes.select("image_id", "det_id", *centre, sx.alias("sx"), sy.alias("sy")).where("sx > 0 AND sy > 0")
    g = b.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    v = F.exp(-(dx * dx / (2 * F.col("sx") * F.col("sx")) + dy * dy / (2 * F.col("sy") * F.col("sy"))))
    return g.select("image_id", "det_id", "y", "x", v.alias("v"))
