"""Tone curves of many presets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def curve_luts(points: DataFrame, levels: int = 256) -> DataFrame:
    """curve_id, level, v: the monotone cubic through each curve's points (curve_id, x, y), at equal steps.

    Values are clamped and sorted by x, the ends moved to x 0 and 1; a point closer than 0.001 to the last
    one kept is left out. A curve of fewer than two points is a straight line.
    """
    clip = lambda c: F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0))
    packed = points.select("curve_id", clip("x").alias("x"), clip("y").alias("y")).groupBy("curve_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    n = F.size("p")
    kind = "array<struct<x:double,y:double>>"

    def keep(out, q):
        return F.when((q.x - F.element_at(out, -1).x > 1e-3) & (1 - q.x > 1e-3), F.concat(out, F.array(q))).otherwise(out)

    at = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    inner = F.aggregate(F.slice("p", F.lit(2), F.greatest(n - 2, F.lit(0))), F.array(at(0.0, F.element_at("p", 1).y)).cast(kind), keep)
    whole = F.when(n < 2, F.array(at(0.0, F.lit(0.0)), at(1.0, F.lit(1.0))).cast(kind)).otherwise(F.concat(inner, F.array(at(1.0, F.element_at("p", -1).y))))
    w = Window.partitionBy("curve_id").orderBy("k")
    s = packed.select("curve_id", F.posexplode(whole).alias("k", "q")).select("curve_id", "k", "q.x", "q.y")
    s = s.withColumn("h", F.lead("x").over(w) - F.col("x")).withColumn("d", (F.lead("y").over(w) - F.col("y")) / F.col("h"))
    h0, d0, h, d = F.lag("h").over(w), F.lag("d").over(w), F.col("h"), F.col("d")
    slope = F.when(d0.isNull(), d).when(d.isNull(), d0).when(d0 * d <= 0, F.lit(0.0)).otherwise((3 * h + 3 * h0) / ((2 * h + h0) / d0 + (h + 2 * h0) / d))
    s = s.withColumn("m", slope)
    s = s.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "m1": F.lead("m").over(w), "last": F.lead("x", 2).over(w).isNull()}).where("h IS NOT NULL")
    # Each segment lists the levels that lie in it: [x, x1), the last with its end.
    steps = levels - 1
    low = F.ceil(F.col("x") * steps - 1e-9)
    each = s.withColumn("level", F.explode(F.sequence(low.cast("int"), F.ceil(F.col("x1") * steps + 1e-9).cast("int")))).withColumn("v", F.col("level") / steps)
    each = each.where((F.col("v") >= F.col("x")) & ((F.col("v") < F.col("x1")) | (F.col("last") & (F.col("v") <= 1))))
    t = (F.col("v") - F.col("x")) / h
    value = (2 * t * t * t - 3 * t * t + 1) * F.col("y") + (t * t * t - 2 * t * t + t) * h * F.col("m") + (3 * t * t - 2 * t * t * t) * F.col("y1") + (t * t * t - t * t) * h * F.col("m1")
    return each.select("curve_id", "level", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("v"))
