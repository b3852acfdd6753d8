"""Queries of the composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelframe.plans import grade
from pixelframe.plans.fixtures import msk, px, with_
from pixelframe.plans.mask_queries import even_sql
from pixelframe.plans.pixel_queries import BAND, DIMS, band_sql, clip_sql, lut_sql, rounded, saturated, shown, vignette_sql, warmed
from pixelframe.plans.registry import query

# The chain of both engines agrees step by step; values that a step cuts to 8 bits are sure to, as their inputs agree to the last bit.
PARAMS = {"exposure": 20, "temperature": 40, **BAND, "vibrance": 30, "saturation": 10, "vignette": 35}


def _exposed(src: str, out: str, percent: float) -> str:
    return f"{out} AS (SELECT image_id, y, x, " + ", ".join(f"{clip_sql(f'{c} * {2 ** (percent / 100)!r}')} AS {c}" for c in "rgb") + f" FROM {src})"


@query(with_("px", ", ".join([_exposed("px", "s1", 20), warmed("s1", "s2", 40), lut_sql("s2", "s3", band_sql(**BAND)), saturated("s3", "s4", 20.0), saturated("s4", "s5", 15.0), DIMS, vignette_sql("s5", "s6", 35)]) + " " + shown() + " FROM s6"))
def grade_global(spark, sf_dir):
    return rounded(grade.grade_global(px(spark, sf_dir), PARAMS))


def _mixed(base: str, edited: str, out: str, weight: str, *masks: str) -> str:
    """edited mixed into base by a weight of the masks' values (mask.v)."""
    joins = "".join(f" JOIN {k} USING (image_id, y, x)" for k in masks)
    return f"{out} AS (SELECT image_id, y, x, " + ", ".join(f"{clip_sql(f'b.{c} * (1 - {weight}) + e.{c} * {weight}')} AS {c}" for c in "rgb") + f" FROM {base} b JOIN {edited} e USING (image_id, y, x){joins})"


MASK = "mk AS (SELECT p.image_id, p.y, p.x, coalesce(m.v, 0) AS v FROM px p LEFT JOIN msk m ON m.image_id = p.image_id AND m.y = p.y AND m.x = p.x)"


def _effect(out: str, power: float, floor: float, sigma: float) -> str:
    return f"{out}_c AS (SELECT image_id, y, x, pow({clip_sql(f'(v - {floor}) / (1 - {floor})')}, {power}) AS v FROM mk), " + even_sql(f"{out}_c", out, sigma)


@query(with_("px msk", ", ".join([MASK, _effect("bl", 0.95, 0.0, 1.0), _exposed("px", "s1", 30), saturated("s1", "s2", 25), warmed("s2", "s3", -30), _mixed("px", "s3", "o", "bl.v", "bl")]) + " " + shown() + " FROM o"))
def grade_masked(spark, sf_dir):
    return rounded(grade.grade_masked(px(spark, sf_dir), msk(spark, sf_dir), "subjects", {"exposure": 30, "saturation": 25, "warmth": -30}))


def _blurred(src: str, out: str, sigma: float) -> str:
    """r, g, b of src smoothed: the channels are planes of their own."""
    return f"{out}_l AS (SELECT image_id * 4 + k AS image_id, y, x, CASE k WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM {src}, range(3) t(k)), " + even_sql(f"{out}_l", f"{out}_s", sigma) + f", {out} AS (SELECT image_id // 4 AS image_id, y, x, " + ", ".join(f"max(v) FILTER (image_id % 4 = {k}) AS {c}" for k, c in enumerate("rgb")) + f" FROM {out}_s GROUP BY image_id // 4, y, x)"


@query(with_("px msk", ", ".join([MASK, _effect("bl", 0.85, 0.0, 1.2), _effect("br", 0.65, 0.0, 1.6), _effect("de", 1.25, 0.04, 0.9), _blurred("px", "s1", 3.4), _mixed("px", "s1", "s2", "br.v", "br"), _exposed("s2", "s3", 10),
    f"dk0 AS (SELECT image_id, y, x, {clip_sql(f'1 - {clip_sql("0.2126 * r + 0.7152 * g + 0.0722 * b")} * 1.15')} AS v FROM s3)", even_sql("dk0", "dk", 2.2), _blurred("s3", "s4", 7.0),
    "s5 AS (SELECT image_id, y, x, " + ", ".join(clip_sql(f"s3.{c} + (s3.{c} - s4.{c}) * 0.51") + f" AS {c}" for c in "rgb") + " FROM s3 JOIN s4 USING (image_id, y, x))",
    _mixed("s3", "s5", "s6", "(dk.v * de.v)", "dk", "de"), _mixed("px", "s6", "o", "bl.v", "bl")]) + " " + shown() + " FROM o"))
def grade_background(spark, sf_dir):
    """A background blurred, lightened and cleared of haze."""
    return rounded(grade.grade_masked(px(spark, sf_dir), msk(spark, sf_dir), "background", {"blur": 20, "exposure": 10, "dehaze": 60}))


@query(with_("px msk", ", ".join([MASK, _effect("su", 0.95, 0.0, 1.0), _effect("ha", 1.1, 0.06, 0.9), _effect("hb", 0.9, 0.03, 1.0), _exposed("px", "a1", 25), _mixed("px", "a1", "a2", "su.v", "su"), _mixed("px", "a2", "a3", "su.v", "su"), _exposed("a3", "b1", -40), _mixed("a3", "b1", "b2", "ha.v", "ha"),
    "b3 AS (SELECT image_id, l.y, l.x, " + ", ".join(clip_sql(f"(1 - 2 * l.{c}) * (a.{c} * a.{c}) + 2 * l.{c} * a.{c}") + f" AS {c}" for c in "rgb") + " FROM a3 a JOIN b2 l USING (image_id, y, x))",
    _mixed("a3", "b3", "o", "least(ha.v * 0.7 + hb.v * 0.3, 1)", "ha", "hb")]) + " " + shown() + " FROM o"))
def layer_stack(spark, sf_dir):
    """Two layers, the same mask serving both."""
    masks = msk(spark, sf_dir).withColumn("layer", F.explode(F.array(F.lit("subjects"), F.lit("hair"))))
    layers = [{"layer": "subjects", "params": {"exposure": 25}, "opacity": 1.0, "mode": "normal"}, {"layer": "hair", "params": {"exposure": -40}, "opacity": 1.0, "mode": "soft_light"}]
    return rounded(grade.layer_stack(px(spark, sf_dir), masks, layers))
