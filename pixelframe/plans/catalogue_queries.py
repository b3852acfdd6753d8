"""Queries over presets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelframe.operators import catalogue
from pixelframe.operators.catalogue import LAYER_ORDER, SLIDERS
from pixelframe.plans.fixtures import msk, ps, with_
from pixelframe.plans.registry import query
from pixelframe.sources import files
from pixelframe.sources.shared import new_path

DIM = "dim(layer, key, def) AS (VALUES " + ", ".join(f"('{layer}', '{key}', {default})" for layer, each in SLIDERS.items() for key, _, _, default in each) + ")"
ORDER = "[" + ", ".join(f"'{x}'" for x in LAYER_ORDER) + "]"
META = """meta AS (SELECT preset_id, CASE WHEN preset_id % 5 = 0 THEN CASE WHEN preset_id % 10 = 0 THEN 'p' || preset_id ELSE 'Untitled' END ELSE trim(name) END AS name,
 CASE WHEN preset_id % 7 = 0 THEN 'general' ELSE lower(trim(category)) END AS category, list_filter(list_transform(string_split(tags_csv, ','), lambda t: lower(trim(t))), lambda t: t <> '') AS tags,
 CASE WHEN preset_id % 10 = 5 THEN '' ELSE '/presets/p' || preset_id || '.pepreset' END AS path FROM ps)"""


def _params(spark, sf_dir):
    """Presets with a few sliders set, one unknown, one fractional."""
    sliders = F.create_map(F.lit("exposure"), F.col("exposure") * 1.5, F.lit("contrast"), F.lit(9.0), F.lit("glow"), F.when(F.col("preset_id") % 3 == 0, F.lit(40.7)))
    return ps(spark, sf_dir).withColumn("params", F.create_map(F.lit("global"), sliders, F.lit("face"), sliders))


def _meta(spark, sf_dir):
    p = ps(spark, sf_dir)
    path = F.when(F.col("preset_id") % 10 == 5, "").otherwise(F.concat(F.lit("/presets/p"), F.col("preset_id").cast("string"), F.lit(".pepreset")))
    name, category, tags = catalogue.normal_meta(F.when(F.col("preset_id") % 5 == 0, "  ").otherwise(F.col("name")), F.when(F.col("preset_id") % 7 == 0, F.lit(None)).otherwise(F.col("category")), F.col("tags_csv"), path)
    return p.select("preset_id", name.alias("name"), category.alias("category"), tags.alias("tags"), path.alias("path"))


@query(with_("ps", DIM + """ SELECT preset_id, layer, key, CAST(trunc(CASE WHEN layer IN ('global', 'face') AND key = 'exposure' THEN exposure * 1.5 WHEN layer IN ('global', 'face') AND key = 'glow' AND preset_id % 3 = 0 THEN 40.7 ELSE def END) AS BIGINT) AS value FROM ps, dim"""))
def preset_params_long(spark, sf_dir):
    return catalogue.preset_params_long(_params(spark, sf_dir), catalogue.sliders(spark))


@query(with_("ps", """SELECT preset_id, least(greatest(opacity, 0), 200) AS strength, CASE WHEN preset_id % 4 = 0 THEN 0 ELSE least(greatest(exposure, 0), 40) END AS feather, least(greatest(exposure * 3, -40), 40) AS expand,
 CAST(round_even(least(greatest(opacity * 50.5, 2000), 12000), 0) AS BIGINT) AS wb_temp_k, CAST(round_even(least(greatest(exposure * 7.5, -150), 150), 0) AS BIGINT) AS wb_tint, CAST(trunc(least(greatest(exposure * 4.3, -100), 100)) AS BIGINT) AS mixer,
 least(greatest(exposure / 5, 0.25), 4) AS gain, least(greatest(exposure / 20, 0), 1 - least(greatest(opacity / 200, 0.05), 1)) AS crop_x, least(greatest(opacity / 200, 0.05), 1) AS crop_w FROM ps"""))
def clamp_settings(spark, sf_dir):
    e, o = F.col("exposure"), F.col("opacity")
    clamped = catalogue.clamped
    x, y, w, h = catalogue.clamped_crop(e / 20, e / 20, o / 200, o / 200)
    odd = F.when(F.col("preset_id") % 4 == 0, "odd").otherwise(e.cast("string"))
    return ps(spark, sf_dir).select("preset_id", clamped(o, "strength").alias("strength"), clamped(odd, "feather").alias("feather"), clamped(e * 3, "expand").alias("expand"), clamped(o * 50.5, "wb_temp_k", "round").alias("wb_temp_k"), clamped(e * 7.5, "wb_tint", "round").alias("wb_tint"), clamped(e * 4.3, "mixer", "cut").alias("mixer"), clamped(e / 5, "gain").alias("gain"), x.alias("crop_x"), w.alias("crop_w"))


@query(with_("ps", """SELECT preset_id, CASE WHEN preset_id % 3 = 0 THEN 'linear' ELSE 'srgb' END AS working_space, CASE WHEN preset_id % 4 = 0 THEN 'gamma22' ELSE 'srgb' END AS output_transform, CASE WHEN preset_id % 5 = 0 THEN 'none' ELSE 'srgb' END AS icc_policy FROM ps"""))
def normalize_color_settings(spark, sf_dir):
    k = F.col("preset_id")
    given = {"working_space": F.when(k % 3 == 0, "linear").otherwise("cmyk"), "output_transform": F.when(k % 4 == 0, "gamma22"), "icc_policy": F.when(k % 5 == 0, "none").otherwise("")}
    return ps(spark, sf_dir).select("preset_id", *[catalogue.normal_choice(v, c).alias(c) for c, v in given.items()])


@query(with_("ps", META + " SELECT preset_id, name, category, array_to_string(tags, '|') AS tags FROM meta"))
def normalize_meta(spark, sf_dir):
    return _meta(spark, sf_dir).select("preset_id", "name", "category", F.array_join("tags", "|").alias("tags"))


@query(with_("ps", META + " SELECT preset_id, name FROM meta WHERE contains(lower(name || ' ' || category || ' ' || array_to_string(tags, ' ') || ' ' || regexp_extract(path, '([^/]*)$', 1)), 'widget')"))
def search_presets(spark, sf_dir):
    return catalogue.search_presets(_meta(spark, sf_dir), " WIDGET ").select("preset_id", "name")


@query(with_("ps", f"""o AS (SELECT preset_id, list_filter([CASE WHEN preset_id % 2 = 0 THEN 'eyes' ELSE 'sky' END, 'fog', CASE WHEN preset_id % 3 = 0 THEN 'eyes' ELSE 'tree' END], lambda x: list_contains({ORDER}, x)) AS k FROM ps)
SELECT preset_id, array_to_string(CASE WHEN len(k) = 0 THEN {ORDER} ELSE list_concat(k, list_filter({ORDER}, lambda x: NOT list_contains(k, x))) END, ',') AS layers FROM o"""))
def layer_order(spark, sf_dir):
    k = F.col("preset_id")
    given = F.array(F.when(k % 2 == 0, "eyes").otherwise("sky"), F.lit("fog"), F.when(k % 3 == 0, "eyes").otherwise("tree"))
    return ps(spark, sf_dir).select("preset_id", F.array_join(catalogue.layer_order(given), ",").alias("layers"))


@query(with_("ps msk", f"""m AS (SELECT image_id, layer_id, max(v) AS mx FROM msk GROUP BY ALL),
p AS (SELECT preset_id, preset_id % 500 AS image_id, unnest(range(7)) AS seq, unnest({ORDER}) AS layer, exposure, opacity FROM ps)
SELECT preset_id, p.image_id, CAST(seq AS BIGINT) AS seq, layer, CASE WHEN layer = 'hair' THEN least(opacity / 100, 1) ELSE 1.0 END AS opacity FROM p JOIN m ON m.image_id = p.image_id AND layer = (CASE layer_id WHEN 0 THEN 'face' WHEN 1 THEN 'hair' ELSE 'skin' END)
WHERE mx > 0.01 AND NOT (layer = 'face' AND exposure < 0)"""))
def active_layers(spark, sf_dir):
    options = F.create_map(F.lit("face"), F.struct((F.col("exposure") >= 0).alias("enabled"), F.lit(100.0).alias("opacity")), F.lit("hair"), F.struct(F.lit(True).alias("enabled"), F.col("opacity")))
    presets = ps(spark, sf_dir).select("preset_id", (F.col("preset_id") % 500).alias("image_id"), F.lit(None).cast("array<string>").alias("layer_order"), options.alias("options"))
    names = F.get(F.array(*map(F.lit, ("face", "hair", "skin"))), F.col("layer_id"))
    stats = msk(spark, sf_dir).groupBy("image_id", names.alias("layer")).agg(F.max("v").alias("max"))
    return catalogue.active_layers(presets, stats).withColumn("seq", F.col("seq").cast("long"))


@query(with_("ps", "SELECT preset_id FROM ps WHERE preset_id % 4 <> 1 AND exposure = 0"))
def identity_presets(spark, sf_dir):
    e = F.col("exposure")
    end = F.when(F.col("preset_id") % 4 == 1, 0.9).otherwise(1.0)
    curve = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), end.alias("y")))
    zero = F.lit(0.0)
    same = catalogue.is_identity(curve, F.array(e.cast("int"), F.lit(0)), F.array(1 + e / 100, F.lit(1.0)), F.array(zero, zero, F.lit(1.0), F.lit(1.0)))
    return ps(spark, sf_dir).where(same).select("preset_id")


@query(with_("ps", META + " SELECT 0 AS place, 'all' AS category, count(*) AS n FROM meta UNION ALL SELECT 1, category, count(*) FROM meta GROUP BY category"))
def preset_facets(spark, sf_dir):
    return catalogue.facets(_meta(spark, sf_dir))


@query(with_("ps", f"""s AS (SELECT preset_id, CASE WHEN exposure > 0 THEN ['face', 'sky', 'face'] ELSE ['hair'] END AS a FROM ps)
SELECT preset_id, array_to_string(list_concat(CASE WHEN len(a) = 3 THEN ['face', 'sky'] ELSE a END, list_filter({ORDER}, lambda x: NOT list_contains(a, x))), ',') AS any_layers, array_to_string(list_filter(CASE WHEN len(a) = 3 THEN ['face', 'sky'] ELSE a END, lambda x: NOT list_contains({ORDER}, x)), ',') AS odd_layers FROM s"""))
def layer_sets(spark, sf_dir):
    a = F.when(F.col("exposure") > 0, F.array(F.lit("face"), F.lit("sky"), F.lit("face"))).otherwise(F.array(F.lit("hair")))
    default = F.array(*map(F.lit, LAYER_ORDER))
    return ps(spark, sf_dir).select("preset_id", F.array_join(catalogue.layer_sets(a, default)[0], ",").alias("any_layers"), F.array_join(catalogue.layer_sets(a, default)[1], ",").alias("odd_layers"))


@query(with_("ps", "SELECT CASE WHEN preset_id % 9 = 0 THEN NULL ELSE name END AS name, count(*) AS n, CAST(sum(CASE WHEN preset_id % 9 = 0 THEN NULL ELSE exposure END) AS DOUBLE) AS exposure FROM ps GROUP BY 1"))
def preset_scan(spark, sf_dir):
    """Presets written as JSON texts, one in nine broken, read back and summed by name."""
    path = new_path(spark, "presets")
    text = F.to_json(F.struct(F.create_map(F.lit("exposure"), F.col("exposure")).alias("global_params"), F.struct("name").alias("meta")))
    ps(spark, sf_dir).select(F.when(F.col("preset_id") % 9 == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("value")).write.text(path)
    read = files.presets_of(spark.read.text(path))
    return read.groupBy(F.col("preset.meta.name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("preset.global_params")["exposure"]).alias("exposure"))
