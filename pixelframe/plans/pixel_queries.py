"""Queries over pixel tables: statistics, colour, geometry and look-up tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.functions import color
from pixelframe.operators import pixels as p
from pixelframe.plans.fixtures import fl, ps, px, table, with_
from pixelframe.plans.registry import query
from pixelframe.sources import files
from pixelframe.sources.shared import new_path

PLACE = "image_id, y, x"


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Numbers of double type rounded to 9 places, so that engines agree."""
    return df.select(*[color.nine_places(F.col(c)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def shown(*values: str, place: str = PLACE) -> str:
    """SELECT list of r, g, b (or given "value AS name"), rounded."""
    values = values or ("r AS r", "g AS g", "b AS b")
    return f"SELECT {place}, " + ", ".join("round({}, 9) AS {}".format(*v.rsplit(" AS ", 1)) for v in values)


def clip_sql(v: str) -> str:
    return f"least(greatest({v}, 0), 1)"


def linear(v: str) -> str:
    return f"(CASE WHEN {clip_sql(v)} <= 0.04045 THEN {clip_sql(v)} / 12.92 ELSE pow(({clip_sql(v)} + 0.055) / 1.055, 2.4) END)"


def encoded(v: str) -> str:
    return f"(CASE WHEN {clip_sql(v)} <= 0.0031308 THEN {clip_sql(v)} * 12.92 ELSE 1.055 * pow({clip_sql(v)}, {1 / 2.4!r}) - 0.055 END)"


def hsv(src: str, out: str) -> str:
    """CTEs that add h, s, v and top values to src."""
    return f"""{out}_q AS (SELECT *, floor({clip_sql('r')} * 255) AS r8, floor({clip_sql('g')} * 255) AS g8, floor({clip_sql('b')} * 255) AS b8 FROM {src}),
{out}_d AS (SELECT *, greatest(r8, g8, b8) AS top, greatest(r8, g8, b8) - least(r8, g8, b8) AS d FROM {out}_q),
{out}_h AS (SELECT *, round_even(CASE WHEN d = 0 THEN 0.0 WHEN top = r8 THEN 30 * (g8 - b8) / d WHEN top = g8 THEN 60 + 30 * (b8 - r8) / d ELSE 120 + 30 * (r8 - g8) / d END, 0) AS h0 FROM {out}_d),
{out} AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h, CASE WHEN top = 0 THEN 0.0 ELSE round_even(255 * d / top, 0) END AS s, top AS v FROM {out}_h)"""


def rgb(src: str, out: str, h: str, s: str, v: str, keep: str = PLACE) -> str:
    """CTEs that turn the given h, s, v (cut off) of src into r, g, b."""
    pick = lambda *a: "round_even(CASE CAST(k % 6 AS INT) " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(a)) + " END, 0) / 255"
    return f"""{out}_w AS (SELECT {keep}, floor({h}) AS hh, floor({s}) / 255 AS ss, floor({v}) AS vv FROM {src}),
{out}_f AS (SELECT *, floor(hh / 30) AS k, hh / 30 - floor(hh / 30) AS f FROM {out}_w),
{out}_p AS (SELECT *, vv * (1 - ss) AS p, vv * (1 - ss * f) AS q, vv * (1 - ss * (1 - f)) AS t FROM {out}_f),
{out} AS (SELECT {keep}, {pick('vv', 'q', 'p', 'p', 't', 'vv')} AS r, {pick('t', 'vv', 'vv', 'q', 'p', 'p')} AS g, {pick('p', 'p', 't', 'vv', 'vv', 'q')} AS b FROM {out}_p)"""


def saturated(src: str, out: str, delta: float) -> str:
    return hsv(src, f"{out}0") + ", " + rgb(f"{out}0", out, "h", f"least(greatest(s * (1 + {delta / 100!r}), 0), 255)", "v")


def warmed(src: str, out: str, delta: float) -> str:
    w = delta / 100
    weight = f"""{out}1 AS (SELECT *, greatest(1 - least(abs(h - 18), 180 - abs(h - 18)) / 48, 0) * least(greatest(s / 255, 0.15), 1) * least(greatest(1 - abs(v / 255 - 0.58) * 1.6, 0.25), 1) AS k FROM {out}0)"""
    return hsv(src, f"{out}0") + f", {weight}, " + rgb(f"{out}1", out, f"((h - {6 * w!r} * k) % 180 + 180) % 180", f"least(greatest(s * (1 + {0.10 * w!r} * k) * {1 + 0.04 * w!r}, 0), 255)", f"least(greatest(v * (1 + {0.05 * w!r} * k), 0), 255)")


def lut_sql(src: str, out: str, lut: str) -> str:
    """CTEs for apply_lut; lut: a SQL list of 256."""
    at = lambda v: f"{out}_l.lut[CAST(floor({clip_sql(v)} * 255) AS INT) + 1]"
    return f"""{out}_l AS MATERIALIZED (SELECT {lut} AS lut), {out}_c AS (SELECT {PLACE}, {clip_sql('r')} AS r, {clip_sql('g')} AS g, {clip_sql('b')} AS b FROM {src}),
{out}_y AS (SELECT *, {clip_sql('r * 0.2126 + g * 0.7152 + b * 0.0722')} AS l FROM {out}_c),
{out}_g AS (SELECT {out}_y.*, {at('l')} / greatest(l, 0.0001) AS k FROM {out}_y, {out}_l),
{out} AS (SELECT {PLACE}, {', '.join(clip_sql(f"{c} * k * 0.85 + {at(c)} * 0.15") + f' AS {c}' for c in 'rgb')} FROM {out}_g, {out}_l)"""


def band_sql(blacks=0, shadows=0, midtones=0, highlights=0, whites=0) -> str:
    """The six knots interpolated at 256 places."""
    y = [max(0.0, blacks / 100), 0.1 + shadows / 200, 0.3 + midtones / 200, 0.7 + highlights / 200, 0.9 + whites / 200, min(1.0, 1 + whites / 400)]
    x = [0.0, 0.1, 0.3, 0.7, 0.9, 1.0]
    pieces = " ".join(f"WHEN t <= {x[k + 1]!r} THEN {y[k]!r} + (t - {x[k]!r}) * {(y[k + 1] - y[k]) / (x[k + 1] - x[k])!r}" for k in range(5))
    return f"(SELECT list(CASE {pieces} END ORDER BY t) FROM (SELECT i / 255 AS t FROM range(256) r(i)))"


LEVELS = f"""q AS (SELECT image_id, round_even({clip_sql('r')} * 255, 0) AS r, round_even({clip_sql('g')} * 255, 0) AS g, round_even({clip_sql('b')} * 255, 0) AS b FROM px),
lv AS (SELECT *, round_even(r * 0.2126 + g * 0.7152 + b * 0.0722, 0) AS y FROM q)"""
DIMS = "dims AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM px GROUP BY image_id)"


def _histogram_sql(channels: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT image_id, '{n}' AS channel, {c} AS bin FROM lv" for n, c in channels.items())
    names = ", ".join(f"('{n}')" for n in channels)
    return with_("px", LEVELS + f", e AS ({each}), c AS (SELECT image_id, channel, CAST(bin AS INT) AS bin, count(*) AS n FROM e GROUP BY ALL) SELECT i.image_id, ch.channel, CAST(k AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM px) i, (VALUES {names}) ch(channel), range(256) r(k) LEFT JOIN c ON c.image_id = i.image_id AND c.channel = ch.channel AND c.bin = k")


@query(_histogram_sql({"red": "r", "green": "g", "blue": "b"}))
def histogram(spark, sf_dir):
    return p.histogram(px(spark, sf_dir))


@query(_histogram_sql({"luma": "y"}))
def luma_histogram(spark, sf_dir):
    return p.histogram(px(spark, sf_dir), ("luma",))


CLIPS = ", ".join(f"round(avg(CASE WHEN {c} = {v} THEN 1.0 ELSE 0.0 END), 9) AS {n}_{k}" for n, c in (("red", "r"), ("green", "g"), ("blue", "b"), ("luma", "y")) for k, v in (("shadow", 0), ("highlight", 255)))


@query(with_("px", LEVELS + f" SELECT image_id, {CLIPS} FROM lv GROUP BY image_id"))
def clip_fractions(spark, sf_dir):
    return rounded(p.clip_fractions(px(spark, sf_dir)))


GRAY = f"""m AS (SELECT image_id, greatest(avg({linear('r')}), 0.0001) AS r, greatest(avg({linear('g')}), 0.0001) AS g, greatest(avg({linear('b')}), 0.0001) AS b FROM px GROUP BY image_id)
SELECT image_id, {', '.join(f"round(least(greatest((r + g + b) / 3 / {c}, 0.25), 4), 9) AS gain_{c}" for c in 'rgb')} FROM m"""


@query(with_("px", GRAY))
def gray_world(spark, sf_dir):
    return rounded(p.gray_world(px(spark, sf_dir)))


@query(with_("px", f"""m AS (SELECT image_id, {', '.join(f"greatest(quantile_cont({linear(c)}, 0.99), 0.0001) AS {c}" for c in 'rgb')} FROM px GROUP BY image_id)
SELECT image_id, {', '.join(f"round(least(greatest(greatest(r, g, b) / {c}, 0.25), 4), 9) AS gain_{c}" for c in 'rgb')} FROM m"""))
def white_patch(spark, sf_dir):
    return rounded(p.white_patch(px(spark, sf_dir)))


def _black(k: str) -> list[str]:
    t = f"({k} / 100.0)"
    red = f"CASE WHEN {t} <= 66 THEN 255.0 ELSE 329.698727446 * pow({t} - 60, -0.1332047592) END"
    green = f"CASE WHEN {t} <= 66 THEN 99.4708025861 * ln({t}) - 161.1195681661 ELSE 288.1221695283 * pow({t} - 60, -0.0755148492) END"
    blue = f"CASE WHEN {t} >= 66 THEN 255.0 WHEN {t} <= 19 THEN 0.0 ELSE 138.5177312231 * ln(greatest({t} - 10, 1)) - 305.0447927307 END"
    return [linear(f"(least(greatest({c}, 0), 255) / 255)") for c in (red, green, blue)]


REF = "ref AS MATERIALIZED (SELECT {} AS fr, {} AS fg, {} AS fb)".format(*_black("6500.0"))


def _invert(src: str) -> str:
    """CTEs from src (id, gr, gg, gb: clamped gains) to bis: id, k, and the gains' red and blue at k."""
    r, g, b = (f"greatest({c}, 0.0001)" for c in _black("mid"))
    r2, g2, b2 = (f"greatest({c}, 0.0001)" for c in _black("k"))
    return f"""{REF}, steps AS (SELECT id, gr, gg, gb, 2000.0::DOUBLE AS lo, 12000.0::DOUBLE AS hi, 7000.0::DOUBLE AS mid, 0 AS n FROM {src}
 UNION ALL SELECT id, gr, gg, gb, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, (CASE WHEN up THEN mid ELSE lo END + CASE WHEN up THEN hi ELSE mid END) / 2, n + 1
 FROM (SELECT steps.*, (fr / {r} / (fg / {g})) / greatest(fb / {b} / (fg / {g}), 0.0001) < gr / greatest(gb, 0.0001) AS up FROM steps, ref WHERE n < 40)),
ends AS (SELECT id, gr, gg, gb, mid AS k FROM steps WHERE n = 40),
inv AS (SELECT ends.*, fr / {r2} / (fg / {g2}) AS kr, fb / {b2} / (fg / {g2}) AS kb FROM ends, ref),
wb AS (SELECT id, CAST(round_even(k, 0) AS BIGINT) AS temp_k, CAST(round_even(least(greatest((1 - sqrt(greatest(0.0001, kr / greatest(gr, 0.0001) * (kb / greatest(gb, 0.0001)))) * gg) / 0.5 * 150, -150), 150), 0) AS BIGINT) AS tint FROM inv)"""


@query(with_("px", f"""s AS (SELECT image_id AS id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px WHERE x BETWEEN 3 AND 7 AND y BETWEEN 4 AND 8 GROUP BY image_id),
l AS (SELECT id, greatest({linear('r')}, 0.0001) AS r, greatest({linear('g')}, 0.0001) AS g, greatest({linear('b')}, 0.0001) AS b FROM s),
gn AS (SELECT id, {', '.join(f"least(greatest((r + g + b) / 3 / {c}, 0.25), 4) AS g{c}" for c in 'rgb')} FROM l), {_invert('gn')}
SELECT id AS image_id, round(r, 9) AS r, round(g, 9) AS g, round(b, 9) AS b, temp_k, tint FROM s JOIN wb USING (id)"""))
def neutral_sample(spark, sf_dir):
    pix = px(spark, sf_dir)
    picks = p.sizes(pix).select("image_id", F.col("image_id").alias("pick_id"), F.lit(5).alias("px"), F.lit(6).alias("py"))
    return rounded(p.neutral_sample(pix, picks).drop("pick_id"))


@query(with_("px", f"SELECT {PLACE}, round({linear('r')}, 9) AS lin, round({encoded('g')}, 9) AS enc, round({encoded(linear('b'))}, 9) AS back FROM px"))
def srgb_linear(spark, sf_dir):
    return rounded(px(spark, sf_dir).select("image_id", "y", "x", color.srgb_to_linear(F.col("r")).alias("lin"), color.linear_to_srgb(F.col("g")).alias("enc"), color.linear_to_srgb(color.srgb_to_linear(F.col("b"))).alias("back")))


@query(with_("px", f"SELECT {PLACE}, round(pow({linear('r')}, {1 / 2.2!r}), 9) AS g22, round(pow({clip_sql('g')}, {1 / 1.8!r}), 9) AS g18, round({linear('b')}, 9) AS lin FROM px"))
def gamma_transfer(spark, sf_dir):
    f = color.working_to_display
    return rounded(px(spark, sf_dir).select("image_id", "y", "x", f(F.col("r"), "gamma22").alias("g22"), f(F.col("g"), "gamma18", "linear").alias("g18"), color.display_to_working(F.col("b"), "linear").alias("lin")))


@query(with_("px", f"SELECT {PLACE}, CAST(floor({clip_sql('r')} * 255) AS BIGINT) AS r8, CAST(floor({clip_sql('g')} * 255) AS BIGINT) AS g8, round(floor({clip_sql('b')} * 255) / 255, 9) AS b FROM px"))
def quantize(spark, sf_dir):
    return rounded(px(spark, sf_dir).select("image_id", "y", "x", color.quantize(F.col("r")).alias("r8"), color.quantize(F.col("g")).alias("g8"), (color.quantize(F.col("b")) / 255).alias("b")))


@query(with_("px", f"SELECT {PLACE}, round({clip_sql('r * 0.2126 + g * 0.7152 + b * 0.0722')}, 9) AS l FROM px"))
def luma(spark, sf_dir):
    return rounded(px(spark, sf_dir).select("image_id", "y", "x", color.luma(F.col("r"), F.col("g"), F.col("b")).alias("l")))


@query(with_("px", hsv("px", "hs") + f", {rgb('hs', 'back', 'h', 's', 'v')}, e AS (SELECT *, 0.299 * r8 + 0.587 * g8 + 0.114 * b8 AS yy FROM hs) SELECT e.image_id, e.y, e.x, h, s, v, round_even(yy, 0) AS luma8, round_even(least(greatest((r8 - yy) * 0.713 + 128, 0), 255), 0) AS cr, round_even(least(greatest((b8 - yy) * 0.564 + 128, 0), 255), 0) AS cb, round(back.r, 9) AS r, round(back.g, 9) AS g, round(back.b, 9) AS b FROM e JOIN back USING (image_id, y, x)"))
def rgb_hsv8(spark, sf_dir):
    df = color.with_hsv(px(spark, sf_dir)).withColumn("c", color.rgb_to_ycrcb8(*[color.quantize(F.col(c)) for c in "rgb"]))
    back = color.hsv8_to_rgb(F.col("_hsv.h"), F.col("_hsv.s"), F.col("_hsv.v"))
    return rounded(df.select("image_id", "y", "x", "_hsv.*", F.col("c.y").cast("double").alias("luma8"), F.col("c.cr").cast("double").alias("cr"), F.col("c.cb").cast("double").alias("cb"), *[v.alias(c) for c, v in zip("rgb", back)]))


def _lab(src: str, out: str) -> str:
    dot = lambda row, w: "(" + " + ".join(f"{m!r} * l{c}" for m, c in zip(row, "rgb")) + f") / {w!r}"
    root = lambda t: f"CASE WHEN {t} > 0.008856 THEN pow({t}, {1 / 3!r}) ELSE 7.787 * {t} + {16 / 116!r} END"
    q = lambda c: f"(floor({clip_sql(c)} * 255) / 255)"
    return f"""{out}_l AS (SELECT *, {linear(q('r'))} AS lr, {linear(q('g'))} AS lg_, {linear(q('b'))} AS lb FROM {src}),
{out}_x AS (SELECT *, {', '.join(dot(row, w).replace('lg', 'lg_') + f' AS {n}' for row, w, n in zip(color.XYZ, color.WHITE, ('xx', 'yy', 'zz')))} FROM {out}_l),
{out}_f AS (SELECT *, {root('xx')} AS fx, {root('yy')} AS fy, {root('zz')} AS fz FROM {out}_x),
{out} AS (SELECT *, round_even(least(greatest(CASE WHEN yy > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * yy END * 255 / 100, 0), 255), 0) AS l8, round_even(least(greatest(500 * (fx - fy) + 128, 0), 255), 0) AS a8, round_even(least(greatest(200 * (fy - fz) + 128, 0), 255), 0) AS bb8 FROM {out}_f)"""


def _unlab(src: str, out: str, a: str) -> str:
    back = lambda f: f"CASE WHEN {f} > 0.206893 THEN ({f}) * ({f}) * ({f}) ELSE ({f} - {16 / 116!r}) / 7.787 END"
    dot = lambda row: "(" + " + ".join(f"{m!r} * {v}" for m, v in zip(row, ("xx", "yy", "zz"))) + ")"
    return f"""{out}_a AS (SELECT {PLACE}, l8, a8, l8 * 100 / 255 AS li, {a} AS aa, bb8 FROM {src}),
{out}_y AS (SELECT *, CASE WHEN li > 8 THEN pow((li + 16) / 116, 3) ELSE li / 903.3 END AS yy FROM {out}_a),
{out}_f AS (SELECT *, CASE WHEN li > 8 THEN (li + 16) / 116 ELSE 7.787 * yy + {16 / 116!r} END AS fy FROM {out}_y),
{out}_x AS (SELECT *, ({back('(fy + (aa - 128) / 500)')}) * {color.WHITE[0]!r} AS xx, ({back('(fy - (bb8 - 128) / 200)')}) * {color.WHITE[2]!r} AS zz FROM {out}_f),
{out} AS (SELECT {PLACE}, l8, a8, bb8, {', '.join(f"round_even({encoded(dot(row))} * 255, 0) / 255 AS {c}" for row, c in zip(color.RGB, 'rgb'))} FROM {out}_x)"""


@query(with_("px", _lab("px", "lab") + f", {_unlab('lab', 'bk', 'a8')} SELECT {PLACE}, l8 AS l, a8 AS a, bb8 AS b, round(r, 9) AS back_r, round(g, 9) AS back_g, round(bk.b, 9) AS back_b FROM bk"))
def rgb_lab8(spark, sf_dir):
    df = px(spark, sf_dir).withColumn("lab", color.rgb_to_lab8(*[color.quantize(F.col(c)) for c in "rgb"]))
    back = color.lab8_to_rgb(F.col("lab.l"), F.col("lab.a"), F.col("lab.b"))
    return rounded(df.select("image_id", "y", "x", *[F.col(f"lab.{c}").cast("double").alias(c) for c in "lab"], *[v.alias(f"back_{c}") for c, v in zip("rgb", back)]))


@query(with_("px", shown(*[f"{clip_sql(f'{c} * {2 ** 0.35!r}')} AS {c}" for c in "rgb"]) + " FROM px"))
def exposure(spark, sf_dir):
    return rounded(color.exposure(px(spark, sf_dir), 35))


GRID = "kg AS (SELECT p_partkey AS id, 1800 + (p_partkey * 37) % 10500 AS kelvin, (p_partkey * 13) % 330 - 165 AS tint0 FROM part)"
GAINS = f"""{GRID}, {REF}, k2 AS (SELECT id, CAST(least(greatest(kelvin, 2000), 12000) AS DOUBLE) AS k, least(greatest(tint0, -150), 150) AS t FROM kg),
k3 AS (SELECT id, t, {', '.join(f'greatest({c}, 0.0001) AS k{n}' for c, n in zip(_black('k'), 'rgb'))} FROM k2),
gains AS (SELECT id, least(greatest(fr / kr / (fg / kg), 0.25), 4) AS gr, least(greatest(1 - t / 150 * 0.5, 0.25), 4) AS gg, least(greatest(fb / kb / (fg / kg), 0.25), 4) AS gb FROM k3, ref)"""


def _grid(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (1800 + (F.col("p_partkey") * 37) % 10500).alias("kelvin"), ((F.col("p_partkey") * 13) % 330 - 165).alias("tint"))


@query("WITH " + GAINS + " SELECT id, round(gr, 9) AS gain_r, round(gg, 9) AS gain_g, round(gb, 9) AS gain_b FROM gains")
def wb_gains(spark, sf_dir):
    return rounded(_grid(spark, sf_dir).select("id", *[v.alias(f"gain_{c}") for c, v in zip("rgb", color.gains_of(F.col("kelvin"), F.col("tint")))]))


@query("WITH RECURSIVE " + GAINS + ", " + _invert("gains").replace(REF + ", ", "") + " SELECT id, temp_k, tint FROM wb")
def wb_invert(spark, sf_dir):
    # A long computation on short rows: a file of them is one task, or a few, unless they are dealt out.
    rows = _grid(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "id")
    gains = rows.select("id", *[v.alias(f"g{c}") for c, v in zip("rgb", color.gains_of(F.col("kelvin"), F.col("tint")))])
    kelvin, tint = color.kelvin_tint_of(F.col("gr"), F.col("gg"), F.col("gb"))
    return gains.select("id", kelvin.alias("temp_k"), tint.alias("tint"))


@query(with_("px", shown(*[f"{encoded(clip_sql(f'{linear(c)} * {k}'))} AS {c}" for c, k in zip("rgb", (1.2, 0.9, 1.5))]) + " FROM px"))
def apply_wb(spark, sf_dir):
    return rounded(color.apply_gains(px(spark, sf_dir), (1.2, 0.9, 1.5)))


BAND = dict(blacks=5, shadows=12, midtones=-8, highlights=20, whites=-10)
CURVE = [(0.3, 0.2), (0.0, 0.05), (1.0, 0.95), (0.7, 0.85), (0.3004, 0.9)]


@query(with_("px", lut_sql("px", "o", band_sql(**BAND)) + " " + shown() + " FROM o"))
def band_tone(spark, sf_dir):
    return rounded(color.band_tone(px(spark, sf_dir), **BAND))


# Three knots between the ends, so that slopes need one step of the rule for inner points each.
def _curve_sql(points: str) -> str:
    return f"""{points}, sg AS (SELECT c, k, x, y, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d FROM pts WINDOW w AS (PARTITION BY c ORDER BY k)),
sl AS (SELECT *, CASE WHEN lag(d) OVER w IS NULL THEN d WHEN d IS NULL THEN lag(d) OVER w WHEN lag(d) OVER w * d <= 0 THEN 0.0
 ELSE (3 * h + 3 * lag(h) OVER w) / ((2 * h + lag(h) OVER w) / lag(d) OVER w + (h + 2 * lag(h) OVER w) / d) END AS m FROM sg WINDOW w AS (PARTITION BY c ORDER BY k)),
seg AS (SELECT *, lead(y) OVER w AS y1, lead(m) OVER w AS m1, lead(x) OVER w AS x1, lead(x, 2) OVER w IS NULL AS final FROM sl WINDOW w AS (PARTITION BY c ORDER BY k)),
ev AS (SELECT c, i, (i / 255 - x) / h AS t, h, y, y1, m, m1 FROM seg, range(256) r(i) WHERE h IS NOT NULL AND i / 255 >= x AND (i / 255 < x1 OR final)),
lut AS (SELECT c, i, {clip_sql('(2*t*t*t - 3*t*t + 1) * y + (t*t*t - 2*t*t + t) * h * m + (3*t*t - 2*t*t*t) * y1 + (t*t*t - t*t) * h * m1')} AS v FROM ev)"""


ONE = _curve_sql("pts(c, k, x, y) AS (VALUES (0, 0, 0.0::DOUBLE, 0.05::DOUBLE), (0, 1, 0.3, 0.2), (0, 2, 0.7, 0.85), (0, 3, 1.0, 0.95))")


@query(with_("px", ONE + ", " + lut_sql("px", "o", "(SELECT list(v ORDER BY i) FROM lut)") + " " + shown() + " FROM o"))
def apply_curve(spark, sf_dir):
    return rounded(color.apply_curve(px(spark, sf_dir), CURVE))


MANY = _curve_sql("pts AS (SELECT p_partkey AS c, k, CASE k WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.1 + (p_partkey % 7) / 20 WHEN 2 THEN 0.5 + (p_partkey % 9) / 20 ELSE 1.0 END AS x, ((p_partkey * (k + 3) * 7) % 101) / 100 AS y FROM part, range(4) r(k))")


@query("WITH " + MANY + " SELECT c AS curve_id, CAST(i AS INT) AS level, round(v, 9) AS v FROM lut")
def curve_lut(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("curve_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    c, k = F.col("curve_id"), F.col("k")
    x = F.when(k == 0, F.lit(0.0)).when(k == 1, 0.1 + (c % 7) / 20).when(k == 2, 0.5 + (c % 9) / 20).otherwise(F.lit(1.0))
    from pixelframe.operators.curves import curve_luts

    return rounded(curve_luts(part.select("curve_id", x.alias("x"), (((c * (k + 3) * 7) % 101) / 100).alias("y"))))


@query(with_("px", saturated("px", "o", 40) + " " + shown() + " FROM o"))
def saturation(spark, sf_dir):
    return rounded(color.saturation(px(spark, sf_dir), 40))


@query(with_("px", hsv("px", "a") + ", " + rgb("a", "o", "(h + 30 * 0.9) % 180", "s", "v") + " " + shown() + " FROM o"))
def hue_shift(spark, sf_dir):
    return rounded(color.hue_shift(px(spark, sf_dir), 30))


@query(with_("px", warmed("px", "o", 60) + " " + shown() + " FROM o"))
def warmth(spark, sf_dir):
    return rounded(color.warmth(px(spark, sf_dir), 60))


def _tinted(src: str, out: str, delta: float) -> str:
    c = {x: clip_sql(x) for x in "rgb"}
    mean = f"(({c['r']} + {c['g']} + {c['b']}) / 3)"
    var = " + ".join(f"({v} - {mean}) * ({v} - {mean})" for v in c.values())
    weight = "least(greatest(sd * 4, 0.12), 1) * least(greatest(1 - abs(l8 / 255 - 0.55) * 1.4, 0.25), 1)"
    return _lab(src, f"{out}0") + f", {out}1 AS (SELECT *, sqrt(({var}) / 3) AS sd FROM {out}0), " + _unlab(f"{out}1", out, f"floor(least(greatest(a8 + {delta / 100 * 9!r} * {weight}, 0), 255))")


@query(with_("px", _tinted("px", "o", 50) + " " + shown() + " FROM o"))
def tint(spark, sf_dir):
    return rounded(color.tint(px(spark, sf_dir), 50))


MIX = {"red": {"hue": 20, "sat": -30, "lum": 0}, "green": {"hue": 0, "sat": 50, "lum": 25}, "blue": {"hue": -40, "sat": 0, "lum": -20}, "yellow": {"hue": 0, "sat": 0, "lum": 0}}


def _mixed(src: str, out: str) -> str:
    sums = {k: [] for k in ("hue", "sat", "lum")}
    for name, change in MIX.items():
        away = f"least(abs(h * 2 - {color.BANDS[name]!r}), 360 - abs(h * 2 - {color.BANDS[name]!r}))"
        for k, scale in (("hue", 0.30), ("sat", 0.01), ("lum", 0.01)):
            if change[k]:
                sums[k].append(f"(CASE WHEN {away} < 45 THEN 0.5 * (1 + cos(pi() * {away} / 45)) ELSE 0 END) * least(s / 255 / 0.15, 1) * {change[k]} * {scale}")
    total = {k: " + ".join(v) for k, v in sums.items()}
    return hsv(src, f"{out}0") + f", {out}1 AS (SELECT *, {total['hue']} AS mh, {total['sat']} AS ms, {total['lum']} AS ml FROM {out}0), " + rgb(f"{out}1", out, "least(((h * 2 + mh) % 360 + 360) % 360 / 2, 179)", f"{clip_sql('s / 255 * (1 + ms)')} * 255", f"{clip_sql('v / 255 * (1 + ml * 0.5)')} * 255")


@query(with_("px", _mixed("px", "o") + " " + shown() + " FROM o"))
def color_mixer(spark, sf_dir):
    return rounded(color.color_mixer(px(spark, sf_dir), MIX))


def vignette_sql(src: str, out: str, amount: float) -> str:
    mask = f"1 - {clip_sql(f'sqrt(((x - width / 2) / (width / 2)) * ((x - width / 2) / (width / 2)) + ((y - height / 2) / (height / 2)) * ((y - height / 2) / (height / 2))) * {abs(amount)} / 100')}"
    mask = f"2 - ({mask})" if amount < 0 else mask
    return f"{out} AS (SELECT {PLACE}, {', '.join(clip_sql(f'{c} * ({mask})') + f' AS {c}' for c in 'rgb')} FROM {src} JOIN dims USING (image_id))"


@query(with_("px", DIMS + ", " + vignette_sql("px", "o", -45) + " " + shown() + " FROM o"))
def vignette(spark, sf_dir):
    pix = px(spark, sf_dir)
    return rounded(color.vignette(pix.join(p.sizes(pix), "image_id"), -45, F.col("width"), F.col("height")).drop("width", "height"))


@query(with_("px", f"SELECT {PLACE}, round({clip_sql('CASE WHEN r <= 0.5 THEN 2 * r * g ELSE 1 - 2 * (1 - r) * (1 - g) END')}, 9) AS overlay, round({clip_sql('(1 - 2 * g) * (r * r) + 2 * g * r')}, 9) AS soft_light, round(g, 9) AS normal FROM px"))
def blend_modes(spark, sf_dir):
    r, g = F.col("r"), F.col("g")
    return rounded(px(spark, sf_dir).select("image_id", "y", "x", *[color.blend(r, g, m).alias(m) for m in ("overlay", "soft_light", "normal")]))


# Each preset of the catalogue is ordered for one image.
@query(with_("px ps", "todo AS (SELECT preset_id, preset_id % (SELECT max(image_id) FROM px) + 1 AS image_id, pow(2.0, exposure / 100) AS k FROM ps) "
             f"SELECT preset_id, {PLACE}, " + ", ".join(f"round({clip_sql(f'{c} * k')}, 9) AS {c}" for c in "rgb") + " FROM px JOIN todo USING (image_id)"))  # fmt: skip
def apply_presets(spark, sf_dir):
    presets, images = ps(spark, sf_dir), table(spark, sf_dir, "lineitem").agg(F.max("l_suppkey").alias("n"))
    work = presets.crossJoin(F.broadcast(images)).select("preset_id", (F.col("preset_id") % F.col("n") + 1).alias("image_id"))
    return rounded(p.apply_presets(px(spark, sf_dir), presets, work))


@query(with_("px", shown(*[f"least(floor({clip_sql(c)} * 255) * (1 + image_id % 5) / 255, 1) AS {c}" for c in "rgb"]) + " FROM px"))
def lut1d_lookup(spark, sf_dir):
    pix = px(spark, sf_dir)
    lut = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.least(k * (1 + F.col("image_id") % 5) / 255, F.lit(1.0)))
    return rounded(p.lut1d_lookup(pix, pix.select("image_id").distinct().withColumn("lut", lut)))


# A LUT for each nation, of 2 to 4 steps: red is squared, green and blue are swapped and scaled.
LUTS = """luts AS (SELECT n_nationkey AS lut_id, 2 + n_nationkey % 3 AS size, ri, gi, bi, pow(ri / (1 + n_nationkey % 3), 2) AS r, bi / (1 + n_nationkey % 3) * 0.9 AS g, gi / (1 + n_nationkey % 3) * 0.8 AS b
 FROM nation, range(4) a(ri), range(4) b(gi), range(4) c(bi) WHERE ri < 2 + n_nationkey % 3 AND gi < 2 + n_nationkey % 3 AND bi < 2 + n_nationkey % 3)"""


def _luts(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey") % 3 + 1
    df = table(spark, sf_dir, "nation").select("n_nationkey", n.cast("int").alias("top"))
    for c in ("bi", "gi", "ri"):
        df = df.withColumn(c, F.explode(F.sequence(F.lit(0), F.col("top"))))
    top = F.col("top")
    return df.select(F.col("n_nationkey").alias("lut_id"), (top + 1).alias("size"), "ri", "gi", "bi", F.pow(F.col("ri") / top, F.lit(2.0)).alias("r"), (F.col("bi") / top * 0.9).alias("g"), (F.col("gi") / top * 0.8).alias("b"))


def _corner(k: int) -> str:
    up = [k >> 2 & 1, k >> 1 & 1, k & 1]
    return " AND ".join(f"l{k}.{c}i = least({c}0 + {u}, fr.size - 1)" for c, u in zip("rgb", up))


def _weight(k: int) -> str:
    return " * ".join(f"{c}d" if u else f"(1 - {c}d)" for c, u in zip("rgb", [k >> 2 & 1, k >> 1 & 1, k & 1]))


@query(with_("px", LUTS + f""", sz AS (SELECT DISTINCT lut_id, size FROM luts), co AS (SELECT {PLACE}, lut_id, size, {', '.join(f'{clip_sql(c)} * (size - 1) AS p{c}' for c in 'rgb')} FROM px JOIN sz ON lut_id = image_id % 25),
fr AS (SELECT *, {', '.join(f'floor(p{c}) AS {c}0, p{c} - floor(p{c}) AS {c}d' for c in 'rgb')} FROM co)
SELECT fr.image_id, fr.y, fr.x, {', '.join("round(" + clip_sql(' + '.join(f'{_weight(k)} * l{k}.{c}' for k in range(8))) + f", 9) AS {c}" for c in 'rgb')} FROM fr {' '.join(f'JOIN luts l{k} ON l{k}.lut_id = fr.lut_id AND {_corner(k)}' for k in range(8))}"""))
def lut3d_trilinear(spark, sf_dir):
    return rounded(p.lut3d_trilinear(px(spark, sf_dir).withColumn("lut_id", F.col("image_id") % 25), _luts(spark, sf_dir)))


@query("WITH " + LUTS + " SELECT 'lut' || lut_id AS lut_id, CAST(size AS INT) AS size, CAST(ri AS INT) AS ri, CAST(gi AS INT) AS gi, CAST(bi AS INT) AS bi, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM luts WHERE lut_id <> 3")
def lut_catalog(spark, sf_dir):
    """The LUTs written as .cube texts, one without its last row, and loaded."""
    row = F.concat_ws(" ", *[F.format_string("%.6f", F.col(c)) for c in "rgb"])
    rows = F.transform(F.array_sort(F.collect_list(F.struct("bi", "gi", "ri", row.alias("row")))), lambda s: s.row)
    cubes = _luts(spark, sf_dir).groupBy("lut_id", "size").agg(rows.alias("rows"))
    rows = F.when(F.col("lut_id") == 3, F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows"))
    text = F.concat(F.lit('TITLE "lut'), F.col("lut_id").cast("string"), F.lit('"\n# made\nLUT_3D_SIZE '), F.col("size").cast("string"), F.lit("\n"), F.array_join(rows, "\n"))
    path = new_path(spark, "luts")
    cubes.select(text.alias("value"), F.col("lut_id").alias("part")).write.partitionBy("part").text(path)
    return files.scan_luts(spark, path + "/*")


BOX = (0.13, 0.21, 0.5, 0.4)


@query(with_("px", DIMS + f""", bx AS (SELECT *, greatest(0, least(width - 1, CAST(round_even(0.13 * width, 0) AS INT))) AS x0, greatest(0, least(height - 1, CAST(round_even(0.21 * height, 0) AS INT))) AS y0 FROM dims),
b2 AS (SELECT *, greatest(x0 + 1, least(width, CAST(round_even({0.13 + 0.5!r} * width, 0) AS INT))) AS x1, greatest(y0 + 1, least(height, CAST(round_even({0.21 + 0.4!r} * height, 0) AS INT))) AS y1 FROM bx)
{shown(place='image_id, y - y0 AS y, x - x0 AS x')} FROM px JOIN b2 USING (image_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1"""))
def crop_pixels(spark, sf_dir):
    pix = px(spark, sf_dir)
    return rounded(p.crop(pix, p.sizes(pix), BOX))


@query(with_("px", DIMS + f" {shown(place='image_id, height - 1 - y AS y, width - 1 - x AS x')} FROM px JOIN dims USING (image_id)"))
def flip_pixels(spark, sf_dir):
    pix = px(spark, sf_dir)
    return rounded(p.flip(pix, p.sizes(pix), True, True))


@query(with_("px", DIMS + """, w AS (SELECT image_id, least(greatest(CASE WHEN 0.6 >= width / height THEN 1.0 ELSE 0.6 / (width / height) END, 0.05), 1) AS w, least(greatest(CASE WHEN 0.6 >= width / height THEN width / height / 0.6 ELSE 1.0 END, 0.05), 1) AS h FROM dims)
SELECT image_id, round((1 - w) / 2, 9) AS x, round((1 - h) / 2, 9) AS y, round(w, 9) AS w, round(h, 9) AS h FROM w"""))
def aspect_crop(spark, sf_dir):
    return rounded(p.aspect_crop(p.sizes(px(spark, sf_dir)), 0.6))


@query(with_("px", hsv("px", "hs") + f""", e AS (SELECT *, 0.299 * r8 + 0.587 * g8 + 0.114 * b8 AS yy FROM hs), f AS (SELECT *, round_even(least(greatest((r8 - yy) * 0.713 + 128, 0), 255), 0) AS cr, round_even(least(greatest((b8 - yy) * 0.564 + 128, 0), 255), 0) AS cb FROM e)
SELECT {PLACE}, CASE WHEN (h <= 25 AND s >= 20 AND v >= 60) OR (h <= 20 AND s BETWEEN 10 AND 180 AND v BETWEEN 40 AND 200) OR (cr BETWEEN 133 AND 173 AND cb BETWEEN 77 AND 127) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v FROM f"""))
def color_range_mask(spark, sf_dir):
    return p.color_range_mask(px(spark, sf_dir))


@query(with_("px", DIMS + f" SELECT o.image_id, o.y, o.x, " + ", ".join(f"round(CASE WHEN o.x < CAST(round_even(0.4 * width, 0) AS INT) THEN o.{c} ELSE {clip_sql(f'o.{c} * 2')} END, 9) AS {c}" for c in "rgb") + " FROM px o JOIN dims USING (image_id)"))
def compare_split(spark, sf_dir):
    pix = px(spark, sf_dir)
    return rounded(p.compare_split(pix, color.exposure(pix, 100), p.sizes(pix), 0.4))


EDGE = f"""lm AS (SELECT {PLACE}, {clip_sql('r * 0.2126 + g * 0.7152 + b * 0.0722')} AS l FROM px),
gr AS (SELECT *, coalesce((lead(l) OVER (PARTITION BY image_id, y ORDER BY x) - lag(l) OVER (PARTITION BY image_id, y ORDER BY x)) * 0.5, 0) AS gx, coalesce((lead(l) OVER (PARTITION BY image_id, x ORDER BY y) - lag(l) OVER (PARTITION BY image_id, x ORDER BY y)) * 0.5, 0) AS gy FROM lm)"""


@query(with_("px", EDGE + f" SELECT {PLACE}, round({clip_sql('1 - sqrt(gx * gx + gy * gy) * 2.5')}, 9) AS v FROM gr"))
def edge_guard(spark, sf_dir):
    return rounded(p.edge_guard(px(spark, sf_dir)))


@query(with_("fl", "SELECT path FROM fl WHERE regexp_matches(lower(path), '\\.(arw|bmp|cr2|dng|jpeg|jpg|nef|png|raw|tif|tiff)$') ORDER BY path"))
def image_listing(spark, sf_dir):
    """The listing's predicate and order over a table of paths; list_images reads a folder."""
    return fl(spark, sf_dir).where(files.is_image(F.col("path"))).orderBy("path")


@query(with_("px", shown() + " FROM px"))
def pixel_store(spark, sf_dir):
    path = new_path(spark, "pixels")
    files.store_pixels(px(spark, sf_dir), path)
    return rounded(spark.read.parquet(path).drop("bucket"))


def flagship(spark, sf_dir):
    """Clipped shares, grey-world gains and the (Kelvin, tint) these stand for, by image."""
    pix = px(spark, sf_dir)
    joined = p.clip_fractions(pix).join(p.gray_world(pix), "image_id")
    kelvin, tint_ = color.kelvin_tint_of(F.col("gain_r"), F.col("gain_g"), F.col("gain_b"))
    return joined.withColumn("temp_k", kelvin).withColumn("tint", tint_)


@query(with_("px", DIMS + """, f AS (SELECT image_id, CAST(j AS INT) AS y, CAST(i AS INT) AS x FROM (SELECT image_id, height, unnest(range(width)) AS i FROM dims), LATERAL (SELECT unnest(range(height)) AS j))
SELECT image_id, f.y, f.x, """ + ", ".join(f"round(coalesce(floor({clip_sql(c)} * 255), 0) / 255, 9) AS {c}" for c in "rgb") + " FROM f LEFT JOIN px USING (image_id, y, x)"))
def image_pixels(spark, sf_dir):
    """All images written as PNG files in the shared folder, listed, and decoded again."""
    folder = new_path(spark, "images")
    written = files.write_png(px(spark, sf_dir), folder)
    listed = files.list_images(spark, folder).select(F.col("path").alias("image_id"), F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name"))
    images = files.read_images(spark, folder).join(listed, "image_id").join(written.select("name"), "name")
    return rounded(files.pixels_of(images.withColumn("image_id", F.col("name").cast("long"))))
