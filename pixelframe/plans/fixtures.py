"""Operator inputs derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels, 16 to a row: image_id, y, x, r, g, b."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax", (F.row_number().over(w) - 1).alias("k"))
    return rows.select(F.col("l_suppkey").alias("image_id"), F.floor(F.col("k") / 16).cast("int").alias("y"), F.pmod("k", F.lit(16)).cast("int").alias("x"), (F.col("l_quantity") / 50).cast("double").alias("r"), (F.col("l_discount") / 0.10).cast("double").alias("g"), (F.col("l_tax") / 0.08).cast("double").alias("b"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("i", "e"))


def msk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft 8 x 8 masks: image_id, layer_id, y, x, v."""
    v = F.greatest(F.least(F.col("e").cast("double") + 0.5, F.lit(1.0)), F.lit(0.0))
    return _cells(spark, sf_dir).select("image_id", F.pmod("label", F.lit(3)).cast("int").alias("layer_id"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.pmod("i", F.lit(8)).cast("int").alias("x"), v.alias("v"))


def scr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores, 64 to a pixel: image_id, class_id, score."""
    return _cells(spark, sf_dir).select("image_id", F.col("i").cast("int").alias("class_id"), F.col("e").cast("double").alias("score"))


def lg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger: seq (file order), ts, job_id, batch_key, status, source_path, output_path, error."""
    failed = (F.col("event_type") == "error") & (F.pmod("user_id", F.lit(3)) == 0)
    n = F.pmod("event_id", F.lit(997)).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("job_id"), F.concat(F.lit("k"), F.pmod("user_id", F.lit(20)).cast("string")).alias("batch_key"),
        F.when(failed, "error").when(F.col("event_type") == "click", "skipped").otherwise("success").alias("status"),
        F.concat(F.lit("/in/"), n, F.lit(".jpg")).alias("source_path"), F.concat(F.lit("/out/"), n, F.lit("_enhanced.jpg")).alias("output_path"),
        F.when(failed, F.concat(F.lit("err "), F.pmod("event_id", F.lit(7)).cast("string"))).alias("error"))


def jb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs: job_id, mode, source_count."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.lower("c_mktsegment").alias("mode"), (55 + F.col("c_nationkey")).alias("source_count"))


def fl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's listing: path."""
    kinds = F.array(*map(F.lit, ("JPG", "jpg", "png", "cr2", "txt", "TIFF", "webp", "bmp")))
    name = F.concat(F.lit("/in/"), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("."), F.get(kinds, F.pmod("p_partkey", F.lit(8)).cast("int")))
    return table(spark, sf_dir, "part").select(name.alias("path"))


def ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets: preset_id, name, category, tags_csv, exposure, opacity."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("preset_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.concat("p_brand", F.lit(", "), F.upper("p_type"), F.lit(" ,")).alias("tags_csv"), (F.col("p_size") - 25).cast("double").alias("exposure"), (F.col("p_retailprice") / 10).cast("double").alias("opacity"))


def dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in a 160 x 160 frame: image_id, det_id, x, y, w, h."""
    w = Window.partitionBy("image_id").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    # Rows are dealt by image_id itself, so that what else is done by image needs no other shuffle.
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image_id").select("image_id", F.row_number().over(w).cast("long").alias("det_id"), (F.col("l_quantity") * 3.7 - 20).cast("double").alias("x"), (F.col("l_extendedprice") / 600.0).cast("double").alias("y"), (F.col("l_linenumber") * 7.3).cast("double").alias("w"), (F.pmod("l_suppkey", F.lit(40)) + 0.5).cast("double").alias("h"))


SQL = {
    "px": """px AS (SELECT l_suppkey AS image_id, CAST(floor((rn - 1) / 16) AS INT) AS y, CAST((rn - 1) % 16 AS INT) AS x, CAST(l_quantity / 50 AS DOUBLE) AS r, CAST(l_discount / 0.10 AS DOUBLE) AS g, CAST(l_tax / 0.08 AS DOUBLE) AS b
 FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem))""",
    "msk": """msk AS (SELECT vec_id AS image_id, CAST(label % 3 AS INT) AS layer_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, least(greatest(CAST(embedding[i + 1] AS DOUBLE) + 0.5, 0), 1) AS v FROM embeddings, range(64) t(i))""",
    "scr": """scr AS (SELECT vec_id AS image_id, CAST(i AS INT) AS class_id, CAST(embedding[i + 1] AS DOUBLE) AS score FROM embeddings, range(64) t(i))""",
    "lg": """lg AS (SELECT event_id AS seq, ts, user_id AS job_id, 'k' || CAST(user_id % 20 AS VARCHAR) AS batch_key, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'error' WHEN event_type = 'click' THEN 'skipped' ELSE 'success' END AS status,
 '/in/' || CAST(event_id % 997 AS VARCHAR) || '.jpg' AS source_path, '/out/' || CAST(event_id % 997 AS VARCHAR) || '_enhanced.jpg' AS output_path, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'err ' || CAST(event_id % 7 AS VARCHAR) END AS error FROM events)""",
    "jb": "jb AS (SELECT c_custkey AS job_id, lower(c_mktsegment) AS mode, 55 + c_nationkey AS source_count FROM customer)",
    "fl": """fl AS (SELECT '/in/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.' || CASE p_partkey % 8 WHEN 0 THEN 'JPG' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 3 THEN 'cr2' WHEN 4 THEN 'txt' WHEN 5 THEN 'TIFF' WHEN 6 THEN 'webp' ELSE 'bmp' END AS path FROM part)""",
    "ps": """ps AS (SELECT p_partkey AS preset_id, p_name AS name, p_type AS category, p_brand || ', ' || upper(p_type) || ' ,' AS tags_csv, CAST(p_size - 25 AS DOUBLE) AS exposure, CAST(p_retailprice / 10 AS DOUBLE) AS opacity FROM part)""",
    "dt": """dt AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS det_id, CAST(l_quantity * 3.7 - 20 AS DOUBLE) AS x, CAST(l_extendedprice / 600.0 AS DOUBLE) AS y, CAST(l_linenumber * 7.3 AS DOUBLE) AS w, CAST((l_suppkey % 40) + 0.5 AS DOUBLE) AS h FROM lineitem)""",
}


def with_(names: str, body: str) -> str:
    """SQL that has the named inputs, and further common table expressions before its SELECT, if any."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names.split()) + (", " if body.lstrip()[:6].upper() != "SELECT" else " ") + body
