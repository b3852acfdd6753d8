"""Queries over the ledger, jobs and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelframe.operators import catalogue, ledger
from pixelframe.plans.fixtures import fl, jb, lg, with_
from pixelframe.plans.registry import query
from pixelframe.sources import files
from pixelframe.sources.shared import cut, new_path
from pixelframe.streaming import ledger_stream

EXT = "regexp_matches(lower(path), '\\.(arw|bmp|cr2|dng|jpeg|jpg|nef|png|raw|tif|tiff)$')"
PLAN = f"""plan AS (SELECT path AS source_path, '/out/' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') || '_enhanced.jpg' AS output_path FROM fl WHERE {EXT}),"""
# Planned rows: every source of the ledger under its batch. Of four outputs, one has gone.
PLANNED = """planned AS (SELECT DISTINCT batch_key, source_path, output_path FROM lg), outs AS (SELECT DISTINCT output_path AS path FROM lg WHERE seq % 4 <> 0),
skip AS (SELECT DISTINCT p.* FROM planned p JOIN (SELECT * FROM lg WHERE status = 'success') d USING (batch_key, source_path, output_path) JOIN outs ON outs.path = p.output_path)"""


def _planned(spark, sf_dir):
    log = lg(spark, sf_dir)
    return log.select(*ledger.KEYS).distinct(), log, log.where("seq % 4 <> 0").select(F.col("output_path").alias("path")).distinct()


def _records(log):
    """The ledger as its file has it: all text."""
    none = F.lit(None).cast("string")
    have = {c: F.col(c).cast("string") for c in ("batch_key", "error", "job_id", "output_path", "source_path", "status")} | {"ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")}
    return log.select(*[have.get(c, none).alias(c) for c in files.LEDGER_FIELDS])


@query(with_("fl", f"SELECT path FROM fl WHERE {EXT}"))
def supported_files(spark, sf_dir):
    return catalogue.supported_files(fl(spark, sf_dir))


@query(with_("fl", PLAN + " SELECT *, count(*) OVER (PARTITION BY output_path) > 1 AS collides FROM plan"))
def plan_outputs(spark, sf_dir):
    return catalogue.plan_outputs(fl(spark, sf_dir), "/out", "_enhanced", "jpeg")


@query(with_("ps", """t AS (SELECT preset_id, '{"category":"' || category || '","name":"' || name || '","size":' || CAST(CAST(exposure AS BIGINT) AS VARCHAR) || '}' AS j FROM ps)
SELECT preset_id, sha256(j) AS preset_hash, '{"format": "jpeg", "preset_hash": "' || sha256(j) || '", "suffix": "_x"}' AS batch_key FROM t"""))
def batch_identity(spark, sf_dir):
    from pixelframe.plans.fixtures import ps

    text = F.to_json(F.struct(F.col("name"), F.col("exposure").cast("long").alias("size"), F.col("category")))
    canonical = ps(spark, sf_dir).select("preset_id", catalogue.canonical_json(text).alias("j"))
    hashed, key = catalogue.batch_identity(F.col("j"), "_x", "jpeg")
    return canonical.select("preset_id", hashed.alias("preset_hash"), key.alias("batch_key"))


@query(with_("lg", """k AS (SELECT *, row_number() OVER (PARTITION BY batch_key, source_path, output_path ORDER BY seq DESC) AS n FROM lg WHERE status = 'success')
SELECT batch_key, source_path, output_path, seq FROM k WHERE n = 1"""))
def last_success(spark, sf_dir):
    return ledger.last_success(lg(spark, sf_dir)).select("batch_key", "source_path", "output_path", "seq")


@query(with_("lg", PLANNED + " SELECT * FROM skip"))
def skip_plan(spark, sf_dir):
    return ledger.skip_plan(*_planned(spark, sf_dir))


@query(with_("lg", PLANNED + " SELECT p.*, CASE WHEN s.batch_key IS NULL THEN 'pending' ELSE 'skipped' END AS status FROM planned p LEFT JOIN skip s USING (batch_key, source_path, output_path)"))
def pending_work(spark, sf_dir):
    return ledger.pending_work(*_planned(spark, sf_dir))


LATEST = """g AS (SELECT batch_key FROM lg GROUP BY batch_key HAVING bool_or(status = 'error') ORDER BY max(ts) DESC, min(seq) LIMIT 1)"""


@query(with_("lg", LATEST + " SELECT seq, batch_key, status, source_path FROM lg WHERE batch_key IN (SELECT batch_key FROM g)"))
def latest_failed_group(spark, sf_dir):
    return ledger.latest_failed_group(lg(spark, sf_dir)).select("seq", "batch_key", "status", "source_path")


@query(with_("lg", LATEST + " SELECT seq, source_path, sha256(batch_key) AS preset_hash FROM lg WHERE status = 'error' AND batch_key IN (SELECT batch_key FROM g)"))
def retry_set(spark, sf_dir):
    log = lg(spark, sf_dir).withColumn("preset_hash", F.sha2("batch_key", 256))
    return ledger.retry_set(log, log.select("preset_hash"))


ROLLUP = """r AS (SELECT job_id, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error, max_by(error, seq) FILTER (status = 'error') AS latest_error, count(*) AS records FROM lg GROUP BY job_id)"""


@query(with_("lg", ROLLUP + " SELECT * FROM r"))
def job_rollup(spark, sf_dir):
    return ledger.job_rollup(lg(spark, sf_dir))


@query(with_("lg jb", ROLLUP + """ SELECT job_id, mode, source_count, coalesce(success, 0) AS success, coalesce(skipped, 0) AS skipped, coalesce(error, 0) AS error, coalesce(latest_error, '') AS latest_error,
 CASE WHEN records IS NULL THEN 'queued' WHEN error > 0 THEN 'error' WHEN success + skipped >= source_count AND source_count > 0 THEN 'complete' ELSE 'running' END AS status FROM jb LEFT JOIN r USING (job_id)"""))
def job_status(spark, sf_dir):
    return ledger.job_status(jb(spark, sf_dir), lg(spark, sf_dir))


@query(with_("lg", """e AS (SELECT batch_key, string_agg(source_path || ': ' || error, '; ' ORDER BY seq) AS f FROM (SELECT *, row_number() OVER (PARTITION BY batch_key ORDER BY seq) AS n FROM lg WHERE status = 'error') WHERE n <= 8 GROUP BY batch_key)
SELECT batch_key, count(*) FILTER (status = 'success') AS completed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS failed, coalesce(any_value(f), '') AS failures FROM lg LEFT JOIN e USING (batch_key) GROUP BY batch_key"""))
def batch_summary(spark, sf_dir):
    return ledger.batch_summary(lg(spark, sf_dir))


@query(with_("fl", PLAN + " o AS (SELECT output_path FROM plan WHERE length(output_path) % 3 = 0) SELECT count(*) AS supported, count(*) FILTER (output_path IN (SELECT output_path FROM o)) AS likely_skipped, count(*) FILTER (output_path NOT IN (SELECT output_path FROM o)) AS to_process FROM plan"))
def batch_estimate(spark, sf_dir):
    plan = catalogue.plan_outputs(fl(spark, sf_dir), "/out", "_enhanced", "jpeg")
    return ledger.batch_estimate(plan, plan.where("length(output_path) % 3 = 0").select(F.col("output_path").alias("path")))


@query(with_("lg", "SELECT source_path, max(seq) AS seq FROM lg GROUP BY source_path ORDER BY seq DESC LIMIT 8"))
def recent_presets(spark, sf_dir):
    return ledger.recent_sources(lg(spark, sf_dir))


TEXT = "CAST(job_id AS VARCHAR) AS job_id, batch_key, status, source_path, output_path, error, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts"


def _shown(df):
    return df.select("job_id", "batch_key", "status", "source_path", "output_path", "error", "ts")


@query(with_("lg", f"SELECT {TEXT} FROM lg"))
def ledger_scan(spark, sf_dir):
    """A ledger written with blank, broken and odd lines between its records."""
    path = new_path(spark, "ledger")
    log = _records(lg(spark, sf_dir)).select(F.to_json(F.struct("*")).alias("value"))
    odd = log.limit(1).select(F.explode(F.array(F.lit(""), F.lit('{"status": "succ'), F.lit("17"))).alias("value"))
    log.union(odd).write.text(path)
    return _shown(files.scan_ledger(spark, path))


@query(with_("lg", f"SELECT {TEXT} FROM lg"))
def ledger_append(spark, sf_dir):
    """The ledger appended in two batches and read back."""
    path = new_path(spark, "ledger")
    log = lg(spark, sf_dir)
    for part in ("seq % 2 = 0", "seq % 2 = 1"):
        files.append_ledger(_records(log.where(part)), path)
    return _shown(files.scan_ledger(spark, path))


@query(with_("jb", "SELECT 'job_' || CAST(job_id AS VARCHAR) AS job_id, mode, job_id % 2 = 0 AS skip_completed, source_count AS sources FROM jb"))
def job_scan(spark, sf_dir):
    path = new_path(spark, "jobs")
    name = F.concat(F.lit("job_"), F.col("job_id").cast("string"))
    paths = F.transform(F.sequence(F.lit(1), F.col("source_count").cast("int")), lambda k: F.concat(F.lit("/in/"), k.cast("string"), F.lit(".jpg")))
    jb(spark, sf_dir).select(F.to_json(F.struct(name.alias("job_id"), "mode", (F.col("job_id") % 2 == 0).alias("skip_completed"), paths.alias("source_paths")))).repartition(8).write.text(path)
    return files.scan_jobs_lines(spark, path).select("job_id", "mode", "skip_completed", F.size("source_paths").cast("long").alias("sources"))


@query(with_("lg", ROLLUP + " SELECT job_id, success, skipped, error, latest_error, records FROM r"))
def stream_job_status(spark, sf_dir):
    """The rollup kept by a stream over the ledger's files; equals the batch rollup."""
    path = new_path(spark, "ledger")
    lg(spark, sf_dir).select("seq", F.col("job_id"), "status", "error").repartition(4).write.json(path)
    return ledger_stream.rollup_of(spark, path)


@query(with_("lg jb", ROLLUP + """ SELECT job_id, mode, source_count, coalesce(success, 0) AS success, coalesce(skipped, 0) AS skipped, coalesce(error, 0) AS error, coalesce(latest_error, '') AS latest_error,
 CASE WHEN records IS NULL THEN 'queued' WHEN error > 0 THEN 'error' WHEN success + skipped >= source_count AND source_count > 0 THEN 'complete' ELSE 'running' END AS status FROM jb LEFT JOIN r USING (job_id)"""))
def stream_jobs(spark, sf_dir):
    """Jobs with their status, kept by a stream over the ledger's files that joins them batch by batch."""
    path = new_path(spark, "ledger")
    lg(spark, sf_dir).select("seq", F.col("job_id"), "status", "error").repartition(8).write.json(path)
    return ledger_stream.status_of(spark, path, jb(spark, sf_dir), every=2)


NUMBER = "CAST(regexp_extract(path, '_([0-9]+)[.]', 1) AS BIGINT)"


@query(with_("fl", PLAN + f""" n AS (SELECT p.*, {NUMBER.replace("path", "source_path")} AS n FROM plan p)
SELECT 'k' AS batch_key, source_path, output_path, CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN 'skipped' ELSE 'pending' END AS status FROM n"""))
def stream_new_images(spark, sf_dir):
    """A folder's listing that arrives in files, held against the ledger: every third image has succeeded, every second output is there."""
    listing, log, work, records = (new_path(spark, k) for k in ("listing", "ledger", "work", "skipped"))
    listed = fl(spark, sf_dir)
    listed.repartition(6).write.json(listing)
    plan = catalogue.plan_outputs(listed, "/out", "_enhanced", "jpeg").withColumn("n", F.regexp_extract("source_path", r"_([0-9]+)[.]", 1).cast("long"))
    past = plan.where("n % 3 = 0").select(F.lit("k").alias("batch_key"), "source_path", "output_path", F.lit("success").alias("status"))
    past.write.json(log)
    outputs = cut(plan.where("n % 2 = 0").select(F.col("output_path").alias("path")))
    arrivals = spark.readStream.schema("path string").option("maxFilesPerTrigger", 2).json(listing)
    planned = lambda batch: catalogue.plan_outputs(batch, "/out", "_enhanced", "jpeg").select(F.lit("k").alias("batch_key"), "source_path", "output_path")
    ledger_stream.take_arrivals(arrivals, planned, lambda: files.scan_ledger(spark, log), lambda: outputs, work, records, new_path(spark, "stream"))
    return spark.read.parquet(work).drop("batch")


@query(with_("lg", "SELECT DISTINCT batch_key, source_path, output_path FROM lg WHERE status = 'success'"))
def stream_dedup_success(spark, sf_dir):
    path = new_path(spark, "ledger")
    lg(spark, sf_dir).select("ts", "status", *ledger.KEYS).repartition(4).write.json(path)
    return ledger_stream.dedup_of(spark, path)
