"""The ledger of batch outcomes: what is done, pending, failed or to be retried, and the state of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["batch_key", "source_path", "output_path"]


def last_success(ledger: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Of each key's successes, the record that comes last in file order (seq)."""
    latest = F.max_by(F.struct(*ledger.columns), "seq").alias("last")
    return ledger.where("status = 'success'").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(latest).select("last.*")


def skip_plan(planned: DataFrame, ledger: DataFrame, outputs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The planned rows that already succeeded and whose output (outputs.path) still exists."""
    done = ledger.where("status = 'success'").select(*keys)
    return planned.join(done, keys, "left_semi").join(outputs.select(F.col("path").alias("output_path")), "output_path", "left_semi").select(*planned.columns)


def pending_work(planned: DataFrame, ledger: DataFrame, outputs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The planned rows with status: pending, or skipped for those of skip_plan."""
    skipped = skip_plan(planned, ledger, outputs, keys)
    pending = planned.join(skipped.select(*keys), keys, "left_anti").select(*planned.columns)
    return pending.withColumn("status", F.lit("pending")).unionByName(skipped.withColumn("status", F.lit("skipped")))


def latest_failed_group(ledger: DataFrame) -> DataFrame:
    """All records (status error, success or skipped) of the batch key that has an error and the greatest ts of all; first in file order on ties."""
    known = ledger.where("batch_key <> ''").where(F.col("status").isin("error", "success", "skipped"))
    groups = known.groupBy("batch_key").agg(F.max("ts").alias("latest"), F.min("seq").alias("first"), F.bool_or(F.col("status") == "error").alias("failed"))
    chosen = groups.where("failed").orderBy(F.desc("latest"), "first").limit(1).select("batch_key")
    return known.join(F.broadcast(chosen), "batch_key", "left_semi")


def retry_set(ledger: DataFrame, presets: DataFrame, latest_only: bool = False) -> DataFrame:
    """Failed sources (seq, source_path, preset_hash) of the latest failed group whose preset hash is among presets' (preset_hash).

    latest_only leaves out sources of which a later record of the group succeeded.
    """
    group = latest_failed_group(ledger)
    failed = group.where("status = 'error' AND source_path <> ''").join(presets.select("preset_hash").distinct(), "preset_hash", "left_semi")
    if latest_only:
        done = group.where("status = 'success'").groupBy("source_path").agg(F.max("seq").alias("done"))
        failed = failed.join(done, "source_path", "left").where("done IS NULL OR done < seq")
    return failed.select("seq", "source_path", "preset_hash")


def job_rollup(ledger: DataFrame) -> DataFrame:
    """By job: success, skipped and error counts and the last error."""
    kind = F.col("status")
    return ledger.groupBy("job_id").agg(F.count_if(kind == "success").alias("success"), F.count_if(kind == "skipped").alias("skipped"), F.count_if(kind == "error").alias("error"), F.max_by(F.when(kind == "error", F.col("error")), F.when(kind == "error", F.col("seq"))).alias("latest_error"), F.count(F.lit(1)).alias("records"))


def with_status(jobs: DataFrame) -> DataFrame:
    """status of jobs with their counts: queued without records; error with any error; complete when all sources are done; else running."""
    done = (F.col("success") + F.col("skipped") >= F.col("source_count")) & (F.col("source_count") > 0)
    return jobs.withColumn("status", F.when(F.col("records") == 0, "queued").when(F.col("error") > 0, "error").when(done, "complete").otherwise("running"))


def job_status(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each job with its ledger counts, last error and status."""
    joined = jobs.join(job_rollup(ledger), "job_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("success", "skipped", "error", "records")]
    return with_status(joined.select(*jobs.columns, *counts, F.coalesce("latest_error", F.lit("")).alias("latest_error"))).drop("records")


def batch_summary(ledger: DataFrame, shown: int = 8) -> DataFrame:
    """By batch: completed, skipped, failed, and the first failures (source: error) in file order.

    The failures are ranked within their batch, and only those shown are gathered.
    """
    w = Window.partitionBy("batch_key").orderBy("seq")
    first = ledger.where("status = 'error'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown)
    lists = first.groupBy("batch_key").agg(F.array_sort(F.collect_list(F.struct("k", F.concat("source_path", F.lit(": "), F.coalesce("error", F.lit(""))).alias("what")))).alias("f"))
    kind = F.col("status")
    counts = ledger.groupBy("batch_key").agg(F.count_if(kind == "success").alias("completed"), F.count_if(kind == "skipped").alias("skipped"), F.count_if(kind == "error").alias("failed"))
    return counts.join(lists, "batch_key", "left").select("batch_key", "completed", "skipped", "failed", F.coalesce(F.array_join(F.transform("f", lambda s: s.what), "; "), F.lit("")).alias("failures"))


def batch_estimate(plan: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row: supported sources of a plan (output_path), those whose output exists, those to process."""
    there = outputs.select(F.col("path").alias("output_path"), F.lit(True).alias("there")).distinct()
    return plan.join(there, "output_path", "left").agg(F.count(F.lit(1)).alias("supported"), F.count_if("there").alias("likely_skipped"), F.count_if(F.col("there").isNull()).alias("to_process"))


def recent_sources(ledger: DataFrame, most: int = 8, by: list[str] | None = None) -> DataFrame:
    """The most recently used distinct sources, overall or within each group of by."""
    used = ledger.groupBy(*(by or []), "source_path").agg(F.max("seq").alias("seq"))
    if not by:
        return used.orderBy(F.desc("seq")).limit(most)
    w = Window.partitionBy(*by).orderBy(F.desc("seq"))
    return used.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
