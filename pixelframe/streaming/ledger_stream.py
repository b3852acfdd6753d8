"""Streams over the ledger: live job counts, one success per key, and work lists of newly arrived files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.operators import ledger
from pixelframe.operators.catalogue import plan_outputs
from pixelframe.sources.files import LEDGER, LEDGER_FIELDS, is_image
from pixelframe.sources.shared import cut, new_path


def job_counts(records: DataFrame) -> DataFrame:
    """The job rollup of a stream of records; its state is one row per job. For update or complete mode."""
    return ledger.job_rollup(records)


def one_success(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first success of each key. Records later than the watermark are dropped, and keys older than it forgotten."""
    return records.where("status = 'success'").withWatermark("ts", late).dropDuplicatesWithinWatermark(ledger.KEYS)


def _drain(stream: DataFrame, spark: SparkSession, write) -> None:
    q = stream.writeStream.option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True)
    write(q).awaitTermination()


class JobStates:
    """The newest row of each job, kept in files that micro-batches write under their ids.

    A replayed batch writes the same rows over its own. Every every-th batch puts the newest row of each job into one
    table, from which on later reads start; so a read has one row a job, and those of a few batches.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "job_id", every: int = 8):
        self.spark, self.changes, self.whole, self.key, self.every = spark, f"{folder}/changes", f"{folder}/whole", key, every

    def _rows(self, below: int | None = None) -> DataFrame | None:
        """All rows since the last whole table, with it, and the batch that each is from."""

        def read(path: str) -> DataFrame | None:
            try:
                return self.spark.read.parquet(path)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
                return None

        whole, changes, since = read(self.whole), read(self.changes), -1
        if whole is not None:
            versions = whole if below is None else whole.where(F.col("upto") < below)
            since = versions.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]
            whole = whole.where(F.col("upto") == since).withColumnRenamed("upto", "batch")
        if changes is not None:
            changes = changes.where(F.col("batch") > since)
        return changes if whole is None else whole if changes is None else whole.unionByName(changes)

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """rows: at most one a job."""
        rows.write.mode("overwrite").parquet(f"{self.changes}/batch={batch_id}")
        if batch_id and batch_id % self.every == 0:
            self._newest(self._rows(batch_id).where(F.col("batch") <= batch_id)).write.mode("overwrite").parquet(f"{self.whole}/upto={batch_id}")

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c != "batch"]
        return rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*columns), "batch").alias("last")).select("last.*")

    def read(self) -> DataFrame:
        return self._newest(self._rows())


RECORDS = "seq long, job_id long, status string, error string"


def rollup_of(spark: SparkSession, path: str, every: int = 8) -> DataFrame:
    """Job counts after all files under path, from the changed jobs of each batch."""
    states = JobStates(spark, new_path(spark, "rollup"), every=every)
    records = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 2).json(path)
    _drain(job_counts(records), spark, lambda q: q.outputMode("update").foreachBatch(states.upsert).start())
    return states.read()


def status_of(spark: SparkSession, path: str, jobs: DataFrame, every: int = 8) -> DataFrame:
    """Each of jobs (job_id, source_count, ...) with its counts and status after all files under path.

    Each batch's changed jobs are joined with their records; jobs of which the ledger says nothing yet are queued. Jobs that
    aren't in jobs have no row.
    """
    states = JobStates(spark, new_path(spark, "status"), every=every)
    records = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 2).json(path)

    def put(changed: DataFrame, batch_id: int) -> None:
        known = changed.withColumn("latest_error", F.coalesce("latest_error", F.lit("")))
        states.upsert(ledger.with_status(jobs.join(known, "job_id")).drop("records"), batch_id)

    _drain(job_counts(records), spark, lambda q: q.outputMode("update").foreachBatch(put).start())
    seen = states.read()
    queued = jobs.join(seen.select("job_id"), "job_id", "left_anti")
    none = [F.lit(0).cast("long").alias(c) for c in ("success", "skipped", "error")]
    return seen.unionByName(queued.select("*", *none, F.lit("").alias("latest_error"), F.lit("queued").alias("status")))


def dedup_of(spark: SparkSession, path: str, late: str = "3650 days") -> DataFrame:
    """One row per key with a success, from all files under path."""
    out = new_path(spark, "dedup")
    records = spark.readStream.schema("ts timestamp, status string, batch_key string, source_path string, output_path string").json(path)
    _drain(one_success(records, late), spark, lambda q: q.outputMode("append").format("parquet").option("path", out).start())
    return spark.read.parquet(out).select(*ledger.KEYS)


def take_arrivals(arrivals: DataFrame, plan, done, outputs, work: str, log: str, checkpoint: str) -> None:
    """Judge a stream of arrived files (path) by the ledger, batch by batch, and append them to a work list.

    plan gives a batch's planned rows (batch_key, source_path, output_path); done and outputs give the ledger and the listing of outputs as they are
    then. Rows that have succeeded and whose output is there are skipped, and get a record in log; the others are pending.
    Work and records of a batch are written under its id, over what a replay of it has left.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        judged = cut(ledger.pending_work(plan(batch), done(), outputs()))
        judged.write.mode("overwrite").parquet(f"{work}/batch={batch_id}")
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        have = {c: F.col(c) for c in (*ledger.KEYS, "status")} | {"reason": F.lit("already completed"), "ts": now}
        skipped = judged.where("status = 'skipped'").select(*[have.get(c, F.lit(None).cast("string")).alias(c) for c in LEDGER_FIELDS])
        skipped.write.mode("overwrite").json(f"{log}/batch={batch_id}")

    arrivals.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def new_images(spark: SparkSession, folder: str, work: str, checkpoint: str, log: str, batch_key: str = "", out: str = "out", suffix: str = "_enhanced", output_format: str = "jpeg", done=None, outputs=None) -> None:
    """Append the image files that came to folder since the last call to the work list (Parquet: batch_key, source_path, output_path, status), once each.

    done and outputs: functions that give the ledger and the listing of outputs (path); without them all is pending.
    """
    listing = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")
    plan = lambda batch: plan_outputs(batch, out, suffix, output_format).select(F.lit(batch_key).alias("batch_key"), "source_path", "output_path")
    empty = lambda kind: lambda: spark.createDataFrame([], kind)
    take_arrivals(listing.where(is_image(F.col("path"))), plan, done or empty(LEDGER), outputs or empty("path string"), work, log, checkpoint)
