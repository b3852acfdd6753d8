"""Folders and cuts that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in a local session (tests) where it is unset, a new local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-pixelframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Spark's own setting that removes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries inside go when each query ends. The session's setting is put back."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


#: Tables cut since the innermost tidy job began, if any runs.
_TABLES: ContextVar[list[DataFrame] | None] = ContextVar("tables", default=None)


def tidy(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """job, whose first argument is a DataFrame, that leaves on disk only what its result reads: the shuffle files of its own
    queries (counts and looks, too) go with each query, and the tables it has cut are emptied at the end."""

    @wraps(job)
    def run(first: DataFrame, *args, **more) -> DataFrame:
        outer = _TABLES.get()
        token = _TABLES.set([])
        try:
            with shuffles_removed(first.sparkSession):
                out = job(first, *args, **more)
                tables = _TABLES.get()
                read = {file.rsplit("/", 1)[0] for file in out.inputFiles()}
                for df in tables:
                    if not read & {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
                        drop_cut(df)
                    elif outer is not None:
                        outer.append(df)
        finally:
            _TABLES.reset(token)
        return out.select("*")

    return run


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back, so that its lineage ends there.

    The shuffle files of the write go with it: nothing else reads them.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "cut")
    with shuffles_removed(spark):
        df.write.parquet(path, compression="zstd")
    table = spark.read.schema(df.schema).parquet(path)
    if (tables := _TABLES.get()) is not None:
        tables.append(table)
    return table


def drop_cut(df: DataFrame) -> None:
    """Empty the table that cut has returned as df: nothing may read it from here on."""
    folder = f"{shared_dir(df.sparkSession)}/cut-"
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.split(":")[-1].lstrip("/") in path:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
            df.sparkSession.range(0, 0, 1, 1).select(*none).write.mode("overwrite").parquet(path)
