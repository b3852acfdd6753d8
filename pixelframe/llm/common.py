"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.sources.shared import cut, drop_cut, tidy  # noqa: F401

#: Rows in one Arrow batch to Python. Documents can be long, so the engine's default of 10,000 is too many.
ARROW_ROWS = 256
#: Rows, and bytes of these rows as text, that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ARROW_ROWS, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def spare_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores in front as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has no more than BROADCAST_ROWS rows and BROADCAST_BYTES bytes; joined by a shuffle otherwise."""
    width = F.octet_length(F.struct("*").cast("string")).cast("long")
    n, held = df.limit(BROADCAST_ROWS + 1).select(width.alias("width")).agg(F.count(F.lit(1)), F.coalesce(F.sum("width"), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def sharing(rows: DataFrame, key: str, groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows joined by key with groups(rows), which aggregates by key and keeps the groups wanted.

    Rows are dealt by key once, for the aggregate and for the join, and only the groups kept are hashed: rows
    are neither sorted nor gathered, however many share a key.
    """
    dealt = rows.repartition(key)
    return dealt.join(groups(dealt).hint("shuffle_hash"), key)


@tidy
def smallest_labels(edges: DataFrame, ids: str = "long") -> DataFrame:
    """Connected components: (id, label) for each id of edges (a, b), label being the smallest id reachable.

    A round joins the smaller neighbours of a node to the least of them, and then every node to the least
    neighbour of its neighbour (small and large stars). Edges never grow in number, and a node's many ways to
    one label soon become a single edge; it ends when all that is left are stars. Every round is cut, so plans
    don't grow. Null ids and self-loops are ignored; repeated edges count once.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        near = stars.join(stars.groupBy("hi").agg(F.min("lo").alias("least")), "hi")
        near = near.select(F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("least").alias("lo")).distinct()
        up = near.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("up"))
        jump = near.join(up, "lo", "left").select("hi", F.coalesce("up", "lo").alias("lo"), F.col("up").isNotNull().alias("moved"))
        new = cut(jump.groupBy("hi", "lo").agg(F.max("moved").alias("moved")))
        drop_cut(stars)
        n, nodes, moved = new.agg(F.count(F.lit(1)), F.count_distinct("hi"), F.max("moved")).first()
        stars = new.select("hi", "lo")
        if n == nodes and not moved:
            return stars.union(stars.select(F.col("lo").alias("hi"), "lo").distinct()).toDF("id", "label")
