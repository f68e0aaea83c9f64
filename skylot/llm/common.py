"""Reading, staging, ranking and connected components, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that separates words in the contracts, as a Java or Python character class.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Spark's own switch that deletes a query's shuffle files when it ends, not when the driver collects garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folder: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local tests a temporary one."""
    if set_by_cluster := spark.conf.get("spark.checkpoint.dir", None):
        return set_by_cluster
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="skylot-"))
    return _local_folder[0]


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts its lineage, survives lost
    executors, and later readers don't compute it anew, so that its shuffle files go at once. Goes when
    the application ends. batch_rows: rows of an Arrow batch, for wide rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skylot-{uuid.uuid4().hex}-{name}"
    settings = {FREES_SHUFFLES: "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)} if batch_rows else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Words between white space; null and empty texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def globally_ranked(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df with name: 0 for the first row by the order given, and so on. Ranges are ranked apart; what
    is broadcast is one row a range, so that no task gets all rows."""
    ranged = staged(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range").orderBy(*by)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (ranged.withColumn("_at", F.row_number().over(within)).join(F.broadcast(starts), "_range")
            .withColumn(name, F.col("_start") + F.col("_at") - 1).drop("_range", "_at", "_start"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph of long ids: rows (id, component), component being
    the smallest id that can be reached; only ids that have an edge to another id.

    Alternates the large-star and small-star steps of map-reduce component search: each hangs every
    neighbour on the smallest one. Minima are aggregated before the shuffle and joined back, so a
    hub's neighbours never meet in one task. Every round is staged; one aggregation tells whether it was the last."""
    def hung(pairs: DataFrame, both_ways: bool) -> DataFrame:
        """pairs (u, v), u > v. Large star: the larger neighbours of u go to its smallest one (or u);
        small star: the smaller ones and u itself do."""
        arrows = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else pairs
        least = arrows.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        near = arrows.join(least, "u")
        moved = near.filter("v > u" if both_ways else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not both_ways:
            moved = moved.union(least.select("u", F.col("m").alias("v")))
        return moved.filter("u <> v").distinct()

    pairs = staged(edges.toDF("a", "b").filter("a <> b")
                   .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        pairs = staged(hung(hung(pairs, True), False), "star")
        # ended when all are stars: what hangs does so on one id, and nothing hangs on it
        ends = pairs.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(pairs.select("v", F.lit(0)))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).filter("up > 0 AND n > 1").isEmpty():
            break
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
