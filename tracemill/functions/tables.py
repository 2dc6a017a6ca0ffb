"""The shared folder and written tables, which cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors see.

    Where the setting is absent, a local folder is set as the session's checkpoint folder if all of it
    runs on this machine; on a cluster that is an error, since executors would not see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-tracemill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tracemill-{label}-{uuid.uuid4().hex}"


#: Spark's own setting: the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again. Once it is there, the shuffle files behind it are of no use and go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark, label)}/table"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all shuffle partitions, however small it is.

    For rows that grow before the next shuffle: adaptive execution, which goes by their size so far, would leave
    them to one task. What is grouped by keys, or by keys and others, needs no further shuffle.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def discard(table: DataFrame) -> None:
    """Delete a written table that nothing unfinished reads any more."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df as a written table with its rows numbered from 0 in the given order, without one task for all.

    A range sort gives each task a stretch; the stretches' sizes, a row each, give where they begin.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", within), "numbered")
    before = F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_held")).select("_part", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at")).select(name, *df.columns)
