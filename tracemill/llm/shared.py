"""What several corpus operators need: table paths, the shared folder and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.functions.tables import discard, shared_dir, written

__all__ = ["discard", "free_name", "partitions", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as it takes to be no column of df."""
    while name in df.columns:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session was sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
