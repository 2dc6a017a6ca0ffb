"""Line scans: movies whose rows are one line at successive times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def autocorrelation_2d(px: DataFrame, dys: list[int], dxs: list[int]) -> DataFrame:
    """recording, dy, dx, r: correlation of all frames with themselves dy rows and dx columns on. Null pixels do not count.

    A pixel goes to its own place and to those that it lies dy, dx behind; what meets at a place is one row, and no join.
    """
    lags = [(dy, dx) for dy in dys for dx in dxs]
    ends = [F.struct(F.lit(-1).alias("k"), F.col("y"), F.col("x")), *(F.struct(F.lit(k).alias("k"), (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x")) for k, (dy, dx) in enumerate(lags))]
    met = px.select("recording", "frame", "value", F.explode(F.array(*ends)).alias("o")).groupBy("recording", "frame", "o.y", "o.x").agg(*(F.max(F.when(F.col("o.k") == k, F.col("value"))).alias(f"v{k + 1}") for k in range(-1, len(lags))))
    pairs = met.filter("v0 is not null").select("recording", "v0", F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.col(f"v{k + 1}").alias("later")) for k, (dy, dx) in enumerate(lags)))).alias("o"))
    return pairs.filter("o.later is not null").groupBy("recording", "o.dy", "o.dx").agg(F.corr("v0", "o.later").alias("r"))


def tag_linescans(px: DataFrame, series: DataFrame, min_size: float = 6.0) -> DataFrame:
    """recording, line_scan of series(recording, px_size): multi for at most as many rows as twice min_size is pixels.

    Else single where the first frame correlates with itself that far along x more than twice as well
    as along y, else none; a correlation that cannot be had also gives none. At least one pixel counts.
    """
    scale = F.greatest(F.lit(1), F.floor(2 * min_size / F.col("px_size"))).cast("int")
    first = px.filter("frame = 0").select("recording", "y", "x", "value").join(series.select("recording", scale.alias("scale")), "recording")
    high = first.groupBy("recording", "scale").agg((F.max("y") - F.min("y") + 1).alias("rows"))
    steps = F.explode(F.array(F.struct(F.lit("y").alias("along"), F.col("scale").alias("dy"), F.lit(0).alias("dx")), F.struct(F.lit("x").alias("along"), F.lit(0).alias("dy"), F.col("scale").alias("dx"))))
    moved = first.withColumn("o", steps).select("recording", "o.along", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), F.col("value").alias("later"))
    r = lambda a: F.corr(F.when(F.col("along") == a, F.col("value")), F.when(F.col("along") == a, F.col("later")))
    both = first.join(moved, ["recording", "y", "x"]).groupBy("recording").agg(r("x").alias("rx"), r("y").alias("ry"))
    tag = F.when(F.col("rows") <= F.col("scale"), "multi").when(F.col("rx") / F.nullif(F.abs("ry"), F.lit(0.0)) > 2, "single").otherwise("none")
    return high.join(both, "recording", "left").select("recording", tag.alias("line_scan"))


def reshape_linescan(px: DataFrame, height: int) -> DataFrame:
    """recording, x, i, value: the rows of all frames one after another as samples of the places x of a line."""
    return px.select("recording", "x", (F.col("frame") * height + F.col("y")).cast("long").alias("i"), "value")


def heatmap_bins(line: DataFrame, size: int, extent: tuple[int, int] | None = None) -> DataFrame:
    """recording, x, k, value: means of whole bins of size samples, for places of an extent with both ends."""
    part = line if extent is None else line.filter(F.col("x").between(*extent))
    binned = part.groupBy("recording", "x", F.floor(F.col("i") / size).alias("k")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return binned.filter(F.col("n") == size).drop("n")
