"""Centres of interest of images(recording, y, x, value): bright pixels are drawn and moved to where they are dense."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracemill.functions.tables import discard, written

STILL = 1e-3  # of the bandwidth: less than this is no move
ROUNDS = 300


def drawn_pixels(image: DataFrame, n: int, exponent: float = 3.0, seed: int = 0) -> DataFrame:
    """recording, y, x of n different pixels of each recording, drawn by value ** exponent: those of the least -ln(u) / weight.

    u comes from an MD5 of place and seed, so the same pixels are drawn each time. Pixels not above 0 are never drawn.
    """
    text = F.concat_ws("|", F.col("recording").cast("string"), F.col("y").cast("string"), F.col("x").cast("string"), F.lit(str(seed)))
    u = (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    keyed = image.filter("value > 0").withColumn("key", -F.ln(u) / F.pow("value", F.lit(float(exponent))))
    first = Window.partitionBy("recording").orderBy("key", "y", "x")
    return keyed.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= n).select("recording", "y", "x")


def shift_step(seeds: DataFrame, points: DataFrame, bandwidth: float) -> DataFrame:
    """seeds(recording, id, cy, cx) moved to the mean of the points(recording, y, x) within the bandwidth; n counts those.

    Both meet by cells as wide as the bandwidth, a seed with its own and the eight around. A seed without points goes.
    """
    cell = lambda c: F.floor(F.col(c) / bandwidth)
    around = [F.explode(F.array(*(cell(c) + d for d in (-1, 0, 1)))).alias(f"b{c}") for c in ("cy", "cx")]
    spread = seeds.select("*", around[0]).select("*", around[1])
    own = points.select("recording", "y", "x", cell("y").alias("bcy"), cell("x").alias("bcx"))
    near = spread.join(own, ["recording", "bcy", "bcx"]).filter(F.pow(F.col("y") - F.col("cy"), F.lit(2)) + F.pow(F.col("x") - F.col("cx"), F.lit(2)) <= bandwidth * bandwidth)
    return near.groupBy("recording", "id", "cy", "cx").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"), F.count(F.lit(1)).alias("n"))


def interesting_centres(image: DataFrame, n: int = 10_000, exponent: float = 3.0, bandwidth: float = 10.0, seed: int = 0) -> DataFrame:
    """recording, y, x, n: modes of the drawn pixels, n the pixels within the bandwidth of each.

    Every drawn pixel moves to the mean of those within the bandwidth until it moves by less than STILL of it,
    at most ROUNDS times; seeds that stand still leave the loop. Of modes within a bandwidth the one of more pixels
    stays. At most n modes of a recording meet in a task. An image without a pixel above 0 has none.
    """
    points = written(drawn_pixels(image, n, exponent, seed), "points")
    order = Window.partitionBy("recording").orderBy("y", "x")
    seeds = written(points.select("recording", F.row_number().over(order).alias("id"), F.col("y").cast("double").alias("cy"), F.col("x").cast("double").alias("cx")), "seeds")
    still = None
    for turn in range(ROUNDS):
        moved = written(shift_step(seeds, points, bandwidth).withColumn("far", F.sqrt(F.pow(F.col("my") - F.col("cy"), F.lit(2)) + F.pow(F.col("mx") - F.col("cx"), F.lit(2)))), "moved")
        discard(seeds)
        rest = F.col("far") < STILL * bandwidth
        done = moved if turn == ROUNDS - 1 else moved.filter(rest)
        still = done.select("recording", "my", "mx", "n") if still is None else still.unionByName(done.select("recording", "my", "mx", "n"))
        seeds = written(moved.filter(~rest).select("recording", "id", F.col("my").alias("cy"), F.col("mx").alias("cx")), "seeds")
        if seeds.isEmpty():
            break
    modes = still.groupBy("recording", F.round("my", 6).alias("y"), F.round("mx", 6).alias("x")).agg(F.max("n").alias("n"))
    schema = T.StructType([modes.schema["recording"], *T._parse_datatype_string("y double, x double, n long").fields])

    def apart(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "y", "x"], ascending=[False, True, True])
        kept: list[tuple[float, float]] = []
        keep = []
        for y, x in zip(rows["y"], rows["x"], strict=True):
            fine = not kept or float(np.min((np.array(kept) - (y, x)).__pow__(2).sum(axis=1))) > bandwidth * bandwidth
            keep.append(fine)
            if fine:
                kept.append((y, x))
        return rows[keep][["recording", "y", "x", "n"]]

    return modes.groupBy("recording").applyInPandas(apart, schema)
