"""Planted motion is found to a part of a pixel and taken back."""

import math

from pyspark.sql import functions as F

from tracemill.operators import motion
from tracemill.sources import readers

N = 20


def movie(spark, shift, frames, lines=lambda y: True):
    """A blob that frame f moves by shift(f) on the lines that move."""
    def value(f, y, x):
        dy, dx = shift(f) if lines(y) else (0, 0)
        return 1 + 100 * math.exp(-((y - 9.3 - dy) ** 2 + (x - 10.1 - dx) ** 2) / 18)
    rows = [("text name", f, y, x, value(f, y, x)) for f in range(frames) for y in range(N) for x in range(N)]
    return spark.createDataFrame(rows, "recording string, frame int, y int, x int, value double")


def spread(df):
    each = df.filter("y between 5 and 14 and x between 5 and 14").groupBy("y", "x").agg(F.stddev_pop("value").alias("s"))
    return each.agg(F.max("s")).first()[0]


def test_motion_is_taken_back(spark):
    shift = lambda f: (1.5 * math.sin(f // 2), -1.2 * math.cos(f // 2))
    px = movie(spark, shift, 13)  # the last block of two is incomplete
    shifts = motion.motion_shifts(px, 2, 3, 0, N - 1, max_dev=0.02).collect()
    assert sorted(r["frame"] for r in shifts) == list(range(13))
    at = {r["frame"]: r for r in shifts}
    assert (at[12]["dy"], at[12]["dx"]) == (at[11]["dy"], at[11]["dx"])
    for c, k in (("dy", 0), ("dx", 1)):
        offs = [at[f][c] - shift(f)[k] for f in range(12)]
        assert max(offs) - min(offs) < 0.25
    inner = px.filter("frame < 12")
    assert spread(motion.motion_correct(inner, 2, 3, 0, N - 1, max_dev=0.02)) < 0.25 * spread(inner)


def test_short_recordings_and_empty_tables(spark):
    px = movie(spark, lambda f: (0, 0), 1)
    assert [(r["dy"], r["dx"]) for r in motion.motion_shifts(px, 2, 2, 0, N - 1).collect()] == [(0, 0)]
    assert not motion.motion_correct(px.filter("frame < 0"), 2, 2, 0, N - 1).collect()


def test_shifts_and_sweeps_come_back_from_text(spark, tmp_path):
    shifts = spark.createDataFrame([("a", 1, 0.5, -1.0), ("a", 0, 0.0, 2.25), ("b", 0, 1.0, 0.0)], "recording string, frame int, dy double, dx double")
    readers.write_shifts(shifts, str(tmp_path / "shifts"))
    back = spark.read.csv(str(tmp_path / "shifts"), header=True, schema="frame int, dy double, dx double, recording string")
    assert sorted(map(tuple, back.select("recording", "frame", "dy", "dx").collect())) == sorted(map(tuple, shifts.collect()))
    readers.write_sweeps(shifts.withColumn("sweep", F.col("frame")), str(tmp_path / "sweeps"))
    assert sorted(p.name for p in (tmp_path / "sweeps").glob("sweep=*")) == ["sweep=0", "sweep=1"]


def test_whole_and_half_pixels(spark):
    px = spark.createDataFrame([("a", 0, 0, x, float(x * x)) for x in range(4)], "recording string, frame int, y int, x int, value double")
    move = lambda dx: [r["value"] for r in motion.apply_shifts(px, spark.createDataFrame([("a", 0, 0.0, dx)], "recording string, frame int, dy double, dx double"), 0, 3).orderBy("x").collect()]
    assert move(1.0) == [1, 4, 9, 9]
    assert move(-0.5) == [0, 0.5, 2.5, 6.5]


def test_phase_of_odd_lines(spark):
    px = movie(spark, lambda f: (0, 1.4), 2, lines=lambda y: y % 2)
    found = motion.phase_shifts(px, 3, 0, N - 1).collect()
    assert len(found) == 2 and all(abs(r["dx"] - 1.4) < 0.2 and r["dy"] == 0 for r in found)
    still = movie(spark, lambda f: (0, 0), 2)
    off = motion.correct_phase(px, 3, 0, N - 1).join(still.withColumnRenamed("value", "v"), ["recording", "frame", "y", "x"]).filter("x between 4 and 15").agg(F.max(F.abs(F.col("value") - F.col("v"))), F.count("*")).first()
    assert off[0] < 8 and off[1] == 2 * N * 12
