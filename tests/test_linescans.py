"""Tags of planted scans."""

import random

from tracemill.operators import linescans as ls


def test_planted_scans(spark):
    rng = random.Random(4)
    line = [rng.random() for _ in range(40)]
    wide = [rng.random() for _ in range(40)]
    smooth = [sum(wide[max(0, x - 3):x + 4]) for x in range(40)]
    rows = [("few", 0, y, x, rng.random()) for y in range(2) for x in range(20)]
    rows += [("single", 0, y, x, smooth[x] + 5 * line[y]) for y in range(40) for x in range(40)]
    rows += [("movie", 0, y, x, rng.random()) for y in range(20) for x in range(20)]
    px = spark.createDataFrame(rows, "recording string, frame int, y int, x int, value double")
    series = spark.createDataFrame([("few", 3.0), ("single", 4.0), ("movie", 4.0)], "recording string, px_size double")
    got = dict(map(tuple, ls.tag_linescans(px, series).collect()))
    assert got["few"] == "multi" and got["single"] == "single"
    assert not ls.tag_linescans(px.filter("frame < 0"), series).collect()
