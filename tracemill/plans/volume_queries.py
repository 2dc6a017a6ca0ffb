"""Queries of stacks, on embedding vectors seen as 4 x 4 x 4 voxels, and of centres of interest in mean images."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.numbers import tidy
from tracemill.operators import centres as ce
from tracemill.operators import volumes as vo
from tracemill.plans.frame_queries import image
from tracemill.plans.registry import query
from tracemill.plans.trace_queries import r
from tracemill.sources import bindings as b

VX = "vx AS (SELECT recording, frame, CAST((y * 8 + x) // 16 AS INTEGER) AS z, CAST((y * 8 + x) // 4 % 4 AS INTEGER) AS y, CAST(x % 4 AS INTEGER) AS x, value FROM px)"


def voxels(spark, sf_dir):
    p = F.col("y") * 8 + F.col("x")
    return b.pixels(spark, sf_dir).select("recording", "frame", F.floor(p / 16).cast("int").alias("z"), (F.floor(p / 4) % 4).cast("int").alias("y"), (p % 4).cast("int").alias("x"), "value")


TAPS = VX + """,
sh AS (SELECT DISTINCT recording, frame, (frame % 5 - 2) / 2.0::DOUBLE AS dz, (frame % 7 - 3) / 4.0::DOUBLE AS dy, (frame % 3 - 1)::DOUBLE AS dx FROM vx),
tp AS (SELECT vx.recording, frame, z, y, x, z + floor(dz) + a AS sz, y + floor(dy) + c AS sy, x + floor(dx) + e AS sx, (CASE WHEN a = 1 THEN dz - floor(dz) ELSE 1 - dz + floor(dz) END) * (CASE WHEN c = 1 THEN dy - floor(dy) ELSE 1 - dy + floor(dy) END) * (CASE WHEN e = 1 THEN dx - floor(dx) ELSE 1 - dx + floor(dx) END) AS w
  FROM vx JOIN sh USING (recording, frame), (SELECT unnest([0, 0, 0, 0, 1, 1, 1, 1]) AS a, unnest([0, 0, 1, 1, 0, 0, 1, 1]) AS c, unnest([0, 1, 0, 1, 0, 1, 0, 1]) AS e)),
mv AS (SELECT tp.recording, tp.frame, tp.z, tp.y, tp.x, sum(coalesce(s.value, 0) * w) AS v FROM tp LEFT JOIN vx s ON s.recording = tp.recording AND s.frame = tp.frame AND s.z = sz AND s.y = sy AND s.x = sx GROUP BY ALL),
bd AS (SELECT recording, frame, min(value) AS low, max(value) AS high FROM vx GROUP BY 1, 2)"""


@query("f19_apply_shifts_3d", b.sql("pixels", then=TAPS) + f"SELECT recording, frame, z, y, x, {r('least(greatest(v, low), high)')} AS value FROM mv JOIN bd USING (recording, frame)")
def f19(spark, sf_dir):
    given = voxels(spark, sf_dir)
    frame = F.col("frame")
    shifts = given.select("recording", "frame").distinct().select("recording", "frame", ((frame % 5 - 2) / 2).alias("dz"), ((frame % 7 - 3) / 4).alias("dy"), (frame % 3 - 1).cast("double").alias("dx"))
    return vo.apply_shifts_3d(given, shifts).select("recording", "frame", "z", "y", "x", tidy("value").alias("value"))


#: With one voxel to look around, the best offset is refined around the middle.
OFFSETS = VX + """,
me AS (SELECT recording, z, y, x, quantile_cont(value, 0.5) AS m FROM vx GROUP BY ALL),
fa AS (SELECT recording, frame, round(sum(abs(value - m)), 9) AS far FROM vx JOIN me USING (recording, z, y, x) GROUP BY ALL),
te AS (SELECT vx.* FROM vx JOIN (SELECT recording, frame FROM fa QUALIFY row_number() OVER (PARTITION BY recording ORDER BY far, frame) = 1) USING (recording, frame)),
sc AS (SELECT vx.recording, vx.frame, a, c, e, coalesce(corr(vx.value, te.value), 0) AS s FROM te, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS c), (SELECT unnest([-1, 0, 1]) AS e), vx
  WHERE te.z BETWEEN 1 AND 2 AND te.y BETWEEN 1 AND 2 AND te.x BETWEEN 1 AND 2 AND vx.recording = te.recording AND vx.z = te.z + a AND vx.y = te.y + c AND vx.x = te.x + e GROUP BY ALL),
lo AS (SELECT *, ln(1e-10 + greatest(s, 0)) AS l FROM sc),
nb AS (SELECT recording, frame, max(s) AS best, max(CASE WHEN a = 0 AND c = 0 AND e = 0 THEN l END) AS o, max(CASE WHEN a = -1 AND c = 0 AND e = 0 THEN l END) AS z0, max(CASE WHEN a = 1 AND c = 0 AND e = 0 THEN l END) AS z1, max(CASE WHEN c = -1 AND a = 0 AND e = 0 THEN l END) AS y0, max(CASE WHEN c = 1 AND a = 0 AND e = 0 THEN l END) AS y1, max(CASE WHEN e = -1 AND a = 0 AND c = 0 THEN l END) AS x0, max(CASE WHEN e = 1 AND a = 0 AND c = 0 THEN l END) AS x1 FROM lo GROUP BY ALL)"""


def vertex(axis: str) -> str:
    bend = f"(({axis}0 + {axis}1 - 2 * o) / 2)"
    top = f"(({axis}1 - {axis}0) / (4 * {bend}))"
    return f"CASE WHEN best > 0 AND abs({bend}) >= 1e-10 AND abs({top}) < 1 THEN -{top} ELSE 0.0 END"


@query("f18_template_shifts_3d", b.sql("pixels", then=OFFSETS) + "SELECT recording, frame, " + ", ".join(f"{r(vertex(a))} AS d{a}" for a in "zyx") + " FROM nb")
def f18(spark, sf_dir):
    found = vo.template_shifts(voxels(spark, sf_dir), most=(1, 1, 1))
    return found.select("recording", "frame", *(tidy(f"d{a}").alias(f"d{a}") for a in "zyx"))


@query("f18_estimate_shifts_3d")
def f18_loop(spark, sf_dir):
    """Without SQL, since it loops; tests/test_volumes.py finds planted shifts in every mode."""
    found = vo.estimate_shifts_3d(voxels(spark, sf_dir), most=(1, 1, 1))
    return found.select("recording", "frame", *(tidy(c).alias(c) for c in ("dz", "dy", "dx", "score")))


DRAWN, BANDWIDTH = 24, 2.0
POINTS = f"""im AS (SELECT recording, y, x, round(avg(value), 9) AS value FROM px GROUP BY 1, 2, 3),
ke AS (SELECT *, -ln((CAST('0x' || substr(md5(recording || '|' || y || '|' || x || '|0'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0) / pow(value, 3.0) AS key FROM im WHERE value > 0),
pt AS (SELECT recording, y, x FROM ke QUALIFY row_number() OVER (PARTITION BY recording ORDER BY key, y, x) <= {DRAWN})"""


@query("f25_shift_step", b.sql("pixels", then=POINTS) + f"SELECT a.recording, a.y, a.x, {r('avg(p.y)')} AS my, {r('avg(p.x)')} AS mx, count(*) AS n FROM pt a JOIN pt p ON p.recording = a.recording AND pow(p.y - a.y, 2) + pow(p.x - a.x, 2) <= {BANDWIDTH * BANDWIDTH} GROUP BY 1, 2, 3")
def f25_step(spark, sf_dir):
    points = ce.drawn_pixels(image(spark, sf_dir), DRAWN)
    seeds = points.select("recording", (F.col("y") * 8 + F.col("x")).alias("id"), F.col("y").cast("double").alias("cy"), F.col("x").cast("double").alias("cx"))
    moved = ce.shift_step(seeds, points, BANDWIDTH)
    return moved.select("recording", F.col("cy").cast("int").alias("y"), F.col("cx").cast("int").alias("x"), tidy("my").alias("my"), tidy("mx").alias("mx"), "n")


@query("f25_interesting_centres")
def f25(spark, sf_dir):
    """Without SQL, since it loops; f25_shift_step is one of its steps, tests/test_volumes.py finds planted blobs."""
    return ce.interesting_centres(image(spark, sf_dir), DRAWN, bandwidth=BANDWIDTH).select("recording", tidy("y").alias("y"), tidy("x").alias("x"), "n")
