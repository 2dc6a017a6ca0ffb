"""Queries of sub-pixel shifts and motion correction, on embedding vectors seen as 8 x 8 frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.numbers import tidy
from tracemill.operators import motion
from tracemill.plans.frame_queries import PX, out, px
from tracemill.plans.registry import query
from tracemill.plans.trace_queries import r
from tracemill.sources import bindings as b

REFINED = """te AS (SELECT recording, y, x, avg(value) AS g FROM px GROUP BY 1, 2, 3), ofs AS (SELECT dy, dx FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS dy), (SELECT unnest([-2, -1, 0, 1, 2]) AS dx)),
sc AS MATERIALIZED (SELECT p1.recording, frame, dy, dx, round(sum(value * g) / sqrt(sum(value * value) * sum(g * g)), 9) AS s FROM te, ofs, px p1 WHERE te.y BETWEEN 2 AND 5 AND te.x BETWEEN 2 AND 5 AND p1.recording = te.recording AND p1.y = te.y + dy AND p1.x = te.x + dx GROUP BY 1, 2, 3, 4),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording, frame ORDER BY s DESC, abs(dy) + abs(dx), dy DESC, dx DESC) AS k FROM sc) WHERE k = 1),
nb AS (SELECT rk.recording, rk.frame, rk.dy, rk.dx, rk.s, max(CASE WHEN sc.dy = rk.dy - 1 AND sc.dx = rk.dx THEN sc.s END) AS u, max(CASE WHEN sc.dy = rk.dy + 1 AND sc.dx = rk.dx THEN sc.s END) AS d, max(CASE WHEN sc.dx = rk.dx - 1 AND sc.dy = rk.dy THEN sc.s END) AS l, max(CASE WHEN sc.dx = rk.dx + 1 AND sc.dy = rk.dy THEN sc.s END) AS e FROM rk JOIN sc ON sc.recording = rk.recording AND sc.frame = rk.frame GROUP BY 1, 2, 3, 4, 5)"""


def vertex(a: str, c: str) -> str:
    bend = f"(2 * ln({a}) - 4 * ln(s) + 2 * ln({c}))"
    return f"CASE WHEN abs(dy) < 2 AND abs(dx) < 2 AND {a} > 0 AND s > 0 AND {c} > 0 THEN CASE WHEN {bend} < 0 THEN (ln({a}) - ln({c})) / {bend} ELSE 0.0 END ELSE 0.0 END"


@query("f13_subpixel_shifts", b.sql("pixels", then=REFINED) + f"SELECT recording, frame, {r('dy + ' + vertex('u', 'd'))} AS dy, {r('dx + ' + vertex('l', 'e'))} AS dx, {r('s')} AS score FROM nb")
def f13(spark, sf_dir):
    pixels = px(spark, sf_dir)
    template = pixels.groupBy("recording", "y", "x").agg(F.avg("value").alias("value"))
    return out(motion.estimate_shifts(pixels, template, 2, (2, 5)), "recording", "frame")


PLANTED = "sh AS (SELECT DISTINCT recording, frame, (frame % 7 - 3) / 4.0::DOUBLE AS dy, (frame % 5 - 2) / 2.0::DOUBLE AS dx FROM px), "
BACK = "CASE WHEN {c} < 0 THEN -1 - {c} WHEN {c} > 7 THEN 15 - {c} ELSE {c} END"
TAPS = PLANTED + "tp AS (SELECT px.recording, frame, y, x, y + floor(dy) + a AS sy0, x + floor(dx) + c AS sx0, (CASE WHEN a = 1 THEN dy - floor(dy) ELSE 1 - dy + floor(dy) END) * (CASE WHEN c = 1 THEN dx - floor(dx) ELSE 1 - dx + floor(dx) END) AS w FROM px JOIN sh USING (recording, frame), (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS c))"


@query("f16_subpixel_apply", b.sql("pixels", then=TAPS) + f"SELECT tp.recording, tp.frame, tp.y, tp.x, {r('sum(value * w)')} AS value FROM tp JOIN px ON px.recording = tp.recording AND px.frame = tp.frame AND px.y = {BACK.format(c='sy0')} AND px.x = {BACK.format(c='sx0')} GROUP BY 1, 2, 3, 4")
def f16(spark, sf_dir):
    pixels = px(spark, sf_dir)
    shifts = pixels.select("recording", "frame").distinct().select("recording", "frame", ((F.col("frame") % 7 - 3) / 4).alias("dy"), ((F.col("frame") % 5 - 2) / 2).alias("dx"))
    return out(motion.apply_shifts(pixels, shifts, 0, 7), *PX)


@query("f15_motion_correct")
def f15(spark, sf_dir):
    """Without SQL, since it loops; tests/test_motion.py takes planted motion back."""
    return out(motion.motion_correct(px(spark, sf_dir), 4, 2, 0, 7, weights=[0.25, 0.5, 0.25]), *PX)


PHASE = """evn AS (SELECT recording, frame, y + o AS y, x, avg(value) AS g FROM px, (SELECT unnest([-1, 1]) AS o) WHERE y % 2 = 0 GROUP BY 1, 2, 3, 4),
sc AS MATERIALIZED (SELECT p1.recording, p1.frame, dx, round(sum(value * g) / sqrt(sum(value * value) * sum(g * g)), 9) AS s FROM evn, (SELECT unnest([-2, -1, 0, 1, 2]) AS dx), px p1 WHERE p1.y % 2 = 1 AND evn.x BETWEEN 2 AND 5 AND p1.recording = evn.recording AND p1.frame = evn.frame AND p1.y = evn.y AND p1.x = evn.x + dx GROUP BY 1, 2, 3),
rk AS (SELECT *, 0 AS dy FROM (SELECT *, row_number() OVER (PARTITION BY recording, frame ORDER BY s DESC, abs(dx), dx DESC) AS k FROM sc) WHERE k = 1),
nb AS (SELECT rk.*, a.s AS l, c.s AS e FROM rk LEFT JOIN sc a ON a.recording = rk.recording AND a.frame = rk.frame AND a.dx = rk.dx - 1 LEFT JOIN sc c ON c.recording = rk.recording AND c.frame = rk.frame AND c.dx = rk.dx + 1)"""


@query("f17_phase_shifts", b.sql("pixels", then=PHASE) + f"SELECT recording, frame, {r('dx + ' + vertex('l', 'e'))} AS dx, {r('s')} AS score FROM nb")
def f17(spark, sf_dir):
    return motion.phase_shifts(px(spark, sf_dir), 2, 0, 7).select("recording", "frame", tidy("dx").alias("dx"), tidy("score").alias("score"))
