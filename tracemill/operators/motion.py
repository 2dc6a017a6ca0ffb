"""Sub-pixel motion correction of pixels(recording, frame, y, x, value); shifts(recording, frame, dy, dx).

Offsets of a frame are bounded by the largest shift, so what is gathered per frame is bounded too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.tables import discard, written
from tracemill.operators import frames as fr


def _vertex(before: Column, at: Column, after: Column) -> Column:
    """Offset of the top of the parabola through the logarithms of three scores, zero if one is not positive."""
    a, b, c = F.ln(before), F.ln(at), F.ln(after)
    bend = 2 * a - 4 * b + 2 * c
    return F.when((before > 0) & (at > 0) & (after > 0) & (bend < 0), (a - c) / bend).otherwise(0.0)


def refined(scores: DataFrame, most: int) -> DataFrame:
    """The best offset per frame of scores(recording, frame, dy, dx, score), refined where it is not at the edge.

    Of equal scores (to nine digits) the smallest offset counts.
    """
    wide = 4 * most + 3  # two offsets never share a number, those one beyond the edge included
    number = lambda dy, dx: (dy * wide + dx).cast("int")
    s = F.round("score", 9)
    best = F.max(F.struct(s.alias("s"), (-(F.abs("dy") + F.abs("dx"))).alias("near"), "dy", "dx")).alias("b")
    every = F.map_from_entries(F.collect_list(F.struct(number(F.col("dy"), F.col("dx")).alias("k"), s.alias("s")))).alias("all")
    rows = scores.groupBy("recording", "frame").agg(best, every).select("recording", "frame", "b.dy", "b.dx", "b.s", "all")
    y, x = F.col("dy"), F.col("dx")
    at = lambda a, b: F.try_element_at("all", number(a, b))
    inside = (F.abs(y) < most) & (F.abs(x) < most)
    up = F.when(inside, _vertex(at(y - 1, x), F.col("s"), at(y + 1, x))).otherwise(0.0)
    right = F.when(inside, _vertex(at(y, x - 1), F.col("s"), at(y, x + 1))).otherwise(0.0)
    return rows.select("recording", "frame", (y + up).alias("dy"), (x + right).alias("dx"), F.col("s").alias("score"))


def estimate_shifts(px: DataFrame, template: DataFrame, most: int, margin: tuple[int, int]) -> DataFrame:
    """Offset of each frame against the template(recording, y, x, value) to parts of a pixel, with its correlation."""
    return refined(fr.shift_scores(px, template, most, margin), most)


def apply_shifts(px: DataFrame, shifts: DataFrame, low: int, high: int) -> DataFrame:
    """Frames moved back by their shift, bilinear; pixels beyond low and high are reflected, the edge repeated.

    A weighted mean never leaves the frame's own range. Frames without a shift go.
    """
    back = lambda c: F.least(F.greatest(F.when(c < low, 2 * low - 1 - c).when(c > high, 2 * high + 1 - c).otherwise(c), F.lit(low)), F.lit(high)).cast("int")
    rows = px.join(shifts.select("recording", "frame", "dy", "dx"), ["recording", "frame"])
    iy, ix = F.floor("dy"), F.floor("dx")
    fy, fx = F.col("dy") - iy, F.col("dx") - ix
    taps = F.explode(F.array(*(F.struct((F.col("y") + iy + a).alias("sy"), (F.col("x") + ix + b).alias("sx"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1))))
    spread = rows.select("recording", "frame", "y", "x", taps.alias("o")).filter("o.w > 0").select("recording", "frame", "y", "x", back(F.col("o.sy")).alias("sy"), back(F.col("o.sx")).alias("sx"), "o.w")
    source = px.select("recording", "frame", F.col("y").alias("sy"), F.col("x").alias("sx"), "value")
    return spread.join(source, ["recording", "frame", "sy", "sx"]).groupBy("recording", "frame", "y", "x").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def motion_shifts(px: DataFrame, n: int, most: int, low: int, high: int, rounds: int = 4, max_dev: float = 0.1, weights: list[float] | None = None) -> DataFrame:
    """shifts of every frame from rounds against the median of the corrected movie, n frames at a time.

    Blocks of n frames are averaged and blurred by weights (none: not); each round estimates the rest
    of the shift of the corrected blocks and adds it, until no part of a shift moves by max_dev or
    more, or after rounds. The frames of an incomplete last block take the block's before; a recording
    of under n frames has no shift. Each round is written, so lineage stays short.
    """
    whole = px.groupBy("recording").agg((F.floor((F.max("frame") + 1) / n) - 1).alias("last"))
    blocks = px.join(whole, "recording").withColumn("k", F.floor(F.col("frame") / n)).filter("k <= last").groupBy("recording", F.col("k").alias("frame"), "y", "x").agg(F.avg("value").alias("value"))
    if weights:
        blocks = fr.blur(fr.blur(blocks, "y", weights, low, high), "x", weights, low, high)
    blocks = written(blocks, "blocks")
    total = written(blocks.select("recording", "frame").distinct().select("recording", "frame", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx")), "shifts")
    margin = (low + most, high - most)
    for _ in range(rounds):
        now = written(apply_shifts(blocks, total, low, high), "corrected")
        template = now.groupBy("recording", "y", "x").agg(F.percentile("value", F.lit(0.5)).alias("value"))
        step = estimate_shifts(now, template, most, margin).select("recording", "frame", F.col("dy").alias("sy"), F.col("dx").alias("sx"))
        last, total = total, written(total.join(step, ["recording", "frame"], "left").select("recording", "frame", (F.col("dy") + F.coalesce("sy", F.lit(0.0))).alias("dy"), (F.col("dx") + F.coalesce("sx", F.lit(0.0))).alias("dx")), "shifts")
        moved = total.join(last.withColumnsRenamed({"dy": "oy", "dx": "ox"}), ["recording", "frame"]).agg(F.max(F.greatest(F.abs(F.col("dy") - F.col("oy")), F.abs(F.col("dx") - F.col("ox"))))).first()[0]
        discard(now)
        discard(last)
        if moved is None or moved < max_dev:
            break
    every = px.select("recording", "frame").distinct().join(whole, "recording").withColumn("k", F.least(F.floor(F.col("frame") / n), "last"))
    found = every.join(total.withColumnRenamed("frame", "k"), ["recording", "k"], "left")
    return found.select("recording", "frame", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dy", "dx")))


def motion_correct(px: DataFrame, n: int, most: int, low: int, high: int, **how) -> DataFrame:
    """px with motion_shifts taken back, clipped at zero."""
    moved = apply_shifts(px, motion_shifts(px, n, most, low, high, **how), low, high)
    return moved.withColumn("value", F.greatest("value", F.lit(0.0)))


def phase_shifts(px: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """Horizontal offset of each frame's odd lines against the mean of the even lines beside them; dy is 0."""
    beside = F.explode(F.array(F.lit(-1), F.lit(1)))
    even = px.filter("y % 2 = 0").withColumn("o", beside).groupBy("recording", "frame", (F.col("y") + F.col("o")).alias("y"), "x").agg(F.avg("value").alias("g"))
    moved = even.filter(F.col("x").between(low + most, high - most)).withColumn("dx", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("x", F.col("x") + F.col("dx"))
    v, g = F.col("value"), F.col("g")
    scores = px.filter("y % 2 = 1").join(moved, ["recording", "frame", "y", "x"]).groupBy("recording", "frame", "dx").agg((F.sum(v * g) / F.sqrt(F.sum(v * v) * F.sum(g * g))).alias("score"))
    return refined(scores.withColumn("dy", F.lit(0)), most).withColumn("dy", F.lit(0.0))


def correct_phase(px: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """px with the odd lines of every frame moved back by its phase shift; even lines stay."""
    # With dy = 0 only taps of the same line have weight, so odd lines alone are enough.
    odd = px.filter("y % 2 = 1")
    return px.filter("y % 2 = 0").select("recording", "frame", "y", "x", "value").unionByName(apply_shifts(odd, phase_shifts(px, most, low, high), low, high))
