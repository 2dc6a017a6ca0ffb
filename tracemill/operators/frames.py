"""Operators on pixels(recording, frame, y, x, value): one row a pixel of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.operators.baselines import FINER, best_decay
from tracemill.operators.components import components

PLACE = ["recording", "y", "x"]


def rebin_space(px: DataFrame, n: int) -> DataFrame:
    """Mean over n x n blocks; incomplete blocks are dropped."""
    out = px.groupBy("recording", "frame", F.floor(F.col("y") / n).cast("int").alias("y"), F.floor(F.col("x") / n).cast("int").alias("x")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") == n * n).drop("n")


def crop(px: DataFrame, y: tuple[int, int], x: tuple[int, int], frame: tuple[int, int] | None = None) -> DataFrame:
    """Half-open ranges of rows, columns and frames."""
    keep = (F.col("y") >= y[0]) & (F.col("y") < y[1]) & (F.col("x") >= x[0]) & (F.col("x") < x[1])
    return px.filter(keep if frame is None else keep & (F.col("frame") >= frame[0]) & (F.col("frame") < frame[1]))


def closeup(px: DataFrame, roi_pixels: DataFrame, pad: int = 10) -> DataFrame:
    """The pixels of each recording within pad of the box around its rois; a recording without rois goes."""
    box = roi_pixels.groupBy("recording").agg(*(f(c).alias(f"{c}_{n}_") for c in "yx" for n, f in (("low", F.min), ("high", F.max))))
    inside = [F.col(c).between(F.col(f"{c}_low_") - pad, F.col(f"{c}_high_") + pad) for c in "yx"]
    return px.join(box, "recording").filter(inside[0] & inside[1]).select(*px.columns)


def resize_axis(px: DataFrame, axis: str, factor: float) -> DataFrame:
    """Area-weighted mean along frame, y or x: place k of the result covers [k, k + 1) / factor; an incomplete last one goes."""
    step, here = 1 / factor, F.col(axis)
    parts = px.withColumn("k", F.explode(F.sequence(F.floor(here / step), F.ceil((here + 1) / step) - 1)))
    overlap = F.least(here + 1.0, (F.col("k") + 1) * step) - F.greatest(here * 1.0, F.col("k") * step)
    others = [c for c in ("recording", "frame", "y", "x") if c != axis]
    out = parts.withColumn("o", overlap).filter("o > 0").groupBy(*others, "k").agg((F.sum(F.col("value") * F.col("o")) / F.sum("o")).alias("value"), F.sum("o").alias("o"))
    return out.filter(F.col("o") > step - 1e-9).select(*(F.col("k").alias(c) if c == axis else c for c in ("recording", "frame", "y", "x")), "value")


def resize_time(px: DataFrame, factor: float) -> DataFrame:
    return resize_axis(px, "frame", factor)


def resize(px: DataFrame, fx: float = 1.0, fy: float = 1.0, fz: float = 1.0) -> DataFrame:
    """Area-weighted means over columns, rows and time."""
    for axis, factor in (("x", fx), ("y", fy), ("frame", fz)):
        px = resize_axis(px, axis, factor) if factor != 1.0 else px
    return px


def blur(px: DataFrame, axis: str, weights: list[float], low: int, high: int | None = None) -> DataFrame:
    """Weighted mean along one axis with the edge repeated; weights has odd length, low and high are the axis'
    ends, high each recording's own if none is given."""
    half = len(weights) // 2
    if high is None:
        px = px.join(px.groupBy("recording").agg(F.max(axis).alias("axis_end")), "recording")
    high = F.col("axis_end") if high is None else F.lit(high)
    # A pixel feeds every place whose clamped neighbour it is: edges feed the taps beyond them too. One pass over px, no union.
    here, taps = F.col(axis), [(i - half, w) for i, w in enumerate(weights)]
    kind = px.schema[axis].dataType
    fed = lambda to, w, holds: F.struct(to.cast(kind).alias("to"), F.lit(float(w)).alias("w"), holds.alias("holds"))
    inside = [fed(here - d, w, F.lit(True)) for d, w in taps]
    over_low = [fed(F.lit(low + j), w, here == low) for d, w in taps for j in range(half + 1) if j + d < 0]
    over_high = [fed(high - j, w, here == high) for d, w in taps for j in range(half + 1) if d - j > 0]
    places = F.filter(F.array(*inside, *over_low, *over_high), lambda p: p["holds"] & p["to"].between(low, high))
    every = px.withColumn("fed_", F.explode(places)).select("*", F.col("fed_.to").alias("to"), F.col("fed_.w").alias("w"))
    others = [c for c in ("recording", "frame", "y", "x") if c != axis]
    return every.groupBy(*others, F.col("to").alias(axis)).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def bin_median(px: DataFrame, n_bins: int) -> DataFrame:
    """Median over bins of the bin mean; bin b holds frames b, b + n_bins, ..."""
    means = px.groupBy(*PLACE, F.pmod(F.col("frame"), F.lit(n_bins)).alias("bin")).agg(F.avg("value").alias("m"))
    return means.groupBy(*PLACE).agg(F.percentile("m", F.lit(0.5)).alias("value"))


#: Rates a frame that a fading is first sought at; slower ones are as good as a straight line.
RATES = tuple(10.0 ** (k / 2) for k in range(-8, 1))


def debleach(px: DataFrame, rates: tuple[float, ...] = RATES) -> DataFrame:
    """value less the trend of the frames' medians, whose own median is kept.

    The trend is b + c exp(-rate frame), with the rate the best of a grid, then of a finer one around it, and b and c
    least squares. Without rates, and for recordings without such a curve (under three frames), it is a straight line.
    """
    medians = px.groupBy("recording", "frame").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    line = medians.groupBy("recording").agg(F.regr_slope("m", "frame").alias("a"), F.avg("frame").alias("mid"), F.percentile("m", F.lit(0.5)).alias("middle"))
    straight = F.coalesce("a", F.lit(0.0)) * (F.col("frame") - F.col("mid"))
    if not rates:
        return px.join(line, "recording").withColumn("value", F.col("value") - straight).select(*px.columns)
    series = medians.select("recording", F.col("frame").alias("i"), F.col("m").alias("value"))
    coarse = best_decay(series, F.array(*map(F.lit, rates)), ["recording"]).select("recording", F.col("rate").alias("near"))
    fit = best_decay(series.join(coarse, "recording"), F.array(*(F.col("near") * f for f in FINER)), ["recording"])
    fading = F.col("b") + F.col("c") * F.exp(-F.col("rate") * F.col("frame")) - F.col("middle")
    return px.join(line, "recording").join(fit, "recording", "left").withColumn("value", F.col("value") - F.coalesce(fading, straight)).select(*px.columns)


def stat_images(px: DataFrame, last: int = 10) -> DataFrame:
    """Per pixel mean, population deviation and the percentile 100 (1 - last / N); also the deviation of frame differences."""
    own = Window.partitionBy(*PLACE)
    step = F.col("value") - F.lag("value").over(own.orderBy("frame"))
    n = px.groupBy("recording").agg(F.countDistinct("frame").alias("n_frames"))
    # Interpolated order statistic: only what lies at or above it stays of a pixel's time course, last + 1 values if no frame is repeated.
    at = (F.col("n_held") - 1) * F.greatest(1 - last / F.col("n_frames"), F.lit(0.0))
    low = F.floor(at)
    rows = px.join(F.broadcast(n), "recording").withColumn("step", step).withColumn("n_held", F.count("value").over(own))
    rows = rows.withColumn("place", F.row_number().over(own.orderBy(F.col("value").desc_nulls_last())))
    top = F.sort_array(F.collect_list(F.when(F.col("place") <= F.col("n_held") - low, F.col("value"))), False)
    found = rows.groupBy(*PLACE, "n_frames", "n_held").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.stddev_pop("step").alias("diff_std"), top.alias("top"))
    value = lambda k: F.try_element_at("top", (F.col("n_held") - F.least(k, F.col("n_held") - 1)).cast("int"))  # noqa: E731  the k-th from below
    return found.select(*PLACE, "mean", "std", "diff_std", F.when(F.col("n_held") > 0, value(low) + (value(low + 1) - value(low)) * (at - low)).alias("highperc"))


def robust_max(px: DataFrame, column: str, last: int = 10, keys=("recording",)) -> DataFrame:
    """Per key the value of the last-th largest magnitude, interpolated.

    Only the last + 1 largest of a key are ranked, of each task first, so no key meets in one array.
    """
    size = px.groupBy(*keys).agg(F.count(column).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("magnitude")))
    top = px.filter(F.col(column).isNotNull()).select(*keys, F.abs(column).alias("magnitude")).withColumn("place", place).filter(F.col("place") <= last + 1)
    v = top.groupBy(*keys).agg(F.sort_array(F.collect_list("magnitude"), False).alias("v")).join(size, list(keys))
    at = (F.col("n") - 1) * F.greatest(1 - last / F.col("n"), F.lit(0.0))
    low = F.floor(at)
    value = lambda k: F.element_at("v", (F.col("n") - F.least(k, F.col("n") - 1)).cast("int"))  # noqa: E731  the k-th from below
    return v.select(*keys, (value(low) + (value(low + 1) - value(low)) * (at - low)).alias("robust_max"))


def composite(images: DataFrame, names: list[str], last: int = 10) -> DataFrame:
    """Mean of the named images each divided by its robust maximum, times the mean maximum."""
    out, total = images, F.lit(0.0)
    for name in names:
        out = out.join(robust_max(images, name, last).withColumnRenamed("robust_max", f"max_{name}"), "recording")
        total = total + F.col(name) / F.col(f"max_{name}")
    scale = sum((F.col(f"max_{n}") for n in names), F.lit(0.0)) / len(names)
    return out.select(*PLACE, (total / len(names) * scale).alias("value"))


def threshold_mask(image: DataFrame, fraction: float) -> DataFrame:
    """Pixels above a fraction of the recording's largest value."""
    top = image.groupBy("recording").agg(F.max("value").alias("top"))
    return image.join(top, "recording").filter(F.col("value") > fraction * F.col("top")).drop("top")


def dilate(mask: DataFrame, radius: int, low: int, high: int) -> DataFrame:
    """Places within a disc of a mask pixel."""
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    taps = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in disc)))
    moved = mask.withColumn("o", taps).select("recording", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return moved.filter(F.col("y").between(low, high) & F.col("x").between(low, high)).distinct()


def subset_frames(px: DataFrame, every: int, largest: int) -> DataFrame:
    """Every so many frames, rescaled so that twice the maximum maps to the integer range."""
    kept = px.filter(F.col("frame") % every == 0)
    top = kept.groupBy("recording").agg(F.max("value").alias("top"))
    scaled = F.floor(F.greatest("value", F.lit(0.0)) / (2 * F.col("top")) * largest).cast("int")
    return kept.join(top, "recording").withColumn("frame", F.floor(F.col("frame") / every)).withColumn("value", scaled).select(*px.columns)


def count_saturated(px: DataFrame, roi_pixels: DataFrame, last: int = 3, share: float = 1.0) -> DataFrame:
    """Per roi the pixels whose robust maximum over time is that of the whole recording's largest, or at least that share of it."""
    each = robust_max(px, "value", last, PLACE)
    top = each.groupBy("recording").agg(F.max("robust_max").alias("top"))
    full = F.col("robust_max") == F.col("top") if share == 1.0 else F.col("robust_max") >= share * F.col("top")
    return each.join(top, "recording").join(roi_pixels, PLACE).groupBy("recording", "roi").agg(F.count_if(full).alias("n_saturated"), F.count(F.lit(1)).alias("n_pixels"))


def connected_events(mask: DataFrame) -> DataFrame:
    """Spatio-temporal components of active pixels: neighbours in the same and the next frame, diagonals included.

    event is the least pixel, a struct (frame, y, x), of its component in its recording.
    """
    here = ["recording", "frame", "y", "x"]
    rows = mask.withColumn("id", F.struct(*here))
    steps = [(df, dy, dx) for df in (0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (df, dy, dx) > (0, 0, 0) or df]
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("f"), F.lit(b).alias("y"), F.lit(c).alias("x")) for a, b, c in steps)))
    near = rows.withColumn("o", o).select("recording", (F.col("frame") + F.col("o.f")).alias("frame"), (F.col("y") + F.col("o.y")).alias("y"), (F.col("x") + F.col("o.x")).alias("x"), F.col("id").alias("a"))
    edges = near.join(rows.select(*here, F.col("id").alias("b")), here).select("a", "b")
    roots = components(edges.union(rows.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    return roots.select("node.*", F.struct("root.frame", "root.y", "root.x").alias("event"))


def event_bounds(found: DataFrame) -> DataFrame:
    """Half-open bounding box and size of each component."""
    ends = [x for c in ("frame", "y", "x") for x in (F.min(c).alias(f"{c}_begin"), (F.max(c) + 1).alias(f"{c}_end"))]
    return found.groupBy("recording", "event").agg(*ends, F.count(F.lit(1)).alias("n"))


def still_movie(px: DataFrame, samples: int = 10) -> DataFrame:
    """Deviation over mean of sampled frames: below a tenth nothing moves."""
    n = px.groupBy("recording").agg((F.max("frame") + 1).alias("n"))
    s = px.join(n, "recording").filter(F.col("frame") % F.greatest(F.floor(F.col("n") / samples), F.lit(1)) == 0)
    return s.groupBy("recording").agg((F.stddev_pop("value") / F.abs(F.avg("value"))).alias("contrast"))


def shift_scores(px: DataFrame, template: DataFrame, most: int, margin: tuple[int, int]) -> DataFrame:
    """Normalised cross-correlation of every frame with the template at each offset up to most.

    The template is cropped to margin (low, high) so that every offset sees all of it.
    """
    span = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    cut = template.filter(F.col("y").between(*margin) & F.col("x").between(*margin)).select("recording", "y", "x", F.col("value").alias("g"))
    moved = cut.withColumn("dy", span).withColumn("dx", span).select("recording", "dy", "dx", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "g")
    return px.join(moved, PLACE).groupBy("recording", "frame", "dy", "dx").agg((F.sum(F.col("value") * F.col("g")) / F.sqrt(F.sum(F.col("value") * F.col("value")) * F.sum(F.col("g") * F.col("g")))).alias("score"))


def estimate_shifts(px: DataFrame, template: DataFrame, most: int, margin: tuple[int, int]) -> DataFrame:
    """Whole-pixel offset of the best score per frame; the smallest offset of equals."""
    scores = shift_scores(px, template, most, margin)
    best = F.max(F.struct(F.round("score", 9).alias("s"), (-(F.abs("dy") + F.abs("dx"))).alias("near"), "dy", "dx")).alias("b")
    return scores.groupBy("recording", "frame").agg(best).select("recording", "frame", "b.dy", "b.dx", F.col("b.s").alias("score"))


def apply_shifts(px: DataFrame, shifts: DataFrame, low: int, high: int) -> DataFrame:
    """Frames moved back by their whole-pixel shift, the border repeated from the nearest pixel inside."""
    s = px.join(shifts.select("recording", "frame", "dy", "dx"), ["recording", "frame"])
    grid = s.select("recording", "frame", "dy", "dx", "y", "x").withColumn("sy", F.least(F.greatest(F.col("y") + F.col("dy"), F.lit(low)), F.lit(high))).withColumn("sx", F.least(F.greatest(F.col("x") + F.col("dx"), F.lit(low)), F.lit(high)))
    source = px.select("recording", "frame", F.col("y").alias("sy"), F.col("x").alias("sx"), "value")
    return grid.join(source, ["recording", "frame", "sy", "sx"]).select("recording", "frame", "y", "x", "value")


def pairwise_shifts(shifts: DataFrame) -> DataFrame:
    """Shifts of each frame against the one before, summed up, less their median."""
    w = Window.partitionBy("recording").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    run = shifts.withColumn("cy", F.sum("dy").over(w)).withColumn("cx", F.sum("dx").over(w))
    middle = run.groupBy("recording").agg(F.percentile("cy", F.lit(0.5)).alias("my"), F.percentile("cx", F.lit(0.5)).alias("mx"))
    return run.join(middle, "recording").select("recording", "frame", (F.col("cy") - F.col("my")).alias("dy"), (F.col("cx") - F.col("mx")).alias("dx"))


def rois_from_shapes(image: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pixels inside circles (roi, cy, cx, radius); drawn by hand, so a handful."""
    inside = F.pow(F.col("y") - F.col("cy"), F.lit(2)) + F.pow(F.col("x") - F.col("cx"), F.lit(2)) <= F.pow("radius", F.lit(2))
    return image.join(F.broadcast(shapes), inside).groupBy("recording", "roi").agg(F.max(F.struct("value", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("b"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("recording", "roi", (-F.col("b.ny")).alias("peak_y"), (-F.col("b.nx")).alias("peak_x"), "n", "mean")




def preview(px: DataFrame, n_space: int, n_time: int) -> DataFrame:
    """Block means in space and time; incomplete blocks are dropped."""
    small = rebin_space(px, n_space)
    out = small.groupBy("recording", F.floor(F.col("frame") / n_time).alias("frame"), "y", "x").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") == n_time).drop("n")


def bandpass(image: DataFrame, narrow: list[float], wide: list[float], low: int, high: int) -> DataFrame:
    """Difference of a narrow and a wide blur of images(recording, y, x, value)."""
    def both(weights: list[float]) -> DataFrame:
        return blur(blur(image.withColumn("frame", F.lit(0)), "y", weights, low, high), "x", weights, low, high).drop("frame")

    return both(narrow).join(both(wide).withColumnRenamed("value", "wide"), PLACE).select(*PLACE, (F.col("value") - F.col("wide")).alias("value"))
