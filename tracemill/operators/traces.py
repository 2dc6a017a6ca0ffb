"""Operators on traces(roi, i, t, value): one row a sample, ``keys`` name a trace.

Each keeps the rows of a trace in one hash partition, so chained windows share one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.numbers import correlation, ln, sigma
from tracemill.functions.tables import numbered, written
from tracemill.operators.events import inside_windows

KEYS = ("roi",)


def rebin(df: DataFrame, n: int, keys=KEYS, agg: str = "avg") -> DataFrame:
    """Blocks of n samples by an aggregate; an incomplete last block is dropped."""
    if n < 1:
        raise ValueError("n must be at least 1")
    block = df.groupBy(*keys, F.floor(F.col("i") / n).cast("int").alias("i")).agg(F.avg("t").alias("t"), F.expr(f"{agg}(value)").alias("value"), F.count(F.lit(1)).alias("n"))
    return block.filter(F.col("n") == n).drop("n")


def demean(df: DataFrame, keys=KEYS) -> DataFrame:
    """trend is the trace's mean, detrended the rest."""
    trend = F.avg("value").over(Window.partitionBy(*keys))
    return df.withColumn("trend", trend).withColumn("detrended", F.col("value") - F.col("trend"))


def mirrored(df: DataFrame, margin: int, keys=KEYS) -> DataFrame:
    """df with up to margin samples reflected at both ends, the edge sample repeated; inner marks the originals."""
    rows = df.withColumn("n_samples", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    i, n = F.col("i"), F.col("n_samples").cast("int")
    places = F.array_compact(F.array(i, F.when(i < margin, -1 - i), F.when(i >= n - margin, 2 * n - 1 - i)))
    return rows.withColumn("place", F.explode(places)).withColumn("inner", F.col("place") == i)


FUNCTIONS = {"avg": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}


def _halves(x: Column) -> tuple[Column, Column]:
    """x as a sum of two numbers of 26 bits, whose products are exact."""
    high = x * 134217729.0 - (x * 134217729.0 - x)
    return high, x - high


def interpolated(values: str, fraction: float) -> Column:
    """The fraction's place in a sorted array, between two values low x (1 - share) + high x share; null if it is empty.

    The first product is not rounded before the sum, as in the SQL engine, which fuses both; F.percentile rounds it, and
    so decides differently what lies at a threshold. Its rounding error is had from halves of its factors.
    """
    at = (F.size(values) - 1) * F.lit(float(fraction))
    k = F.floor(at).cast("int")
    low, high = (F.try_element_at(values, F.least(k + d, F.size(values))) for d in (1, 2))
    held = F.struct(low.cast("double").alias("a"), high.cast("double").alias("b"), (at - k).alias("d"))

    def between(v: Column) -> Column:
        a, rest, second = v["a"], 1 - v["d"], v["b"] * v["d"]
        (a1, a2), (r1, r2) = _halves(a), _halves(rest)
        first = a * rest
        lost = a2 * r2 - (((first - a1 * r1) - a2 * r1) - a1 * r2)
        total = first + second
        part = total - first
        fused = total + (((first - (total - part)) + (second - part)) + lost)
        return F.when((v["d"] == 0) | (a == v["b"]), a).when(F.abs(a) < 1e290, fused).otherwise(total)

    return F.when(F.size(values) > 0, F.element_at(F.transform(F.array(held), between), 1))


def quantiles(df: DataFrame, column: str, fractions: list[float]) -> list[float | None]:
    """The fractions' places among a column's values in order, between two values low x (1 - share) + high x share; null if there are none.

    As in the SQL engine's aggregate the first product is not rounded before the sum, and, other than in its windows, two
    equal values may be missed by a bit. Values are numbered by all tasks; only those at the places reach the driver.
    """
    placed = numbered(df.select(F.col(column).cast("double").alias("x")).dropna(), ["x"], "at")
    n = placed.count()
    places = [(n - 1) * f for f in fractions] if n else []
    held = {r["at"]: r["x"] for r in placed.filter(F.col("at").isin([p for at in places for p in (math.floor(at), math.ceil(at))])).collect()}
    between = lambda low, high, share: math.fma(low, 1 - share, high * share) if share else low
    return [between(held[math.floor(at)], held[math.ceil(at)], at - math.floor(at)) for at in places] or [None] * len(fractions)


def running(df: DataFrame, size: int, funcs: dict[str, str | float], keys=KEYS, column: str = "value") -> DataFrame:
    """Centred running functions over an odd window, reflected at the ends.

    funcs maps a new column to "avg", "std" (population), "min", "max" or a fraction for a percentile.
    """
    delta = size // 2
    frame = Window.partitionBy(*keys).orderBy("place").rowsBetween(-delta, delta)
    out = mirrored(df, delta, keys)
    for name, f in funcs.items():
        if isinstance(f, str):
            out = out.withColumn(name, FUNCTIONS[f](column).over(frame))
        else:
            out = out.withColumn("held_", F.sort_array(F.collect_list(column).over(frame))).withColumn(name, interpolated("held_", f)).drop("held_")
    return out.filter("inner").drop("inner", "place", "n_samples")


def percentile_lowpass(df: DataFrame, size: int, fraction: float = 0.1, average: int | None = None, keys=KEYS) -> DataFrame:
    """slow: running percentile, then a running mean."""
    low = running(df, size, {"low": fraction}, keys)
    return running(low, average or size, {"slow": "avg"}, keys, "low").drop("low")


def z_scores(df: DataFrame, gain: float = 1.0) -> DataFrame:
    """fast = value - slow and z = fast / sigma(slow)."""
    return df.withColumn("fast", F.col("value") - F.col("slow")).withColumn("z", F.col("fast") / sigma(F.col("slow"), gain))


def trailing(df: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """Moving sum and average of the last n samples; the first n - 1 samples are dropped."""
    order = Window.partitionBy(*keys).orderBy("i")
    frame = order.rowsBetween(-(n - 1), 0)
    return df.withColumn("moving_sum", F.sum("value").over(frame)).withColumn("moving_average", F.avg("value").over(frame)).withColumn("seen", F.count(F.lit(1)).over(frame)).filter(F.col("seen") == n).drop("seen")


def activity(df: DataFrame, z_th: float, begin: float, end: float, keys=KEYS) -> DataFrame:
    """Fraction of samples above z_th strictly inside a time frame."""
    return df.filter((F.col("t") > begin) & (F.col("t") < end)).groupBy(*keys).agg(F.avg((F.col("z") > z_th).cast("double")).alias("activity"))


def raster(df: DataFrame, z_th: float, smooth: int = 0, keys=KEYS) -> DataFrame:
    """on: whether z, after a running mean over 2 x smooth + 1 samples, is above z_th."""
    rows = running(df, 2 * smooth + 1, {"z_smooth": "avg"}, keys, "z") if smooth else df.withColumn("z_smooth", F.col("z"))
    return rows.withColumn("on", F.col("z_smooth") > z_th)


def excursions(df: DataFrame, z_th: float, dt: float, keys=KEYS) -> DataFrame:
    """Runs of samples with z above z_th as events, by gaps and islands."""
    order = Window.partitionBy(*keys).orderBy("i")
    above = F.col("z") > z_th
    rows = df.withColumn("above", above).withColumn("starts", (above & ~F.coalesce(F.lag(above).over(order), F.lit(False))).cast("int"))
    runs = rows.withColumn("run", F.sum("starts").over(order)).filter("above")
    peak = F.struct("z", (-F.col("i")).alias("first"), "t")
    return runs.groupBy(*keys, "run").agg(
        F.min("t").alias("t0"), (F.max("t") + dt).alias("tend"), F.max(peak)["t"].alias("peakpoint"), F.max("z").alias("z_max"),
        (F.sum(F.col("fast") / F.greatest("slow", F.lit(1.0))) * dt).alias("auc"),
    ).withColumn("halfwidth", F.col("tend") - F.col("t0")).drop("run")


def fill_gaps(df: DataFrame, width: int, keys=()) -> DataFrame:
    """Stretches where every trace is zero become the line between the means of width samples on each side.

    The last sample of a gap is left as it is. raw keeps the old value.
    """
    zero = df.groupBy(*keys, "i").agg(F.bool_and(F.col("value") == 0).alias("zero"))
    order = Window.partitionBy(*keys).orderBy("i") if keys else Window.orderBy("i")
    # One row a time step, whatever the number of traces.
    starts = zero.withColumn("starts", (F.col("zero") & ~F.coalesce(F.lag("zero").over(order), F.lit(False))).cast("int"))
    gaps = starts.withColumn("gap", F.sum("starts").over(order)).filter("zero").groupBy(*keys, "gap").agg(F.min("i").alias("g0"), F.max("i").alias("g1"))
    keys = list(keys)
    # The samples beside a gap and in it, one row each: equi-joins, whatever the number of gaps.
    beside = lambda a, c, what: gaps.select(*keys, "g0", "g1", F.explode(F.sequence(a, c)).alias("i"), F.lit(what).alias("side"))
    near = beside(F.col("g0") - width, F.col("g0") - 1, "before").unionByName(beside(F.col("g1") + 1, F.col("g1") + width, "after"))
    side = df.join(near, [*keys, "i"]).groupBy(*keys, "roi", "g0", "g1").agg(*(F.avg(F.when(F.col("side") == w, F.col("value"))).alias(w) for w in ("before", "after")))
    inside = gaps.filter("g1 > g0").select(*keys, "g0", "g1", F.explode(F.sequence(F.col("g0"), F.col("g1") - 1)).alias("i"))
    rows = df.join(inside, [*keys, "i"], "left").join(side, [*keys, "roi", "g0", "g1"], "left")
    line = F.coalesce("before", "after") + (F.coalesce("after", "before") - F.coalesce("before", "after")) * (F.col("i") - F.col("g0") + 1) / (F.col("g1") - F.col("g0") + 2)
    return rows.select(*keys, "roi", "i", "t", F.col("value").alias("raw"), F.coalesce(line, F.col("value")).alias("value"))


def weighted_mean_trace(df: DataFrame, weight: Column, keys=()) -> DataFrame:
    """Mean over traces at each sample, weighted."""
    return df.groupBy(*keys, "i").agg(F.first("t").alias("t"), (F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"))


def sum_trace(df: DataFrame, n: int, keys=()) -> DataFrame:
    """Sum over traces of what deviates from each trace's mean, rebinned."""
    total = demean(df, (*keys, "roi")).groupBy(*keys, "i").agg(F.first("t").alias("t"), F.sum("detrended").alias("value"))
    return rebin(total, n, keys)


def power_spectrum(df: DataFrame, frequencies: list[int], length: int, keys=("recording",)) -> DataFrame:
    """Magnitude of the mean over traces of each Fourier coefficient."""
    k = F.explode(F.array(*map(F.lit, frequencies)))
    angle = -2 * 3.141592653589793 * F.col("k") * F.col("i") / length
    one = df.withColumn("k", k).groupBy(*keys, "roi", "k").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), F.sum(F.col("value") * F.sin(angle)).alias("im"))
    return one.groupBy(*keys, "k").agg(F.sqrt(F.pow(F.avg("re"), F.lit(2)) + F.pow(F.avg("im"), F.lit(2))).alias("magnitude"))


def autocorrelation(df: DataFrame, lags: list[int], keys=KEYS, splits: int = 1) -> DataFrame:
    """Pearson correlation of a trace with itself lag samples later; lag 0 is 1, a level trace has none elsewhere.

    With more than one split the trace is cut into so many pieces of (nearly) equal length: r is the mean over
    them and r_std their deviation.
    """
    keys = list(keys)
    last = df.groupBy(*keys).agg((F.max("i") + 1).alias("n_"))
    part = F.floor(((F.col("i") + 1) * splits - 1) / F.col("n_"))
    rows = (df.join(last, keys) if splits > 1 else df).withColumn("split_", part if splits > 1 else F.lit(0))
    own = [*keys, "split_"]
    later = rows.select(*own, F.explode(F.array(*map(F.lit, lags))).alias("lag"), "i", F.col("value").alias("later")).withColumn("i", F.col("i") - F.col("lag"))
    r = rows.join(later, [*own, "i"]).groupBy(*own, "lag").agg(correlation(F.col("value"), F.col("later")).alias("r"))
    r = r.withColumn("r", F.when(F.col("lag") == 0, 1.0).otherwise(F.col("r")))
    return r.drop("split_") if splits == 1 else r.groupBy(*keys, "lag").agg(F.avg("r").alias("r"), F.stddev_pop("r").alias("r_std"))


def correlation_to_sum(df: DataFrame, keys=("recording",)) -> DataFrame:
    """Pearson correlation of each trace with the sum over all traces of its recording."""
    total = F.sum("value").over(Window.partitionBy(*keys, "i"))
    return df.withColumn("total", total).groupBy(*keys, "roi").agg(correlation(F.col("value"), F.col("total")).alias("r"))


def most_representative(scores: DataFrame, columns: list[str], k: int = 3, keys=("recording",)) -> DataFrame:
    """Rank by each column (ties share their mean rank), add the ranks, keep the k largest sums."""
    total = F.lit(0.0)
    for c in columns:
        w = Window.partitionBy(*keys).orderBy(c)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        total = total + F.rank().over(w) + (ties - 1) / 2
    best = Window.partitionBy(*keys).orderBy(F.desc("rank_sum"), "roi")
    return scores.withColumn("rank_sum", total).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def rescale(df: DataFrame, mode: str, keys=("recording",)) -> DataFrame:
    """z divided by the median over traces of their deviation (soft), or by each trace's 1.4826 MAD (hard)."""
    own = [*keys, "roi"]
    if mode == "soft":
        each = df.groupBy(*own).agg(F.stddev_pop("z").alias("s"))
        scale = each.groupBy(*keys).agg(F.percentile("s", F.lit(0.5)).alias("scale"))
        return df.join(scale, list(keys)).withColumn("z", F.col("z") / F.col("scale")).drop("scale")
    of_trace = Window.partitionBy(*own)
    median = lambda c: F.percentile(c, F.lit(0.5)).over(of_trace)
    off = df.dropna(subset=own).withColumn("middle_", median("z")).withColumn("off_", F.abs(F.col("z") - F.col("middle_")))
    return off.withColumn("z", F.col("z") / (1.4826 * median("off_"))).drop("middle_", "off_")


def first_run(df: DataFrame, condition: Column, least: int, keys=KEYS) -> DataFrame:
    """First index of the first run of at least so many samples for which the condition holds."""
    order = Window.partitionBy(*keys).orderBy("i")
    rows = df.withColumn("ok", condition).withColumn("run", F.col("i") - F.sum(F.when(condition, 1).otherwise(0)).over(order)).filter("ok")
    return rows.groupBy(*keys, "run").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).groupBy(*keys).agg(F.min("first").alias("first"))


def shown(df: DataFrame, n: int, offset: float, keys=KEYS) -> DataFrame:
    """Rebinned z (times the root of n), less its median, stacked by offset deviations in order of traces."""
    binned = rebin(df, n, keys).withColumn("value", F.col("value") * n**0.5)
    stats = binned.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("middle"), F.stddev_pop("value").alias("s"))
    stacked = stats.withColumn("shift", F.sum(F.col("s") * offset).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)))
    return binned.join(stacked, list(keys)).select(*keys, "i", "t", (F.col("value") - F.col("middle") + F.col("shift")).alias("value"))


def mean_variance_points(df: DataFrame, half: int, every: int, keys=KEYS) -> DataFrame:
    """slow and the variance of fast within half samples on each side, at every so many samples."""
    frame = Window.partitionBy(*keys).orderBy("i").rowsBetween(-half, half)
    return df.withColumn("variance", F.var_pop("fast").over(frame)).filter((F.col("i") % every == 0) & (F.col("slow") > 0)).select(*keys, "i", F.col("slow").alias("mean"), "variance")


def gain(points: DataFrame, rounds: int = 5, most: float = 10.0) -> DataFrame:
    """Variance over mean: the mean of ratios, less points beyond most times the current gain, round by round."""
    ratio = points.withColumn("ratio", F.col("variance") / F.col("mean"))
    for _ in range(rounds):
        now = ratio.agg(F.avg("ratio").alias("now"))
        ratio = ratio.crossJoin(F.broadcast(now)).filter(F.col("ratio") <= most * F.col("now")).drop("now")
    return ratio.agg(F.avg("ratio").alias("gain"), F.count(F.lit(1)).alias("n"))


def infer_gain(points: DataFrame, most: float | None = None, bins: int = 50, rounds: int = 5, tolerance: float = 0.03) -> float | None:
    """Variance over mean of points(mean, variance): the mean over bins of the median variance over the mean of means.

    Bins are even in the logarithm from the 2nd percentile of the means to the 98th, or to most if that is less, and
    hold what lies beyond either end too; a mean not above 0 counts as the least one that is. Points above ten times
    the gain leave the medians, and so on for so many rounds or until the gain changes by less than the tolerance.
    """
    least = points.filter("mean > 0").agg(F.min("mean")).first()[0]
    if least is None:
        return None
    rows = points.withColumn("mean", F.when(F.col("mean") > 0, F.col("mean")).otherwise(least))
    low, high = rows.agg(F.percentile("mean", F.array(F.lit(0.02), F.lit(0.98))).alias("p")).first()["p"]
    high = high if most is None else min(high, most)
    place = F.floor((F.ln("mean") - math.log(low)) / max(math.log(high) - math.log(low), 1e-300) * (bins - 1)) + 1
    binned = rows.withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.lit(bins)))
    held, now = F.lit(True), None
    for turn in range(rounds + 1):
        own = F.when(held, F.col("variance"))
        each = binned.groupBy("bin").agg(F.avg("mean").alias("x"), F.percentile(own, F.lit(0.5)).alias("y"), F.count_if(~held).alias("gone"))
        new = each.agg(F.avg(F.col("y") / F.col("x")).alias("gain"), F.sum("gone").alias("gone")).first()
        if turn and (not new["gone"] or abs(new["gain"] / now - 1) < tolerance):
            break
        now = new["gain"]
        held = held & (F.col("variance") <= 10 * now * F.col("mean"))
    return now


def two_parameter_fit(points: DataFrame, bins: int = 20) -> DataFrame:
    """ln(variance) against ln(mean): bins of the logarithm, median variance of each, straight line.

    Means that differ in their last bit lie on either side of an end, and few of them make a bin, so logarithms and ends are rounded as in the SQL engine.
    """
    logs = written(points.filter("mean > 0 and variance > 0").select("mean", "variance").withColumn("lx", ln("mean")), "logs")
    low, high = (F.lit(end).cast("double") for end in quantiles(logs, "lx", [0.01, 0.99]))
    binned = logs.filter((F.col("lx") >= low) & (F.col("lx") < high)).withColumn("bin", F.floor((F.col("lx") - low) / (high - low) * bins))
    each = binned.groupBy("bin").agg(F.avg("mean").alias("mx"), F.percentile("variance", F.lit(0.5)).alias("my"), F.count(F.lit(1)).alias("n")).filter("n > 10")
    return each.agg(F.regr_slope(F.ln("my"), F.ln("mx")).alias("exponent"), F.exp(F.regr_intercept(F.ln("my"), F.ln("mx"))).alias("factor"))


def bleaching(df: DataFrame, rates: list[float], keys=KEYS) -> DataFrame:
    """The best b + c exp(-rate t) of each trace over a grid of rates, by least squares in closed form."""
    rows = df.withColumn("rate", F.explode(F.array(*map(F.lit, rates)))).withColumn("e", F.exp(-F.col("rate") * F.col("t")))
    fits = rows.groupBy(*keys, "rate").agg(F.regr_slope("value", "e").alias("c"), F.regr_intercept("value", "e").alias("b"), (F.regr_syy("value", "e") - F.pow(F.regr_sxy("value", "e"), F.lit(2)) / F.regr_sxx("value", "e")).alias("sse"))
    return fits.groupBy(*keys).agg(F.min(F.struct("sse", "rate", "b", "c")).alias("best")).select(*keys, "best.*")


def resample(df: DataFrame, factor: float, keys=KEYS) -> DataFrame:
    """Area-weighted resampling in time: bin k of the result covers [k, k + 1) / factor old samples; sums are kept."""
    step = 1 / factor
    low, high = F.floor(F.col("i") / step), F.ceil((F.col("i") + 1) / step) - 1
    parts = df.withColumn("k", F.explode(F.sequence(low, high)))
    overlap = F.least(F.col("i") + 1.0, (F.col("k") + 1) * step) - F.greatest(F.col("i") * 1.0, F.col("k") * step)
    out = parts.withColumn("overlap", overlap).filter("overlap > 0").groupBy(*keys, F.col("k").cast("int").alias("i")).agg(F.sum(F.col("value") * F.col("overlap")).alias("s"), F.sum("overlap").alias("o"))
    return out.filter(F.col("o") > step - 1e-9).select(*keys, "i", (F.col("s") / F.col("o") / factor).alias("value"))


def running_mode(df: DataFrame, size: int, width: float, keys=KEYS) -> DataFrame:
    """Middle of the fullest bin of the given width in a centred window; the lowest of equals."""
    delta = size // 2
    frame = Window.partitionBy(*keys).orderBy("place").rowsBetween(-delta, delta)
    rows = mirrored(df, delta, keys).withColumn("bin", F.floor(F.col("value") / width)).withColumn("bins", F.collect_list("bin").over(frame))
    score = lambda b: F.struct(F.size(F.filter("bins", lambda x: x == b)).alias("n"), (-b).alias("low"))
    best = F.array_max(F.transform(F.array_distinct("bins"), score))
    return rows.filter("inner").select(*keys, "i", "t", ((-best["low"] + 0.5) * width).alias("mode"))


def trace_activity(df: DataFrame, legs: DataFrame, dt: float, keys=KEYS) -> DataFrame:
    """Per trace and leg the sum of fast / slow times dt over the leg's length; samples strictly inside the leg."""
    rows = inside_windows(df, legs, lambda w: (F.col("t") > w["leg_begin"]) & (F.col("t") < w["leg_end"]))
    return rows.groupBy(*keys, "leg").agg((F.sum(F.col("fast") / F.greatest("slow", F.lit(1.0))) * dt / F.max(F.col("leg_end") - F.col("leg_begin"))).alias("activity"))
