"""Slow baselines of traces(roi, i, t, value), and thresholds and mixtures of a column's values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.tables import discard, written
from tracemill.operators import filters
from tracemill.operators import traces as tr

FINER = (0.5, 0.7, 0.85, 1.0, 1.2, 1.4, 2.0)  # the second grid, as multiples of the first one's best rate


def best_decay(rows: DataFrame, rate: Column, keys) -> DataFrame:
    at = rows.withColumn("rate", F.explode(rate)).withColumn("e", F.exp(-F.col("rate") * F.col("i")))
    sse = F.regr_syy("value", "e") - F.try_divide(F.pow(F.regr_sxy("value", "e"), F.lit(2)), F.regr_sxx("value", "e"))
    fits = at.groupBy(*keys, "rate").agg(F.regr_slope("value", "e").alias("c"), F.regr_intercept("value", "e").alias("b"), F.round(sse, 6).alias("sse"))
    return fits.filter("c is not null").groupBy(*keys).agg(F.min(F.struct("sse", "rate", "b", "c")).alias("best")).select(*keys, "best.rate", "best.b", "best.c")


def debleached(df: DataFrame, rates: list[float], points: int = 100, keys=tr.KEYS) -> DataFrame:
    """trend: b + c exp(-rate i) through tenth percentiles of blocks, plus the line through what is left; detrended: the rest.

    Blocks hold n // points samples; the first and last tenth of blocks are left out. The rate is the
    best of a grid, then of a finer one around it; b and c are least squares. A trace with too few
    blocks for a curve has the line alone.
    """
    ends = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("width", F.greatest(F.floor(F.col("n") / points), F.lit(1))).withColumn("blocks", F.floor(F.col("n") / F.col("width")))
    block = F.floor(F.col("i") / F.col("width"))
    inner = (F.col("k") >= F.floor(F.col("blocks") / 10)) & (F.col("k") < F.col("blocks") - F.ceil(F.col("blocks") / 10) - 1)
    low = df.join(ends, list(keys)).withColumn("k", block).filter(inner).groupBy(*keys, "k").agg(F.percentile("value", F.lit(0.1)).alias("value"), F.avg("i").alias("i"))
    coarse = best_decay(low, F.array(*map(F.lit, rates)), keys).select(*keys, F.col("rate").alias("near"))
    fit = best_decay(low.join(coarse, list(keys)), F.array(*(F.col("near") * f for f in FINER)), keys)
    curve = df.join(fit, list(keys), "left").withColumn("curve", F.coalesce(F.col("b") + F.col("c") * F.exp(-F.col("rate") * F.col("i")), F.lit(0.0)))
    rest = F.col("value") - F.col("curve")
    line = curve.groupBy(*keys).agg(F.regr_slope(rest, "i").alias("up"), F.regr_intercept(rest, "i").alias("start"))
    trend = F.col("curve") + F.coalesce(F.col("start") + F.col("up") * F.col("i"), F.lit(0.0))
    return curve.join(line, list(keys)).withColumn("trend", trend).withColumn("detrended", F.col("value") - F.col("trend")).select(*df.columns, "trend", "detrended")


def interpolated(df: DataFrame, binned: DataFrame, n: int, column: str, keys=tr.KEYS) -> DataFrame:
    """df with a column of blocks of n samples, by the parabola through the three nearest block centres.

    Samples beyond the second or the second last centre use the outermost parabola; traces of under three blocks get the nearest block.
    """
    order = Window.partitionBy(*keys).orderBy("i")
    knots = binned.select(*keys, F.col("i").alias("k"), F.lag(column).over(order).alias("s0"), F.col(column).alias("s1"), F.lead(column).over(order).alias("s2"))
    last = binned.groupBy(*keys).agg(F.max("i").alias("k_last"))
    u = (F.col("i") - (n - 1) / 2) / n
    near = F.greatest(F.lit(1), F.least(F.floor(u + 0.5), F.col("k_last") - 1))
    rows = df.join(last, list(keys)).withColumn("k", F.when(F.col("k_last") >= 2, near).otherwise(F.greatest(F.lit(0), F.least(F.floor(u + 0.5), F.col("k_last")))).cast("int"))
    d = u - F.col("k")
    parabola = F.col("s0") * d * (d - 1) / 2 + F.col("s1") * (1 - d * d) + F.col("s2") * d * (d + 1) / 2
    return rows.join(knots, [*keys, "k"]).withColumn(column, F.when(F.col("k_last") >= 2, parabola).otherwise(F.col("s1"))).select(*df.columns, column)


def slow_filter(df: DataFrame, ts: float, freq: float, gain: float = 1.0, size: Column | None = None, fraction: float = 0.1, most: int = 200, keys=tr.KEYS) -> DataFrame:
    """slow, fast and z by the running percentile and mean over ts seconds.

    Windows beyond most samples run on rebinned traces, and slow is interpolated back. size is the
    number of pixels behind a value. gain must be positive.
    """
    if gain <= 0:
        raise ValueError("the slow filter needs a positive gain")
    w = int(ts * freq)
    n = max(1, round(w / most)) if w > most else 1
    w = w // n
    w += 1 - w % 2
    low = tr.percentile_lowpass(tr.rebin(df, n, keys) if n > 1 else df, w, fraction, keys=keys)
    slow = interpolated(df, low, n, "slow", keys) if n > 1 else low
    pixels = F.lit(1.0) if size is None else size
    fast = F.col("value") - F.col("slow")
    return slow.withColumn("fast", fast).withColumn("z", F.col("fast") * pixels / F.sqrt(gain * F.col("slow") * pixels / n))


def detrend(df: DataFrame, method: str = "debleach", keys=tr.KEYS, **how) -> DataFrame:
    """trend and detrended by the mean (simple), the fast or the slow filter, or the bleaching curve (debleach)."""
    if method == "simple":
        return tr.demean(df, keys)
    if method == "debleach":
        return debleached(df, keys=keys, **how)
    if method not in ("fast", "slow"):
        raise ValueError(f"no such method: {method}")
    found = filters.fast_filter(df, keys=keys, **how) if method == "fast" else slow_filter(df, keys=keys, **how)
    return found.withColumnsRenamed({"slow": "trend", "fast": "detrended"}).drop("z")


def separation_threshold(df: DataFrame, column: str, log: bool = False, most: float | None = None, bins: int = 100) -> DataFrame:
    """One row: the valley of the density between its two highest peaks, minus infinity with fewer peaks.

    The density is Gaussian with Scott's bandwidth, on the centres of bins between least and largest
    value (under most). It is summed by partial aggregates; only the bins meet in one task.
    """
    x = F.log10(column) if log else F.col(column).cast("double")
    rows = df.select(x.alias("x")).filter("x is not null and not isnan(x) and abs(x) != double('infinity')").groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    top = F.col("x") if most is None else F.when(F.col("x") < most, F.col("x"))
    total = F.sum("w")
    var = (F.sum(F.col("w") * F.col("x") * F.col("x")) - F.pow(F.sum(F.col("w") * F.col("x")), F.lit(2)) / total) / (total - 1)
    ends = rows.agg(F.min(top).alias("a"), F.max(top).alias("z"), (F.sqrt(var) * F.pow(total.cast("double"), F.lit(-0.2))).alias("width"))
    at = rows.crossJoin(F.broadcast(ends)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    centre = F.col("a") + (F.col("k") + 0.5) * (F.col("z") - F.col("a")) / bins
    density = at.withColumn("centre", centre).groupBy("k").agg(F.first("centre").alias("centre"), F.sum(F.col("w") * F.exp(-F.pow((F.col("centre") - F.col("x")) / F.col("width"), F.lit(2)) / 2)).alias("d"))
    order = Window.orderBy("k")
    peak = (F.col("d") > F.coalesce(F.lag("d").over(order), F.lit(-1.0))) & (F.col("d") > F.coalesce(F.lead("d").over(order), F.lit(-1.0)))
    two = density.withColumn("peak", peak).filter("peak").withColumn("place", F.row_number().over(Window.orderBy(F.desc("d"), "k"))).filter("place <= 2").agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    valley = density.crossJoin(F.broadcast(two)).filter("k > k0 and k < k1").agg(F.min(F.struct("d", "centre")).alias("b"))
    found = F.coalesce(F.col("b.centre"), F.lit(float("-inf")))
    return valley.select((F.when(found == float("-inf"), found).otherwise(F.pow(F.lit(10.0), found)) if log else found).alias("threshold"))


def mixture_fit(df: DataFrame, column: str, ks=(1, 2, 3), crit: str = "bic", mindist: float = 0.0, rounds: int = 200, tol: float = 1e-4) -> DataFrame:
    """k, component, weight, mean, deviation, score of the Gaussian mixture with the least BIC or AIC.

    Expectation-maximisation on (distinct value, count); each round is one aggregate, and only the
    parameters reach the driver. Means start at percentiles from 1 to 99. While two means are closer
    than mindist, one component fewer is taken. Nulls and NaN do not count; without values no row.
    """
    values = written(df.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)").groupBy("x").agg(F.count(F.lit(1)).alias("w")), "values")
    marks = sorted({(98 * j / (k - 1) + 1) / 100 if k > 1 else 0.5 for k in ks for j in range(k)})
    whole = values.agg(F.sum("w").alias("n"), F.percentile("x", F.array(*map(F.lit, marks)), F.col("w")).alias("p"), F.sum(F.col("w") * F.col("x")).alias("s")).first()
    schema = "k int, component int, weight double, mean double, deviation double, score double"
    if not whole["n"]:
        return df.sparkSession.createDataFrame([], schema)
    n, at = whole["n"], dict(zip(marks, whole["p"]))
    mean = whole["s"] / n
    spread = max(values.agg(F.sum(F.col("w") * F.pow(F.col("x") - mean, F.lit(2)))).first()[0] / n, 1e-12)
    fits = []
    for k in sorted(ks):
        parts = [(1 / k, at[(98 * j / (k - 1) + 1) / 100 if k > 1 else 0.5], spread / k**2) for j in range(k)]
        before = -math.inf
        for _ in range(rounds):
            logs = [math.log(p) - 0.5 * math.log(2 * math.pi * v) - F.pow(F.col("x") - m, F.lit(2)) / (2 * v) for p, m, v in parts]
            top = F.greatest(*logs) if k > 1 else logs[0]
            rows = values.withColumn("top", top).withColumn("l", F.array(*(F.exp(c - F.col("top")) for c in logs))).withColumn("all", sum((F.col("l")[j] for j in range(1, k)), F.col("l")[0]))
            share = [F.col("w") * F.col("l")[j] / F.col("all") for j in range(k)]
            sums = [a for j, (_, m, _) in enumerate(parts) for a in (F.sum(share[j]), F.sum(share[j] * (F.col("x") - m)), F.sum(share[j] * F.pow(F.col("x") - m, F.lit(2))))]
            likelihood, *s = rows.agg(F.sum(F.col("w") * (F.col("top") + F.ln("all"))), *sums).first()
            moved = []
            for j, (_, m, _) in enumerate(parts):
                r = max(s[3 * j], 1e-12)
                d = s[3 * j + 1] / r
                moved.append((r / n, m + d, max(s[3 * j + 2] / r - d * d, 1e-6 * spread)))
            if likelihood - before < tol * n:
                break
            parts, before = moved, likelihood
        free = 3 * k - 1
        fits.append((-2 * likelihood + free * (math.log(n) if crit == "bic" else 2), k, sorted(parts, key=lambda p: p[1])))
    discard(values)
    chosen = min(range(len(fits)), key=lambda j: fits[j][0])
    close = lambda parts: any(b[1] - a[1] < mindist for a, b in zip(parts, parts[1:]))
    while chosen and close(fits[chosen][2]):
        chosen -= 1
    score, k, parts = fits[chosen]
    return df.sparkSession.createDataFrame([(k, j, p, m, math.sqrt(v), score) for j, (p, m, v) in enumerate(parts)], schema)
