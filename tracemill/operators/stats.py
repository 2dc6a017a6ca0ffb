"""Statistics over events with legs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.numbers import normal_tail


def active_rois(events: DataFrame, min_events: int, keys=("roi",)) -> DataFrame:
    """Rois with more than min_events events."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all")).filter(F.col("n_all") > min_events).select(*keys)


def leg_durations(events: DataFrame, keys=("roi",)) -> DataFrame:
    """Per recording and leg the span of the peaks of its events."""
    return events.filter("leg is not null").groupBy(*list(keys)[:-1], "leg").agg((F.max("peakpoint") - F.min("peakpoint")).alias("duration"))


def beside(rows: DataFrame, one: DataFrame, of: list[str]) -> DataFrame:
    """rows with the columns of one, which has a row for each value of the columns of, or a single row if there are none."""
    return rows.join(one, of) if of else rows.crossJoin(F.broadcast(one))


def classes(column: Column, edges: list[tuple[float, float]]) -> Column:
    """Name of the class [low, high) that holds the value, null for none."""
    out = F.lit(None).cast("string")
    for low, high in edges:
        out = F.when((column >= low) & (column < high), F.lit(f"{low:g}-{high:g}")).otherwise(out)
    return out


def event_rate(events: DataFrame, edges: list[tuple[float, float]], min_events: int, reduce: int, n_boot: int = 20, seed: int = 0, value: Column | None = None, keys=("roi",)) -> DataFrame:
    """Events per minute and active roi by recording, leg and class of halfwidth, with bootstrap deviation.

    Each replicate draws floor(active / reduce) rois of a recording without replacement, in order of an MD5 of roi,
    replicate and seed; its events are counted (or value summed), divided by duration and rois, x 60.
    """
    keys, of = list(keys), list(keys)[:-1]
    roi = keys[-1]
    active = active_rois(events, min_events, keys)
    n_active = active.groupBy(*of).agg(F.count(F.lit(1)).alias("n_active"))
    draws = active.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    key = F.md5(F.concat_ws("|", F.col(roi).cast("string"), F.col("rep").cast("string"), F.lit(str(seed))))
    ranked = beside(draws.withColumn("place", F.row_number().over(Window.partitionBy(*of, "rep").orderBy(key, roi))), n_active, of)
    drawn = ranked.withColumn("n_drawn", F.floor(F.col("n_active") / reduce)).filter("place <= n_drawn")
    per_roi = events.filter("leg is not null").withColumn("hw_region", classes(F.col("halfwidth"), edges)).filter("hw_region is not null").groupBy(*keys, "leg", "hw_region").agg((F.sum(value) if value is not None else F.count(F.lit(1)).cast("double")).alias("x"))
    cells = per_roi.select(*of, "leg", "hw_region").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    sums = drawn.join(per_roi, keys).groupBy(*of, "rep", "leg", "hw_region").agg(F.sum("x").alias("x"))
    size = drawn.groupBy(*of).agg(F.max("n_drawn").alias("n_drawn"))
    every = cells.join(sums, [*of, "rep", "leg", "hw_region"], "left").fillna(0.0, ["x"])
    rate = every.groupBy(*of, "leg", "hw_region").agg(F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("std_x"))
    scale = 60 / (F.col("duration") * F.col("n_drawn"))
    return beside(rate.join(leg_durations(events, keys), [*of, "leg"]), size, of).select(*of, "leg", "hw_region", (F.col("mean_x") * scale).alias("epmpr"), (F.col("std_x") * scale).alias("epmpr_std"))


def event_activity(events: DataFrame, edges: list[tuple[float, float]], min_events: int, reduce: int, column: str = "auc", **how) -> DataFrame:
    """As event_rate, with the sum of a column in the place of the count."""
    return event_rate(events, edges, min_events, reduce, value=F.col(column), **how)


def pool_experiments(events: DataFrame, plan: DataFrame, experiment: str = "recording") -> DataFrame:
    """Events of several experiments with what plan(experiment, ...) says of each and pooled_roi, a name of the roi over all of them.

    Experiments without a plan go.
    """
    name = F.concat(F.lit("exp"), F.col(experiment).cast("string"), F.lit("_"), F.col("roi").cast("string"))
    return events.withColumn("pooled_roi", name).withColumnRenamed(experiment, "experiment").join(plan, "experiment")


def tidy_roi_leg(events: DataFrame, low: float, high: float, n_legs: int, keys=("roi",)) -> DataFrame:
    """Per leg and roi count and medians, for rois with more than one event in every leg."""
    keys = list(keys)
    rows = events.filter((F.col("halfwidth") > low) & (F.col("halfwidth") < high) & F.col("leg").isNotNull())
    each = rows.groupBy("leg", *keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("halfwidth", F.lit(0.5)).alias("halfwidth"), F.percentile("height", F.lit(0.5)).alias("height"))
    full = each.filter("n > 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == n_legs).select(*keys)
    return each.join(full, keys, "left_semi").join(leg_durations(events, keys), [*keys[:-1], "leg"])


def duration_histogram(events: DataFrame, edges: list[float], legs: DataFrame) -> DataFrame:
    """Counts of halfwidth by leg and bin per minute of leg, with the root of the count; the last bin is closed."""
    bins = F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(i == len(edges) - 2).alias("last")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    hw = F.col("halfwidth")
    own = F.element_at(F.filter(bins, lambda b: (hw >= b["low"]) & ((hw < b["high"]) | (b["last"] & (hw == b["high"])))), 1)
    inside = F.col("halfwidth").between(edges[0], edges[-1])
    counts = events.filter(inside & F.col("leg").isNotNull()).withColumn("b", own).groupBy("leg", F.col("b.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per_minute = 60 / (F.col("leg_end") - F.col("leg_begin"))
    return counts.join(F.broadcast(legs), "leg").select("leg", "bin", "n", (F.col("n") * per_minute).alias("rate"), (F.sqrt("n") * per_minute).alias("rate_err"))


def control_rate(events: DataFrame, edges: list[float]) -> DataFrame:
    """bin and control: events a minute that chance alone would give at each bin's middle, 60 P(Z >= least z_max) / middle."""
    least = events.agg(F.min("z_max").alias("z"))
    bins = F.array(*(F.struct(F.lit(k).alias("bin"), F.lit(math.sqrt(a * b)).alias("middle")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    return least.select("z", F.explode(bins).alias("b")).select("b.bin", (60 * normal_tail(F.col("z")) / F.col("b.middle")).alias("control"))


def cdf(rows: DataFrame, column: str, keys: list[str], parts: int = 200) -> DataFrame:
    """Each value with its place in the order, from 0 to 1; of equal values the lower event_id comes first.

    Rows are numbered within buckets between approximate percentiles, so that no task orders a whole
    key; the places are exact, wherever the ends of the buckets fall.
    """
    own = [F.col(f"at.{k}").eqNullSafe(F.col(f"of.{k}")) for k in keys]
    ends = rows.groupBy(*keys).agg(F.percentile_approx(column, F.array(*(F.lit(i / parts) for i in range(1, parts)))).alias("ends"), F.count(F.lit(1)).alias("n_all"))
    bucket = F.coalesce(F.size(F.filter("of.ends", lambda e: e < F.col(f"at.{column}"))), F.lit(0))
    at = rows.alias("at").join(ends.alias("of"), own).select("at.*", "of.n_all", bucket.alias("bucket"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = at.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    placed = at.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(column, "event_id")))
    both = placed.alias("at").join(firsts.alias("of"), [*own, F.col("at.bucket") == F.col("of.bucket")])
    return both.select(*(F.col(f"at.{c}") for c in rows.columns), ((F.col("of.before") + F.col("at.place") - 1) / F.nullif(F.col("at.n_all") - 1, F.lit(0))).alias("cdf"))


def box_summary(rows: DataFrame, column: str, keys: list[str], whiskers=(0.05, 0.95)) -> DataFrame:
    p = F.percentile(column, F.array(*map(F.lit, (whiskers[0], 0.25, 0.5, 0.75, whiskers[1]))))
    q = rows.groupBy(*keys).agg(p.alias("p"), F.count(F.lit(1)).alias("n"))
    names = ["low", "q1", "median", "q3", "high"]
    return q.select(*keys, "n", *(F.col("p")[i].alias(c) for i, c in enumerate(names)), (1.57 * (F.col("p")[3] - F.col("p")[1]) / F.sqrt("n")).alias("notch"))


def paired_t(tidy: DataFrame, column: str, leg: str, ref: str) -> DataFrame:
    """One-sample t of the rois' difference between two legs: mean, t and degrees of freedom."""
    both = tidy.groupBy("roi").pivot("leg", [leg, ref]).agg(F.first(column))
    d = both.select((F.col(leg) - F.col(ref)).alias("d")).filter("d is not null")
    return d.agg(F.avg("d").alias("mean_diff"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d")))).alias("t"), (F.count("d") - 1).alias("df"))


def pairwise_z(rows: DataFrame, key: str, mean: str, error: str) -> DataFrame:
    """All pairs of a small summary table: z and its one-sided p."""
    a = rows.select(F.col(key).alias("a"), F.col(mean).alias("ma"), F.col(error).alias("ea"))
    b = rows.select(F.col(key).alias("b"), F.col(mean).alias("mb"), F.col(error).alias("eb"))
    z = F.abs(F.col("ma") - F.col("mb")) / F.sqrt(F.pow("ea", F.lit(2)) + F.pow("eb", F.lit(2)))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", z.alias("z")).withColumn("p", normal_tail(F.col("z")))


def effect_ols(rows: DataFrame, column: str, ref: str) -> DataFrame:
    """log10 of the quantity on leg: per leg coefficient, standard error, t and effect in percent."""
    logs = rows.filter(F.col(column) > 0).withColumn("y", F.log10(column)).filter("leg is not null")
    each = logs.groupBy("leg").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("v"))
    pooled = each.agg((F.sum((F.col("n") - 1) * F.col("v")) / (F.sum("n") - F.count(F.lit(1)))).alias("s2"))
    base = each.filter(F.col("leg") == ref).select(F.col("n").alias("n0"), F.col("m").alias("m0"))
    out = each.filter(F.col("leg") != ref).crossJoin(F.broadcast(base)).crossJoin(F.broadcast(pooled))
    coef, se = F.col("m") - F.col("m0"), F.sqrt(F.col("s2") * (1 / F.col("n") + 1 / F.col("n0")))
    return out.select("leg", coef.alias("coef"), se.alias("se"), (coef / se).alias("t"), ((F.pow(F.lit(10.0), coef) - 1) * 100).alias("effect"))


def roi_heterogeneity(events: DataFrame, column: str, min_events: int) -> DataFrame:
    """Per roi with more than min_events events the quartiles, in order of the median."""
    q = events.groupBy("roi").agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_events)
    return q.select("roi", "n", F.col("p")[0].alias("q1"), F.col("p")[1].alias("median"), F.col("p")[2].alias("q3"))


def median_of_rois(events: DataFrame, column: str, keys: list[str], min_events: int) -> DataFrame:
    """Mean over rois (more than min_events events) of the roi's median; error: population deviation / sqrt(n - 1)."""
    each = events.groupBy(*keys, "roi").agg(F.percentile(column, F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_events)
    return each.groupBy(*keys).agg(F.avg("m").alias("mean"), (F.stddev_pop("m") / F.sqrt(F.count(F.lit(1)) - 1)).alias("sem"), F.count(F.lit(1)).alias("n_rois")).filter("n_rois > 1")


def percentile_range(events: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows strictly between two global percentiles."""
    ends = events.agg(F.percentile(column, F.lit(low)).alias("p_low"), F.percentile(column, F.lit(high)).alias("p_high"))
    return events.crossJoin(F.broadcast(ends)).filter((F.col(column) > F.col("p_low")) & (F.col(column) < F.col("p_high"))).drop("p_low", "p_high")


def leg_ratio(events: DataFrame, column: str, ref: str, keys=("roi",)) -> DataFrame:
    """Per recording and leg mean and median over rois of the roi's median in the leg over that in the reference leg."""
    keys = list(keys)
    each = events.filter("leg is not null").groupBy(*keys, "leg").agg(F.percentile(column, F.lit(0.5)).alias("m"))
    base = each.filter(F.col("leg") == ref).select(*keys, F.col("m").alias("m0"))
    r = each.filter(F.col("leg") != ref).join(base, keys).withColumn("ratio", F.col("m") / F.col("m0"))
    return r.groupBy(*keys[:-1], "leg").agg(F.avg("ratio").alias("mean_ratio"), F.percentile("ratio", F.lit(0.5)).alias("median_ratio"), F.count(F.lit(1)).alias("n"))


def tally(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def predict_and_residual(rows: DataFrame, column: str) -> DataFrame:
    """fitted is the leg's mean of log10 of the quantity, residual the rest; null without a leg."""
    y = F.log10(column)
    fitted = rows.filter("leg is not null").groupBy("leg").agg(F.avg(y).alias("fitted"))
    return rows.join(fitted, "leg", "left").withColumn("residual", y - F.col("fitted"))


def pulse(t: Column, loc: Column, amplitude: Column, scale: Column, s: float = 0.5) -> Column:
    """Log-normal pulse that starts at loc and peaks with amplitude; zero before, and under a hundredth of the peak."""
    x = (t - loc) / scale
    peak = float(2.718281828459045 ** (-(s * s)))  # the mode of the log-normal density
    shape = F.exp(-F.pow(F.ln(x), F.lit(2)) / (2 * s * s)) / x
    top = F.exp(F.lit(-(s**4) / (2 * s * s))) / peak
    share = F.when(x > 0, shape / top).otherwise(F.lit(0.0))
    return amplitude * F.when(share < 0.01, 0.0).otherwise(share)
