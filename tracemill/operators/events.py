"""Operators on events(event_id, roi, t0, tend, peakpoint, halfwidth, z_max, ...).

keys name a trace: ("roi",) in one recording, ("recording", "roi") where there are several; the last one is
the roi, the others its recording. event_id is one event's own over all recordings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.tables import written
from tracemill.operators.components import components


def define_legs(events: DataFrame, legs: DataFrame) -> DataFrame:
    """leg whose open interval holds the peak; of several the last named, of none null.

    legs(leg, leg_begin, leg_end) is a treatment plan: a handful of rows a recording. With a column
    recording in both, each recording has its own legs; without one in legs, all have the same.
    """
    if "recording" in legs.columns and "recording" in events.columns:
        own = legs.groupBy("recording").agg(F.sort_array(F.collect_list(F.struct("leg", "leg_begin", "leg_end"))).alias("legs"))
        inside = F.filter("legs", lambda x: (F.col("peakpoint") > x["leg_begin"]) & (F.col("peakpoint") < x["leg_end"]))
        return events.join(own, "recording", "left").withColumn("leg", F.try_element_at(inside, F.lit(-1))["leg"]).drop("legs").select(*[c for c in events.columns if c != "leg"], "leg")
    ordered = legs.agg(F.sort_array(F.collect_list(F.struct("leg", "leg_begin", "leg_end"))).alias("legs"))
    inside = F.filter("legs", lambda x: (F.col("peakpoint") > x["leg_begin"]) & (F.col("peakpoint") < x["leg_end"]))
    return events.crossJoin(F.broadcast(ordered)).withColumn("leg", F.try_element_at(inside, F.lit(-1))["leg"]).drop("legs")


def inside_windows(rows: DataFrame, windows: DataFrame, holds) -> DataFrame:
    """rows with leg, leg_begin and leg_end of each window(leg, leg_begin, leg_end) for which holds(window) is true.

    Windows, a plan of a handful of rows, are one array for each recording, or one for all if they have none.
    """
    of = ["recording"] if "recording" in windows.columns and "recording" in rows.columns else []
    own = windows.groupBy(*of).agg(F.sort_array(F.collect_list(F.struct("leg", "leg_begin", "leg_end"))).alias("windows_"))
    met = rows.join(own, of) if of else rows.crossJoin(F.broadcast(own))  # one row
    kept = [c for c in rows.columns if c not in ("leg", "leg_begin", "leg_end")]
    return met.select(*kept, F.explode(F.filter("windows_", holds)).alias("w_")).select(*kept, "w_.leg", "w_.leg_begin", "w_.leg_end")


def window_events(events: DataFrame, windows: DataFrame) -> DataFrame:
    """One row for each window that holds the whole event, ends included."""
    return inside_windows(events, windows, lambda w: (F.col("t0") >= w["leg_begin"]) & (F.col("tend") <= w["leg_end"]))


WIDE = 4  # bins, in tolerances of the longest seed of a class


def binned(seeds: DataFrame, targets: DataFrame, tol: float, keys: list[str]) -> DataFrame:
    """Pairs of a seed and a target of the same keys whose start and end differ by less than tol x the seed's halfwidth.

    Seeds fall into classes of halfwidth by powers of four; a class has bins of WIDE times its largest tolerance, and a
    seed goes to the one or two bins that its tolerance reaches. Both ends are close, so a target's halfwidth is
    within 2 tol of the seed's and it joins only the classes near its own: an equi-join, no theta join.
    seeds(a_id, a_t0, a_tend, a_hw, keys) and targets(b_id, b_t0, b_tend, keys); tol below 0.5.
    """
    width = lambda c: F.pow(F.lit(4.0), c + 1) * (tol * WIDE)
    size = lambda hw: F.floor(F.log2(hw) / 2)
    reach, slack = tol * F.col("a_hw"), 1e-9  # of a bin: ends are rounded
    at = lambda t: t / width(F.col("class"))
    s = seeds.withColumn("class", size(F.col("a_hw"))).withColumn("bin", F.explode(F.sequence(F.floor(at(F.col("a_t0") - reach) - slack), F.floor(at(F.col("a_t0") + reach) + slack))))
    hw = F.col("b_tend") - F.col("b_t0")
    low, high = size(hw / (1 + 2 * tol) * (1 - slack)), size(hw / (1 - 2 * tol) * (1 + slack))
    t = targets.withColumn("class", F.explode(F.sequence(low, high))).withColumn("bin", F.floor(at(F.col("b_t0"))))
    near = (F.abs(F.col("a_t0") - F.col("b_t0")) < tol * F.col("a_hw")) & (F.abs(F.col("a_tend") - F.col("b_tend")) < tol * F.col("a_hw"))
    return s.join(t, [*keys, "class", "bin"]).filter(near).drop("class", "bin")


def match_events(a: DataFrame, b: DataFrame, tol: float = 0.2, keys=("roi",)) -> DataFrame:
    """For each event of a the ids of matching events of b, sorted; empty for those without a match."""
    keys = list(keys)
    seeds = a.select(*keys, F.col("event_id").alias("a_id"), F.col("t0").alias("a_t0"), F.col("tend").alias("a_tend"), F.col("halfwidth").alias("a_hw"))
    targets = b.select(*keys, F.col("event_id").alias("b_id"), F.col("t0").alias("b_t0"), F.col("tend").alias("b_tend"))
    found = binned(seeds, targets, tol, keys).groupBy("a_id").agg(F.sort_array(F.collect_set("b_id")).alias("matches"))
    return a.join(found, F.col("event_id") == F.col("a_id"), "left").drop("a_id").withColumn("matches", F.coalesce("matches", F.array().cast("array<bigint>")))


def distill_audit(events: DataFrame, first: float | Column, last: float | Column, tol: float = 0.2, min_confidence: int = 4, small: float = 2.0, contingency: bool = True, shortest: float = 0.0, keys=("roi",)) -> DataFrame:
    """Every candidate with status, attractor (the survivor of its component) and clique_size.

    first and last, the ends of a recording, may be columns of events. Too short or too close to the ends: no seed. Each seed links to every event of its roi that
    begins and ends within tol x the seed's halfwidth; components of the links are one event each,
    told by their member of the largest z_max (the smallest id of equals). A component of one is
    solitary; one below min_confidence members is dropped unless it is shorter than small.
    """
    keys, hw = list(keys), F.col("halfwidth")
    edge = F.when(F.col("t0") - hw / 2 < first, "too close to beginning").when(F.col("tend") + hw / 2 > last, "too close to end").when(hw < shortest, "too short").otherwise("ok")
    rows = events.withColumn("own", edge)
    seeds = rows.filter("own = 'ok'").select(*keys, F.col("event_id").alias("a_id"), F.col("t0").alias("a_t0"), F.col("tend").alias("a_tend"), hw.alias("a_hw"), F.col("its").alias("a_its"))
    targets = rows.select(*keys, F.col("event_id").alias("b_id"), F.col("t0").alias("b_t0"), F.col("tend").alias("b_tend"), F.col("its").alias("b_its"))
    links = binned(seeds, targets, tol, keys)
    if contingency:
        links = links.filter(F.abs(F.col("a_its") - F.col("b_its")) <= 1)
    roots = components(links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    member = rows.join(roots, F.col("event_id") == F.col("node"), "left").drop("node")
    of_root = Window.partitionBy("root")
    best = F.max(F.struct("z_max", (-F.col("event_id")).alias("id"))).over(of_root)
    member = written(member, "members").withColumn("clique_size", F.when(F.col("root").isNotNull(), F.count("root").over(of_root))).withColumn("attractor", F.when(F.col("root").isNotNull(), -best["id"]))
    middle = lambda c: F.percentile(c, F.lit(0.5)).over(of_root)
    member = member.withColumn("m_t0", middle("t0")).withColumn("m_tend", middle("tend")).withColumn("m_z", middle("z_max"))
    status = (
        F.when(F.col("root").isNull(), F.col("own"))
        .when(F.col("clique_size") == 1, "solitary")
        .when((F.col("clique_size") < min_confidence) & (F.col("m_tend") - F.col("m_t0") > small), "too few calls")
        .when(F.col("attractor") == F.col("event_id"), "survivor")
        .otherwise("merged")
    )
    return member.withColumn("status", status).drop("own")


def distilled(audit: DataFrame, keys=("roi",), take_best: bool = False) -> DataFrame:
    """The survivors with the medians of their component, or with their own values."""
    own = ["t0", "tend", "z_max"] if take_best else ["m_t0", "m_tend", "m_z"]
    t0, tend, z = map(F.col, own)
    return audit.filter("status = 'survivor'").select("event_id", *keys, t0.alias("t0"), tend.alias("tend"), (tend - t0).alias("halfwidth"), z.alias("z_max"), "clique_size", "its")


BELOW = 0.1  # of its background: a lower event is too steep


def judged_windows(events: DataFrame, samples: DataFrame, dt: float, keys=("roi",)) -> DataFrame:
    """events with status: "too short", "spurious", "too steep" or "ok".

    samples(keys, its, i, value, slow) have the slow part at the timescale its. A window is the samples from
    the one before the event's start to the one after its end. Under 3 samples it is too short. It is spurious
    if it is over 20 long, the slow part bends upward by more than 0.1 a sample on average, and by more than half
    of what the trace bends down. It is too steep if the 95th percentile of the trace above the straight line
    between the ends of the slow part is under BELOW of that line's mean. An event without samples is too short.
    """
    keys = list(keys)
    first, last = F.greatest(F.ceil(F.col("t0") / dt) - 1, F.lit(0)), F.ceil((F.col("t0") + F.col("halfwidth")) / dt)
    kind = samples.schema["i"].dataType
    wanted = events.filter(first <= last).select("event_id", "its", *keys, F.explode(F.sequence(first.cast(kind), last.cast(kind))).alias("i"))
    met = wanted.join(samples.select(*keys, "its", "i", "value", "slow"), [*keys, "its", "i"])
    rows = met.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("i", "value", "slow"))).alias("s"), F.count(F.lit(1)).alias("n"))
    at = lambda k, c: F.element_at("s", k)[c]
    # the mean of second differences is that of the last step less the first
    bend = lambda c: F.when(F.col("n") >= 3, ((at(-1, c) - at(-2, c)) - (at(2, c) - at(1, c))) / (F.col("n") - 2))
    line = lambda k: at(1, "slow") + k * (at(-1, "slow") - at(1, "slow")) / (F.col("n") - 1)
    long = rows.filter("n >= 3").withColumn("bend_slow", bend("slow")).withColumn("bend_trace", bend("value")).withColumn("middle", (at(1, "slow") + at(-1, "slow")) / 2)
    peak = long.select("event_id", "bend_slow", "bend_trace", "middle", "n", F.explode(F.transform("s", lambda r, k: r["value"] - line(k))).alias("over"))
    each = peak.groupBy("event_id", "bend_slow", "bend_trace", "middle", "n").agg(F.percentile("over", F.lit(0.95)).alias("height_over"))
    spurious = (F.col("n") > 20) & (F.col("bend_slow") > 0.1) & (F.col("bend_slow") > -0.5 * F.col("bend_trace"))
    status = F.when(F.col("n").isNull(), "too short").when(spurious, "spurious").when(F.try_divide("height_over", "middle") < BELOW, "too steep").otherwise("ok")
    return events.join(each, "event_id", "left").select(*(c for c in events.columns if c != "status"), status.alias("status"))


def distill_by_height(events: DataFrame, samples: DataFrame, dt: float, tol: float = 0.33, keys=("roi",)) -> DataFrame:
    """Of each component of events that begin and end within tol x a seed's halfwidth the one of the greatest height, with clique_size.

    Seeds are the events whose window is "ok" (judged_windows); what they link to may be any event of the trace.
    Of equal heights the smaller event_id counts; halfwidth is tend - t0.
    """
    keys = list(keys)
    rows = written(judged_windows(events, samples, dt, keys), "judged")
    seeds = rows.filter("status = 'ok'").select(*keys, F.col("event_id").alias("a_id"), F.col("t0").alias("a_t0"), F.col("tend").alias("a_tend"), F.col("halfwidth").alias("a_hw"))
    targets = rows.select(*keys, F.col("event_id").alias("b_id"), F.col("t0").alias("b_t0"), F.col("tend").alias("b_tend"))
    links = binned(seeds, targets, tol, keys).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    member = rows.join(components(links), F.col("event_id") == F.col("node"))
    best = member.groupBy("root").agg(F.max(F.struct("height", (-F.col("event_id")).alias("id"))).alias("b"), F.count(F.lit(1)).alias("clique_size"))
    found = best.select((-F.col("b.id")).alias("event_id"), "clique_size")
    return rows.drop("status").join(found, "event_id").withColumn("halfwidth", F.col("tend") - F.col("t0"))


def activation_time(events: DataFrame, rois: DataFrame, begin: float, end: float, min_halfwidth: float, keys=("roi",)) -> DataFrame:
    """First t0 of each roi inside an open window among events longer than min_halfwidth; null without one."""
    first = events.filter((F.col("t0") > begin) & (F.col("t0") < end) & (F.col("halfwidth") > min_halfwidth)).groupBy(*keys).agg(F.min("t0").alias("activation"))
    return rois.join(first, list(keys), "left")


def to_raster(events: DataFrame, n_points: int, last: float, keys=("roi",)) -> DataFrame:
    """Cells of a grid of n_points over [0, last] that lie inside an event; one row an active cell of a trace."""
    step = last / (n_points - 1)
    low = F.greatest(F.ceil(F.col("t0") / step), F.lit(0))
    high = F.least(F.floor(F.col("tend") / step), F.lit(n_points - 1))
    cells = events.filter(low <= high).select(*keys, F.explode(F.sequence(low, high)).alias("cell"))
    return cells.select(*keys, F.col("cell").cast("int").alias("cell")).distinct()


def hexbin(points: DataFrame, x: Column, y: Column, nx: int, ny: int, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Counts of hexagonal bins: of two shifted lattices in range-scaled space the nearer centre."""
    x0, x1, y0, y1 = bounds
    u, v = (x - x0) / (x1 - x0) * nx, (y - y0) / (y1 - y0) * ny
    rows = points.select(u.alias("u"), v.alias("v"))
    i1, j1, i2, j2 = F.floor(F.col("u") + 0.5), F.floor(F.col("v") + 0.5), F.floor("u"), F.floor("v")
    d1 = F.pow(F.col("u") - i1, F.lit(2)) + 3 * F.pow(F.col("v") - j1, F.lit(2))
    d2 = F.pow(F.col("u") - i2 - 0.5, F.lit(2)) + 3 * F.pow(F.col("v") - j2 - 0.5, F.lit(2))
    cx, cy = F.when(d1 < d2, i1.cast("double")).otherwise(i2 + 0.5), F.when(d1 < d2, j1.cast("double")).otherwise(j2 + 0.5)
    return rows.groupBy(cx.alias("hx"), cy.alias("hy")).agg(F.count(F.lit(1)).alias("n"))


def cross_filter(events: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Events inside every range, ends included."""
    for column, (low, high) in ranges.items():
        events = events.filter(F.col(column).between(low, high))
    return events


def filtered(events: DataFrame, condition: str, logs=()) -> DataFrame:
    """Events that meet a condition on their columns, with log_ and the name for log10 of the columns in logs (null if not above 0)."""
    kept = events.filter(condition)
    return kept.withColumns({f"log_{c}": F.when(F.col(c) > 0, F.log10(c)) for c in logs}) if logs else kept


def thinned(events: DataFrame, most: int = 1000, keys=("roi",)) -> DataFrame:
    """Rois of a recording in order of abundance, then time; every (n // most + 1)-th event; run numbers the blocks of one roi.

    Only rois are put in one order, one row each; events are numbered within theirs.
    """
    keys, of = list(keys), list(keys)[:-1]
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("abundance"))
    by_abundance = Window.partitionBy(*of).orderBy(F.desc("abundance"), keys[-1])
    before = F.coalesce(F.sum("abundance").over(by_abundance.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).withColumn("total", F.sum("abundance").over(Window.partitionBy(*of)))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*keys).orderBy("t0", "event_id")) - 1
    rows = events.join(offsets, keys).withColumn("place", place).filter(F.col("place") % (F.floor(F.col("total") / most) + 1) == 0)
    runs = rows.select(*keys, "abundance").distinct().select(*keys, F.row_number().over(by_abundance).cast("long").alias("run"))
    return rows.join(runs, keys).drop("before", "total")


def intervals(events: DataFrame, min_events: int, keys=("roi",)) -> DataFrame:
    """By recording the median over rois (at least min_events events) of the median interval between events and of the median halfwidth."""
    own = Window.partitionBy(*keys).orderBy("t0", "event_id")
    rows = events.withColumn("interval", F.col("t0") - F.lag("t0").over(own))
    middle = lambda c: F.percentile(c, F.lit(0.5))
    each = rows.groupBy(*keys).agg(middle("interval").alias("interval"), middle("halfwidth").alias("halfwidth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_events)
    return each.groupBy(*list(keys)[:-1]).agg(middle("interval").alias("interval"), middle("halfwidth").alias("halfwidth"), F.count(F.lit(1)).alias("n_rois"))


def event_windows(events: DataFrame, filtered: DataFrame, dt: float, keys=("roi",)) -> DataFrame:
    """Samples of fast from one to four widths around each event's start; k counts from the window's first.

    The width is the halfwidth in samples down to a multiple of five, at least five.
    """
    wide = F.greatest(F.lit(5), F.floor(F.ceil(F.col("halfwidth") / dt) / 5) * 5).cast("int")
    places = events.withColumn("i0", F.round(F.col("t0") / dt).cast("int")).withColumn("wide", wide)
    # One row a sample of a window: an equi-join, not a range join.
    wanted = places.select(*keys, "event_id", "wide", "i0", F.explode(F.sequence(F.col("i0") - F.col("wide"), F.col("i0") + 4 * F.col("wide") - 1)).alias("i"))
    return wanted.join(filtered.select(*keys, "i", "fast"), [*keys, "i"]).select(*keys, "event_id", "wide", (F.col("i") - F.col("i0") + F.col("wide")).alias("k"), "fast")


def event_shapes(windows: DataFrame, least: int, keys=("roi",)) -> DataFrame:
    """Mean over events of the z-normalised windows of one width, where there are at least so many events."""
    own = Window.partitionBy(*keys, "event_id")
    s = F.stddev_pop("fast").over(own)
    rows = windows.withColumn("u", (F.col("fast") - F.avg("fast").over(own)) / F.nullif(s, F.lit(0.0)))
    return rows.groupBy("wide", "k").agg(F.avg("u").alias("shape"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
