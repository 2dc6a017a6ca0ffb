"""Queries of event shapes on lifted weekly supplier volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.numbers import tidy
from tracemill.operators import filters as fl
from tracemill.operators import pulses as pu
from tracemill.plans import filter_queries as fq
from tracemill.plans.registry import query
from tracemill.plans.trace_queries import r
from tracemill.sources import bindings as b

GRID = pu.Grid()
POINTS = ", ".join(f"({m}, '{model}', {k}, {loc!r}, {width!r}, {form!r})" for m, model in enumerate(pu.MODELS) for k, (loc, width, form) in enumerate(GRID.points(model).tolist()))

HALF = "form * sqrt(1 + form * form / 4)"
ROOT = "list_reduce([{start}, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[], lambda q, _: q - (exp(q) - 1 - q - ln(2) / form) / (exp(q) - 1))"

#: gr: points with, in halfwidths of the event, the width at half height; sh: heights of each pulse at each sample of each event.
SHAPES = f"""gp AS (SELECT m, model, k, loc::DOUBLE AS loc, width::DOUBLE AS width, form::DOUBLE AS form FROM (VALUES {POINTS}) v(m, model, k, loc, width, form)),
g2 AS (SELECT *, width / (exp(-1.5 * form * form + {HALF}) - exp(-1.5 * form * form - {HALF})) AS scale FROM gp),
gr AS MATERIALIZED (SELECT *, scale * exp(-1.5 * form * form - {HALF}) AS first, CASE WHEN m = 1 THEN scale * exp(-form * form) * (exp(form * sqrt(2 * ln(2))) - exp(-form * sqrt(2 * ln(2))))
  ELSE (exp({ROOT.format(start="ln(1 + 2 * ln(2) / form / 3 + sqrt((2 * ln(2) / form / 3) * (2 * ln(2) / form / 3) + 2 * ln(2) / form))")}) - exp({ROOT.format(start="-1 - ln(2) / form")})) * sqrt(form) * width / 2 END AS fwhm FROM g2),
ev AS (SELECT roi, p, x0 * 7 AS t0, (x1 - x0) * 7 AS hw FROM xx),
wn AS MATERIALIZED (SELECT ev.*, t, value AS y, count(*) OVER w AS n, t - avg(t) OVER w AS tau, avg(value) OVER w AS my, min(t) OVER w AS ta, max(t) OVER w AS tb FROM ev JOIN lt ON lt.roi = ev.roi AND i BETWEEN greatest(ceil((t0 - {pu.BEFORE} * hw) / 7), 0) AND ceil((t0 + {pu.AFTER} * hw) / 7) - 1 WINDOW w AS (PARTITION BY ev.roi, p)),
sq AS (SELECT *, sum(tau * tau) OVER w AS tt, sum(tau * y) OVER w AS ty FROM wn WHERE n >= 4 WINDOW w AS (PARTITION BY roi, p)),
su AS (SELECT sq.*, gr.m, model, k, loc, width, form, fwhm, CASE m WHEN 0 THEN (t - t0 - loc * hw) * 2 * sqrt(form) / (width * hw) + form - sqrt(form) ELSE (t - t0 - loc * hw) / hw + first END AS u, scale,
  CASE m WHEN 0 THEN t0 + loc * hw + width * hw / 2 ELSE t0 + (loc - first + scale * exp(-form * form)) * hw END AS mode FROM sq, gr),
sh AS (SELECT *, CASE WHEN u <= 0 THEN 0 WHEN m = 0 THEN exp(form * ln(u / form) + form - u) ELSE exp(-ln(u / scale) - pow(ln(u / scale), 2) / (2 * form * form) - form * form / 2) END AS h FROM su),
li AS (SELECT roi, p, m, k, any_value(n) AS n, any_value(my) AS my, any_value(tt) AS tt, any_value(ty) AS ty, avg(h) AS mh, sum(h * tau) / any_value(tt) AS hs FROM sh GROUP BY ALL),
am AS (SELECT roi, p, m, k, mh, hs, sum((h - mh - hs * tau) * y) / nullif(sum(pow(h - mh - hs * tau, 2)), 0) AS amplitude FROM sh JOIN li USING (roi, p, m, k) GROUP BY ALL),
cu AS (SELECT sh.*, amplitude, my - amplitude * mh AS base, ty / tt - amplitude * hs AS slope FROM sh JOIN am USING (roi, p, m, k) WHERE amplitude > {pu.LEAST_RISE} * abs(my) AND mode > ta AND mode < tb AND abs(loc - {pu.START}) <= 1 + fwhm),
fi AS (SELECT *, amplitude * h + base + slope * tau AS f, min(CASE WHEN h >= {pu.CUT} THEN amplitude * h + base + slope * tau END) OVER (PARTITION BY roi, p, m, k) AS low FROM cu),
ch AS (SELECT roi, p, m, model, k, any_value(t0 + loc * hw) AS loc, any_value(width * hw) AS width, any_value(form) AS form, any_value(amplitude) AS amplitude, any_value(base) + any_value(slope) * min(tau) AS "offset", any_value(base) + any_value(slope) * max(tau) AS "end", any_value(fwhm * hw) AS halfwidth,
  sum(CASE WHEN h >= {pu.CUT} THEN pow(y - f, 2) / (f + low / 100) END) / count(CASE WHEN h >= {pu.CUT} THEN 1 END) AS chi2 FROM fi WHERE low > 0 GROUP BY ALL HAVING count(CASE WHEN h >= {pu.CUT} THEN 1 END) >= 3),
be AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY roi, p ORDER BY chi2, m, k) = 1)"""

COLUMNS = ["loc", "width", "form", "amplitude", "offset", "end", "halfwidth", "chi2"]


def found_events(spark, sf_dir):
    found = fl.detect_events(fl.fast_filter(fq.lifted(spark, sf_dir), fq.N, 2.0, 1), fq.N, 7.0, smooth=fq.SMOOTH)
    return found.select("roi", F.round(F.col("peakpoint") / 7).cast("long").alias("event_id"), "t0", "halfwidth")


@query("e12_fit_event_shapes", b.sql("week", then=f"{fq.LIFTED},\n{fq.one_pass(source='lt')},\n{fq.peaks()},\n{SHAPES}") + "SELECT roi, CAST(p AS BIGINT) AS event_id, model, " + ", ".join(f'{r(chr(34) + c + chr(34))} AS "{c}"' for c in COLUMNS) + " FROM be")
def e12(spark, sf_dir):
    found = pu.fit_event_shapes(found_events(spark, sf_dir), fq.lifted(spark, sf_dir), 7.0, levels=1)
    return found.select("roi", "event_id", "model", *(tidy(c).alias(c) for c in COLUMNS))


@query("e13_greedy_pulse_fit")
def e13(spark, sf_dir):
    found = pu.greedy_pulse_fit(fq.lifted(spark, sf_dir), fq.N, 7.0)
    return found.select("roi", "round", "model", *(tidy(c).alias(c) for c in ("explained", "loc", "width", "form", "amplitude", "halfwidth")))


#: Pulses of the events of each roi, of either model by turns, on a grid of six hours.
LAST = 119
SUMS = f"""pl AS (SELECT roi, event_id % 2 AS m, t0 AS loc, halfwidth AS width, CASE event_id % 2 WHEN 0 THEN 1.0 + event_id % 5 ELSE 0.2 + 0.1 * (event_id % 5) END::DOUBLE AS form, height AS amplitude FROM ev),
sc AS (SELECT *, width / (exp(-1.5 * form * form + {HALF}) - exp(-1.5 * form * form - {HALF})) AS scale, exp(-1.5 * form * form - {HALF}) AS part FROM pl),
tm AS (SELECT roi, CAST(unnest(generate_series(0, {LAST})) AS INTEGER) AS i FROM (SELECT DISTINCT roi FROM ev)),
uu AS (SELECT tm.roi, tm.i, m, form, scale, amplitude, CASE m WHEN 0 THEN (tm.i * 6 - loc) * 2 * sqrt(form) / width + form - sqrt(form) ELSE tm.i * 6 - loc + scale * part END AS u FROM tm LEFT JOIN sc USING (roi)),
hh AS (SELECT *, CASE WHEN u IS NULL OR u <= 0 THEN 0 WHEN m = 0 THEN exp(form * ln(u / form) + form - u) ELSE exp(-ln(u / scale) - pow(ln(u / scale), 2) / (2 * form * form) - form * form / 2) END AS h FROM uu)"""


@query("e11_sum_of_pulses", b.sql("events", then=SUMS) + f"SELECT roi, i, {r(f'sum(CASE WHEN h < {pu.CUT} THEN 0 ELSE coalesce(amplitude * h, 0) END)')} AS pulses FROM hh GROUP BY 1, 2")
def e11_sum(spark, sf_dir):
    events = b.events(spark, sf_dir)
    gamma = F.col("event_id") % 2 == 0
    form = F.when(gamma, 1.0 + F.col("event_id") % 5).otherwise(0.2 + 0.1 * (F.col("event_id") % 5))
    pulses = events.select("roi", F.when(gamma, "gamma").otherwise("lognormal").alias("model"), F.col("t0").alias("loc"), F.col("halfwidth").alias("width"), form.alias("form"), F.col("height").alias("amplitude"))
    samples = events.select("roi").distinct().select("roi", F.explode(F.sequence(F.lit(0), F.lit(LAST))).alias("i"))
    return pu.sum_of_pulses(pulses, samples, 6.0).select("roi", "i", tidy("pulses").alias("pulses"))
