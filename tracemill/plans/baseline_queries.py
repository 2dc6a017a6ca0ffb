"""Queries of slow baselines on weekly supplier volumes, and of densities and mixtures of halfwidths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.numbers import tidy
from tracemill.operators import baselines as bl
from tracemill.plans.registry import query
from tracemill.plans.trace_queries import SLOW
from tracemill.sources import bindings as b

TS, MOST = 7.0 * 26, 13  # a window of 26 samples on blocks of two

SLOWER = """rb AS (SELECT roi, CAST(i // 2 AS INTEGER) AS i, avg(t) AS t, avg(value) AS value FROM tr GROUP BY roi, i // 2 HAVING count(*) = 2),
""" + SLOW.replace(" tr ", " rb ") + """,
kn AS (SELECT roi, i AS k, lag(slow) OVER o AS s0, slow AS s1, lead(slow) OVER o AS s2, max(i) OVER (PARTITION BY roi) AS k_last FROM slow WINDOW o AS (PARTITION BY roi ORDER BY i)),
la AS (SELECT DISTINCT roi, k_last FROM kn), pl AS (SELECT tr.*, (i - 0.5) / 2 AS u, greatest(1, least(floor((i - 0.5) / 2 + 0.5), k_last - 1)) AS k FROM tr JOIN la USING (roi)),
sl AS (SELECT roi, i, value, s0 * (u - k) * (u - k - 1) / 2 + s1 * (1 - (u - k) * (u - k)) + s2 * (u - k) * (u - k + 1) / 2 AS slow FROM pl JOIN kn USING (roi, k))"""

RATES = [0.0003, 0.001, 0.003, 0.01, 0.03]


def best(name: str, source: str, rate: str) -> str:
    """Table name(roi, rate, b, c): the best decay of source(roi, i, value, ...) over a list of rates."""
    return f"""{name}_x AS (SELECT roi, value, i, unnest({rate}) AS rate FROM {source}), {name}_e AS (SELECT *, exp(-rate * i) AS e FROM {name}_x),
{name}_f AS (SELECT roi, rate, regr_slope(value, e) AS c, regr_intercept(value, e) AS b, round(regr_syy(value, e) - pow(regr_sxy(value, e), 2) / regr_sxx(value, e), 6) AS sse FROM {name}_e GROUP BY 1, 2),
{name} AS (SELECT roi, rate, b, c FROM (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY sse, rate) AS k FROM {name}_f WHERE c IS NOT NULL) WHERE k = 1)"""


BLEACHED = """en AS (SELECT roi, count(*) AS n, greatest(count(*) // 40, 1) AS width FROM tr GROUP BY 1),
bk AS (SELECT roi, i // width AS k, n // width AS blocks, quantile_cont(value, 0.1) AS value, avg(i) AS i FROM tr JOIN en USING (roi) GROUP BY roi, i // width, n // width),
lo AS (SELECT roi, value, i FROM bk WHERE k >= blocks // 10 AND k < blocks - ceil(blocks / 10) - 1),
""" + best("co", "lo", f"{RATES}::DOUBLE[]") + """,
l2 AS (SELECT lo.*, rate AS near FROM lo JOIN co USING (roi)),
""" + best("fi", "l2", "[near * 0.5, near * 0.7, near * 0.85, near * 1.0, near * 1.2, near * 1.4, near * 2.0]::DOUBLE[]") + """,
cu AS (SELECT tr.roi, tr.i, value, coalesce(b + c * exp(-rate * tr.i), 0.0) AS curve FROM tr LEFT JOIN fi USING (roi)),
li AS (SELECT roi, regr_slope(value - curve, i) AS up, regr_intercept(value - curve, i) AS start FROM cu GROUP BY 1)"""

DENSITY = """vx AS (SELECT ln(halfwidth) / ln(10) AS x FROM ev), ds AS (SELECT x, count(*) AS w FROM vx GROUP BY 1), ea AS (SELECT min(x) AS a, max(x) AS z, stddev_samp(x) * pow(count(*), -0.2) AS width FROM vx),
gr AS (SELECT k, a + (k + 0.5) * (z - a) / 100 AS centre, width FROM ea, (SELECT unnest(generate_series(0, 99)) AS k)),
de AS (SELECT k, centre, sum(w * exp(-pow((centre - x) / width, 2) / 2)) AS d FROM gr, ds GROUP BY 1, 2),
pe AS (SELECT *, d > coalesce(lag(d) OVER (ORDER BY k), -1) AND d > coalesce(lead(d) OVER (ORDER BY k), -1) AS peak FROM de),
tw AS (SELECT min(k) AS k0, max(k) AS k1 FROM (SELECT k FROM pe WHERE peak ORDER BY d DESC, k LIMIT 2)),
va AS (SELECT arg_min(centre, d) AS centre FROM de, tw WHERE k > k0 AND k < k1)"""


@query("t12_slow_filter", b.sql("week", then=SLOWER) + "SELECT roi, i, round(slow, 6) + 0.0 AS slow, round(value - slow, 6) + 0.0 AS fast, round(CASE WHEN slow > 0.001 THEN (value - slow) / sqrt(1.5 * slow / 2) END, 6) + 0.0 AS z FROM sl")
def t12(spark, sf_dir):
    found = bl.slow_filter(b.traces_week(spark, sf_dir), TS, 1 / 7, 1.5, most=MOST)
    return found.select("roi", "i", tidy("slow", 6).alias("slow"), tidy("fast", 6).alias("fast"), tidy(F.when(F.col("slow") > 0.001, F.col("z")), 6).alias("z"))


@query("t2_debleached", b.sql("week", then=BLEACHED) + "SELECT cu.roi, i, round(curve + start + up * i, 3) + 0.0 AS trend, round(value - (curve + start + up * i), 3) + 0.0 AS detrended FROM cu JOIN li USING (roi)")
def t2(spark, sf_dir):
    found = bl.detrend(b.traces_week(spark, sf_dir), "debleach", rates=RATES, points=40)
    return found.select("roi", "i", tidy("trend", 3).alias("trend"), tidy("detrended", 3).alias("detrended"))


@query("t31_separation_threshold", b.sql("events", then=DENSITY) + "SELECT round(CASE WHEN centre IS NULL THEN 0.0 ELSE pow(10.0, centre) END, 4) AS threshold, centre IS NOT NULL AS separated FROM va")
def t31(spark, sf_dir):
    found = bl.separation_threshold(b.events(spark, sf_dir), "halfwidth", log=True)
    split = F.col("threshold") > float("-inf")
    return found.select(F.round(F.when(split, F.col("threshold")).otherwise(0.0), 4).alias("threshold"), split.alias("separated"))


@query("t32_mixture_fit")
def t32(spark, sf_dir):
    """Without SQL, since it iterates; tests/test_baselines.py fits planted mixtures."""
    events = b.events(spark, sf_dir).withColumn("x", F.log10("halfwidth"))
    return bl.mixture_fit(events, "x", rounds=40).select("k", "component", *(tidy(c, 2).alias(c) for c in ("weight", "mean", "deviation")))
