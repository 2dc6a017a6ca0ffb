"""Queries of lines and dose-response curves with intervals, and of effects on rates."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tracemill.functions.numbers import tidy
from tracemill.operators import calibration as ca
from tracemill.plans.event_queries import LEGGED, legged
from tracemill.plans.registry import query
from tracemill.plans.trace_queries import r
from tracemill.sources import bindings as b

Z = NormalDist().inv_cdf(0.975)
T = " + ".join(f"({c!r}) / pow(n - 2, {k})" for k, c in enumerate((Z, (Z**3 + Z) / 4, (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96, (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384, (79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160)))

LINE = f"""WITH s AS (SELECT regr_count(p_retailprice, p_size) AS n, regr_slope(p_retailprice, p_size) AS slope, regr_intercept(p_retailprice, p_size) AS intercept, regr_sxx(p_retailprice, p_size) AS sxx, regr_syy(p_retailprice, p_size) AS syy, regr_sxy(p_retailprice, p_size) AS sxy, regr_avgx(p_retailprice, p_size) AS mx FROM part),
s2 AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS v, {T} AS t FROM s), f AS (SELECT *, sqrt(v / sxx) AS slope_se, sqrt(v * (1 / n + mx * mx / sxx)) AS intercept_se FROM s2)
"""


@query("a11_line_intervals", LINE + "SELECT round(slope - t * slope_se, 3) + 0.0 AS slope_low, round(slope + t * slope_se, 3) + 0.0 AS slope_high, round(intercept - t * intercept_se, 2) AS intercept_low, round(intercept + t * intercept_se, 2) AS intercept_high FROM f")
def a11(spark, sf_dir):
    fit = ca.line_fit(b.read(spark, sf_dir, "part"), "p_size", "p_retailprice")
    return fit.select(*(tidy(c, 3).alias(c) for c in ("slope_low", "slope_high")), *(F.round(c, 2).alias(c) for c in ("intercept_low", "intercept_high")))


@query("a11_line_predictions", LINE + "SELECT p_partkey, round(intercept + slope * p_size, 2) AS fitted, round(sqrt(v * (1 / n + pow(p_size - mx, 2) / sxx)), 3) AS fit_se, round(sqrt(v * (1 + 1 / n + pow(p_size - mx, 2) / sxx)), 2) AS value_se FROM part, f")
def a11p(spark, sf_dir):
    part = b.read(spark, sf_dir, "part")
    found = ca.line_predictions(part.select("p_partkey", "p_size"), ca.line_fit(part, "p_size", "p_retailprice"), "p_size")
    return found.select("p_partkey", F.round("fitted", 2).alias("fitted"), F.round("fit_se", 3).alias("fit_se"), F.round("value_se", 2).alias("value_se"))


EC50, HILLS, REPLICATES = [4.0, 8.0, 12.0, 16.0, 24.0], [0.5, 1.0, 1.5, 2.0, 3.0], 40

FALLING = f"""po AS (SELECT p_partkey, p_size AS concentration, 1000 - 900 * pow(p_size, 1.5) / (pow(p_size, 1.5) + pow(12.0, 1.5)) + (p_retailprice % 7) AS measurement FROM part WHERE p_size > 0),
rp AS (SELECT *, CAST('0x' || substr(md5(p_partkey || '|' || rep), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM po, (SELECT unnest(generate_series(0, {REPLICATES})) AS rep)),
wt AS (SELECT *, CASE WHEN rep = 0 THEN 1 ELSE {" + ".join(f"(CASE WHEN u >= {p!r}::DOUBLE THEN 1 ELSE 0 END)" for p in ca.POISSON)} END AS w FROM rp),
su AS (SELECT rep, concentration, sum(w)::DOUBLE AS w, sum(w * measurement) AS wy, sum(w * measurement * measurement) AS wyy FROM wt WHERE w > 0 GROUP BY 1, 2),
gr AS (SELECT su.*, ec50, h, 1 - pow(concentration, h) / (pow(concentration, h) + pow(ec50, h)) AS f FROM su, (SELECT unnest({EC50}::DOUBLE[]) AS ec50), (SELECT unnest({HILLS}::DOUBLE[]) AS h)),
tt AS (SELECT rep, ec50, h, sum(w) AS w, sum(wy) AS wy, sum(wyy) AS wyy, sum(w * f) AS wf, sum(w * f * f) AS wff, sum(wy * f) AS wfy FROM gr GROUP BY 1, 2, 3),
sp AS (SELECT *, (wfy - wf * wy / w) / nullif(wff - wf * wf / w, 0) AS span FROM tt),
ft AS (SELECT rep, ec50, h, span, (wy - span * wf) / w AS bottom, round(wyy - wy * wy / w - span * (wfy - wf * wy / w), 6) AS sse FROM sp WHERE span > 0),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY sse, ec50, h) AS k FROM ft) WHERE k = 1)"""

INFERRED = FALLING + """, iv AS (SELECT p_partkey, rep, ec50 * pow((1 - (measurement - bottom) / span) / ((measurement - bottom) / span), 1 / h) AS c FROM po, be WHERE (measurement - bottom) / span > 0 AND (measurement - bottom) / span < 1),
ic AS (SELECT p_partkey, max(CASE WHEN rep = 0 THEN c END) AS inferred, count(*) FILTER (WHERE rep > 0) AS k, avg(c) FILTER (WHERE rep > 0) AS m, stddev_pop(c) FILTER (WHERE rep > 0) AS s, quantile_cont(c, 0.025) FILTER (WHERE rep > 0) AS p0, quantile_cont(c, 0.975) FILTER (WHERE rep > 0) AS p1 FROM iv WHERE c > 0.5 GROUP BY 1)"""


def falling(spark, sf_dir):
    size = F.pow("p_size", F.lit(1.5))
    return b.read(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", F.col("p_size").alias("concentration"), (1000 - 900 * size / (size + 12.0**1.5) + F.col("p_retailprice") % 7).alias("measurement"))


@query("a18_falling_bootstrap", "WITH " + FALLING + " SELECT CAST(rep AS INTEGER) AS rep, ec50, h, round(bottom, 2) AS bottom, round(bottom + span, 2) AS top FROM be")
def a18(spark, sf_dir):
    fits = ca.dose_response(falling(spark, sf_dir), "p_partkey", EC50, HILLS, True, REPLICATES)
    return fits.select("rep", "ec50", "h", F.round("bottom", 2).alias("bottom"), F.round("top", 2).alias("top"))


@query("a19_inferred_intervals", "WITH " + INFERRED + f" SELECT po.p_partkey, {r('inferred')} AS inferred, CASE WHEN inferred IS NOT NULL THEN round(CASE WHEN k < 30 THEN m - {Z!r} * s ELSE p0 END, 3) + 0.0 END AS low, CASE WHEN inferred IS NOT NULL THEN round(CASE WHEN k < 30 THEN m + {Z!r} * s ELSE p1 END, 3) + 0.0 END AS high FROM po LEFT JOIN ic USING (p_partkey)")
def a19(spark, sf_dir):
    points = falling(spark, sf_dir)
    found = ca.infer_concentrations(points, "p_partkey", ca.dose_response(points, "p_partkey", EC50, HILLS, True, REPLICATES), 1.0, True)
    return found.select("p_partkey", tidy("inferred").alias("inferred"), tidy("low", 3).alias("low"), tidy("high", 3).alias("high"))


# In this table every experiment has one rate a leg, so the model's coefficient is a difference of means.
RATES = """ra AS (SELECT recording, leg, count(*) * 60 / (max(peakpoint) - min(peakpoint)) AS x FROM le WHERE leg IS NOT NULL GROUP BY 1, 2), nr AS (SELECT recording, count(DISTINCT roi) AS n FROM ev GROUP BY 1),
lo AS (SELECT leg, avg(log10(x / n)) AS m FROM ra JOIN nr USING (recording) GROUP BY 1)"""


@query("a10_rate_effect", b.sql("events", "legs", then=LEGGED + ", " + RATES) + f"SELECT a.leg, {r('a.m - c.m')} AS coef, {r('(pow(10, a.m - c.m) - 1) * 100')} AS effect FROM lo a, lo c WHERE c.leg = 'a' AND a.leg <> 'a'")
def a10(spark, sf_dir):
    found = ca.rate_effect(legged(spark, sf_dir), "a", legs=["a", "b", "c"])
    return found.select("leg", tidy("coef").alias("coef"), tidy("effect").alias("effect"))
