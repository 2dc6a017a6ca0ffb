"""Queries of the event operators and the statistics over events, on user events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.numbers import hill, tidy
from tracemill.operators import calibration as ca
from tracemill.operators import events as ev
from tracemill.operators import mixed, stats
from tracemill.operators import traces as tr
from tracemill.plans.registry import query
from tracemill.plans.trace_queries import RUNS, SLOW, r, z_table
from tracemill.sources import bindings as b

LEGGED = """le AS (SELECT ev.*, leg FROM ev LEFT JOIN legs ON peakpoint > leg_begin AND peakpoint < leg_end),
du AS (SELECT leg, max(peakpoint) - min(peakpoint) AS duration FROM le WHERE leg IS NOT NULL GROUP BY leg)"""


def legged(spark, sf_dir):
    return ev.define_legs(b.events(spark, sf_dir), b.legs(spark))


@query("e4_define_legs", b.sql("events", "legs", then=LEGGED) + "SELECT event_id, leg FROM le")
def e4(spark, sf_dir):
    return legged(spark, sf_dir).select("event_id", "leg")


@query("e5_match_events", b.sql("events", then="ma AS (SELECT a.event_id, list_sort(list(DISTINCT c.event_id)) AS m FROM ev a JOIN ev c ON a.roi = c.roi AND a.its <> c.its AND abs(a.t0 - c.t0) < 0.2 * a.halfwidth AND abs(a.tend - c.tend) < 0.2 * a.halfwidth WHERE a.its <= 1 AND c.its > 1 GROUP BY 1)") + "SELECT ev.event_id, coalesce(array_to_string(m, ','), '') AS matches FROM ev LEFT JOIN ma USING (event_id) WHERE its <= 1")
def e5(spark, sf_dir):
    events = b.events(spark, sf_dir)
    return ev.match_events(events.filter("its <= 1"), events.filter("its > 1")).select("event_id", F.array_join("matches", ",").alias("matches"))


DISTILL = """ow AS (SELECT *, CASE WHEN t0 - halfwidth / 2 < 12 THEN 'too close to beginning' WHEN tend + halfwidth / 2 > 700 THEN 'too close to end' WHEN halfwidth < 1.5 THEN 'too short' ELSE 'ok' END AS own FROM ev),
li AS (SELECT a.event_id AS a, c.event_id AS b FROM ow a JOIN ow c ON a.roi = c.roi AND abs(a.t0 - c.t0) < 0.45 * a.halfwidth AND abs(a.tend - c.tend) < 0.45 * a.halfwidth AND abs(a.its - c.its) <= 1 WHERE a.own = 'ok'),
un AS (SELECT a, b FROM li UNION SELECT b, a FROM li),
cc(node, root) AS (SELECT a, a FROM un UNION SELECT un.b, cc.root FROM cc JOIN un ON un.a = cc.node),
ro AS (SELECT node, min(root) AS root FROM cc GROUP BY node),
me AS (SELECT ow.*, root FROM ow LEFT JOIN ro ON event_id = node),
st AS (SELECT root, count(*) AS clique_size, arg_max(event_id, (z_max, -event_id)) AS attractor, quantile_cont(t0, 0.5) AS m_t0, quantile_cont(tend, 0.5) AS m_tend, quantile_cont(z_max, 0.5) AS m_z FROM me WHERE root IS NOT NULL GROUP BY root),
au AS (SELECT me.*, clique_size, attractor, m_t0, m_tend, m_z, CASE WHEN me.root IS NULL THEN own WHEN clique_size = 1 THEN 'solitary' WHEN clique_size < 2 AND m_tend - m_t0 > 2 THEN 'too few calls' WHEN attractor = event_id THEN 'survivor' ELSE 'merged' END AS status FROM me LEFT JOIN st USING (root))"""


def audit(spark, sf_dir):
    return ev.distill_audit(b.events(spark, sf_dir), 12.0, 700.0, tol=0.45, min_confidence=2, small=2.0, shortest=1.5)


@query("e6_distill_events", b.sql("events", then=DISTILL) + f"SELECT event_id, roi, clique_size, {r('m_t0')} AS t0, {r('m_tend')} AS tend, {r('m_tend - m_t0')} AS halfwidth, {r('m_z')} AS z_max FROM au WHERE status = 'survivor'")
def e6(spark, sf_dir):
    out = ev.distilled(audit(spark, sf_dir))
    return out.select("event_id", "roi", "clique_size", *(tidy(c).alias(c) for c in ("t0", "tend", "halfwidth", "z_max")))


@query("e7_distill_audit", b.sql("events", then=DISTILL) + "SELECT event_id, status, coalesce(attractor, -1) AS attractor, coalesce(clique_size, 0) AS clique_size FROM au")
def e7(spark, sf_dir):
    found = audit(spark, sf_dir)
    return found.select("event_id", "status", F.coalesce("attractor", F.lit(-1)).cast("long").alias("attractor"), F.coalesce("clique_size", F.lit(0)).cast("long").alias("clique_size"))


@query("g1_connected_components", b.sql("events", then="""li AS (SELECT a.event_id AS a, c.event_id AS b FROM ev a JOIN ev c ON a.roi = c.roi AND abs(a.t0 - c.t0) < 0.45 * a.halfwidth AND abs(a.tend - c.tend) < 0.45 * a.halfwidth),
un AS (SELECT a, b FROM li UNION SELECT b, a FROM li), cc(node, root) AS (SELECT a, a FROM un UNION SELECT un.b, cc.root FROM cc JOIN un ON un.a = cc.node)""") + "SELECT node, min(root) AS root FROM cc GROUP BY node")
def g1(spark, sf_dir):
    e = b.events(spark, sf_dir)
    pairs = ev.binned(e.select("roi", F.col("event_id").alias("a_id"), F.col("t0").alias("a_t0"), F.col("tend").alias("a_tend"), F.col("halfwidth").alias("a_hw")), e.select("roi", F.col("event_id").alias("b_id"), F.col("t0").alias("b_t0"), F.col("tend").alias("b_tend")), 0.45, ["roi"])
    return ev.components(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


@query("e14_hill_and_log_scale", b.sql("events") + f"SELECT event_id, {r('pow(halfwidth / 4.0, 2) / (1 + pow(halfwidth / 4.0, 2)) * 0.94 + 0.03')} AS hill, {r('ln(least(greatest(halfwidth, 1.0), 50.0)) / ln(50.0)')} AS log_scaled FROM ev")
def e14(spark, sf_dir):
    hw = F.col("halfwidth")
    return b.events(spark, sf_dir).select("event_id", tidy(hill(hw)).alias("hill"), tidy(F.ln(F.least(F.greatest(hw, F.lit(1.0)), F.lit(50.0))) / F.ln(F.lit(50.0))).alias("log_scaled"))


@query("e15_hexbin", b.sql("events", then="""uv AS (SELECT (peakpoint - 0) / 720.0 * 30 AS u, (log10(halfwidth) - 0) / 2.0 * 17 AS v FROM ev),
di AS (SELECT u, v, pow(u - floor(u + 0.5), 2) + 3 * pow(v - floor(v + 0.5), 2) AS d1, pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS d2 FROM uv)""") + "SELECT CASE WHEN d1 < d2 THEN floor(u + 0.5) ELSE floor(u) + 0.5 END AS hx, CASE WHEN d1 < d2 THEN floor(v + 0.5) ELSE floor(v) + 0.5 END AS hy, count(*) AS n FROM di GROUP BY 1, 2")
def e15(spark, sf_dir):
    return ev.hexbin(b.events(spark, sf_dir), F.col("peakpoint"), F.log10("halfwidth"), 30, 17, (0.0, 720.0, 0.0, 2.0))


@query("e16_thin_selected", b.sql("events", then="""fe AS (SELECT * FROM ev WHERE halfwidth > 3), co AS (SELECT roi, count(*) AS abundance FROM fe GROUP BY roi),
pl AS (SELECT event_id, roi, row_number() OVER (ORDER BY abundance DESC, roi, t0, event_id) - 1 AS place FROM fe JOIN co USING (roi)), th AS (SELECT * FROM pl WHERE place % ((SELECT count(*) FROM fe) // 200 + 1) = 0),
nw AS (SELECT *, CASE WHEN coalesce(lag(roi) OVER (ORDER BY place), -1) <> roi THEN 1 ELSE 0 END AS n FROM th)""") + "SELECT event_id, roi, CAST(sum(n) OVER (ORDER BY place) AS BIGINT) AS run FROM nw")
def e16(spark, sf_dir):
    return ev.thinned(b.events(spark, sf_dir).filter("halfwidth > 3"), 200).select("event_id", "roi", "run")


@query("e17_cross_filter", b.sql("events") + "SELECT event_id FROM ev WHERE halfwidth BETWEEN 2 AND 8 AND peakpoint BETWEEN 100 AND 500 AND height BETWEEN 0.1 AND 0.6")
def e17(spark, sf_dir):
    return ev.cross_filter(b.events(spark, sf_dir), {"halfwidth": (2.0, 8.0), "peakpoint": (100.0, 500.0), "height": (0.1, 0.6)}).select("event_id")


@query("e18_window_events", b.sql("events", "legs") + "SELECT event_id, leg FROM ev JOIN legs ON t0 >= leg_begin AND tend <= leg_end")
def e18(spark, sf_dir):
    return ev.window_events(b.events(spark, sf_dir), b.legs(spark)).select("event_id", "leg")


@query("e19_activation_time", b.sql("events", then="fi AS (SELECT roi, min(t0) AS a FROM ev WHERE t0 > 48 AND t0 < 216 AND halfwidth > 5 GROUP BY roi)") + f"SELECT roi, {r('a')} AS activation FROM (SELECT DISTINCT roi FROM ev) LEFT JOIN fi USING (roi)")
def e19(spark, sf_dir):
    events = b.events(spark, sf_dir)
    return ev.activation_time(events, events.select("roi").distinct(), 48.0, 216.0, 5.0).select("roi", tidy("activation").alias("activation"))


@query("e20_filter_events", b.sql("events") + f"SELECT event_id, {r('log10(halfwidth)')} AS log_halfwidth FROM ev WHERE z_max > 4 AND ts <= 8 AND halfwidth < 10")
def e20(spark, sf_dir):
    found = ev.filtered(b.events(spark, sf_dir), "z_max > 4 and ts <= 8 and halfwidth < 10", ["halfwidth"])
    return found.select("event_id", tidy("log_halfwidth").alias("log_halfwidth"))


@query("t26_events_to_raster", b.sql("events", then="ce AS (SELECT roi, unnest(generate_series(CAST(greatest(ceil(t0 / (720.0 / 999)), 0) AS BIGINT), CAST(least(floor(tend / (720.0 / 999)), 999) AS BIGINT))) AS cell FROM ev)") + "SELECT DISTINCT roi, CAST(cell AS INTEGER) AS cell FROM ce")
def t26(spark, sf_dir):
    return ev.to_raster(b.events(spark, sf_dir), 1000, 720.0)


def boot(x: str) -> str:
    return f"""ac AS (SELECT roi FROM ev GROUP BY roi HAVING count(*) > 20), na AS (SELECT count(*) AS n FROM ac),
rp AS (SELECT roi, rep, row_number() OVER (PARTITION BY rep ORDER BY md5(roi || '|' || rep || '|0'), roi) AS place FROM ac, (SELECT unnest(generate_series(0, 19)) AS rep)),
dr AS (SELECT roi, rep FROM rp, na WHERE place <= n // 2),
cl AS (SELECT *, CASE WHEN halfwidth >= 1 AND halfwidth < 3 THEN '1-3' WHEN halfwidth >= 3 AND halfwidth < 10 THEN '3-10' END AS hw_region FROM le WHERE leg IS NOT NULL),
pe AS (SELECT roi, leg, hw_region, {x} AS x FROM cl WHERE hw_region IS NOT NULL GROUP BY 1, 2, 3),
ce AS (SELECT leg, hw_region, rep FROM (SELECT DISTINCT leg, hw_region FROM pe), (SELECT unnest(generate_series(0, 19)) AS rep)),
su AS (SELECT rep, leg, hw_region, sum(x) AS x FROM dr JOIN pe USING (roi) GROUP BY 1, 2, 3),
ra AS (SELECT leg, hw_region, avg(coalesce(x, 0)) AS m, stddev_pop(coalesce(x, 0)) AS s FROM ce LEFT JOIN su USING (rep, leg, hw_region) GROUP BY 1, 2)"""


EDGES = [(1.0, 3.0), (3.0, 10.0)]


@query("a1_event_rate", b.sql("events", "legs", then=LEGGED + ",\n" + boot("count(*)")) + f"SELECT leg, hw_region, {r('m * 60 / (duration * (n // 2))')} AS epmpr, {r('s * 60 / (duration * (n // 2))')} AS epmpr_std FROM ra JOIN du USING (leg), na")
def a1(spark, sf_dir):
    return stats.event_rate(legged(spark, sf_dir), EDGES, 20, 2).select("leg", "hw_region", tidy("epmpr").alias("epmpr"), tidy("epmpr_std").alias("epmpr_std"))


@query("a2_event_activity", b.sql("events", "legs", then=LEGGED + ",\n" + boot("sum(auc)")) + f"SELECT leg, hw_region, {r('m * 60 / (duration * (n // 2))')} AS epmpr, {r('s * 60 / (duration * (n // 2))')} AS epmpr_std FROM ra JOIN du USING (leg), na")
def a2(spark, sf_dir):
    return stats.event_activity(legged(spark, sf_dir), EDGES, 20, 2).select("leg", "hw_region", tidy("epmpr").alias("epmpr"), tidy("epmpr_std").alias("epmpr_std"))


TIDY = """ti AS (SELECT leg, roi, count(*) AS n, quantile_cont(halfwidth, 0.5) AS halfwidth, quantile_cont(height, 0.5) AS height FROM le WHERE halfwidth > 1 AND halfwidth < 60 AND leg IS NOT NULL GROUP BY 1, 2),
fu AS (SELECT roi FROM ti WHERE n > 1 GROUP BY roi HAVING count(*) = 3), td AS (SELECT * FROM ti WHERE roi IN (SELECT roi FROM fu))"""


def tidy_rows(spark, sf_dir):
    return stats.tidy_roi_leg(legged(spark, sf_dir), 1.0, 60.0, 3)


@query("a3_tidy_roi_leg", b.sql("events", "legs", then=LEGGED + ",\n" + TIDY) + f"SELECT leg, roi, n, round(halfwidth, 6) AS halfwidth, round(height, 6) AS height, {r('duration')} AS duration FROM td JOIN du USING (leg)")
def a3(spark, sf_dir):
    return tidy_rows(spark, sf_dir).select("leg", "roi", "n", F.round("halfwidth", 6).alias("halfwidth"), F.round("height", 6).alias("height"), tidy("duration").alias("duration"))


@query("a4_duration_histogram", b.sql("events", "legs", then=LEGGED + ", ed AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin, unnest([1.0, 2.0, 4.0, 8.0, 16.0]) AS low, unnest([2.0, 4.0, 8.0, 16.0, 32.0]) AS high), ct AS (SELECT leg, bin, count(*) AS n FROM le JOIN ed ON halfwidth >= low AND (halfwidth < high OR (bin = 4 AND halfwidth = high)) WHERE leg IS NOT NULL GROUP BY 1, 2)") + f"SELECT leg, bin, n, {r('n * (60 / (leg_end - leg_begin))')} AS rate, {r('sqrt(n) * (60 / (leg_end - leg_begin))')} AS rate_err FROM ct JOIN legs USING (leg)")
def a4(spark, sf_dir):
    return stats.duration_histogram(legged(spark, sf_dir), [1.0, 2.0, 4.0, 8.0, 16.0, 32.0], b.legs(spark)).select("leg", "bin", "n", tidy("rate").alias("rate"), tidy("rate_err").alias("rate_err"))


@query("a5_cdf", b.sql("events", "legs", then=LEGGED) + f"SELECT event_id, leg, {r('(row_number() OVER (PARTITION BY leg ORDER BY halfwidth, event_id) - 1) / nullif(count(*) OVER (PARTITION BY leg) - 1, 0)')} AS cdf FROM le WHERE leg IS NOT NULL")
def a5(spark, sf_dir):
    return stats.cdf(legged(spark, sf_dir).filter("leg is not null"), "halfwidth", ["leg"]).select("event_id", "leg", tidy("cdf").alias("cdf"))


@query("a6_box_summary", b.sql("events", "legs", then=LEGGED + ",\n" + TIDY + ", q AS (SELECT leg, count(*) AS n, quantile_cont(halfwidth, 0.05) AS low, quantile_cont(halfwidth, 0.25) AS q1, quantile_cont(halfwidth, 0.5) AS median, quantile_cont(halfwidth, 0.75) AS q3, quantile_cont(halfwidth, 0.95) AS high FROM td GROUP BY leg)") + "SELECT leg, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("low", "q1", "median", "q3", "high")) + f", {r('1.57 * (q3 - q1) / sqrt(n)')} AS notch FROM q")
def a6(spark, sf_dir):
    return stats.box_summary(tidy_rows(spark, sf_dir), "halfwidth", ["leg"]).select("leg", "n", *(F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")), tidy("notch").alias("notch"))


@query("a6_paired_t", b.sql("events", "legs", then=LEGGED + ",\n" + TIDY + ", df AS (SELECT x.halfwidth - y.halfwidth AS d FROM td x JOIN td y ON x.roi = y.roi AND x.leg = 'b' AND y.leg = 'a')") + f"SELECT {r('avg(d)')} AS mean_diff, {r('avg(d) / (stddev_samp(d) / sqrt(count(d)))')} AS t, count(d) - 1 AS df FROM df")
def a6t(spark, sf_dir):
    return stats.paired_t(tidy_rows(spark, sf_dir), "halfwidth", "b", "a").select(tidy("mean_diff").alias("mean_diff"), tidy("t").alias("t"), "df")


@query("a7_pairwise_z", b.sql("events", "legs", then=LEGGED + ", su AS (SELECT leg, avg(halfwidth) AS m, stddev_samp(halfwidth) / sqrt(count(*)) AS e FROM le WHERE leg IS NOT NULL GROUP BY leg)") + f"SELECT x.leg AS a, y.leg AS b, {r('abs(x.m - y.m) / sqrt(x.e * x.e + y.e * y.e)')} AS z FROM su x JOIN su y ON x.leg < y.leg")
def a7(spark, sf_dir):
    rows = legged(spark, sf_dir).filter("leg is not null").groupBy("leg").agg(F.avg("halfwidth").alias("m"), (F.stddev_samp("halfwidth") / F.sqrt(F.count(F.lit(1)))).alias("e"))
    return stats.pairwise_z(rows, "leg", "m", "e").select("a", "b", tidy("z").alias("z"))


@query("a8_effect_ols", b.sql("events", "legs", then=LEGGED + """, lg AS (SELECT leg, log10(halfwidth) AS y FROM le WHERE leg IS NOT NULL AND halfwidth > 0), ea AS (SELECT leg, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM lg GROUP BY leg),
po AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS s2 FROM ea), ba AS (SELECT n AS n0, m AS m0 FROM ea WHERE leg = 'a')""") + f"SELECT leg, {r('m - m0')} AS coef, round(sqrt(s2 * (1 / n + 1 / n0)), 6) AS se, round((m - m0) / sqrt(s2 * (1 / n + 1 / n0)), 3) + 0.0 AS t, {r('(pow(10.0, m - m0) - 1) * 100')} AS effect FROM ea, po, ba WHERE leg <> 'a'")
def a8(spark, sf_dir):
    return stats.effect_ols(legged(spark, sf_dir), "halfwidth", "a").select("leg", tidy("coef").alias("coef"), F.round("se", 6).alias("se"), tidy("t", 3).alias("t"), tidy("effect").alias("effect"))


@query("a11_linear_fit", "WITH s AS (SELECT regr_count(p_retailprice, p_size) AS n, regr_slope(p_retailprice, p_size) AS slope, regr_intercept(p_retailprice, p_size) AS intercept, regr_sxx(p_retailprice, p_size) AS sxx, regr_syy(p_retailprice, p_size) AS syy, regr_sxy(p_retailprice, p_size) AS sxy, regr_avgx(p_retailprice, p_size) AS mx FROM part) SELECT CAST(n AS BIGINT) AS n, round(slope, 3) + 0.0 AS slope, round(intercept, 2) AS intercept, round(sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 4) AS slope_se, round(sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1 / n + mx * mx / sxx)), 3) AS intercept_se FROM s")
def a11(spark, sf_dir):
    fit = ca.line_fit(b.read(spark, sf_dir, "part"), "p_size", "p_retailprice")
    return fit.select("n", tidy("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("slope_se", 4).alias("slope_se"), F.round("intercept_se", 3).alias("intercept_se"))


@query("a12_roi_heterogeneity", b.sql("events") + f"SELECT roi, count(*) AS n, round(quantile_cont(halfwidth, 0.25), 6) AS q1, round(quantile_cont(halfwidth, 0.5), 6) AS median, round(quantile_cont(halfwidth, 0.75), 6) AS q3 FROM ev GROUP BY roi HAVING count(*) > 10")
def a12(spark, sf_dir):
    return stats.roi_heterogeneity(b.events(spark, sf_dir), "halfwidth", 10).select("roi", "n", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")))


@query("a13_pool_experiments", b.sql("events") + "SELECT 'exp' || recording || '_' || roi AS pooled_roi, recording AS experiment, recording * 2.5 AS dose, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def a13(spark, sf_dir):
    plan = spark.createDataFrame([(0, 0.0), (1, 2.5), (2, 5.0)], "experiment long, dose double")
    pooled = stats.pool_experiments(b.events(spark, sf_dir), plan)
    return pooled.groupBy("pooled_roi", "experiment", "dose").agg(F.count(F.lit(1)).alias("n"))


@query("a14_median_of_rois", b.sql("events", "legs", then=LEGGED + ", ea AS (SELECT recording, leg, roi, quantile_cont(halfwidth, 0.5) AS m FROM le WHERE leg IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 3)") + f"SELECT recording, leg, {r('avg(m)')} AS mean, {r('stddev_pop(m) / sqrt(count(*) - 1)')} AS sem, count(*) AS n_rois FROM ea GROUP BY 1, 2 HAVING count(*) > 1")
def a14(spark, sf_dir):
    rows = legged(spark, sf_dir).filter("leg is not null")
    return stats.median_of_rois(rows, "halfwidth", ["recording", "leg"], 3).select("recording", "leg", tidy("mean").alias("mean"), tidy("sem").alias("sem"), "n_rois")


@query("a15_percentile_range", b.sql("events", then="en AS (SELECT quantile_cont(halfwidth, 0.1) AS lo, quantile_cont(halfwidth, 0.9) AS hi FROM ev)") + "SELECT event_id FROM ev, en WHERE halfwidth > lo AND halfwidth < hi")
def a15(spark, sf_dir):
    return stats.percentile_range(b.events(spark, sf_dir), "halfwidth", 0.1, 0.9).select("event_id")


@query("a17_leg_ratio", b.sql("events", "legs", then=LEGGED + ", ea AS (SELECT roi, leg, quantile_cont(halfwidth, 0.5) AS m FROM le WHERE leg IS NOT NULL GROUP BY 1, 2)") + f"SELECT x.leg, {r('avg(x.m / y.m)')} AS mean_ratio, {r('quantile_cont(x.m / y.m, 0.5)')} AS median_ratio, count(*) AS n FROM ea x JOIN ea y ON x.roi = y.roi AND y.leg = 'a' WHERE x.leg <> 'a' GROUP BY x.leg")
def a17(spark, sf_dir):
    return stats.leg_ratio(legged(spark, sf_dir), "halfwidth", "a").select("leg", tidy("mean_ratio").alias("mean_ratio"), tidy("median_ratio").alias("median_ratio"), "n")


DOSE = """pt AS (SELECT CAST(p_size AS DOUBLE) AS concentration, 100 + 900 * pow(p_size, 1.5) / (pow(p_size, 1.5) + pow(12.0, 1.5)) + (p_retailprice % 7) AS measurement FROM part WHERE p_size > 0),
gr AS (SELECT ec50, h FROM (SELECT unnest([4.0, 8.0, 12.0, 16.0, 24.0]) AS ec50), (SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0]) AS h)), ff AS (SELECT ec50, h, measurement, pow(concentration, h) / (pow(concentration, h) + pow(ec50, h)) AS f FROM pt, gr),
fi AS (SELECT ec50, h, regr_slope(measurement, f) AS span, regr_intercept(measurement, f) AS bottom, regr_syy(measurement, f) - pow(regr_sxy(measurement, f), 2) / regr_sxx(measurement, f) AS sse FROM ff GROUP BY 1, 2),
be AS (SELECT * FROM fi ORDER BY sse, ec50, h LIMIT 1)"""


def dose_points(spark, sf_dir):
    c = F.col("p_size").cast("double")
    return b.read(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", c.alias("concentration"), (100 + 900 * F.pow(c, F.lit(1.5)) / (F.pow(c, F.lit(1.5)) + F.pow(F.lit(12.0), F.lit(1.5))) + F.col("p_retailprice") % 7).alias("measurement"))


@query("a18_dose_response", "WITH " + DOSE + " SELECT ec50, h, round(bottom, 2) AS bottom, round(bottom + span, 2) AS top FROM be")
def a18(spark, sf_dir):
    fit = ca.dose_response(dose_points(spark, sf_dir), "p_partkey", [4.0, 8.0, 12.0, 16.0, 24.0], [0.5, 1.0, 1.5, 2.0, 3.0], replicates=0)
    return fit.select("ec50", "h", F.round("bottom", 2).alias("bottom"), F.round("top", 2).alias("top"))


@query("a19_infer_concentration", "WITH " + DOSE + ", yy AS (SELECT p_partkey, (100 + 900 * pow(p_size, 1.5) / (pow(p_size, 1.5) + pow(12.0, 1.5)) + (p_retailprice % 7) - bottom) / span AS y, ec50, h FROM part, be WHERE p_size > 0) SELECT p_partkey, CASE WHEN y > 0 AND y < 1 THEN round(ec50 * pow(y / (1 - y), 1 / h), 2) + 0.0 END AS inferred FROM yy")
def a19(spark, sf_dir):
    points = dose_points(spark, sf_dir)
    fit = ca.dose_response(points, "p_partkey", [4.0, 8.0, 12.0, 16.0, 24.0], [0.5, 1.0, 1.5, 2.0, 3.0], replicates=0)
    return ca.infer_concentrations(points, "p_partkey", fit, 0.0).select("p_partkey", tidy("inferred", 2).alias("inferred"))


@query("a20_tally_mode", b.sql("events", then="ta AS (SELECT roi, its, count(*) AS n FROM ev GROUP BY 1, 2)") + "SELECT roi, arg_max(its, (n, -its)) AS most, arg_min(its, (n, its)) AS least, CAST(sum(n) AS BIGINT) AS n FROM ta GROUP BY roi")
def a20(spark, sf_dir):
    counts = b.events(spark, sf_dir).groupBy("roi", "its").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("roi").agg(F.max(F.struct("n", (-F.col("its")).alias("k"), "its"))["its"].alias("most"), F.min(F.struct("n", "its"))["its"].alias("least"), F.sum("n").alias("n"))


@query("a9_effect_mixed")
def a9(spark, sf_dir):
    found = mixed.effect_mixed(legged(spark, sf_dir), "halfwidth", "a", least=5, legs=["a", "b", "c"])
    return found.select("leg", *(tidy(c).alias(c) for c in ("coef", "se", "z", "p", "effect", "theta")))


TAIL = "t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) * exp(-z * z / 2) / 2.5066282746310002"


@query("a4_control_line", b.sql("events", then="le AS (SELECT min(z_max) AS z, 1 / (1 + 0.2316419 * min(z_max)) AS t FROM ev), ed AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin, unnest([1.0, 2.0, 4.0, 8.0, 16.0]) AS low)") + f"SELECT bin, {r(f'60 * {TAIL} / sqrt(low * low * 2)')} AS control FROM ed, le")
def a4_control(spark, sf_dir):
    return stats.control_rate(b.events(spark, sf_dir), [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]).select("bin", tidy("control").alias("control"))


@query("a9_effect_nested")
def a9_nested(spark, sf_dir):
    found = mixed.effect_nested(legged(spark, sf_dir), "halfwidth", "a", least=5, legs=["a", "b", "c"])
    return found.select("leg", *(tidy(c).alias(c) for c in ("coef", "se", "z", "p", "effect", "theta", "theta_outer")))


@query("t29_summarise_recording", b.sql("events", then="iv AS (SELECT roi, halfwidth, t0 - lag(t0) OVER (PARTITION BY roi ORDER BY t0, event_id) AS d FROM ev), ea AS (SELECT roi, quantile_cont(d, 0.5) AS d, quantile_cont(halfwidth, 0.5) AS h FROM iv GROUP BY roi HAVING count(*) >= 10)") + 'SELECT round(quantile_cont(d, 0.5), 6) AS "interval", round(quantile_cont(h, 0.5), 6) AS halfwidth, count(*) AS n_rois FROM ea')
def t29(spark, sf_dir):
    found = ev.intervals(b.events(spark, sf_dir), 10)
    return found.select(F.round("interval", 6).alias("interval"), F.round("halfwidth", 6).alias("halfwidth"), "n_rois")


@query("t35_trace_activity", b.sql("week", "legs_days", then=SLOW) + "SELECT roi, leg, round(sum(fast / greatest(slow, 1.0)) * 7 / max(leg_end - leg_begin), 3) + 0.0 AS activity FROM slow JOIN legs ON t > leg_begin AND t < leg_end GROUP BY 1, 2")
def t35(spark, sf_dir):
    return tr.trace_activity(z_table(spark, sf_dir), b.legs(spark, b.LEGS_DAYS), 7.0).select("roi", "leg", tidy("activity", 3).alias("activity"))


NUMBERED = "nu AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY t0) AS event_id FROM ex), wi AS (SELECT roi, event_id, CAST(round(t0 / 7) AS INTEGER) AS i0, CAST(greatest(5, floor(ceil(halfwidth / 7) / 5) * 5) AS INTEGER) AS wide FROM nu), wn AS (SELECT wi.roi, event_id, wide, slow.i - i0 + wide AS k, fast FROM wi JOIN slow ON slow.roi = wi.roi AND slow.i BETWEEN i0 - wide AND i0 + 4 * wide - 1)"


def windows_of(spark, sf_dir):
    z = z_table(spark, sf_dir)
    found = tr.excursions(z, 3.0, 7.0).withColumn("event_id", F.row_number().over(Window.partitionBy("roi").orderBy("t0")))
    return ev.event_windows(found, z, 7.0)


@query("e9_event_windows", b.sql("week", then=SLOW + ",\n" + RUNS + ",\n" + NUMBERED) + f"SELECT roi, event_id, k, {r('fast')} AS fast FROM wn")
def e9(spark, sf_dir):
    return windows_of(spark, sf_dir).select("roi", F.col("event_id").cast("long").alias("event_id"), F.col("k").cast("int").alias("k"), tidy("fast").alias("fast"))


@query("e10_event_shapes", b.sql("week", then=SLOW + ",\n" + RUNS + ",\n" + NUMBERED + ", u AS (SELECT wide, k, (fast - avg(fast) OVER w) / nullif(stddev_pop(fast) OVER w, 0) AS u FROM wn WINDOW w AS (PARTITION BY roi, event_id))") + f"SELECT wide, k, {r('avg(u)')} AS shape, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) >= 10")
def e10(spark, sf_dir):
    return ev.event_shapes(windows_of(spark, sf_dir), 10).select("wide", "k", tidy("shape").alias("shape"), "n")


@query("a16_predict_and_residual", b.sql("events", "legs", then=LEGGED) + f"SELECT event_id, {r('avg(log10(halfwidth)) OVER (PARTITION BY leg)')} AS fitted, {r('log10(halfwidth) - avg(log10(halfwidth)) OVER (PARTITION BY leg)')} AS residual FROM le WHERE leg IS NOT NULL")
def a16(spark, sf_dir):
    rows = stats.predict_and_residual(legged(spark, sf_dir).filter("leg is not null"), "halfwidth")
    return rows.select("event_id", tidy("fitted").alias("fitted"), tidy("residual").alias("residual"))


SHARE = "exp(-pow(ln(x), 2) / 0.5) / x / (exp(-0.125) / exp(-0.25))"


@query("e11_pulse_shape", b.sql("events", then="xx AS (SELECT event_id, k, height, (k * halfwidth / 4) / (halfwidth / 2) AS x FROM ev, (SELECT unnest([1, 2, 4, 8, 16]) AS k))") + f"SELECT event_id, k, {r(f'height * CASE WHEN {SHARE} < 0.01 THEN 0.0 ELSE {SHARE} END')} AS value FROM xx")
def e11(spark, sf_dir):
    rows = b.events(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16)))))
    t = F.col("t0") + F.col("k") * F.col("halfwidth") / 4
    return rows.select("event_id", "k", tidy(stats.pulse(t, F.col("t0"), F.col("height"), F.col("halfwidth") / 2)).alias("value"))
