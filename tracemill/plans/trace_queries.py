"""Queries of the trace operators on weekly supplier volumes and on embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.numbers import rounded, sigma, tidy
from tracemill.operators import clusters as cl
from tracemill.operators import events as ev
from tracemill.operators import filters as fl
from tracemill.operators import linescans as ls
from tracemill.operators import stats
from tracemill.operators import traces as tr
from tracemill.plans.registry import query
from tracemill.sources import bindings as b

R = "round({}, 4) + 0.0"


def r(x: str) -> str:
    return R.format(x)


MIRROR = """nn AS (SELECT roi, count(*) AS n FROM tr GROUP BY roi),
mir AS (SELECT roi, i, i AS place, true AS inner_, {c} FROM {t} UNION ALL SELECT roi, i, -1 - i, false, {c} FROM {t} WHERE i < {d} UNION ALL SELECT roi, i, CAST(2 * n - 1 - i AS INTEGER), false, {c} FROM {t} JOIN nn USING (roi) WHERE i >= n - {d})"""

SLOW = MIRROR.format(c="t, value", t="tr", d=6) + """,
low AS (SELECT roi, i, t, value, inner_, quantile_cont(value, 0.1) OVER (PARTITION BY roi ORDER BY place ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS low FROM mir),
low1 AS (SELECT roi, i, t, value, low FROM low WHERE inner_),
mir2 AS (SELECT roi, i, i AS place, true AS inner_, t, value, low FROM low1 UNION ALL SELECT roi, i, -1 - i, false, t, value, low FROM low1 WHERE i < 6 UNION ALL SELECT roi, i, CAST(2 * n - 1 - i AS INTEGER), false, t, value, low FROM low1 JOIN nn USING (roi) WHERE i >= n - 6),
slow0 AS (SELECT roi, i, t, value, inner_, avg(low) OVER (PARTITION BY roi ORDER BY place ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS slow FROM mir2),
slow AS (SELECT roi, i, t, value, slow, value - slow AS fast, (value - slow) / sqrt(greatest(slow, 3.0)) AS z FROM slow0 WHERE inner_)"""


def z_table(spark, sf_dir):
    return tr.z_scores(tr.percentile_lowpass(b.traces_week(spark, sf_dir), 13, 0.1))


RUNS = """ab AS (SELECT *, z > 3 AS above, lag(z > 3) OVER (PARTITION BY roi ORDER BY i) AS before FROM slow),
rn AS (SELECT *, sum(CASE WHEN above AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY roi ORDER BY i) AS run FROM ab),
ex AS (SELECT roi, min(t) AS t0, max(t) + 7 AS tend, arg_max(t, (z, -i)) AS peakpoint, max(z) AS z_max, sum(fast / greatest(slow, 1.0)) * 7 AS auc, max(t) + 7 - min(t) AS halfwidth FROM rn WHERE above GROUP BY roi, run)"""


@query("f1_rebin", b.sql("week") + f"SELECT roi, CAST(i // 4 AS INTEGER) AS i, {r('avg(t)')} AS t, {r('avg(value)')} AS value FROM tr GROUP BY 1, 2 HAVING count(*) = 4")
def f1(spark, sf_dir):
    return tr.rebin(b.traces_week(spark, sf_dir), 4).select("roi", "i", tidy("t").alias("t"), tidy("value").alias("value"))


@query("t1_detrend", b.sql("week") + f"SELECT roi, i, {r('avg(value) OVER (PARTITION BY roi)')} AS trend, {r('value - avg(value) OVER (PARTITION BY roi)')} AS detrended FROM tr")
def t1(spark, sf_dir):
    return tr.demean(b.traces_week(spark, sf_dir)).select("roi", "i", tidy("trend").alias("trend"), tidy("detrended").alias("detrended"))


@query("t2_fit_bleaching", b.sql("week", then="rates AS (SELECT unnest([0.0001, 0.0003, 0.001, 0.003, 0.01, 0.03]::DOUBLE[]) AS rate), xs AS (SELECT roi, rate, value, exp(-rate * t) AS e FROM tr, rates), ft AS (SELECT roi, rate, regr_slope(value, e) AS c, regr_intercept(value, e) AS b, regr_syy(value, e) - pow(regr_sxy(value, e), 2) / regr_sxx(value, e) AS sse FROM xs GROUP BY roi, rate)") + "SELECT roi, rate, round(b, 2) + 0.0 AS b, round(c, 2) + 0.0 AS c FROM (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY sse, rate) AS k FROM ft) WHERE k = 1")
def t2(spark, sf_dir):
    return tr.bleaching(b.traces_week(spark, sf_dir), [0.0001, 0.0003, 0.001, 0.003, 0.01, 0.03]).select("roi", "rate", tidy("b", 2).alias("b"), tidy("c", 2).alias("c"))


@query("t5_prepare_filter", b.sql("week", then="sc AS (SELECT unnest([28.0, 112.0, 420.0]) AS ts), nb AS (SELECT ts, greatest(1, CAST(floor(ts / 7 / 5) AS INTEGER)) AS nr FROM sc)") + f"SELECT ts, roi, CAST(i // nr AS INTEGER) AS i, {r('avg(value)')} AS value FROM tr, nb GROUP BY ts, nr, roi, i // nr HAVING count(*) = nr")
def t5(spark, sf_dir):
    return fl.prepared(b.traces_week(spark, sf_dir), [28.0, 112.0, 420.0], 7.0, 5).select("ts", "roi", "i", tidy("value").alias("value"))


@query("t6_sigma", b.sql("week") + f"SELECT roi, i, {r('sqrt(greatest(value, 3.0))')} AS plain, {r('sqrt(1.5 * pow(greatest(value, 3.0), 0.9))')} AS fitted FROM tr")
def t6(spark, sf_dir):
    v = F.col("value")
    return b.traces_week(spark, sf_dir).select("roi", "i", tidy(sigma(v)).alias("plain"), tidy(sigma(v, 1.5, 0.9)).alias("fitted"))


@query("t9_running", b.sql("week", then=MIRROR.format(c="value", t="tr", d=4) + f""",
w AS (SELECT roi, i, inner_, avg(value) OVER q AS m, stddev_pop(value) OVER q AS s, min(value) OVER q AS lo, max(value) OVER q AS hi, quantile_cont(value, 0.3) OVER q AS p FROM mir WINDOW q AS (PARTITION BY roi ORDER BY place ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))""") + f"SELECT roi, i, {r('m')} AS run_mean, round(s, 3) + 0.0 AS run_std, lo AS run_min, hi AS run_max, {r('p')} AS run_p30 FROM w WHERE inner_")
def t9(spark, sf_dir):
    out = tr.running(b.traces_week(spark, sf_dir), 9, {"m": "avg", "s": "std", "run_min": "min", "run_max": "max", "p": 0.3})
    return out.select("roi", "i", tidy("m").alias("run_mean"), tidy("s", 3).alias("run_std"), "run_min", "run_max", tidy("p").alias("run_p30"))


@query("t10_running_mode", b.sql("week", then=MIRROR.format(c="value", t="tr", d=4) + """,
bn AS (SELECT roi, i, inner_, list(CAST(floor(value / 25) AS BIGINT)) OVER (PARTITION BY roi ORDER BY place ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS bins FROM mir),
ct AS (SELECT roi, i, bin, count(*) AS n FROM (SELECT roi, i, unnest(bins) AS bin FROM bn WHERE inner_) GROUP BY 1, 2, 3)""") + 'SELECT roi, i, (arg_max(bin, (n, -bin)) + 0.5) * 25.0 AS "mode" FROM ct GROUP BY roi, i')
def t10(spark, sf_dir):
    return tr.running_mode(b.traces_week(spark, sf_dir), 9, 25.0).select("roi", "i", "mode")


@query("t11_percentile_lowpass", b.sql("week", then=SLOW) + f"SELECT roi, i, {r('slow')} AS slow, {r('fast')} AS fast, {r('z')} AS z FROM slow")
def t11(spark, sf_dir):
    return z_table(spark, sf_dir).select("roi", "i", *(tidy(c).alias(c) for c in ("slow", "fast", "z")))


@query("t14_infer_gain", b.sql("week", then=SLOW + """,
vr AS (SELECT roi, i, slow, var_pop(fast) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) / slow AS ratio FROM slow),
r0 AS (SELECT ratio FROM vr WHERE i % 5 = 0 AND slow > 0), r1 AS (SELECT ratio FROM r0 WHERE ratio <= 10 * (SELECT avg(ratio) FROM r0)), r2 AS (SELECT ratio FROM r1 WHERE ratio <= 10 * (SELECT avg(ratio) FROM r1))""") + f"SELECT round(avg(ratio), 3) AS gain, count(*) AS n FROM r2")
def t14(spark, sf_dir):
    return tr.gain(tr.mean_variance_points(z_table(spark, sf_dir), 10, 5), rounds=2).select(F.round("gain", 3).alias("gain"), "n")


@query("t23_mean_variance_points", b.sql("week", then=SLOW) + "SELECT roi, i, round(slow, 4) + 0.0 AS mean, round(variance, 2) + 0.0 AS variance FROM (SELECT roi, i, slow, var_pop(fast) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS variance FROM slow) WHERE i % 5 = 0 AND slow > 0")
def t23(spark, sf_dir):
    return tr.mean_variance_points(z_table(spark, sf_dir), 10, 5).select("roi", "i", tidy("mean").alias("mean"), tidy("variance", 2).alias("variance"))


@query("t13_fit_mean_variance", b.sql("week", then=SLOW + """,
pt AS (SELECT * FROM (SELECT roi, i, slow AS mean, var_pop(fast) OVER (PARTITION BY roi ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS variance FROM slow) WHERE i % 5 = 0 AND mean > 0 AND variance > 0),
lg AS (SELECT mean, variance, ln(mean) AS lx FROM pt), en AS (SELECT quantile_cont(lx, 0.01) AS low, quantile_cont(lx, 0.99) AS high FROM lg),
bi AS (SELECT floor((lx - low) / (high - low) * 20) AS bin, avg(mean) AS mx, quantile_cont(variance, 0.5) AS my, count(*) AS n FROM lg, en WHERE lx >= low AND lx < high GROUP BY 1 HAVING count(*) > 10)""") + "SELECT round(regr_slope(ln(my), ln(mx)), 3) + 0.0 AS exponent, round(exp(regr_intercept(ln(my), ln(mx))), 1) AS factor FROM bi")
def t13(spark, sf_dir):
    return tr.two_parameter_fit(tr.mean_variance_points(z_table(spark, sf_dir), 10, 5)).select(tidy("exponent", 3).alias("exponent"), F.round("factor", 1).alias("factor"))


@query("t15_fill_gaps", b.sql("week", then="""g1 AS (SELECT roi, i, t, CASE WHEN i % 60 BETWEEN 20 AND 25 THEN 0.0 ELSE value + 1 END AS value FROM tr),
ze AS (SELECT i, bool_and(value = 0) AS zero FROM g1 GROUP BY i), st AS (SELECT i, zero, CASE WHEN zero AND NOT coalesce(lag(zero) OVER (ORDER BY i), false) THEN 1 ELSE 0 END AS s FROM ze),
ga AS (SELECT gap, min(i) AS g0, max(i) AS g1 FROM (SELECT i, zero, sum(s) OVER (ORDER BY i) AS gap FROM st) WHERE zero GROUP BY gap),
sd AS (SELECT roi, g0, ga.g1 AS g1, avg(CASE WHEN i < g0 AND i >= g0 - 2 THEN value END) AS before, avg(CASE WHEN i > ga.g1 AND i <= ga.g1 + 2 THEN value END) AS after FROM g1 JOIN ga ON i >= g0 - 2 AND i <= ga.g1 + 2 GROUP BY roi, g0, ga.g1)""")
    + f"SELECT g1.roi, g1.i, {r('coalesce(coalesce(before, after) + (coalesce(after, before) - coalesce(before, after)) * (g1.i - g0 + 1) / (sd.g1 - g0 + 2), value)')} AS value, value AS raw FROM g1 LEFT JOIN sd ON g1.roi = sd.roi AND g1.i >= g0 AND g1.i < sd.g1")
def t15(spark, sf_dir):
    rows = b.traces_week(spark, sf_dir).withColumn("value", F.when((F.col("i") % 60).between(20, 25), 0.0).otherwise(F.col("value") + 1))
    return tr.fill_gaps(rows, 2).select("roi", "i", tidy("value").alias("value"), "raw")


@query("t16_resample", b.sql("week", then="""pa AS (SELECT roi, i, value, unnest(generate_series(CAST(floor(i / 2.5) AS BIGINT), CAST(ceil((i + 1) / 2.5) - 1 AS BIGINT))) AS k FROM tr),
ov AS (SELECT roi, k, value, least(i + 1.0, (k + 1) * 2.5) - greatest(i * 1.0, k * 2.5) AS o FROM pa)""") + f"SELECT roi, CAST(k AS INTEGER) AS i, {r('sum(value * o) / sum(o) / 0.4')} AS value FROM ov WHERE o > 0 GROUP BY roi, k HAVING sum(o) > 2.5 - 1e-9")
def t16(spark, sf_dir):
    return tr.resample(b.traces_week(spark, sf_dir), 0.4).select("roi", "i", tidy("value").alias("value"))


@query("t17_fov_trace", b.sql("week", then="fv AS (SELECT i, avg(t) AS t, sum(value * (roi % 5 + 1)) / sum(roi % 5 + 1) AS value FROM tr GROUP BY i)") + f"SELECT CAST(i // 2 AS INTEGER) AS i, {r('avg(value)')} AS value FROM fv GROUP BY 1 HAVING count(*) = 2")
def t17(spark, sf_dir):
    return tr.rebin(tr.weighted_mean_trace(b.traces_week(spark, sf_dir), F.col("roi") % 5 + 1), 2, ()).select("i", tidy("value").alias("value"))


@query("t18_show_traces", b.sql("week", then=SLOW + """,
bb AS (SELECT roi, CAST(i // 4 AS INTEGER) AS i, avg(z) * 2 AS value FROM slow GROUP BY 1, 2 HAVING count(*) = 4),
sb AS (SELECT roi, quantile_cont(value, 0.5) AS middle, stddev_pop(value) AS s FROM bb GROUP BY roi), sh AS (SELECT roi, middle, sum(s * 5) OVER (ORDER BY roi) AS shift FROM sb)""") + "SELECT roi, i, round(value - middle + shift, 3) + 0.0 AS value FROM bb JOIN sh USING (roi)")
def t18(spark, sf_dir):
    rows = z_table(spark, sf_dir).withColumn("value", F.col("z"))
    return tr.shown(rows, 4, 5.0).select("roi", "i", tidy("value", 3).alias("value"))


@query("t19_power_spectrum", b.sql("emb", then="""fq AS (SELECT unnest([0, 1, 2, 3, 5, 8, 16, 32]) AS k),
on_ AS (SELECT recording, roi, k, sum(value * cos(-2 * 3.141592653589793::DOUBLE * k * i / 64)) AS re, sum(value * sin(-2 * 3.141592653589793::DOUBLE * k * i / 64)) AS im FROM tr, fq GROUP BY 1, 2, 3)""") + f"SELECT recording, k, {r('sqrt(pow(avg(re), 2) + pow(avg(im), 2))')} AS magnitude FROM on_ GROUP BY recording, k")
def t19(spark, sf_dir):
    return tr.power_spectrum(b.traces_emb(spark, sf_dir), [0, 1, 2, 3, 5, 8, 16, 32], 64).select("recording", "k", tidy("magnitude").alias("magnitude"))


@query("t20_autocorrelation", b.sql("week", then="lg AS (SELECT unnest([0, 1, 2, 4, 8]) AS lag)") + f"SELECT a.roi, lag, CASE WHEN lag = 0 THEN 1.0 ELSE {r('corr(a.value, c.value)')} END AS r FROM tr a, lg, tr c WHERE c.roi = a.roi AND c.i = a.i + lag GROUP BY a.roi, lag")
def t20(spark, sf_dir):
    return tr.autocorrelation(b.traces_week(spark, sf_dir), [0, 1, 2, 4, 8]).select("roi", "lag", tidy("r").alias("r"))


@query("t21_moving", b.sql("week") + f"SELECT roi, i, moving_sum, {r('moving_average')} AS moving_average FROM (SELECT roi, i, sum(value) OVER q AS moving_sum, avg(value) OVER q AS moving_average, count(*) OVER q AS n FROM tr WINDOW q AS (PARTITION BY roi ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) WHERE n = 7")
def t21(spark, sf_dir):
    return tr.trailing(b.traces_week(spark, sf_dir), 7).select("roi", "i", "moving_sum", tidy("moving_average").alias("moving_average"))


@query("t22_autocorrelation_2d", b.sql("pixels") + f"SELECT a.recording, dy, dx, {r('corr(a.value, c.value)')} AS r FROM px a, (SELECT unnest([0, 1, 2]) AS dy) d1, (SELECT unnest([0, 1, 2]) AS dx) d2, px c WHERE c.recording = a.recording AND c.frame = a.frame AND c.y = a.y + dy AND c.x = a.x + dx GROUP BY 1, 2, 3")
def t22(spark, sf_dir):
    return ls.autocorrelation_2d(b.pixels(spark, sf_dir), [0, 1, 2], [0, 1, 2]).select("recording", "dy", "dx", tidy("r").alias("r"))


@query("t24_activity", b.sql("week", then=SLOW) + f"SELECT roi, {r('avg(CASE WHEN z > 3 THEN 1.0 ELSE 0.0 END)')} AS activity FROM slow WHERE t > 140 AND t < 2380 GROUP BY roi")
def t24(spark, sf_dir):
    return tr.activity(z_table(spark, sf_dir), 3.0, 140.0, 2380.0).select("roi", tidy("activity").alias("activity"))


@query("t25_raster", b.sql("week", then=SLOW + """,
mz AS (SELECT roi, i, i AS place, true AS inner_, z FROM slow UNION ALL SELECT roi, i, -1 - i, false, z FROM slow WHERE i < 1 UNION ALL SELECT roi, i, CAST(2 * n - 1 - i AS INTEGER), false, z FROM slow JOIN nn USING (roi) WHERE i >= n - 1)""") + "SELECT roi, i FROM (SELECT roi, i, inner_, avg(z) OVER (PARTITION BY roi ORDER BY place ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS zs FROM mz) WHERE inner_ AND zs > 3")
def t25(spark, sf_dir):
    return tr.raster(z_table(spark, sf_dir), 3.0, 1).filter("on").select("roi", "i")


@query("t27_correlation_to_sum", b.sql("week") + f"SELECT roi, {r('corr(value, total)')} AS r FROM (SELECT roi, value, sum(value) OVER (PARTITION BY i) AS total FROM tr) GROUP BY roi")
def t27(spark, sf_dir):
    return tr.correlation_to_sum(b.traces_week(spark, sf_dir), ()).select("roi", tidy("r").alias("r"))


@query("t27_correlation_matrix", b.sql("emb") + f"SELECT a.recording, a.roi AS roi_a, c.roi AS roi_b, {r('corr(a.value, c.value)')} AS r FROM tr a JOIN tr c ON a.recording = c.recording AND a.i = c.i AND a.roi < c.roi GROUP BY 1, 2, 3")
def t27m(spark, sf_dir):
    return cl.correlation_matrix(b.traces_emb(spark, sf_dir)).select("recording", "roi_a", "roi_b", rounded("r").alias("r"))


@query("t28_most_representative", b.sql("week", then="""c0 AS (SELECT roi, i, value, sum(value) OVER (PARTITION BY i) AS total FROM tr), sc AS (SELECT roi, round(corr(value, total), 9) AS r, round(avg(value), 9) AS m FROM c0 GROUP BY roi),
rk AS (SELECT roi, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 + rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rank_sum FROM sc)""") + "SELECT roi, CAST(rank_sum AS DOUBLE) AS rank_sum FROM rk ORDER BY rank_sum DESC, roi LIMIT 3")
def t28(spark, sf_dir):
    rows = b.traces_week(spark, sf_dir)
    scores = tr.correlation_to_sum(rows, ()).select("roi", F.round("r", 9).alias("r")).join(rows.groupBy("roi").agg(F.round(F.avg("value"), 9).alias("m")), "roi")
    return tr.most_representative(scores, ["r", "m"], 3, ()).select("roi", "rank_sum")


@query("t30_rescale_soft", b.sql("week", then=SLOW + ", sp AS (SELECT quantile_cont(s, 0.5) AS scale FROM (SELECT roi, stddev_pop(z) AS s FROM slow GROUP BY roi))") + "SELECT roi, i, round(z / scale, 3) + 0.0 AS z FROM slow, sp")
def t30(spark, sf_dir):
    return tr.rescale(z_table(spark, sf_dir).withColumn("recording", F.lit(0)), "soft").select("roi", "i", tidy("z", 3).alias("z"))


@query("t30_rescale_hard", b.sql("week", then=SLOW + ", md AS (SELECT roi, quantile_cont(z, 0.5) AS m FROM slow GROUP BY roi), ma AS (SELECT roi, 1.4826 * quantile_cont(abs(z - m), 0.5) AS scale FROM slow JOIN md USING (roi) GROUP BY roi)") + "SELECT roi, i, round(z / scale, 3) + 0.0 AS z FROM slow JOIN ma USING (roi)")
def t30h(spark, sf_dir):
    return tr.rescale(z_table(spark, sf_dir), "hard", ()).select("roi", "i", tidy("z", 3).alias("z"))


@query("t36_first_run", b.sql("week", then="ok AS (SELECT roi, i, i - row_number() OVER (PARTITION BY roi ORDER BY i) AS run FROM tr WHERE value > 20), rr AS (SELECT roi, run, min(i) AS first, count(*) AS n FROM ok GROUP BY 1, 2)") + 'SELECT roi, min(first) AS "first" FROM rr WHERE n >= 3 GROUP BY roi')
def t36(spark, sf_dir):
    return tr.first_run(b.traces_week(spark, sf_dir), F.col("value") > 20, 3)


@query("t37_sum_trace", b.sql("week", then="dm AS (SELECT roi, i, value - avg(value) OVER (PARTITION BY roi) AS d FROM tr), sm AS (SELECT i, sum(d) AS value FROM dm GROUP BY i)") + "SELECT CAST(i // 2 AS INTEGER) AS i, round(avg(value), 3) + 0.0 AS value FROM sm GROUP BY 1 HAVING count(*) = 2")
def t37(spark, sf_dir):
    return tr.sum_trace(b.traces_week(spark, sf_dir), 2).select("i", tidy("value", 3).alias("value"))


@query("e1_excursions", b.sql("week", then=SLOW + ",\n" + RUNS) + f"SELECT roi, t0, tend, peakpoint, halfwidth, {r('z_max')} AS z_max, round(auc, 3) AS auc FROM ex")
def e1(spark, sf_dir):
    return tr.excursions(z_table(spark, sf_dir), 3.0, 7.0).select("roi", "t0", "tend", "peakpoint", "halfwidth", tidy("z_max").alias("z_max"), F.round("auc", 3).alias("auc"))


@query("flagship", b.sql("week", "legs_days", then=SLOW + ",\n" + RUNS + """,
lg AS (SELECT ex.*, leg FROM ex LEFT JOIN legs ON peakpoint > leg_begin AND peakpoint < leg_end),
du AS (SELECT leg, max(peakpoint) - min(peakpoint) AS duration FROM lg WHERE leg IS NOT NULL GROUP BY leg), ac AS (SELECT roi FROM ex GROUP BY roi HAVING count(*) > 2)""") + f"SELECT leg, count(*) AS n, {r('count(*) / (SELECT count(*) FROM ac) / max(duration) * 60')} AS rate FROM lg JOIN du USING (leg) WHERE roi IN (SELECT roi FROM ac) GROUP BY leg")
def flagship(spark, sf_dir):
    """How many excursions has each source per unit time, by leg?"""
    found = ev.define_legs(tr.excursions(z_table(spark, sf_dir), 3.0, 7.0), b.legs(spark, b.LEGS_DAYS))
    active = stats.active_rois(found, 2)
    n_active = active.agg(F.count(F.lit(1)).alias("n_active"))
    counts = found.filter("leg is not null").join(active, "roi", "left_semi").groupBy("leg").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(stats.leg_durations(found), "leg").crossJoin(F.broadcast(n_active)).select("leg", "n", tidy(F.col("n") / F.col("n_active") / F.col("duration") * 60).alias("rate"))


#: Plain complete linkage: in each step the nearest pair of a recording merges, pairs of equal distance by their names.
LINKS = """ds AS (SELECT a.recording, a.roi AS a, c.roi AS b, round(1 - corr(a.value, c.value), 9) AS d FROM tr a JOIN tr c ON a.recording = c.recording AND a.i = c.i AND a.roi < c.roi GROUP BY 1, 2, 3),
cl AS (SELECT 0 AS step, * FROM ds UNION ALL SELECT step, recording, least(x, y), greatest(x, y), max(d) FROM (
  SELECT step + 1 AS step, recording, d, CASE WHEN a = mb THEN ma ELSE a END AS x, CASE WHEN b = mb THEN ma ELSE b END AS y FROM (
    SELECT *, first_value(a) OVER w AS ma, first_value(b) OVER w AS mb FROM cl WINDOW w AS (PARTITION BY recording ORDER BY d, a, b))) WHERE x != y GROUP BY step, recording, least(x, y), greatest(x, y)),
mg AS (SELECT recording, a, b, d AS height FROM cl QUALIFY row_number() OVER (PARTITION BY recording, step ORDER BY d, a, b) = 1)"""
CUT = 4


def linked(spark, sf_dir):
    return cl.trace_linkage(b.traces_emb(spark, sf_dir), digits=9)


@query("t33_cluster_traces", b.sql("emb", then=LINKS) + f"SELECT recording, a, b, {r('height')} AS height FROM mg")
def t33(spark, sf_dir):
    return linked(spark, sf_dir).select("recording", "a", "b", tidy("height").alias("height"))


@query("t33_cut_clusters", b.sql("emb", then=LINKS + f""", le AS (SELECT recording, height AS least FROM (SELECT mg.recording, height, row_number() OVER (PARTITION BY mg.recording ORDER BY height, a, b) AS place, n FROM mg JOIN (SELECT recording, count(DISTINCT roi) AS n FROM tr GROUP BY 1) USING (recording)) WHERE place = n - {CUT}),
kp AS (SELECT recording, a, b FROM mg JOIN le USING (recording) WHERE height <= least),
up AS (SELECT DISTINCT recording, roi, roi AS name FROM tr UNION ALL SELECT up.recording, up.roi, kp.a FROM up JOIN kp ON kp.recording = up.recording AND kp.b = up.name)""") + "SELECT recording, roi, min(name) AS cluster FROM up GROUP BY 1, 2")
def t33_cut(spark, sf_dir):
    rois = b.traces_emb(spark, sf_dir).select("recording", "roi").distinct()
    return cl.cut_tree(linked(spark, sf_dir), rois, count=CUT)


@query("t20_autocorrelation_splits", b.sql("week", then="nn AS (SELECT roi, count(*) AS n FROM tr GROUP BY roi), sp AS (SELECT roi, i, value, ((i + 1) * 3 - 1) // n AS s FROM tr JOIN nn USING (roi)), co AS (SELECT a.roi, a.s, lag, CASE WHEN lag = 0 THEN 1.0 ELSE corr(a.value, c.value) END AS r FROM sp a, (SELECT unnest([0, 1, 4]) AS lag), sp c WHERE c.roi = a.roi AND c.s = a.s AND c.i = a.i + lag GROUP BY a.roi, a.s, lag)") + f"SELECT roi, CAST(lag AS INTEGER) AS lag, {r('avg(r)')} AS r, {r('stddev_pop(r)')} AS r_std FROM co GROUP BY roi, lag")
def t20_splits(spark, sf_dir):
    return tr.autocorrelation(b.traces_week(spark, sf_dir), [0, 1, 4], splits=3).select("roi", "lag", tidy("r").alias("r"), tidy("r_std").alias("r_std"))
