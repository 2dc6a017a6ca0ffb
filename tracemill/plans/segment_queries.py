"""Queries of the operators that split and merge rois."""

from __future__ import annotations

from tracemill.functions.numbers import tidy
from tracemill.operators import frames as fr
from tracemill.operators import rois
from tracemill.operators import segments as sg
from tracemill.plans.frame_queries import BASINS, GEOMETRY, basins, geometry, image, px
from tracemill.plans.registry import query
from tracemill.plans.trace_queries import r
from tracemill.sources import bindings as b

SPLIT = BASINS + """,
ne4 AS (SELECT a.recording, a.roi, a.p AS a, c.p AS b FROM ba a JOIN ba c ON a.recording = c.recording AND a.roi = c.roi AND abs(a.y - c.y) + abs(a.x - c.x) <= 1),
wk(recording, roi, p, root) AS (SELECT recording, roi, p, p FROM ba UNION SELECT wk.recording, wk.roi, ne4.b, wk.root FROM wk JOIN ne4 ON ne4.recording = wk.recording AND ne4.roi = wk.roi AND ne4.a = wk.p),
pa AS (SELECT recording, roi, p, min(root) AS root FROM wk GROUP BY 1, 2, 3),
nm AS (SELECT pa.recording, pa.roi, root, CASE WHEN bool_or(pa.p = pa.roi) THEN any_value(pa.roi) ELSE arg_max(pa.p, (value, -pa.p)) END AS part FROM pa JOIN im ON im.recording = pa.recording AND im.y = pa.p // 2147483648 AND im.x = pa.p % 2147483648 GROUP BY 1, 2, 3)"""

NODES = """no AS (SELECT recording, roi, ey AS ny, ex AS nx FROM ed UNION SELECT recording, roi, CASE WHEN side = 'h' THEN ey ELSE ey + 1 END, CASE WHEN side = 'h' THEN ex + 1 ELSE ex END FROM ed)"""

TABLE = GEOMETRY + ", " + NODES + """,
ds AS (SELECT ad.recording, roi_i, roi_j, sqrt(pow(ny - 0.5 - peak_y, 2) + pow(nx - 0.5 - peak_x, 2)) AS d FROM ad JOIN su ON su.recording = ad.recording AND su.roi = roi_i JOIN no ON no.recording = ad.recording AND no.roi = roi_j),
dm AS (SELECT recording, roi_i, roi_j, min(d) AS distance FROM ds GROUP BY 1, 2, 3),
dn AS (SELECT dm.recording, dm.roi_i, dm.roi_j, any_value(distance) AS distance, count(*) AS n_nearest FROM dm JOIN ds ON ds.recording = dm.recording AND ds.roi_i = dm.roi_i AND ds.roi_j = dm.roi_j AND d = distance GROUP BY 1, 2, 3),
tc AS (SELECT px.recording, ba.roi, frame, avg(value) AS value FROM px JOIN ba ON ba.recording = px.recording AND ba.y = px.y AND ba.x = px.x GROUP BY 1, 2, 3),
st2 AS (SELECT recording, roi, frame, value - lag(value) OVER (PARTITION BY recording, roi ORDER BY frame) AS step FROM tc),
co AS (SELECT ad.recording, roi_i, roi_j, corr(a.step, c.step) AS step_corr FROM ad JOIN st2 a ON a.recording = ad.recording AND a.roi = roi_i JOIN st2 c ON c.recording = ad.recording AND c.roi = roi_j AND c.frame = a.frame WHERE a.step IS NOT NULL AND c.step IS NOT NULL GROUP BY 1, 2, 3)"""

BARRIER = GEOMETRY + """,
sh AS (SELECT a.recording, a.roi AS roi_i, c.roi AS roi_j, a.side, a.ey, a.ex, peak_y, peak_x, CASE WHEN a.side = 'h' THEN a.ey - 1 ELSE a.ey END AS fy, CASE WHEN a.side = 'h' THEN a.ex ELSE a.ex - 1 END AS fx FROM ed a JOIN ed c USING (recording, side, ey, ex) JOIN su ON su.recording = a.recording AND su.roi = a.roi WHERE a.roi <> c.roi),
nr AS (SELECT *, sqrt(pow((fy + ey) / 2 - peak_y, 2) + pow((fx + ex) / 2 - peak_x, 2)) AS distance FROM sh),
st3 AS (SELECT nr.recording, roi_i, roi_j, distance, o.value - i.value AS barrier FROM nr JOIN im i ON i.recording = nr.recording AND i.y = peak_y AND i.x = peak_x JOIN im o ON o.recording = nr.recording AND o.y = fy + ey - peak_y AND o.x = fx + ex - peak_x WHERE distance < 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording, roi_i, roi_j ORDER BY distance, barrier DESC) AS k FROM st3),
fi AS (SELECT *, row_number() OVER (PARTITION BY recording, roi_i ORDER BY distance, barrier, roi_j) AS k2 FROM rk WHERE k = 1)"""

CLOSE = GEOMETRY + """,
cd AS (SELECT ad.recording, roi_i, roi_j, a.size, sqrt(pow(a.peak_y - c.peak_y, 2) + pow(a.peak_x - c.peak_x, 2)) AS distance FROM ad JOIN su a ON a.recording = ad.recording AND a.roi = roi_i JOIN su c ON c.recording = ad.recording AND c.roi = roi_j),
cn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording, roi_i ORDER BY distance, roi_j) AS k FROM cd) WHERE k = 1),
cw AS (SELECT recording, count(*) AS n_rois, quantile_cont(size, 0.5) AS middle FROM su GROUP BY 1), cs AS (SELECT recording, count(*) AS n_proposed FROM cn GROUP BY 1)"""


@query("r3_split_unconnected", b.sql("pixels", then=SPLIT) + "SELECT pa.recording, CAST(part AS BIGINT) AS roi, CAST(p // 2147483648 AS INTEGER) AS y, CAST(p % 2147483648 AS INTEGER) AS x FROM pa JOIN nm USING (recording, roi, root)")
def r3(spark, sf_dir):
    return sg.split_unconnected(basins(spark, sf_dir), image(spark, sf_dir))


@query("r10_peak_boundary_trace_table", b.sql("pixels", then=TABLE) + f"SELECT dn.recording, dn.roi_i, dn.roi_j, {r('distance')} AS distance, n_nearest, a.size AS size_from, c.size AS size_to, round(step_corr, 3) + 0.0 AS step_corr FROM dn JOIN su a ON a.recording = dn.recording AND a.roi = dn.roi_i JOIN su c ON c.recording = dn.recording AND c.roi = dn.roi_j LEFT JOIN co ON co.recording = dn.recording AND co.roi_i = dn.roi_i AND co.roi_j = dn.roi_j")
def r10(spark, sf_dir):
    own, summary, edges, pairs = geometry(spark, sf_dir)
    found = sg.peak_boundary_trace_table(summary, rois.boundary_nodes(edges), pairs, rois.roi_traces(px(spark, sf_dir), own))
    return found.select("recording", "roi_i", "roi_j", tidy("distance").alias("distance"), "n_nearest", "size_from", "size_to", tidy("step_corr", 3).alias("step_corr"))


@query("r11_peak_edge_barrier", b.sql("pixels", then=BARRIER) + f"SELECT recording, roi_i, roi_j, {r('distance')} AS distance, round(barrier, 6) + 0.0 AS barrier FROM fi WHERE k2 = 1")
def r11(spark, sf_dir):
    _, summary, edges, _ = geometry(spark, sf_dir)
    found = sg.peak_edge_barrier(summary, edges, image(spark, sf_dir))
    return found.select("recording", "roi_i", "roi_j", tidy("distance").alias("distance"), tidy("barrier", 6).alias("barrier"))


@query("r16_propose_by_close_peaks", b.sql("pixels", then=CLOSE) + f"SELECT recording, roi_i, roi_j, {r('distance')} AS distance FROM cn JOIN cw USING (recording) JOIN cs USING (recording) WHERE 2 * n_proposed <= n_rois OR size < middle")
def r16(spark, sf_dir):
    _, summary, _, pairs = geometry(spark, sf_dir)
    return sg.propose_by_close_peaks(summary, pairs).select("recording", "roi_i", "roi_j", tidy("distance").alias("distance"))


@query("r14_merge_closest")
def r14(spark, sf_dir):
    """Without SQL, since it loops; tests/test_segments.py follows it by brute force."""
    return sg.merge_closest(basins(spark, sf_dir), image(spark, sf_dir), 0.5, 1.0)


@query("f22_count_saturated", b.sql("pixels", then=BASINS + """,
hv AS (SELECT recording, y, x, list_sort(list(abs(value))) AS v FROM px GROUP BY 1, 2, 3), hq AS (SELECT recording, y, x, v, (len(v) - 1) * greatest(1 - 3 / len(v), 0) AS q FROM hv),
rb AS (SELECT recording, y, x, v[CAST(floor(q) AS BIGINT) + 1] + (v[CAST(least(floor(q) + 1, len(v) - 1) AS BIGINT) + 1] - v[CAST(floor(q) AS BIGINT) + 1]) * (q - floor(q)) AS top FROM hq), mx AS (SELECT recording, max(top) AS most FROM rb GROUP BY 1)""") + "SELECT rb.recording, roi, count(*) FILTER (WHERE top = most) AS n_saturated, count(*) AS n_pixels FROM rb JOIN mx USING (recording) JOIN ba ON ba.recording = rb.recording AND ba.y = rb.y AND ba.x = rb.x GROUP BY 1, 2")
def f22(spark, sf_dir):
    return fr.count_saturated(px(spark, sf_dir), basins(spark, sf_dir))
