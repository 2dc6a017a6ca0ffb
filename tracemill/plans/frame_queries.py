"""Queries of the frame and roi operators on embedding vectors seen as 8 x 8 frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.numbers import tidy
from tracemill.operators import frames as fr
from tracemill.operators import rois
from tracemill.plans.registry import query
from tracemill.plans.trace_queries import r
from tracemill.sources import bindings as b

PX = ["recording", "frame", "y", "x"]


def px(spark, sf_dir):
    return b.pixels(spark, sf_dir)


def out(df, *keys, digits=4):
    return df.select(*keys, *(tidy(c, digits).alias(c) for c in df.columns if c not in keys))


@query("f1_rebin_space", b.sql("pixels") + f"SELECT recording, frame, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, {r('avg(value)')} AS value FROM px GROUP BY 1, 2, 3, 4")
def f1s(spark, sf_dir):
    return out(fr.rebin_space(px(spark, sf_dir), 2), *PX)


@query("f2_resize_time", b.sql("pixels", then="pa AS (SELECT *, unnest(generate_series(CAST(floor(frame / 2.5) AS BIGINT), CAST(ceil((frame + 1) / 2.5) - 1 AS BIGINT))) AS k FROM px), ov AS (SELECT *, least(frame + 1.0, (k + 1) * 2.5) - greatest(frame * 1.0, k * 2.5) AS o FROM pa)") + f"SELECT recording, k AS frame, y, x, {r('sum(value * o) / sum(o)')} AS value FROM ov WHERE o > 0 GROUP BY 1, 2, 3, 4 HAVING sum(o) > 2.5 - 1e-9")
def f2(spark, sf_dir):
    return out(fr.resize_time(px(spark, sf_dir), 0.4), *PX)


@query("f3_crop", b.sql("pixels") + f"SELECT recording, frame, y, x, {r('value')} AS value FROM px WHERE y >= 2 AND y < 6 AND x >= 1 AND x < 7 AND frame >= 5 AND frame < 25")
def f3(spark, sf_dir):
    return out(fr.crop(px(spark, sf_dir), (2, 6), (1, 7), (5, 25)), *PX)


BLUR = "wt AS (SELECT unnest([-1, 0, 1]) AS d, unnest([0.25, 0.5, 0.25]::DOUBLE[]) AS w), b1 AS (SELECT a.recording, a.frame, a.y, a.x, sum(c.value * w) AS value FROM {src} a, wt, {src} c WHERE c.recording = a.recording AND c.frame = a.frame AND c.y = least(greatest(a.y + d, 0), 7) AND c.x = a.x GROUP BY 1, 2, 3, 4), bl AS (SELECT a.recording, a.frame, a.y, a.x, sum(c.value * w) AS value FROM b1 a, wt, b1 c WHERE c.recording = a.recording AND c.frame = a.frame AND c.y = a.y AND c.x = least(greatest(a.x + d, 0), 7) GROUP BY 1, 2, 3, 4)"


@query("f4_gaussian_blur", b.sql("pixels", then=BLUR.format(src="px")) + f"SELECT recording, frame, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {r('value')} AS value FROM bl")
def f4(spark, sf_dir):
    w = [0.25, 0.5, 0.25]
    blurred = fr.blur(fr.blur(px(spark, sf_dir), "y", w, 0, 7), "x", w, 0, 7)
    return out(blurred.select("recording", "frame", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value"), *PX)


@query("f6_bin_median", b.sql("pixels", then="bm AS (SELECT recording, y, x, frame % 7 AS bin, avg(value) AS m FROM px GROUP BY 1, 2, 3, 4)") + f"SELECT recording, y, x, {r('quantile_cont(m, 0.5)')} AS value FROM bm GROUP BY 1, 2, 3")
def f6(spark, sf_dir):
    return out(fr.bin_median(px(spark, sf_dir), 7), "recording", "y", "x")


@query("f7_debleach_movie", b.sql("pixels", then="md AS (SELECT recording, frame, quantile_cont(value, 0.5) AS m FROM px GROUP BY 1, 2), ln AS (SELECT recording, regr_slope(m, frame) AS a, avg(frame) AS mid FROM md GROUP BY 1)") + f"SELECT recording, frame, y, x, {r('value - a * (frame - mid)')} AS value FROM px JOIN ln USING (recording)")
def f7(spark, sf_dir):
    return out(fr.debleach(px(spark, sf_dir), ()), *PX)


STATS = """nf AS (SELECT recording, count(DISTINCT frame) AS n FROM px GROUP BY 1), sp AS (SELECT *, value - lag(value) OVER (PARTITION BY recording, y, x ORDER BY frame) AS step FROM px),
si AS (SELECT recording, y, x, avg(value) AS mean, stddev_pop(value) AS std, stddev_pop(step) AS diff_std, list_sort(list(value)) AS v FROM sp GROUP BY 1, 2, 3),
sq AS (SELECT si.*, (len(v) - 1) * greatest(1 - 10 / n, 0) AS pt_ FROM si JOIN nf USING (recording)),
im AS (SELECT recording, y, x, mean, std, diff_std, v[CAST(floor(pt_) AS BIGINT) + 1] + (v[CAST(least(floor(pt_) + 1, len(v) - 1) AS BIGINT) + 1] - v[CAST(floor(pt_) AS BIGINT) + 1]) * (pt_ - floor(pt_)) AS highperc FROM sq)"""


@query("f8_stat_images", b.sql("pixels", then=STATS) + f"SELECT recording, y, x, {r('mean')} AS mean, {r('std')} AS std, {r('diff_std')} AS diff_std, {r('highperc')} AS highperc FROM im")
def f8(spark, sf_dir):
    return out(fr.stat_images(px(spark, sf_dir)), "recording", "y", "x")


@query("f9_robust_max", b.sql("pixels", then="rv AS (SELECT recording, list_sort(list(abs(value))) AS v FROM px GROUP BY 1), ra AS (SELECT recording, v, (len(v) - 1) * greatest(1 - 10 / len(v), 0) AS pt_ FROM rv)") + f"SELECT recording, {r('v[CAST(floor(pt_) AS BIGINT) + 1] + (v[CAST(least(floor(pt_) + 1, len(v) - 1) AS BIGINT) + 1] - v[CAST(floor(pt_) AS BIGINT) + 1]) * (pt_ - floor(pt_))')} AS robust_max FROM ra")
def f9(spark, sf_dir):
    return out(fr.robust_max(px(spark, sf_dir), "value"), "recording")


COMPOSITE = STATS + """,
r0 AS (SELECT recording, list_sort(list(abs(mean))) AS vm, list_sort(list(abs(highperc))) AS vh, 63 * greatest(1 - 10 / 64, 0) AS pt_ FROM im GROUP BY 1),
rm AS (SELECT recording, vm[CAST(floor(pt_) AS BIGINT) + 1] + (vm[CAST(floor(pt_) AS BIGINT) + 2] - vm[CAST(floor(pt_) AS BIGINT) + 1]) * (pt_ - floor(pt_)) AS a, vh[CAST(floor(pt_) AS BIGINT) + 1] + (vh[CAST(floor(pt_) AS BIGINT) + 2] - vh[CAST(floor(pt_) AS BIGINT) + 1]) * (pt_ - floor(pt_)) AS b FROM r0),
co AS (SELECT recording, y, x, (mean / a + highperc / b) / 2 * ((a + b) / 2) AS value FROM im JOIN rm USING (recording))"""


def composite(spark, sf_dir):
    return fr.composite(fr.stat_images(px(spark, sf_dir)), ["mean", "highperc"])


@query("f10_composite_image", b.sql("pixels", then=COMPOSITE) + f"SELECT recording, y, x, {r('value')} AS value FROM co")
def f10(spark, sf_dir):
    return out(composite(spark, sf_dir), "recording", "y", "x")


@query("f12_valid_mask", b.sql("pixels", then=COMPOSITE + ", mk AS (SELECT recording, y, x FROM (SELECT *, max(value) OVER (PARTITION BY recording) AS top FROM co) WHERE value > 0.9 * top), di AS (SELECT recording, y + dy AS y, x + dx AS x FROM mk, (SELECT unnest([-1, 0, 0, 0, 1]) AS dy, unnest([0, -1, 0, 1, 0]) AS dx))") + "SELECT DISTINCT recording, y, x FROM di WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7")
def f12(spark, sf_dir):
    return fr.dilate(fr.threshold_mask(composite(spark, sf_dir), 0.9), 1, 0, 7)


@query("f20_subset_frames", b.sql("pixels", then="ev2 AS (SELECT * FROM px WHERE frame % 2 = 0), tp AS (SELECT *, max(value) OVER (PARTITION BY recording) AS top FROM ev2)") + "SELECT recording, CAST(frame // 2 AS BIGINT) AS frame, y, x, CAST(floor(greatest(value, 0.0) / (2 * top) * 65535) AS INTEGER) AS value FROM tp")
def f20(spark, sf_dir):
    return fr.subset_frames(px(spark, sf_dir), 2, 65535)


MASK = "mk AS (SELECT recording, frame, y, x FROM px WHERE value > 0.25)"


@query("f24_event_bounds", b.sql("pixels", then=MASK + """, nb AS (SELECT *, (CAST(recording AS BIGINT) * 1000000 + frame) * 16777216 + y * 4096 + x AS id FROM mk),
eg AS (SELECT a.id AS a, c.id AS b FROM nb a JOIN nb c ON a.recording = c.recording AND abs(a.frame - c.frame) <= 1 AND abs(a.y - c.y) <= 1 AND abs(a.x - c.x) <= 1),
cc(node, root) AS (SELECT a, a FROM eg UNION SELECT eg.b, cc.root FROM cc JOIN eg ON eg.a = cc.node), ro AS (SELECT node, min(root) AS event FROM cc GROUP BY node)""") + "SELECT recording, event, min(frame) AS frame_begin, max(frame) + 1 AS frame_end, min(y) AS y_begin, max(y) + 1 AS y_end, min(x) AS x_begin, max(x) + 1 AS x_end, count(*) AS n FROM nb JOIN ro ON id = node GROUP BY 1, 2")
def f24(spark, sf_dir):
    mask = px(spark, sf_dir).filter("value > 0.25").drop("value")
    found = fr.event_bounds(fr.connected_events(mask))
    number = (F.col("recording").cast("long") * 1_000_000 + F.col("event.frame")) * 16_777_216 + F.col("event.y") * 4096 + F.col("event.x")
    return found.withColumn("event", number)


@query("m14_check_still_movie", b.sql("pixels", then="fn AS (SELECT *, max(frame) OVER (PARTITION BY recording) + 1 AS n FROM px)") + f"SELECT recording, round(stddev_pop(value) / abs(avg(value)), 2) AS contrast FROM fn WHERE frame % greatest(n // 10, 1) = 0 GROUP BY 1")
def m14(spark, sf_dir):
    return fr.still_movie(px(spark, sf_dir)).select("recording", F.round("contrast", 2).alias("contrast"))


@query("f13_estimate_shifts", b.sql("pixels", then="""te AS (SELECT recording, y, x, avg(value) AS g FROM px GROUP BY 1, 2, 3),
of AS (SELECT dy, dx FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS dy), (SELECT unnest([-2, -1, 0, 1, 2]) AS dx)),
sc AS (SELECT p1.recording, frame, dy, dx, round(sum(value * g) / sqrt(sum(value * value) * sum(g * g)), 9) AS s FROM te, of, px p1 WHERE te.y BETWEEN 2 AND 5 AND te.x BETWEEN 2 AND 5 AND p1.recording = te.recording AND p1.y = te.y + dy AND p1.x = te.x + dx GROUP BY 1, 2, 3, 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording, frame ORDER BY s DESC, abs(dy) + abs(dx), dy DESC, dx DESC) AS k FROM sc)""") + f"SELECT recording, frame, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, {r('s')} AS score FROM rk WHERE k = 1")
def f13(spark, sf_dir):
    pixels = px(spark, sf_dir)
    template = pixels.groupBy("recording", "y", "x").agg(F.avg("value").alias("value"))
    return out(fr.estimate_shifts(pixels, template, 2, (2, 5)), "recording", "frame", "dy", "dx")


def image(spark, sf_dir):
    return px(spark, sf_dir).groupBy("recording", "y", "x").agg(F.round(F.avg("value"), 9).alias("value"))


BASINS = """im AS (SELECT recording, y, x, round(avg(value), 9) AS value FROM px GROUP BY 1, 2, 3),
st AS (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dx, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS rk),
ne AS (SELECT a.recording, a.y, a.x, a.value AS own, c.value AS v, c.y AS ny, c.x AS nx, row_number() OVER (PARTITION BY a.recording, a.y, a.x ORDER BY c.value DESC, rk) AS k FROM im a, st, im c WHERE c.recording = a.recording AND c.y = a.y + dy AND c.x = a.x + dx),
cl AS (SELECT recording, CAST(y * 2147483648 + x AS BIGINT) AS p, CASE WHEN v > own THEN ny * 2147483648 + nx ELSE y * 2147483648 + x END AS up FROM ne WHERE k = 1),
wa(recording, p, pt_) AS (SELECT recording, p, up FROM cl UNION SELECT wa.recording, wa.p, cl.up FROM wa JOIN cl ON cl.recording = wa.recording AND cl.p = wa.pt_),
ba AS (SELECT wa.recording, wa.p, CAST(pt_ AS BIGINT) AS roi, CAST(wa.p // 2147483648 AS INTEGER) AS y, CAST(wa.p % 2147483648 AS INTEGER) AS x FROM wa JOIN cl ON cl.recording = wa.recording AND cl.p = wa.pt_ AND cl.up = cl.p)"""

SUMMARY = BASINS + """,
su AS (SELECT recording, roi, count(*) AS size, avg(y) AS cy, avg(x) AS cx, CAST(roi // 2147483648 AS INTEGER) AS peak_y, CAST(roi % 2147483648 AS INTEGER) AS peak_x, max(value) AS peak_value FROM ba JOIN im USING (recording, y, x) GROUP BY 1, 2)"""

GEOMETRY = SUMMARY + """,
e0 AS (SELECT recording, roi, 'h' AS side, y AS ey, x AS ex FROM ba UNION ALL SELECT recording, roi, 'h', y + 1, x FROM ba UNION ALL SELECT recording, roi, 'v', y, x FROM ba UNION ALL SELECT recording, roi, 'v', y, x + 1 FROM ba),
ed AS (SELECT recording, roi, side, ey, ex FROM e0 GROUP BY ALL HAVING count(*) = 1),
ad AS (SELECT a.recording, a.roi AS roi_i, c.roi AS roi_j, count(*) AS n_shared FROM ed a JOIN ed c USING (recording, side, ey, ex) WHERE a.roi <> c.roi GROUP BY 1, 2, 3)"""


def basins(spark, sf_dir):
    return rois.grow_basins(image(spark, sf_dir))


def geometry(spark, sf_dir):
    own = basins(spark, sf_dir)
    summary = rois.roi_summary(own, image(spark, sf_dir))
    edges = rois.roi_edges(own)
    return own, summary, edges, rois.adjacency(edges)


@query("r1_climb", b.sql("pixels", then=BASINS) + "SELECT recording, p, CAST(up AS BIGINT) AS up FROM cl")
def r1(spark, sf_dir):
    return rois.climb(image(spark, sf_dir)).withColumnRenamed("to", "up")


@query("r2_grow_basins", b.sql("pixels", then=BASINS) + "SELECT recording, roi, y, x FROM ba")
def r2(spark, sf_dir):
    return basins(spark, sf_dir)


@query("r4_r5_roi_summary", b.sql("pixels", then=SUMMARY) + f"SELECT recording, roi, size, {r('cy')} AS cy, {r('cx')} AS cx, peak_y, peak_x, round(peak_value, 6) AS peak_value FROM su")
def r5(spark, sf_dir):
    s = rois.roi_summary(basins(spark, sf_dir), image(spark, sf_dir))
    return s.select("recording", "roi", "size", tidy("cy").alias("cy"), tidy("cx").alias("cx"), "peak_y", "peak_x", F.round("peak_value", 6).alias("peak_value"))


@query("r6_roi_edges", b.sql("pixels", then=GEOMETRY) + "SELECT recording, roi, side, CAST(ey AS INTEGER) AS ey, CAST(ex AS INTEGER) AS ex FROM ed")
def r6(spark, sf_dir):
    return rois.roi_edges(basins(spark, sf_dir))


@query("r7_adjacency", b.sql("pixels", then=GEOMETRY) + "SELECT recording, roi_i, roi_j, n_shared FROM ad")
def r7(spark, sf_dir):
    return geometry(spark, sf_dir)[3]


@query("r8_boundary_nodes", b.sql("pixels", then=GEOMETRY + ", no AS (SELECT recording, roi, ey AS ny, ex AS nx FROM ed UNION SELECT recording, roi, CASE WHEN side = 'h' THEN ey ELSE ey + 1 END, CASE WHEN side = 'h' THEN ex + 1 ELSE ex END FROM ed)") + "SELECT recording, roi, CAST(ny AS INTEGER) AS ny, CAST(nx AS INTEGER) AS nx FROM no")
def r8(spark, sf_dir):
    return rois.boundary_nodes(rois.roi_edges(basins(spark, sf_dir)))


@query("r9_peak_to_boundary", b.sql("pixels", then=GEOMETRY + """, no AS (SELECT recording, roi, ey AS ny, ex AS nx FROM ed UNION SELECT recording, roi, CASE WHEN side = 'h' THEN ey ELSE ey + 1 END, CASE WHEN side = 'h' THEN ex + 1 ELSE ex END FROM ed),
di AS (SELECT ad.recording, roi_i, roi_j, min(sqrt(pow(ny - 0.5 - peak_y, 2) + pow(nx - 0.5 - peak_x, 2))) AS distance FROM ad JOIN su ON su.recording = ad.recording AND su.roi = roi_i JOIN no ON no.recording = ad.recording AND no.roi = roi_j GROUP BY 1, 2, 3),
rk AS (SELECT di.*, size, row_number() OVER (PARTITION BY di.recording, roi_i ORDER BY size DESC, roi_j) AS k FROM di JOIN su ON su.recording = di.recording AND su.roi = roi_j WHERE distance <= 3)""") + f"SELECT recording, roi_i, roi_j, {r('distance')} AS distance, size AS size_to FROM rk WHERE k = 1")
def r9(spark, sf_dir):
    _, summary, edges, pairs = geometry(spark, sf_dir)
    return rois.peak_to_boundary(summary, rois.boundary_nodes(edges), pairs, 3.0).select("recording", "roi_i", "roi_j", tidy("distance").alias("distance"), "size_to")


PROPOSED = GEOMETRY + """, pq AS (SELECT ad.*, size, row_number() OVER (PARTITION BY ad.recording, roi_i ORDER BY n_shared DESC, size DESC, roi_j) AS k FROM ad JOIN su ON su.recording = ad.recording AND su.roi = roi_j),
oe AS (SELECT recording, roi AS roi_i, count(*) AS n_edges FROM ed GROUP BY 1, 2), pp AS (SELECT recording, roi_i, roi_j, n_shared / n_edges AS weight FROM pq JOIN oe USING (recording, roi_i) WHERE k = 1)"""


@query("r15_propose_by_shared_edges", b.sql("pixels", then=PROPOSED) + f"SELECT recording, roi_i, roi_j, {r('weight')} AS weight FROM pp")
def r15(spark, sf_dir):
    _, summary, edges, pairs = geometry(spark, sf_dir)
    return rois.propose_by_shared_edges(pairs, edges, summary).select("recording", "roi_i", "roi_j", tidy("weight").alias("weight"))


@query("r12_merge_graph", b.sql("pixels", then=PROPOSED) + "SELECT p.recording, p.roi_i, p.roi_j FROM pp p JOIN su a ON a.recording = p.recording AND a.roi = p.roi_i JOIN su c ON c.recording = p.recording AND c.roi = p.roi_j LEFT JOIN pp q ON q.recording = p.recording AND q.roi_i = p.roi_j AND q.roi_j = p.roi_i WHERE q.roi_i IS NULL OR a.peak_value < c.peak_value OR (a.peak_value = c.peak_value AND p.roi_i < p.roi_j)")
def r12(spark, sf_dir):
    _, summary, edges, pairs = geometry(spark, sf_dir)
    return rois.merge_graph(rois.propose_by_shared_edges(pairs, edges, summary), summary)


@query("r17_purge_lones", b.sql("pixels", then=GEOMETRY) + "SELECT recording, roi, size FROM su WHERE size >= 4 OR EXISTS (SELECT 1 FROM ad WHERE ad.recording = su.recording AND ad.roi_i = su.roi)")
def r17(spark, sf_dir):
    _, summary, _, pairs = geometry(spark, sf_dir)
    return rois.purge_lones(summary, pairs).select("recording", "roi", "size")


@query("r18_roi_traces", b.sql("pixels", then=BASINS) + f"SELECT px.recording, roi, frame, {r('avg(value)')} AS value FROM px JOIN ba ON ba.recording = px.recording AND ba.y = px.y AND ba.x = px.x GROUP BY 1, 2, 3")
def r18(spark, sf_dir):
    return out(rois.roi_traces(px(spark, sf_dir), basins(spark, sf_dir)), "recording", "roi", "frame")


@query("r19_sort_rois", b.sql("pixels", then=SUMMARY) + "SELECT recording, roi, row_number() OVER (PARTITION BY recording ORDER BY pow(peak_y - 3.5, 2) + pow(peak_x - 3.5, 2), peak_y, peak_x) - 1 AS from_centre, row_number() OVER (PARTITION BY recording ORDER BY peak_y, peak_x) - 1 AS in_order FROM su")
def r19(spark, sf_dir):
    s = rois.roi_summary(basins(spark, sf_dir), image(spark, sf_dir))
    return rois.sorted_from_centre(s, 3.5, 3.5).select("recording", "roi", F.col("from_centre").cast("long").alias("from_centre"), F.col("in_order").cast("long").alias("in_order"))


@query("r20_intra_roi_correlation", b.sql("pixels", then=BASINS + ", rs AS (SELECT px.recording, roi, px.y, px.x, value, sum(value) OVER (PARTITION BY px.recording, roi, frame) - value AS rest FROM px JOIN ba ON ba.recording = px.recording AND ba.y = px.y AND ba.x = px.x)") + "SELECT recording, roi, y, x, round(corr(value, rest), 3) + 0.0 AS r, count(*) AS n FROM rs WHERE roi IN (SELECT roi FROM ba b2 WHERE b2.recording = rs.recording GROUP BY roi HAVING count(*) > 1) GROUP BY 1, 2, 3, 4")
def r20(spark, sf_dir):
    own = basins(spark, sf_dir)
    several = own.groupBy("recording", "roi").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return rois.intra_roi_correlation(px(spark, sf_dir), own.join(several, ["recording", "roi"])).select("recording", "roi", "y", "x", tidy("r", 3).alias("r"), "n")


@query("r21_r22_tag_and_discard", b.sql("pixels", then=SUMMARY + ", sh AS (SELECT *, avg(CASE WHEN size < 4 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY recording) AS share FROM su)") + "SELECT recording, roi, CASE WHEN size > 8 THEN 'big' ELSE '' END AS tag FROM sh WHERE NOT size < 4 OR share > 0.5")
def r21(spark, sf_dir):
    s = rois.roi_summary(basins(spark, sf_dir), image(spark, sf_dir)).withColumn("tag", F.lit(""))
    tagged = rois.tag_rois(rois.tag_rois(s, F.col("size") > 8, "big"), F.col("size") > 8, "big")
    return rois.discard(tagged, F.col("size") < 4).select("recording", "roi", "tag")


@query("r23_threshold_rois", b.sql("pixels", then=SUMMARY + ", lm AS (SELECT recording, quantile_cont(peak_value, 0.1) AS lim FROM su GROUP BY 1)") + "SELECT recording, roi FROM su JOIN lm USING (recording) WHERE peak_value <= lim")
def r23(spark, sf_dir):
    return rois.threshold(rois.roi_summary(basins(spark, sf_dir), image(spark, sf_dir)), "peak_value", 0.1).select("recording", "roi")


@query("r24_colour_scale", b.sql("pixels", then=SUMMARY + ", en AS (SELECT recording, quantile_cont(peak_value, 0.01) AS a, quantile_cont(peak_value, 0.95) AS z FROM su GROUP BY 1)") + f"SELECT recording, roi, {r('(peak_value - a) / (z - a)')} AS scaled FROM su JOIN en USING (recording)")
def r24(spark, sf_dir):
    s = rois.colour_scale(rois.roi_summary(basins(spark, sf_dir), image(spark, sf_dir)), "peak_value")
    return s.select("recording", "roi", tidy("scaled").alias("scaled"))


SHIFTED = "sh AS (SELECT DISTINCT recording, frame, CAST(frame % 3 - 1 AS INTEGER) AS dy, CAST(frame % 5 - 2 AS INTEGER) AS dx FROM px)"


def planted_shifts(pixels):
    return pixels.select("recording", "frame").distinct().select("recording", "frame", (F.col("frame") % 3 - 1).cast("int").alias("dy"), (F.col("frame") % 5 - 2).cast("int").alias("dx"))


@query("f16_apply_shifts", b.sql("pixels", then=SHIFTED) + f"SELECT a.recording, a.frame, a.y, a.x, {r('c.value')} AS value FROM px a JOIN sh USING (recording, frame) JOIN px c ON c.recording = a.recording AND c.frame = a.frame AND c.y = least(greatest(a.y + dy, 0), 7) AND c.x = least(greatest(a.x + dx, 0), 7)")
def f16(spark, sf_dir):
    pixels = px(spark, sf_dir)
    return out(fr.apply_shifts(pixels, planted_shifts(pixels), 0, 7), *PX)


@query("f14_pairwise_shifts", b.sql("pixels", then=SHIFTED + ", cu AS (SELECT recording, frame, sum(dy) OVER w AS cy, sum(dx) OVER w AS cx FROM sh WINDOW w AS (PARTITION BY recording ORDER BY frame)), md AS (SELECT recording, quantile_cont(cy, 0.5) AS my, quantile_cont(cx, 0.5) AS mx FROM cu GROUP BY 1)") + "SELECT recording, frame, CAST(cy - my AS DOUBLE) AS dy, CAST(cx - mx AS DOUBLE) AS dx FROM cu JOIN md USING (recording)")
def f14(spark, sf_dir):
    return fr.pairwise_shifts(planted_shifts(px(spark, sf_dir)))


@query("f26_rois_from_shapes", b.sql("pixels", then="""im AS (SELECT recording, y, x, round(avg(value), 9) AS value FROM px GROUP BY 1, 2, 3), sp AS (SELECT * FROM (VALUES (0, 2.0, 2.0, 1.5), (1, 5.0, 4.0, 2.5)) v(roi, cy, cx, radius)),
ins AS (SELECT recording, roi, y, x, value, row_number() OVER (PARTITION BY recording, roi ORDER BY value DESC, y, x) AS k FROM im JOIN sp ON pow(y - cy, 2) + pow(x - cx, 2) <= radius * radius)""") + f"SELECT recording, roi, max(CASE WHEN k = 1 THEN y END) AS peak_y, max(CASE WHEN k = 1 THEN x END) AS peak_x, count(*) AS n, {r('avg(value)')} AS mean FROM ins GROUP BY 1, 2")
def f26(spark, sf_dir):
    shapes = spark.createDataFrame([(0, 2.0, 2.0, 1.5), (1, 5.0, 4.0, 2.5)], "roi int, cy double, cx double, radius double")
    return fr.rois_from_shapes(image(spark, sf_dir), shapes).select("recording", "roi", "peak_y", "peak_x", "n", tidy("mean").alias("mean"))


MERGED = PROPOSED + """, mg AS (SELECT p.recording, p.roi_i, p.roi_j FROM pp p JOIN su a ON a.recording = p.recording AND a.roi = p.roi_i JOIN su c ON c.recording = p.recording AND c.roi = p.roi_j LEFT JOIN pp q ON q.recording = p.recording AND q.roi_i = p.roi_j AND q.roi_j = p.roi_i WHERE p.weight > 0.4 AND (q.roi_i IS NULL OR a.peak_value < c.peak_value OR (a.peak_value = c.peak_value AND p.roi_i < p.roi_j))),
un AS (SELECT recording, roi_i AS a, roi_j AS b FROM mg UNION SELECT recording, roi_j, roi_i FROM mg UNION SELECT recording, roi, roi FROM su),
cp(recording, node, root) AS (SELECT recording, a, a FROM un UNION SELECT un.recording, un.b, cp.root FROM cp JOIN un ON un.recording = cp.recording AND un.a = cp.node), rt AS (SELECT recording, node AS roi, min(root) AS root FROM cp GROUP BY 1, 2),
sk AS (SELECT rt.recording, root, su.roi, row_number() OVER (PARTITION BY rt.recording, root ORDER BY peak_value DESC, su.roi) AS k FROM rt JOIN su ON su.recording = rt.recording AND su.roi = rt.roi WHERE NOT EXISTS (SELECT 1 FROM mg WHERE mg.recording = rt.recording AND mg.roi_i = rt.roi)),
mr AS (SELECT rt.recording, rt.roi, sk.roi AS survivor FROM rt JOIN sk ON sk.recording = rt.recording AND sk.root = rt.root AND k = 1)"""


def merge(spark, sf_dir):
    own, summary, edges, pairs = geometry(spark, sf_dir)
    proposed = rois.propose_by_shared_edges(pairs, edges, summary)
    strong = rois.merge_graph(proposed, summary).join(proposed, ["recording", "roi_i", "roi_j"]).filter("weight > 0.4").drop("weight")
    return own, rois.merged(strong, summary)


@query("r13_merge_rois", b.sql("pixels", then=MERGED) + "SELECT recording, roi, survivor FROM mr")
def r13(spark, sf_dir):
    return merge(spark, sf_dir)[1].select("recording", "roi", "survivor")


@query("r13_merged_traces", b.sql("pixels", then=MERGED + ", tc AS (SELECT px.recording, ba.roi, frame, avg(value) AS value FROM px JOIN ba ON ba.recording = px.recording AND ba.y = px.y AND ba.x = px.x GROUP BY 1, 2, 3)") + f"SELECT tc.recording, survivor AS roi, frame, {r('sum(value * size) / sum(size)')} AS value FROM tc JOIN mr ON mr.recording = tc.recording AND mr.roi = tc.roi JOIN su ON su.recording = tc.recording AND su.roi = tc.roi GROUP BY 1, 2, 3")
def r13t(spark, sf_dir):
    own, found = merge(spark, sf_dir)
    return out(rois.merged_traces(rois.roi_traces(px(spark, sf_dir), own), found), "recording", "roi", "frame")


@query("f5_blur_time", b.sql("pixels", then="wt AS (SELECT unnest([-1, 0, 1]) AS d, unnest([0.25, 0.5, 0.25]::DOUBLE[]) AS w), p1 AS (SELECT *, max(frame) OVER (PARTITION BY recording) AS last FROM px)") + f"SELECT a.recording, a.frame, a.y, a.x, {r('sum(c.value * w)')} AS value FROM p1 a, wt, px c WHERE c.recording = a.recording AND c.y = a.y AND c.x = a.x AND c.frame = least(greatest(a.frame + d, 0), a.last) GROUP BY 1, 2, 3, 4")
def f5(spark, sf_dir):
    blurred = fr.blur(px(spark, sf_dir), "frame", [0.25, 0.5, 0.25], 0)
    return out(blurred.select("recording", F.col("frame").cast("long").alias("frame"), "y", "x", "value"), *PX)


@query("f21_preview_reduce", b.sql("pixels", then="bl AS (SELECT recording, frame, CAST(y // 4 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, avg(value) AS v FROM px GROUP BY 1, 2, 3, 4)") + f"SELECT recording, CAST(frame // 5 AS BIGINT) AS frame, y, x, {r('avg(v)')} AS value FROM bl GROUP BY 1, 2, 3, 4 HAVING count(*) = 5")
def f21(spark, sf_dir):
    return out(fr.preview(px(spark, sf_dir), 4, 5), *PX)


def blurred_sql(name: str, weights: list[float]) -> str:
    half = len(weights) // 2
    return f"""w_{name} AS (SELECT unnest({list(range(-half, half + 1))}) AS d, unnest({weights}::DOUBLE[]) AS w), a_{name} AS (SELECT a.recording, a.y, a.x, sum(c.value * w) AS value FROM im a, w_{name}, im c WHERE c.recording = a.recording AND c.y = least(greatest(a.y + d, 0), 7) AND c.x = a.x GROUP BY 1, 2, 3),
{name} AS (SELECT a.recording, a.y, a.x, sum(c.value * w) AS value FROM a_{name} a, w_{name}, a_{name} c WHERE c.recording = a.recording AND c.y = a.y AND c.x = least(greatest(a.x + d, 0), 7) GROUP BY 1, 2, 3)"""


NARROW, WIDE = [0.25, 0.5, 0.25], [0.1, 0.2, 0.4, 0.2, 0.1]


@query("f11_bandpass_image", b.sql("pixels", then="im AS (SELECT recording, y, x, round(avg(value), 9) AS value FROM px GROUP BY 1, 2, 3),\n" + blurred_sql("na", NARROW) + ",\n" + blurred_sql("wi", WIDE)) + f"SELECT na.recording, na.y, na.x, {r('na.value - wi.value')} AS value FROM na JOIN wi ON wi.recording = na.recording AND wi.y = na.y AND wi.x = na.x")
def f11(spark, sf_dir):
    found = fr.bandpass(image(spark, sf_dir), NARROW, WIDE, 0, 7)
    return out(found.select("recording", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value"), "recording", "y", "x")


@query("f2_resize_space", b.sql("pixels", then="py AS (SELECT *, unnest(generate_series(CAST(floor(y / 2.5) AS BIGINT), CAST(ceil((y + 1) / 2.5) - 1 AS BIGINT))) AS ky FROM px), pa AS (SELECT *, unnest(generate_series(CAST(floor(x / 2.5) AS BIGINT), CAST(ceil((x + 1) / 2.5) - 1 AS BIGINT))) AS kx FROM py), ov AS (SELECT *, (least(y + 1.0, (ky + 1) * 2.5) - greatest(y, ky * 2.5)) * (least(x + 1.0, (kx + 1) * 2.5) - greatest(x, kx * 2.5)) AS o FROM pa)") + f"SELECT recording, frame, ky AS y, kx AS x, {r('sum(value * o) / sum(o)')} AS value FROM ov WHERE o > 0 GROUP BY recording, frame, ky, kx HAVING sum(o) > 6.25 - 1e-9")
def f2_space(spark, sf_dir):
    return out(fr.resize(px(spark, sf_dir), 0.4, 0.4), *PX)


@query("f3_closeup", b.sql("pixels", then="im AS (SELECT recording, y, x, round(avg(value), 9) AS value FROM px GROUP BY 1, 2, 3), pk AS (SELECT recording, arg_max(y, (value, -y, -x)) AS py, arg_max(x, (value, -y, -x)) AS qx FROM im GROUP BY 1)") + f"SELECT px.recording, frame, y, x, {r('value')} AS value FROM px JOIN pk USING (recording) WHERE abs(y - py) <= 2 AND abs(x - qx) <= 2")
def f3_closeup(spark, sf_dir):
    top = image(spark, sf_dir).groupBy("recording").agg(F.max(F.struct("value", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("b"))
    return out(fr.closeup(px(spark, sf_dir), top.select("recording", (-F.col("b.ny")).alias("y"), (-F.col("b.nx")).alias("x")), 2), *PX)


@query("r20_step_correlation", b.sql("pixels", then=BASINS + ", rs AS (SELECT px.recording, roi, frame, px.y, px.x, value, sum(value) OVER (PARTITION BY px.recording, roi, frame) - value AS rest FROM px JOIN ba ON ba.recording = px.recording AND ba.y = px.y AND ba.x = px.x), sp AS (SELECT recording, roi, y, x, value - lag(value) OVER w AS dv, rest - lag(rest) OVER w AS dr FROM rs WINDOW w AS (PARTITION BY recording, roi, y, x ORDER BY frame))") + "SELECT recording, roi, y, x, round(corr(dv, dr), 3) + 0.0 AS r, count(*) AS n FROM sp WHERE dv IS NOT NULL AND roi IN (SELECT roi FROM ba b2 WHERE b2.recording = sp.recording GROUP BY roi HAVING count(*) > 1) GROUP BY 1, 2, 3, 4")
def r20_steps(spark, sf_dir):
    own = basins(spark, sf_dir)
    several = own.groupBy("recording", "roi").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return rois.intra_roi_correlation(px(spark, sf_dir), own.join(several, ["recording", "roi"]), diff=True).select("recording", "roi", "y", "x", tidy("r", 3).alias("r"), "n")


def decay(name: str, source: str, rates: str) -> str:
    """Table name(recording, rate, b, c), the best of the rates given by an expression for each row of source(recording, frame, m, ...)."""
    return f"""{name}_e AS (SELECT recording, rate, m, exp(-rate * frame) AS e FROM (SELECT *, unnest({rates}) AS rate FROM {source})),
{name}_f AS (SELECT recording, rate, regr_slope(m, e) AS c, regr_intercept(m, e) AS b, round(regr_syy(m, e) - pow(regr_sxy(m, e), 2) / regr_sxx(m, e), 6) AS sse FROM {name}_e GROUP BY 1, 2),
{name} AS (SELECT recording, rate, b, c FROM {name}_f WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording ORDER BY sse, rate, b, c) = 1)"""


@query("f7_debleach_decay", b.sql("pixels", then="md AS (SELECT recording, frame, quantile_cont(value, 0.5) AS m FROM px GROUP BY 1, 2), " + decay("co", "md", f"{list(fr.RATES)}::DOUBLE[]") + ", mn AS (SELECT md.*, rate AS near FROM md JOIN co USING (recording)), " + decay("fi", "mn", f"list_transform({list(fr.FINER)}::DOUBLE[], lambda f: f * near)") + ", mi AS (SELECT recording, quantile_cont(m, 0.5) AS middle FROM md GROUP BY 1)") + f"SELECT px.recording, frame, y, x, {r('value - (b + c * exp(-rate * frame) - middle)')} AS value FROM px JOIN fi USING (recording) JOIN mi USING (recording)")
def f7_decay(spark, sf_dir):
    return out(fr.debleach(px(spark, sf_dir)), *PX)
