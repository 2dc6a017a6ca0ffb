"""Queries of the recording, catalog and protocol operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.numbers import tidy
from tracemill.operators import linescans as ls
from tracemill.operators import protocols as pr
from tracemill.operators import recordings as rec
from tracemill.plans.registry import query
from tracemill.plans.trace_queries import r
from tracemill.sources import bindings as b
from tracemill.sources import readers

GAPS = 'ga AS (SELECT *, start - lag("end") OVER (PARTITION BY recording ORDER BY series) AS gap, lag(px_size) OVER (PARTITION BY recording ORDER BY series) AS was FROM se)'


@query("m1_calc_gaps", b.sql("series", then=GAPS) + "SELECT recording, series, gap FROM ga")
def m1(spark, sf_dir):
    return rec.gaps(b.series(spark, sf_dir)).select("recording", F.col("series").cast("long").alias("series"), "gap")


@query("m2_group_series", b.sql("series", then=GAPS + """, nw AS (SELECT *, sum(CASE WHEN gap IS NULL OR abs(gap) > 60 OR px_size <> was THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY series) AS part FROM ga),
gr AS (SELECT recording, part, min(series) AS f, max(series) AS l, count(*) AS n, CAST(sum(size_t) AS BIGINT) AS frames FROM nw GROUP BY 1, 2)""") + "SELECT recording, CAST(part AS BIGINT) AS part, n, frames, CASE WHEN f = l THEN printf('Series%03d', f) ELSE printf('Series%03d-%d', f, l) END AS label FROM gr")
def m2(spark, sf_dir):
    return rec.group_series(b.series(spark, sf_dir), 60.0).select("recording", "part", "n", "frames", "label")


@query("m3_merge_series", b.sql("series", then="fq AS (SELECT *, size_t / nullif(duration, 0) AS f FROM se), mf AS (SELECT *, avg(f) OVER (PARTITION BY recording) AS m FROM fq)") + "SELECT recording, series, CAST(coalesce(sum(size_t) OVER (PARTITION BY recording ORDER BY series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_frame, coalesce(abs(f - m) <= 0.1 * m, false) AS fits FROM mf")
def m3(spark, sf_dir):
    return rec.merged_offsets(b.series(spark, sf_dir)).select("recording", F.col("series").cast("long").alias("series"), "first_frame", F.coalesce("fits", F.lit(False)).alias("fits"))


@query("m4_derive_timing", b.sql("series") + f"SELECT recording, series, {r('size_t / nullif(duration, 0)')} AS frequency, CAST(floor(start + duration) AS BIGINT) AS floor_end FROM se")
def m4(spark, sf_dir):
    return rec.timing(b.series(spark, sf_dir)).select("recording", F.col("series").cast("long").alias("series"), tidy("frequency").alias("frequency"), "floor_end")


@query("m5_frequency_from_name", r"SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_name || ' ' || p_size || '.5 Hz', '([0-9.]+)[ _]*Hz', 1), '') AS DOUBLE) AS frequency FROM part")
def m5(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 Hz"))
    return b.read(spark, sf_dir, "part").select("p_partkey", rec.frequency_from_name(name).alias("frequency"))


@query("m10_series_durations", b.sql("series", then="""un AS (SELECT recording, series, duration, sum(duration) OVER (PARTITION BY recording ORDER BY series) AS u FROM se),
tx AS (SELECT recording, series, regexp_replace(printf('%d:%02d:%02d', CAST(floor((u - duration) / 3600) AS BIGINT), CAST(floor((u - duration) % 3600 / 60) AS BIGINT), CAST(floor((u - duration) % 60) AS BIGINT)), '^[0:]+(.)', '\\1') AS a, regexp_replace(printf('%d:%02d:%02d', CAST(floor(u / 3600) AS BIGINT), CAST(floor(u % 3600 / 60) AS BIGINT), CAST(floor(u % 60) AS BIGINT)), '^[0:]+(.)', '\\1') AS z FROM un)""") + "SELECT recording, string_agg(a || '-' || z, chr(10) ORDER BY series) AS ranges FROM tx GROUP BY recording")
def m10(spark, sf_dir):
    return rec.durations_text(b.series(spark, sf_dir))


@query("s1_constrain_catalog", "SELECT page_id, url FROM pages WHERE contains(url, '.org') OR contains(url, '/de/')")
def s1(spark, sf_dir):
    return rec.constrained(b.read(spark, sf_dir, "pages").select("page_id", "url"), "url", ".org, /de/")


@query("m9_catalog_row", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS folder, count(*) AS n, arg_max(url, (length(url), page_id)) AS longest, max(TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT)) AS last_number FROM pages GROUP BY 1")
def m9(spark, sf_dir):
    pages = b.read(spark, sf_dir, "pages").select("page_id", "url")
    number = F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).try_cast("bigint")
    return pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.length("url"), "page_id", "url"))["url"].alias("longest"), F.max(number).alias("last_number"))


#: Pages as files of recordings: hosts are recordings, languages series, in parts of 300 s and two channels.
FILES = """fi AS (SELECT '/data/' || regexp_extract(url, '://([^/?#]*)', 1) || '/' || regexp_extract(url, '://[^/]*/([a-z]*)', 1) || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_0-300' ELSE '_300s-600s' END || CASE page_id % 2 WHEN 0 THEN '' ELSE '_c1' END AS folder, page_id, length(html) AS length,
  CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '_protocol.txt' ELSE '.mp4' END AS ending, page_id % 7 AS mtime FROM pages),
fp AS (SELECT *, folder || '/' || page_id || ending AS path FROM fi)"""


@query("m9_catalog_rows", "WITH " + FILES + """ SELECT folder, regexp_extract(folder, '^/data/([^/]*)', 1) AS recording, regexp_extract(folder, '([^/_]*)[^/]*$', 1) AS series, CASE WHEN regexp_matches(folder, '_c1$') THEN 1 ELSE 0 END AS channel,
  CASE WHEN folder LIKE '%_0-300%' THEN 0.0::DOUBLE WHEN folder LIKE '%_300s-600s%' THEN 300.0::DOUBLE END AS "begin", CASE WHEN folder LIKE '%_0-300%' THEN 300.0::DOUBLE WHEN folder LIKE '%_300s-600s%' THEN 600.0::DOUBLE END AS "end",
  count(*) FILTER (ending = '.mp4') AS n_movies, arg_max(path, (mtime, path)) FILTER (ending = '.mp4') AS movie, count(*) FILTER (ending = '.png') AS n_images,
  coalesce(arg_max(path, (length, path)) FILTER (ending = '_protocol.txt'), folder || '/' || regexp_extract(folder, '^/data/([^/]*)', 1) || '_' || regexp_extract(folder, '([^/_]*)[^/]*$', 1) || '_protocol.txt') AS protocol FROM fp GROUP BY folder""")
def m9_rows(spark, sf_dir):
    page = F.col("page_id")
    part = F.when(page % 3 == 0, "").when(page % 3 == 1, "_0-300").otherwise("_300s-600s")
    folder = F.concat(F.lit("/data/"), F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), F.regexp_extract("url", "://[^/]*/([a-z]*)", 1), part, F.when(page % 2 == 0, "").otherwise("_c1"))
    ending = F.when(page % 5 == 0, ".png").when(page % 5 == 1, "_protocol.txt").otherwise(".mp4")
    files = b.read(spark, sf_dir, "pages").select(F.concat(folder, F.lit("/"), page.cast("string"), ending).alias("path"), F.length("html").alias("length"), (page % 7).alias("modificationTime"))
    found = rec.catalog_rows(files)
    return found.select("folder", F.regexp_replace("recording", "^/data/", "").alias("recording"), "series", "channel", "begin", "end", F.size("movies").cast("long").alias("n_movies"), "movie", F.size("images").cast("long").alias("n_images"), "protocol")


@query("m13_search_catalog", "SELECT page_id, url FROM pages WHERE contains(url, '/fr/') ORDER BY page_id LIMIT 20")
def m13(spark, sf_dir):
    return rec.searched(b.read(spark, sf_dir, "pages").select("page_id", "url"), "url", "/fr/", "page_id", 20)


@query("m12_additional_info", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def m12(spark, sf_dir):
    lines = b.read(spark, sf_dir, "events").select("event_id", F.regexp_replace("props", r'[{}"]', "").alias("text"))
    return rec.additional_info(lines, "text").select("event_id", F.col("info")["k"].alias("k"))


@query("p1_split_concentration", b.sql("protocol") + "SELECT p_partkey, regexp_extract(concentration, '^([0-9]+)', 1) AS conc, regexp_extract(concentration, '([A-Za-z]+)$', 1) AS unit FROM pr")
def p1(spark, sf_dir):
    return pr.split_concentration(b.protocol(spark, sf_dir)).select("p_partkey", "conc", "unit")


TIMES = """ts AS (SELECT *, CAST(split_part("begin", ':', 1) AS DOUBLE) * 60 + CAST(split_part("begin", ':', 2) AS DOUBLE) AS b0, CAST(split_part("end", ':', 1) AS DOUBLE) * 60 + CAST(split_part("end", ':', 2) AS DOUBLE) AS e0 FROM pr),
pt AS (SELECT recording, p_partkey, compound, concentration, coalesce(b0, 0.0) AS t_begin, coalesce(e0, greatest(max(e0) OVER (PARTITION BY recording), 600.0), 600.0) AS t_end FROM ts)"""


def timed(spark, sf_dir):
    return pr.parse_times(b.protocol(spark, sf_dir), 0.0, 600.0)


@query("p2_parse_times", b.sql("protocol", then=TIMES) + "SELECT p_partkey, t_begin, t_end FROM pt")
def p2(spark, sf_dir):
    return timed(spark, sf_dir).select("p_partkey", "t_begin", "t_end")


LEGS = TIMES + """, po AS (SELECT recording, t_begin AS t FROM pt UNION SELECT recording, t_end FROM pt),
lg AS (SELECT pt.recording, t AS leg_begin, min(t_end) AS leg_end, array_to_string(list_sort(list(DISTINCT lower(compound) || '=' || concentration)), ';') AS treatment, count(*) AS n_rows, count(DISTINCT lower(compound)) AS n_compounds FROM pt JOIN po ON po.recording = pt.recording AND t_begin <= t AND t < t_end GROUP BY 1, 2)"""


@query("p3_legs", b.sql("protocol", then=LEGS) + "SELECT recording, leg_begin, leg_end, treatment FROM lg")
def p3(spark, sf_dir):
    return pr.legs(timed(spark, sf_dir)).select("recording", "leg_begin", "leg_end", "treatment")


@query("p4_validate", b.sql("protocol", then=LEGS + ", af AS (SELECT *, lead(leg_begin) OVER (PARTITION BY recording ORDER BY leg_begin) AS after FROM lg)") + "SELECT recording, leg_begin, CASE WHEN n_rows > n_compounds THEN 'compound twice' ELSE 'gap' END AS problem FROM af WHERE n_rows > n_compounds OR after > leg_end")
def p4(spark, sf_dir):
    return pr.invalid(pr.legs(timed(spark, sf_dir)))


@query("p5_scheme", b.sql("protocol", then=LEGS + ", fs AS (SELECT recording, treatment, min(leg_begin) AS seen FROM lg GROUP BY 1, 2), sy AS (SELECT recording, treatment, repeat('*', CAST(dense_rank() OVER (PARTITION BY recording ORDER BY seen, treatment) - 1 AS INTEGER)) AS symbol FROM fs)") + "SELECT lg.recording, leg_begin, symbol FROM lg JOIN sy ON sy.recording = lg.recording AND sy.treatment = lg.treatment")
def p5(spark, sf_dir):
    return pr.scheme(pr.legs(timed(spark, sf_dir)))


@query("p6_replace", b.sql("protocol") + "SELECT p_partkey, CASE compound WHEN 'red' THEN 'glucose' WHEN 'small' THEN 'ca' ELSE compound END AS compound FROM pr")
def p6(spark, sf_dir):
    return pr.replaced(b.protocol(spark, sf_dir), {"red": "glucose", "small": "ca"}).select("p_partkey", "compound")


@query("p7_active_at", b.sql("protocol", then=TIMES + ", ks AS (SELECT recording, compound, concentration, unnest(generate_series(CAST(ceil(t_begin / 120.0) AS BIGINT), CAST(ceil(least(t_end, 3600.0) / 120.0) - 1 AS BIGINT))) AS k FROM pt)") + "SELECT recording, k, array_to_string(list_sort(list(DISTINCT compound || ' ' || concentration)), ', ') AS active FROM ks GROUP BY 1, 2")
def p7(spark, sf_dir):
    return pr.active_at(timed(spark, sf_dir), 120.0, 3600.0)


@query("m11_protocol_summary", b.sql("protocol") + "SELECT recording, array_to_string(list_sort(list(DISTINCT compound || ':' || concentration)), ' ') AS summary FROM pr GROUP BY 1")
def m11(spark, sf_dir):
    return pr.summary(b.protocol(spark, sf_dir))


@query("s8_wide_traces", b.sql("week") + "SELECT t, count(*) AS n_rois, string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY roi) AS row_values FROM tr GROUP BY t")
def s8(spark, sf_dir):
    return readers.wide_traces(b.traces_week(spark, sf_dir), "cast(value as long)")


@query("s11_melt_calibration", "SELECT p_size AS concentration, m AS replicate, v AS measurement FROM (SELECT p_size, p_retailprice AS measurement_1, p_retailprice * 2 AS measurement_2 FROM part) UNPIVOT (v FOR m IN (measurement_1, measurement_2))")
def s11(spark, sf_dir):
    wide = b.read(spark, sf_dir, "part").select(F.col("p_size").alias("concentration"), F.col("p_retailprice").alias("measurement_1"), (F.col("p_retailprice") * 2).alias("measurement_2"))
    return readers.tidy_calibration(wide)


@query("m7_reshape_linescan", b.sql("pixels") + f"SELECT recording, x, frame * 8 + y AS i, {r('value')} AS value FROM px")
def m7(spark, sf_dir):
    return ls.reshape_linescan(b.pixels(spark, sf_dir), 8).withColumn("value", tidy("value"))


@query("t34_heatmap_bins", b.sql("pixels", then="li AS (SELECT recording, x, frame * 8 + y AS i, value FROM px WHERE x BETWEEN 2 AND 5), bi AS (SELECT recording, x, i // 16 AS k, avg(value) AS v, count(*) AS n FROM li GROUP BY 1, 2, 3)") + f"SELECT recording, x, CAST(k AS BIGINT) AS k, {r('v')} AS value FROM bi WHERE n = 16")
def t34(spark, sf_dir):
    line = ls.reshape_linescan(b.pixels(spark, sf_dir), 8)
    return ls.heatmap_bins(line, 16, (2, 5)).withColumn("value", tidy("value"))


@query("m6_tag_linescans", b.sql("pixels", then="""ff AS (SELECT recording, y, x, value FROM px WHERE frame = 0), sz AS (SELECT recording, CAST(greatest(1, floor(12.0 / (4 + recording % 3 * 2))) AS INTEGER) AS scale FROM ff GROUP BY 1),
cx AS (SELECT a.recording, corr(a.value, c.value) AS rx FROM ff a JOIN sz USING (recording) JOIN ff c ON c.recording = a.recording AND c.y = a.y AND c.x = a.x + scale GROUP BY 1), cy AS (SELECT a.recording, corr(a.value, c.value) AS ry FROM ff a JOIN sz USING (recording) JOIN ff c ON c.recording = a.recording AND c.x = a.x AND c.y = a.y + scale GROUP BY 1),
hi AS (SELECT recording, max(y) - min(y) + 1 AS n_rows FROM ff GROUP BY 1)""") + "SELECT recording, CASE WHEN n_rows <= scale THEN 'multi' WHEN rx / nullif(abs(ry), 0) > 2 THEN 'single' ELSE 'none' END AS line_scan FROM hi JOIN sz USING (recording) LEFT JOIN cx USING (recording) LEFT JOIN cy USING (recording)")
def m6(spark, sf_dir):
    px = b.pixels(spark, sf_dir)
    series = px.select("recording").distinct().select("recording", (4.0 + F.col("recording") % 3 * 2).alias("px_size"))
    return ls.tag_linescans(px, series)
