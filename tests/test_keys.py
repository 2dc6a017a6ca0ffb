"""Two recordings whose rois have the same numbers are never mixed."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import events as ev
from tracemill.operators import frames as fr
from tracemill.operators import rois, stats
from tracemill.operators import traces as tr

KEYS = ("recording", "roi")
SCHEMA = "event_id long, recording string, roi int, its int, t0 double, halfwidth double, z_max double, height double, leg string"


@pytest.fixture(scope="module")
def both(spark):
    """The same events in recordings a and b, but for their ids; b's legs are shorter."""
    rows = []
    for r, rec in enumerate("ab"):
        for k in range(120):
            roi, place = k % 4, k // 4
            t0 = 10.0 + 20 * (place // 2) + 0.1 * (place % 2)
            leg = ("x" if t0 < 150 else "y") if rec == "a" or t0 < 250 else None
            rows.append((1000 * r + k, rec, roi, place % 2, t0, 4.0 + roi, 5.0 + k, 1.0 + k % 7, leg))
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("tend", F.col("t0") + F.col("halfwidth")).withColumn("peakpoint", F.col("t0") + F.col("halfwidth") / 2)


def one(df, rec):
    return df.filter(F.col("recording") == rec)


def same(got, rec, alone):
    """What both recordings give for one equals what that one gives alone."""
    columns = [c for c in alone.columns if c != "recording"]
    rows = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(columns).collect()), key=repr)
    assert rows(one(got, rec)) == rows(alone) != []


def test_distillation(both):
    audit = ev.distill_audit(both, 5.0, F.when(F.col("recording") == "a", 400.0).otherwise(200.0), min_confidence=2, keys=KEYS)
    found = audit.collect()
    assert len(found) == 240
    assert all(r.attractor is None or (r.attractor < 1000) == (r.recording == "a") for r in found)
    assert {r.status for r in found if r.recording == "b" and r.tend + r.halfwidth / 2 > 200} == {"too close to end"}
    for rec, last in (("a", 400.0), ("b", 200.0)):
        same(ev.distilled(audit, KEYS), rec, ev.distilled(ev.distill_audit(one(both, rec), 5.0, last, min_confidence=2)))
    best = {r.event_id: r for r in ev.distilled(audit, KEYS, take_best=True).collect()}
    own = {r.event_id: r for r in both.collect()}
    assert best and all((r.t0, r.tend, r.z_max) == (own[k].t0, own[k].tend, own[k].z_max) for k, r in best.items())


def test_event_operators(both):
    same(ev.thinned(both, 20, KEYS).select("recording", "event_id", "roi", "run"), "b", ev.thinned(one(both, "b"), 20).select("event_id", "roi", "run"))
    same(ev.intervals(both, 3, KEYS), "a", ev.intervals(one(both, "a"), 3))
    same(ev.to_raster(both, 50, 400.0, KEYS), "a", ev.to_raster(one(both, "a"), 50, 400.0))
    rois_ = both.select("recording", "roi").distinct()
    late = both.filter("recording = 'a' or t0 > 100")
    same(ev.activation_time(late, rois_, 0.0, 300.0, 1.0, KEYS), "b", ev.activation_time(one(late, "b"), rois_.filter("recording = 'b'").select("roi"), 0.0, 300.0, 1.0))
    matched = ev.match_events(both.filter("its = 0"), both.filter("its = 1"), keys=KEYS).collect()
    assert all((m < 1000) == (r.recording == "a") for r in matched for m in r.matches) and any(r.matches for r in matched)


def test_statistics(both):
    edges = [(0.0, 6.0), (6.0, 20.0)]
    for rec in "ab":
        same(stats.event_rate(both, edges, 5, 2, keys=KEYS), rec, stats.event_rate(one(both, rec), edges, 5, 2))
        same(stats.tidy_roi_leg(both, 0.0, 50.0, 2, KEYS), rec, stats.tidy_roi_leg(one(both, rec), 0.0, 50.0, 2))
        same(stats.leg_ratio(both, "height", "x", KEYS), rec, stats.leg_ratio(one(both, rec), "height", "x"))


def test_windows_of_each_recording(spark, both):
    windows = spark.createDataFrame([("a", "p", 0.0, 60.0), ("b", "q", 0.0, 20.0), ("b", "r", 0.0, 200.0)], "recording string, leg string, leg_begin double, leg_end double")
    got = ev.window_events(both, windows)
    assert {(r.recording, r.leg) for r in got.collect()} == {("a", "p"), ("b", "q"), ("b", "r")}
    assert got.filter("leg = 'p'").count() == one(both, "a").filter("tend <= 60").count()
    assert ev.window_events(both, windows.filter("recording = 'b'").drop("recording")).filter("leg = 'q'").count() == both.filter("tend <= 20").count()
    samples = spark.createDataFrame([(rec, 1, float(t), 2.0, 4.0) for rec in "ab" for t in range(10)], "recording string, roi int, t double, fast double, slow double")
    legs = spark.createDataFrame([("a", "p", 0.0, 4.0), ("b", "p", 0.0, 8.0)], "recording string, leg string, leg_begin double, leg_end double")
    assert {r.recording: r.activity for r in tr.trace_activity(samples, legs, 1.0, KEYS).collect()} == {"a": pytest.approx(3 * 0.5 / 4), "b": pytest.approx(7 * 0.5 / 8)}


def test_heights_of_two_recordings(spark):
    rows = []
    for r, (rec, level) in enumerate((("a", 10.0), ("b", 1000.0))):
        rows += [(rec, 1, 0, i, level + (30.0 if 20 <= i < 26 else 0.0), level) for i in range(60)]
    samples = spark.createDataFrame(rows, "recording string, roi int, its int, i int, value double, slow double")
    made = [(10 * r + k, rec, 1, 0, t0, hw, 1.0, h) for r, rec in enumerate("ab") for k, (t0, hw, h) in enumerate([(19.0, 7.0, 1.0), (19.5, 7.0, 3.0), (19.0, 7.5, 2.0), (40.0, 0.2, 9.0), (50.0, 5.0, 1.0)])]
    events = spark.createDataFrame(made, "event_id long, recording string, roi int, its int, t0 double, halfwidth double, z_max double, height double").withColumn("tend", F.col("t0") + F.col("halfwidth"))
    status = {r.event_id: r.status for r in ev.judged_windows(events, samples, 1.0, KEYS).collect()}
    assert [status[k] for k in (0, 1, 2, 4)] == ["ok", "ok", "ok", "too steep"] and {status[k] for k in (10, 11, 12, 14)} == {"too steep"}  # 3 % of b's level
    best = ev.distill_by_height(events, samples, 1.0, keys=KEYS).collect()
    assert [(r.event_id, r.clique_size, r.halfwidth) for r in best] == [(1, 3, 7.0)]
    short = spark.createDataFrame([(7, "c", 1, 0, 3.0, 1.0, 1.0, 1.0)], "event_id long, recording string, roi int, its int, t0 double, halfwidth double, z_max double, height double").withColumn("tend", F.col("t0") + 1)
    assert ev.judged_windows(short, samples, 1.0, KEYS).first().status == "too short"
    bent = spark.createDataFrame([("a", 1, 0, i, 100.0 + i * i, 100.0 + i * i) for i in range(60)], "recording string, roi int, its int, i int, value double, slow double")
    assert ev.judged_windows(events.filter("event_id = 0").withColumn("halfwidth", F.lit(30.0)), bent, 1.0, KEYS).first().status == "spurious"


def test_pixels_of_text_recordings_and_wide_images(spark):
    schema = "recording string, frame int, y int, x int"
    mask = spark.createDataFrame([("a", 0, 0, 4999), ("a", 0, 1, 5000), ("a", 0, 1, 0), ("a", 2_000_000, 7, 7), ("b", 0, 0, 4999), ("b", 1, 0, 4998)], schema)
    got = {(r.recording, r.frame, r.y, r.x): tuple(r.event) for r in fr.connected_events(mask).collect()}
    assert len(got) == 6 and got["a", 0, 1, 5000] == got["a", 0, 0, 4999] == (0, 0, 4999)
    assert got["a", 0, 1, 0] == (0, 1, 0) and got["a", 2_000_000, 7, 7] == (2_000_000, 7, 7) and got["b", 1, 0, 4998] == (0, 0, 4999)
    wide = spark.createDataFrame([("w", y, x, float(x == 4990) * 3 + float(x == 10 and y == 1) * 2 + x * 1e-6) for y in range(2) for x in [*range(8, 13), *range(4988, 5000)]], "recording string, y int, x int, value double")
    basins = {(r.y, r.x): r.roi for r in rois.grow_basins(wide).collect()}
    assert len(basins) == 34 and basins[0, 4989] == basins[1, 4991] and basins[0, 9] == rois.WIDTH + 10 != basins[0, 4989]
