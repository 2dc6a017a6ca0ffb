"""Golden protocol, and signals with known truth."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import events as ev
from tracemill.operators import frames as fr
from tracemill.operators import protocols as pr
from tracemill.operators import rois
from tracemill.operators import traces as tr
from tracemill.operators.components import components

PROTOCOL = [
    ("glucose", "8mM", "00:00", "20:00"), ("glucose", "6mM", "20:00", "28:58"), ("glucose", "8mM", "28:58", "48:58"), ("glucose", "6mM", "48:58", "57:57"),
    ("glucose", "8mM", "57:57", "77:57"), ("glucose", "6mM", "77:57", None), ("pH", "7.4", "00:00", "28:58"), ("pH", "7.1", "28:58", "48:58"), ("pH", "7.4", "48:58", None),
]


def test_golden_protocol_and_legs(spark):
    df = spark.createDataFrame([("r", *p) for p in PROTOCOL], "recording string, compound string, concentration string, begin string, end string")
    timed = pr.parse_times(pr.split_concentration(df), 0.0, 5133.939394)
    got = {(r.compound, r.t_begin): (r.t_end, r.conc, r.unit) for r in timed.collect()}
    assert got[("glucose", 1200.0)] == (1738.0, "6", "mM") and got[("glucose", 4677.0)] == (5133.939394, "6", "mM")
    assert got[("pH", 1738.0)] == (2938.0, "7.1", "") and got[("pH", 2938.0)] == (5133.939394, "7.4", "")
    legs = pr.legs(timed)
    assert [(r.leg_begin, r.leg_end, r.treatment) for r in legs.orderBy("leg_begin").collect()] == [
        (0.0, 1200.0, "glucose=8mM;ph=7.4"), (1200.0, 1738.0, "glucose=6mM;ph=7.4"), (1738.0, 2938.0, "glucose=8mM;ph=7.1"),
        (2938.0, 3477.0, "glucose=6mM;ph=7.4"), (3477.0, 4677.0, "glucose=8mM;ph=7.4"), (4677.0, 5133.939394, "glucose=6mM;ph=7.4"),
    ]
    assert pr.invalid(legs).count() == 0


def test_two_units_are_an_error(spark):
    df = spark.createDataFrame([("r", "x", "8mM5nM")], "recording string, compound string, concentration string")
    with pytest.raises(Exception, match="more than one unit"):
        pr.split_concentration(df).collect()


def test_pulses_are_found_where_they_are(spark):
    r = random.Random(4)
    rows = []
    for roi in range(3):
        for i in range(400):
            pulse = 60.0 if i in range(100 + 50 * roi, 106 + 50 * roi) else 0.0
            rows.append((roi, i, float(i), 100 + r.gauss(0, 3) + pulse))
    z = tr.z_scores(tr.percentile_lowpass(spark.createDataFrame(rows, "roi int, i int, t double, value double"), 61, 0.5))
    found = {x.roi: (x.t0, x.tend) for x in tr.excursions(z, 4.0, 1.0).collect()}
    assert found == {k: (100.0 + 50 * k, 106.0 + 50 * k) for k in range(3)}


def test_bleaching_rate(spark):
    rows = [(0, i, float(i), 5 + 20 * math.exp(-0.01 * i)) for i in range(300)]
    best = tr.bleaching(spark.createDataFrame(rows, "roi int, i int, t double, value double"), [0.003, 0.01, 0.03]).first()
    assert best.rate == 0.01 and abs(best.b - 5) < 1e-6 and abs(best.c - 20) < 1e-6


def test_shifted_frames(spark):
    r = random.Random(1)
    base = {(y, x): r.random() for y in range(-3, 15) for x in range(-3, 15)}
    shifts = [(0, 0), (1, 0), (-1, 2), (2, -2)]
    px = spark.createDataFrame([(0, f, y, x, base[y - dy, x - dx]) for f, (dy, dx) in enumerate(shifts) for y in range(12) for x in range(12)], "recording int, frame int, y int, x int, value double")
    template = px.filter("frame = 0").drop("frame")
    got = {x.frame: (x.dy, x.dx) for x in fr.estimate_shifts(px, template, 2, (3, 8)).collect()}
    assert got == dict(enumerate(shifts))
    back = fr.apply_shifts(px, fr.estimate_shifts(px, template, 2, (3, 8)), 0, 11).filter("y between 3 and 8 and x between 3 and 8")
    assert back.join(template.withColumnRenamed("value", "v"), ["recording", "y", "x"]).filter("abs(value - v) > 1e-12").count() == 0


def test_two_touching_blobs_and_a_lone_one(spark):
    centres = [(8, 8), (8, 15), (24, 24)]
    rows = [(0, y, x, max(math.exp(-((y - a) ** 2 + (x - b) ** 2) / 8) for a, b in centres)) for y in range(32) for x in range(32)]
    image = spark.createDataFrame(rows, "recording int, y int, x int, value double")
    basins = rois.grow_basins(image).join(image.filter("value > 0.05"), ["recording", "y", "x"]).select("recording", "roi", "y", "x")
    summary = rois.roi_summary(basins, image)
    assert {(r.peak_y, r.peak_x) for r in summary.collect()} == set(centres)
    pairs = rois.adjacency(rois.roi_edges(basins)).collect()
    assert {(p.roi_i, p.roi_j) for p in pairs} == {(8 * rois.WIDTH + 8, 8 * rois.WIDTH + 15), (8 * rois.WIDTH + 15, 8 * rois.WIDTH + 8)}


def test_events_match_themselves(spark):
    rows = [(i, i % 3, float(i), i + 1.0 + i % 5, 1.0 + i % 5) for i in range(40)]
    e = spark.createDataFrame(rows, "event_id long, roi long, t0 double, tend double, halfwidth double")
    assert all(r.event_id in r.matches for r in ev.match_events(e, e).collect())


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(50)] + [(99, 98), (98, 97)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == ({} if not edges else {1: 1} if len(edges) == 1 else {i: 0 for i in range(51)} | {97: 97, 98: 97, 99: 97})


def test_rebin_keeps_means(spark):
    df = spark.range(0, 90).select(F.lit(0).alias("roi"), F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("t"), (F.col("id") * 2.0).alias("value"))
    assert tr.rebin(df, 9).agg(F.avg("value")).first()[0] == pytest.approx(89.0)
    assert tr.rebin(df, 40).count() == 2


def test_gaps_of_each_recording(spark):
    """Gaps at other places in two recordings, rois of the same names."""
    rows = []
    for rec, (g0, g1), level in (("a", (5, 8), 10.0), ("b", (12, 14), 100.0)):
        for roi in range(2):
            rows += [(rec, roi, i, float(i), 0.0 if g0 <= i <= g1 else level + roi) for i in range(20)]
    df = spark.createDataFrame(rows, "recording string, roi int, i int, t double, value double")
    got = {(r.recording, r.roi, r.i): (r.value, r.raw) for r in tr.fill_gaps(df, 2, ("recording",)).collect()}
    assert len(got) == len(rows)
    for rec, roi, i, _, v in rows:
        filled = {"a": 10.0, "b": 100.0}[rec] + roi
        last = i == {"a": 8, "b": 14}[rec]
        assert got[rec, roi, i] == (pytest.approx(v if last else filled), v)


def test_legs_of_each_recording(spark):
    events = spark.createDataFrame([(k, rec, p) for k, (rec, p) in enumerate([("a", 5.0), ("b", 5.0), ("b", 25.0), ("c", 5.0)])], "event_id long, recording string, peakpoint double")
    legs = spark.createDataFrame([("a", "x", 0.0, 10.0), ("b", "y", 0.0, 10.0), ("b", "z", 20.0, 30.0)], "recording string, leg string, leg_begin double, leg_end double")
    assert {r.event_id: r.leg for r in ev.define_legs(events, legs).collect()} == {0: "x", 1: "y", 2: "z", 3: None}
    assert {r.event_id: r.leg for r in ev.define_legs(events, legs.drop("recording").filter("leg != 'y'")).collect()} == {0: "x", 1: "x", 2: "z", 3: "x"}


def test_saturated_pixels(spark):
    rows = [("r", f, 0, x, 100.0 if x < 2 else 10.0 + f) for f in range(30) for x in range(4)]
    px = spark.createDataFrame(rows, "recording string, frame int, y int, x int, value double")
    own = spark.createDataFrame([("r", 1, 0, 0), ("r", 1, 0, 1), ("r", 1, 0, 2), ("r", 2, 0, 3)], "recording string, roi int, y int, x int")
    assert {r.roi: (r.n_saturated, r.n_pixels) for r in fr.count_saturated(px, own).collect()} == {1: (2, 3), 2: (0, 1)}
    few = px.filter("frame < 2").select("recording", "value")
    assert fr.robust_max(few, "value", 10).first().robust_max == 10.0
