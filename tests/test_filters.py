import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions.tables import numbered
from tracemill.operators import filters as fl

SCHEMA = "recording string, roi string, i int, t double, value double"
KEYS = ["recording", "roi"]


def traces(spark, made):
    """made: {(recording, roi): values}"""
    return spark.createDataFrame([(r, o, i, i * 0.5, float(v)) for (r, o), vs in made.items() for i, v in enumerate(vs)], SCHEMA)


def arrays(df, column, keys=KEYS):
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", column))).alias("r")).collect()
    return {tuple(r[k] for k in keys): np.array([x[column] for x in r["r"]]) for r in rows}


def test_a_filter_has_the_response_it_says():
    n, samples = 6000, 20
    for period in (200, 40, 10):
        wave = np.sin(np.arange(n) * 2 * math.pi / period)
        out = fl.smoothed(wave, samples)[2000:4000]
        assert np.allclose(out, wave[2000:4000] * fl.gain_at(np.array([2 / period]), samples), atol=1e-9)
    assert fl.smoothed(np.full(50, 7.0), 20) == pytest.approx(7.0) and fl.smoothed(np.array([3.0]), 4) == pytest.approx(3.0)


def test_long_traces_in_overlapping_stretches(spark, monkeypatch):
    made = np.random.default_rng(1)
    values = {("a", "x"): made.poisson(40, 3000), ("b", "x"): made.poisson(10, 900)}
    for k in range(100, 2900, 170):
        values["a", "x"][k : k + 6] += 90
    df = traces(spark, values).withColumn("part_of", F.lit("kept"))
    whole = fl.fast_filter(df, 6, 2.0, 2, KEYS)
    lines = fl.fast_filter_lines(df, 16, 0.7, 2.0, 2, keys=KEYS)
    want, want_lines = arrays(whole, "slow"), arrays(lines, "slow")
    monkeypatch.setattr(fl, "CHUNK", 700)
    parted = fl.fast_filter(df, 6, 2.0, 2, KEYS)
    assert parted.count() == 3900 and set(parted.columns) == {*df.columns, "slow", "fast", "z"}
    for got, found in ((arrays(parted, "slow"), want), (arrays(fl.fast_filter_lines(df, 16, 0.7, 2.0, 2, keys=KEYS), "slow"), want_lines)):
        assert all(np.allclose(got[k], found[k], atol=1e-8) for k in found)
    direct = fl.without_excursions(values["a", "x"].astype(float), 6, 2.0, 2)
    assert np.allclose(want["a", "x"], direct, atol=1e-12)


def test_excursions_leave_the_slow_part_of_lines(spark):
    base = np.full(400, 50.0)
    pulses = base.copy()
    pulses[100:104] += 80
    df = traces(spark, {("a", "1"): pulses, ("a", "2"): base})
    slow = arrays(fl.fast_filter_lines(df, 30, 1.0, 3.0, 3, keys=KEYS), "slow")
    assert np.abs(slow["a", "1"] - 50).max() < 0.5 and np.allclose(slow["a", "2"], 50)
    unmasked = arrays(fl.fast_filter_lines(df, 30, 1.0, 0.0, 3, keys=KEYS), "slow")
    assert np.abs(unmasked["a", "1"] - 50).max() > 5
    found = fl.without_excursions_lines(np.array([1.0, 2.0, 3.0]), 4, -9.0, 1e-9, 2, True)  # may mask all
    assert len(found) == 3 and np.isfinite(found).all()


def naive_peaks(z, z_th, least, most):
    found, n, p = [], len(z), 1
    while p < n - 1:
        q = p
        while q + 1 < n and z[q + 1] == z[p]:
            q += 1
        if q + 1 < n and z[p - 1] < z[p] > z[q + 1] and z[p] >= z_th:
            m = (p + q) // 2
            i = m
            while i >= 0 and z[i] <= z[m]:
                i -= 1
            j = m
            while j < n and z[j] <= z[m]:
                j += 1
            half = z[m] - (z[m] - max(min(z[i + 1 : m + 1]), min(z[m:j]))) / 2
            a = next(k for k in range(m, -1, -1) if z[k] <= half)
            b = next(k for k in range(m, n) if z[k] <= half)
            begin = a + (half - z[a]) / (z[a + 1] - z[a]) if z[a] < half else a
            end = b - (half - z[b]) / (z[b - 1] - z[b]) if z[b] < half else b
            if least <= end - begin <= most:
                found.append((m, begin, end))
        p = q + 1
    return found


def test_prominence_against_a_plain_search():
    made = random.Random(4)
    for _ in range(300):
        n = made.randrange(1, 60)
        z = [float(made.randrange(0, 6)) if made.random() < 0.5 else made.uniform(0, 6) for _ in range(n)]
        got = fl.peak_events(np.array(z), 2.0, 0.5, 30)
        assert got == [(p, pytest.approx(a), pytest.approx(b)) for p, a, b in naive_peaks(z, 2.0, 0.5, 30)]


def test_a_base_far_away_counts(spark):
    """The lowest sample before the next higher one lies 20 timescales off; a nearer base would halve the width."""
    samples, far = 10, 200
    z = np.full(3 * far, 2.0)
    z[far] = 8.0
    z[far - 3 : far] = [6.0, 6.5, 7.0]
    z[far + 1 : far + 4] = [7.0, 6.5, 6.0]
    z[:far - 20] = np.linspace(0.0, 2.0, far - 20)
    z[far + 20 :] = np.linspace(2.0, 0.0, 2 * far - 20)
    df = traces(spark, {("a", "1"): z}).withColumnRenamed("value", "z")
    found = fl.detect_events(df, samples, 0.5, keys=KEYS, smooth=1).collect()
    assert len(found) == 1 and found[0].peakpoint == far * 0.5 and found[0].height is None
    half = 8 - 8 / 2
    left = far - 4 + (half - 2) / (6 - 2)
    assert found[0].t0 == pytest.approx(left * 0.5) and found[0].halfwidth == pytest.approx(2 * (far - left) * 0.5)


def test_heights_areas_and_samples(spark):
    n = 200
    bump = 40 * np.exp(-(((np.arange(n) - 90) / 6) ** 2))
    df = traces(spark, {("a", "1"): 100 + bump}).withColumn("slow", F.lit(100.0)).withColumn("fast", F.col("value") - 100).withColumn("z", F.col("fast") / 10)
    event = fl.detect_events(df, 20, 0.5, keys=KEYS, smooth=3).first()
    smooth = fl.running_average(bump, 3)
    a, b = int(event.t0 / 0.5), int((event.t0 + event.halfwidth) / 0.5 + 2)
    assert event.height == pytest.approx(smooth[90] / 100) and event.z_max == pytest.approx(smooth[90] / 10)
    assert event.auc == pytest.approx(smooth[a:b].sum() / 100 * 0.5) and np.allclose(event.trace, 100 + smooth[a:b]) and event.time == [k * 0.5 for k in range(a, b)]


def test_candidates_of_two_recordings(spark):
    made = np.random.default_rng(7)
    values = {}
    for rec in ("a", "b"):
        for roi in ("1", "2", "3"):
            v = 100 + made.normal(0, 10, 900)
            for at in range(60, 860, 200):
                v[at : at + 12] += 200
            values[rec, roi] = v
    df = traces(spark, values)
    found = fl.candidate_events(df, 0.5, [10.0, 20.0], 2.0, 2, keys=KEYS).collect()
    assert sorted(e.event_id for e in found) == list(range(len(found)))
    order = sorted(found, key=lambda e: (e.its, e.recording, e.roi, e.t0))
    assert [e.event_id for e in order] == list(range(len(found)))
    for key in values:
        own = [e.peakpoint for e in found if (e.recording, e.roi) == key and e.its == 0]
        assert all(any(abs(p - (at + 6) * 0.5) < 4 for p in own) for at in range(60, 860, 200))
    # One noisy trace does not change the scale of the others: the median of deviations, by recording.
    values["a", "3"] = 100 + made.normal(0, 4000, 900)
    again = fl.candidate_events(traces(spark, values), 0.5, [10.0, 20.0], 2.0, 2, keys=KEYS).collect()
    one = lambda rows, key: sorted((e.its, e.peakpoint, e.z_max) for e in rows if (e.recording, e.roi) == key)
    assert one(again, ("b", "1")) == one(found, ("b", "1"))
    before, after = one(found, ("a", "1")), one(again, ("a", "1"))
    assert len(after) >= 0.8 * len(before) and max(z for *_, z in after) > 0.5 * max(z for *_, z in before)
    z = lambda rec, roi: (lambda v, s: (v - s) / np.sqrt(np.maximum(s, 3)))(values[rec, roi], fl.without_excursions(values[rec, roi], 20, 2.0, 2))
    scale = np.median([z("a", r).std() for r in "123"])
    peak = max(e.z_max for e in again if (e.recording, e.roi, e.its) == ("a", "1", 0))
    assert peak <= z("a", "1").max() / scale + 1e-9
    hard = fl.candidate_events(traces(spark, values), 0.5, [10.0], 2.0, 2, keys=KEYS, mode="hard", smooth=1).filter("recording = 'a' and roi = '1'").agg(F.max("z_max")).first()[0]
    own = z("a", "1")
    assert hard == pytest.approx(own.max() / (1.4826 * np.median(np.abs(own - np.median(own)))))


def test_default_timescales(spark):
    scales = fl.default_timescales()
    assert scales[:3] == [4.0, 4.76, 5.66] and scales[-1] == 256.0 and len(scales) == 25
    df = traces(spark, {("a", "1"): 100 + 50 * (np.arange(400) % 40 < 8)})  # 200 units long, 0.5 apart
    used = {e.ts for e in fl.candidate_events(df, 0.5, passes=1, keys=KEYS, z_th=0.5).select("ts").collect()}
    assert used and min(used) >= 4.0 and max(used) < 200 / 3


def test_empty_and_null(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fl.fast_filter(none, 6, keys=KEYS).collect() == [] and fl.candidate_events(none, 0.5, [4.0], keys=KEYS).collect() == []
    assert fl.detect_events(none.withColumn("z", F.col("value")), 6, 0.5, keys=KEYS).collect() == []
    some = spark.createDataFrame([("a", "1", i, 0.0, None if i == 3 else 5.0) for i in range(9)] + [(None, None, i, 0.0, 5.0) for i in range(9)], SCHEMA)
    got = fl.lowpass(some, 2, KEYS).collect()
    assert len(got) == 18 and all(r.slow is None for r in got if r.roi == "1") and all(r.slow == pytest.approx(5.0) for r in got if r.roi is None)


def test_numbered(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(6)
    got = [(r.n, r.a, r.b) for r in numbered(df, ["a", "b"], "n").orderBy("n").collect()]
    assert got == [(n, *ab) for n, ab in enumerate(sorted((k % 7, k) for k in range(5000)))]
