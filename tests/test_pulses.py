import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import pulses as pu

SCHEMA = "recording string, roi string, i int, t double, value double"
KEYS = ["recording", "roi"]
EVENTS = "recording string, roi string, event_id long, t0 double, halfwidth double"
DT = 0.25


def traces(spark, made):
    return spark.createDataFrame([(r, o, i, i * DT, float(v)) for (r, o), vs in made.items() for i, v in enumerate(vs)], SCHEMA)


@pytest.mark.parametrize(("model", "form"), [("gamma", 1.0), ("gamma", 7.0), ("lognormal", 0.2), ("lognormal", 0.9)])
def test_shapes(model, form):
    loc, width = 3.0, 2.0
    t = np.linspace(-5, 60, 650_001)
    y = pu.shares(model, t, loc, width, form)
    top = t[np.argmax(y)]
    assert y.max() == pytest.approx(1.0, abs=1e-6) and top == pytest.approx(float(pu.modes(model, loc, width, np.float64(form))), abs=1e-3)
    over = t[y >= 0.5]
    assert over[-1] - over[0] == pytest.approx(float(pu.halfwidths(model, width, form)), abs=1e-3)
    bend = np.gradient(np.gradient(y, t), t)  # from convex to concave at loc, back at loc + width
    inside = (t > loc - 0.4) & (t < loc + width + 0.4) if form != 1.0 else (t > loc + 1) & (t < loc + width + 0.4)
    turns = t[inside][np.flatnonzero(np.diff(np.sign(bend[inside])))]
    want = [loc, loc + width] if form != 1.0 else [loc + width]
    assert all(np.abs(turns - w).min() < 2e-3 for w in want)


def test_columns_are_the_same_shapes(spark):
    rows = [(m, float(t), 2.0, w, f) for m in pu.MODELS for t in np.arange(-3, 30, 0.37) for w in (0.7, 3.0) for f in (0.3, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "model string, t double, loc double, width double, form double")
    low, high = pu.support(*map(F.col, ("model", "loc", "width", "form")))
    got = df.select("*", pu.share(*map(F.col, ("model", "t", "loc", "width", "form"))).alias("h"), low.alias("low"), high.alias("high")).collect()
    for r in got:
        want = float(pu.shares(r.model, np.array([r.t]), r.loc, r.width, r.form)[0])
        assert r.h == pytest.approx(want if want >= pu.CUT else 0.0, abs=1e-9)
        assert r.h == 0 or r.low <= r.t <= r.high
    one = spark.range(1).select(*(pu.gamma_pulse(F.lit(t), F.lit(5.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias(f"t{k}") for k, t in enumerate((0.5, 1.0, 5.0, 9.0))), pu.background(F.lit(3.0), F.lit(2.0), F.lit(6.0), F.lit(10.0), F.lit(2.0)).alias("b")).first()
    assert (one.t0, one.t1, one.b) == (0.0, 0.0, 8.0) and one.t2 == pytest.approx(5.0) and one.t3 == pytest.approx(5 * 4 * np.exp(-2))


def planted(kind, form, loc, width, amplitude, n=400, offset=100.0, rise=0.0, noise=0.0, seed=0):
    t = np.arange(n) * DT
    return offset + rise * t + amplitude * pu.shares(kind, t, loc, width, form) + np.random.default_rng(seed).normal(0, noise, n)


def test_planted_pulses_are_recovered(spark):
    cases = {("a", "g"): ("gamma", 3.0), ("a", "l"): ("lognormal", 0.5), ("b", "g"): ("gamma", 8.0), ("b", "l"): ("lognormal", 0.9)}
    made = {k: planted(m, f, 40.0, 6.0, 50.0, rise=0.1 if k[0] == "b" else 0.0) for k, (m, f) in cases.items()}
    events = spark.createDataFrame([(*k, 7, 39.5, float(pu.halfwidths(m, 6.0, f)) * 1.1) for k, (m, f) in cases.items()], EVENTS)
    got = {(r.recording, r.roi): r for r in pu.fit_event_shapes(events, traces(spark, made), DT, KEYS, levels=7).collect()}
    assert len(got) == 4
    for k, (model, form) in cases.items():
        r = got[k]
        assert r.model == model and r.event_id == 7
        assert (r.loc, r.width, r.amplitude) == (pytest.approx(40.0, abs=0.3), pytest.approx(6.0, rel=0.06), pytest.approx(50.0, rel=0.05))
        assert r.halfwidth == pytest.approx(float(pu.halfwidths(model, 6.0, form)), rel=0.06) and r.chi2 < 0.02
        y = made[k]
        assert r.offset == pytest.approx(y[int((39.5 - 0.7 * 6) / DT)], abs=8)


def test_each_level_is_no_worse():
    t = np.arange(60) * DT
    y = 50 + 30 * pu.shares("gamma", t, 4.0, 2.3, 3.3)
    scores = [pu.fit_window(t, y, 3.8, 2.5, pu.Grid(), n)[-1] for n in (1, 2, 3, 5)]
    assert scores == sorted(scores, reverse=True) and scores[-1] < scores[0] / 20


def test_what_is_rejected(spark):
    flat, dip = np.full(200, 50.0), 50 - 30 * np.exp(-(((np.arange(200) - 80) / 6) ** 2))
    up = planted("gamma", 3.0, 20.0, 3.0, 40.0, 200)
    made = {("a", "flat"): flat, ("a", "dip"): dip, ("a", "up"): up, ("a", "short"): up[:5], ("a", "null"): up}
    events = spark.createDataFrame([("a", "flat", 1, 19.0, 3.0), ("a", "up", 1, 20.0, 3.0), ("a", "up", 1, 20.0, 3.0), ("a", "up", 2, 20.0, -1.0), ("a", "up", 3, 900.0, 3.0), ("a", "up", 4, None, 3.0), ("a", "short", 1, 0.0, 1.0), ("a", "none", 1, 20.0, 3.0), ("a", "null", 1, 20.0, 3.0)], EVENTS)
    samples = traces(spark, made).withColumn("value", F.when((F.col("roi") != "null") | (F.col("i") != 85), F.col("value")))
    fit = lambda **how: [(r.roi, r.event_id) for r in pu.fit_event_shapes(events, samples, DT, KEYS, **how).collect() if r.roi != "short"]
    assert fit() == [("up", 1)]
    assert fit(min_halfwidth=50.0) == [] and fit(z_th=50.0) == [] and fit(z_th=1.0) == [("up", 1)]
    assert pu.fit_event_shapes(events.limit(0), samples, DT, KEYS).collect() == []
    # beside a deep dip only the rise after it can be a pulse; its height is not above the level before
    dips = pu.fit_window(np.arange(40) * DT, dip[62:102], 18.0, 3.0, pu.Grid(), 3, jump=False)
    assert dips is None or dips[4] > 0


def test_overlapping_pulses_are_taken_apart(spark):
    t = np.arange(600) * DT
    noise = np.random.default_rng(3).normal(0, 0.5, 600)
    truth = [(30.0, 5.0, 0.3, 60.0), (37.5, 5.0, 0.3, 35.0), (100.0, 6.0, 0.4, 45.0)]
    y = 20 + noise + sum(a * pu.shares("lognormal", t, loc, w, f) for loc, w, f, a in truth)
    made = {("a", "1"): y, ("b", "1"): 20 + noise}
    got = pu.greedy_pulse_fit(traces(spark, made), 60, DT, KEYS, tolerance=0.02).collect()
    assert {r.recording for r in got} == {"a"}
    for loc, _, _, a in truth:
        near = [r for r in got if abs(r.loc - loc) < 1.5]
        assert near and abs(sum(r.amplitude for r in near) - a) < 0.25 * a
    assert max(r["round"] for r in got) >= 1 and max(r.explained for r in got) > 0.97
    by_round = {}
    for r in got:
        by_round.setdefault(r["round"], set()).add(round(r.explained, 12))
    assert all(len(v) == 1 for v in by_round.values()) and [min(by_round[k]) for k in sorted(by_round)] == sorted(min(v) for v in by_round.values())
    # the sum of what was found is the trace again
    back = pu.sum_of_pulses(spark.createDataFrame(got), traces(spark, made), DT, KEYS).filter("recording = 'a'").orderBy("i").collect()
    rest = y - np.array([r.pulses for r in back])
    assert 1 - rest.var() / y.var() == pytest.approx(max(r.explained for r in got), abs=0.01)
    # all of a round's pulses go if they explain too little
    assert pu.greedy_pulse_fit(traces(spark, made), 60, DT, KEYS, tolerance=0.9999).collect() == []
    assert pu.greedy_pulse_fit(traces(spark, made).limit(0), 60, DT, KEYS).collect() == []


def test_windows_are_fitted_side_by_side():
    """windows of any length in one call are fitted as alone; each had calls of its own for every form."""
    t = np.arange(80) * DT
    r = np.random.default_rng(4)
    windows = [(t[:n], 50 + r.normal(0, 1, n) + 30 * pu.shares(m, t[:n], 4.0, 2.3, f), 3.8, 2.5) for n, m, f in ((60, "gamma", 3.3), (9, "gamma", 2.0), (80, "lognormal", 0.4), (3, "gamma", 1.0), (33, "lognormal", 0.8))]
    windows += [(t, np.full(80, 7.0), 3.8, 2.5), (t, windows[2][1], 3.8, None), (t, np.where(t > 3, np.nan, 1.0), 3.8, 2.5)]
    jump = [True, False, True, True, False, True, True, True]
    for levels, relative in ((1, True), (4, False)):
        together = pu.fit_windows(windows, pu.Grid(), levels, jump, relative)
        alone = [pu.fit_windows([w], pu.Grid(), levels, [j], relative)[0] for w, j in zip(windows, jump, strict=True)]
        assert [k for k, row in enumerate(together) if row] == [k for k, row in enumerate(alone) if row] and together[0] and together[2] and together[4]
        assert together[3] is together[5] is together[6] is together[7] is None
        for x, y in zip(together, alone, strict=True):
            assert x is y is None or (x[0] == y[0] and x[1:] == pytest.approx(y[1:], rel=1e-9))


def test_traces_are_pursued_side_by_side():
    """the next windows of all traces are fitted in one call, with what each trace gives alone."""
    t = np.arange(300) * DT
    r = np.random.default_rng(6)
    traces_ = [(t[:n], 20 + r.normal(0, 0.5, n) + sum(40 * pu.shares("lognormal", t[:n], loc, 3.0, 0.4) for loc in locs)) for n, locs in ((300, (20.0, 50.0)), (200, (30.0,)), (300, ()))]
    how = dict(samples=30, dt=DT, z_th=3.0, rounds=4, least_drop=0.01, tolerance=0.1)
    together = pu.pursued(traces_, pu.Grid(gamma=()), 3, **how)
    assert [len(f) > 0 for f in together] == [True, True, False] and pu.pursued([], pu.Grid(), 3, **how) == []
    for one, found in zip(traces_, together, strict=True):
        alone = pu.pursued([one], pu.Grid(gamma=()), 3, **how)[0]
        assert [(a[0], a[2]) for a in alone] == [(f[0], f[2]) for f in found]
        assert all(f[3:] == pytest.approx(a[3:], rel=1e-9) for f, a in zip(found, alone, strict=True))
