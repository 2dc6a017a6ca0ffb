import random

import numpy as np

from tracemill.operators.mixed import effect_mixed, effect_nested


def dense_reml(rows, legs, theta):
    y = np.array([v for _, _, v in rows])
    x = np.array([[leg == a for a in legs] for _, leg, _ in rows], float)
    same = np.array([[a[0] == b[0] for b in rows] for a in rows], float)
    v = np.eye(len(rows)) + theta * same
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    e = y - x @ beta
    s2 = e @ vi @ e / (len(y) - len(legs))
    return -0.5 * ((len(y) - len(legs)) * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), beta


def test_against_dense_matrices(spark):
    r = random.Random(9)
    rows = []
    for g in range(12):
        u = r.gauss(0, 0.4)
        for leg, effect in (("a", 0.0), ("b", 0.2), ("c", -0.1)):
            rows += [(g, leg, u + effect + r.gauss(0, 0.2)) for _ in range(r.randint(3, 8))]
    events = spark.createDataFrame([(g, leg, 10**y) for g, leg, y in rows] + [(99, "a", 5.0), (1, None, 1.0), (1, "a", None)], "roi int, leg string, halfwidth double")
    got = {x.leg: x for x in effect_mixed(events, "halfwidth", "a", least=3).collect()}
    theta = got["b"].theta
    here, beta = dense_reml(rows, ["a", "b", "c"], theta)
    assert all(here >= dense_reml(rows, ["a", "b", "c"], theta * f)[0] - 1e-3 for f in (0.3, 0.8, 1.25, 3))
    assert abs(got["b"].coef - (beta[1] - beta[0])) < 1e-9 and abs(got["c"].coef - (beta[2] - beta[0])) < 1e-9
    assert abs(got["b"].coef - 0.2) < 0.08 and got["b"].p < 0.01


def test_nothing_eligible(spark):
    events = spark.createDataFrame([(1, "a", 1.0)], "roi int, leg string, halfwidth double")
    assert effect_mixed(events, "halfwidth", "a", legs=["a", "b"]).count() == 0


def dense_nested(rows, legs, theta, phi):
    y = np.array([r[3] for r in rows])
    x = np.array([[r[2] == a for a in legs] for r in rows], float)
    roi = np.array([[a[:2] == b[:2] for b in rows] for a in rows], float)
    experiment = np.array([[a[0] == b[0] for b in rows] for a in rows], float)
    v = np.eye(len(rows)) + theta * roi + phi * experiment
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    e = y - x @ beta
    s2 = e @ vi @ e / (len(y) - len(legs))
    return -0.5 * ((len(y) - len(legs)) * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), beta, s2 * np.linalg.inv(a)


def test_nested_against_dense_matrices(spark):
    r = random.Random(2)
    rows = []
    for e in range(7):
        w = r.gauss(0, 0.5)
        for g in range(5):
            u = r.gauss(0, 0.3)
            for leg, effect in (("a", 0.0), ("b", 0.2), ("c", -0.1)):
                rows += [(e, g, leg, w + u + effect + r.gauss(0, 0.2)) for _ in range(r.randint(2, 5))]
    events = spark.createDataFrame([(e, g, leg, 10**y) for e, g, leg, y in rows] + [(9, 1, "a", 5.0), (1, 1, None, 1.0), (1, 1, "a", None)], "recording int, roi int, leg string, halfwidth double")
    got = {x.leg: x for x in effect_nested(events, "halfwidth", "a", least=2).collect()}
    theta, phi = got["b"].theta, got["b"].theta_outer
    here, beta, covariance = dense_nested(rows, ["a", "b", "c"], theta, phi)
    assert 0.5 < theta < 8 and 0.5 < phi < 60
    for f in (0.3, 0.7, 0.9, 1.0, 1.1, 1.4, 3):
        for h in (0.3, 0.7, 0.9, 1.0, 1.1, 1.4, 3):
            assert here >= dense_nested(rows, ["a", "b", "c"], theta * f, phi * h)[0] - 1e-3
    for k, leg in ((1, "b"), (2, "c")):
        assert abs(got[leg].coef - (beta[k] - beta[0])) < 1e-9
        assert abs(got[leg].se**2 - (covariance[k, k] + covariance[0, 0] - 2 * covariance[0, k])) < 1e-9
    # the same roi names in other experiments are other rois
    alone = {x.leg: x for x in effect_mixed(events.filter("recording < 9"), "halfwidth", "a", least=2).collect()}
    assert alone["b"].theta != theta
    assert effect_nested(events.limit(0), "halfwidth", "a", legs=["a", "b"]).count() == 0
