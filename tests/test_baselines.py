"""Planted bleaching, parabolas, valleys and mixtures."""

import math
import random

import pytest

from tracemill.operators import baselines as bl


def trace(spark, f, n, name="long recording"):
    return spark.createDataFrame([(name, i, float(i), float(f(i))) for i in range(n)], "roi string, i int, t double, value double")


def test_planted_bleaching_is_the_trend(spark):
    f = lambda i: 20 + 100 * math.exp(-0.004 * i)
    got = bl.detrend(trace(spark, f, 600), "debleach", rates=[0.001, 0.004, 0.016], points=100).collect()
    assert len(got) == 600
    assert max(abs(r["detrended"]) for r in got) < 1.0


def test_short_and_empty_traces(spark):
    got = bl.debleached(trace(spark, lambda i: 2 * i + 1, 3), [0.01]).collect()
    assert all(abs(r["detrended"]) < 1e-9 for r in got)
    assert not bl.debleached(trace(spark, lambda i: i, 0), [0.01]).collect()


def test_parabola_comes_back_from_blocks(spark):
    df = trace(spark, lambda i: 5 + 0.5 * i + 0.25 * i * i, 40)
    blocks = df.groupBy("roi", (df.i / 4).cast("int").alias("i")).agg({"value": "avg"}).withColumnRenamed("avg(value)", "slow")
    got = bl.interpolated(df, blocks, 4, "slow").collect()
    # A block's mean of a square is the square at its centre and the variance inside it.
    assert len(got) == 40
    assert max(abs(r["slow"] - r["value"] - 0.25 * 1.25) for r in got) < 1e-9


def test_slow_filter_of_a_constant(spark):
    got = bl.slow_filter(trace(spark, lambda i: 7.0, 60), 30.0, 1.0, 2.0, most=10).collect()
    assert len(got) == 60 and all(abs(r["slow"] - 7) < 1e-9 and abs(r["z"]) < 1e-9 for r in got)
    with pytest.raises(ValueError):
        bl.slow_filter(trace(spark, lambda i: 7.0, 60), 30.0, 1.0, 0.0)


def values(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "x double")


def test_valley_between_two_modes(spark):
    rng = random.Random(1)
    two = [rng.gauss(0, 1) for _ in range(800)] + [rng.gauss(10, 1) for _ in range(800)] + [None]
    assert 3 < bl.separation_threshold(values(spark, two), "x").first()["threshold"] < 7
    one = bl.separation_threshold(values(spark, [i / 100 for i in range(200)] * 2), "x").first()["threshold"]
    assert one == -math.inf
    assert bl.separation_threshold(values(spark, []), "x").first()["threshold"] == -math.inf


def test_planted_mixture(spark):
    rng = random.Random(2)
    xs = [rng.gauss(0, 1) for _ in range(600)] + [rng.gauss(8, 0.5) for _ in range(300)] + [None]
    got = bl.mixture_fit(values(spark, xs), "x").collect()
    assert [r["k"] for r in got] == [2, 2]
    for r, (weight, mean, deviation) in zip(got, ((2 / 3, 0, 1), (1 / 3, 8, 0.5))):
        assert abs(r["weight"] - weight) < 0.02 and abs(r["mean"] - mean) < 0.15 and abs(r["deviation"] - deviation) < 0.1
    assert [r["k"] for r in bl.mixture_fit(values(spark, xs), "x", mindist=20.0).collect()] == [1]
    assert not bl.mixture_fit(values(spark, [None]), "x").collect()
