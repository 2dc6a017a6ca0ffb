import math

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tracemill.functions.numbers import ln
from tracemill.operators import traces as tr
from tracemill.plans import SQL

FIT = "WITH " + SQL["t13_fit_mean_variance"][SQL["t13_fit_mean_variance"].index("lg AS") :]


def near(k, bits):
    x = k / 65
    for _ in range(abs(bits)):
        x = math.nextafter(x, math.inf if bits > 0 else 0.0)
    return x


def test_logarithms_equal_the_engines(spark):
    """F.ln gave another last bit for one in fifty."""
    pt = pd.DataFrame({"x": [near(k, bits) for k in range(1, 1600) for bits in range(-3, 4)]})  # noqa: F841
    want = dict(duckdb.sql("SELECT x, ln(x) FROM pt").fetchall())
    assert {r.x: r.l for r in spark.createDataFrame(pt).select("x", ln("x").alias("l")).collect()} == want


def test_quantiles_equal_the_engines(spark):
    """F.percentile gives the value itself between two equal ones and rounds both products otherwise."""
    for n, x in ((33, math.log(344 / 65)), (45, math.log(51 / 65)), (48, 2.7906930757057693), (1, 0.1)):
        for values in ([x] * n, [x * (1 + k / 7) for k in range(n)]):
            pt = pd.DataFrame({"x": values})  # noqa: F841
            want = duckdb.sql("SELECT quantile_cont(x, 0.01), quantile_cont(x, 0.99), quantile_cont(x, 0.5) FROM pt").fetchall()[0]
            assert tr.quantiles(spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(3), "x", [0.01, 0.99, 0.5]) == list(want)
    assert tr.quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_means_a_bit_apart_at_the_last_end(spark):
    """twelve points one bit below the last end make a bin of their own; F.ln took them for points at the end, which are left out."""
    spread = [(k / 65, 4.0 + k % 7) for k in range(3, 1150)]
    pt = pd.DataFrame(spread * 2 + [(near(1289, 0), 400.0)] * 12 + [(near(1289, 1), 400.0)] * 40, columns=["mean", "variance"])
    want = duckdb.sql(FIT).fetchall()[0]
    assert tuple(tr.two_parameter_fit(spark.createDataFrame(pt)).select(F.round("exponent", 3) + 0.0, F.round("factor", 1)).first()) == want


def test_no_points(spark):
    assert tuple(tr.two_parameter_fit(spark.createDataFrame([(1.0, 0.0)], "mean double, variance double")).first()) == (None, None)
