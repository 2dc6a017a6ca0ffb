"""Random-intercept models of log10 of a quantity on legs, from sufficient statistics of groups.

With one random intercept a group's inverse covariance is (I - theta / (1 + n theta) 11') / s2, so
the likelihood needs only counts and sums by group and leg. theta, the ratio of variances, is found
on a grid: all its values in one job over the groups, refined twice. What reaches the driver is one
row a value of theta and pair of legs.

With groups nested in outer ones (rois in experiments) there is a second ratio. Given the first, an outer
group's inverse covariance differs by one more rank-one term, made of sums over its groups, so both
likelihood terms are sums again and every pair of ratios is tried in the same two jobs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.tables import written

GRID = [0.0, *(10.0**k for k in range(-4, 5))]


def eligible(events: DataFrame, column: str, group: str, least: int, n_legs: int) -> DataFrame:
    """Rows with a leg and a positive quantity, of groups with at least so many in every leg."""
    rows = events.filter(F.col("leg").isNotNull() & (F.col(column) > 0)).select(F.col(group).alias("g"), "leg", F.log10(column).alias("y"))
    full = rows.groupBy("g", "leg").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == n_legs)
    return rows.join(full.select("g"), "g", "left_semi")


def statistics(rows: DataFrame) -> DataFrame:
    """Per group and leg count and sum, and the group's totals."""
    cells = rows.groupBy("g", "leg").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    return cells.groupBy("g").agg(F.collect_list(F.struct("leg", "n", "s")).alias("cells"), F.sum("n").alias("n_g"), F.sum("s").alias("s_g"), F.sum("q").alias("q_g"))


def _likelihood(groups: DataFrame, grid: list[float], legs: list[str]) -> list[tuple]:
    """(REML log likelihood, theta, coefficients of legs, their covariance over s2, s2)."""
    at = groups.withColumn("theta", F.explode(F.array(*map(F.lit, grid)))).withColumn("c", F.col("theta") / (1 + F.col("n_g") * F.col("theta")))
    total = {r["theta"]: r for r in at.groupBy("theta").agg(F.sum("n_g").alias("n"), F.sum(F.log1p(F.col("n_g") * F.col("theta"))).alias("logdet"), F.sum(F.col("q_g") - F.col("c") * F.col("s_g") * F.col("s_g")).alias("q")).collect()}
    one = at.select("theta", "c", "s_g", "cells", F.explode("cells").alias("a"))
    sums = one.groupBy("theta", "a.leg").agg(F.sum("a.n").alias("n"), F.sum(F.col("a.s") - F.col("c") * F.col("a.n") * F.col("s_g")).alias("b")).collect()
    pairs = one.select("theta", "c", "a", F.explode("cells").alias("d")).groupBy("theta", F.col("a.leg").alias("x"), F.col("d.leg").alias("z")).agg(F.sum(F.col("c") * F.col("a.n") * F.col("d.n")).alias("w")).collect()
    place, found = {leg: i for i, leg in enumerate(legs)}, []
    for theta, t in total.items():
        a, rhs = np.zeros((len(legs), len(legs))), np.zeros(len(legs))
        for r in sums:
            if r["theta"] == theta:
                a[place[r["leg"]], place[r["leg"]]] += r["n"]
                rhs[place[r["leg"]]] = r["b"]
        for r in pairs:
            if r["theta"] == theta:
                a[place[r["x"]], place[r["z"]]] -= r["w"]
        inverse = np.linalg.inv(a)
        beta = inverse @ rhs
        free = t["n"] - len(legs)
        s2 = max(t["q"] - rhs @ beta, 1e-300) / free
        found.append((-0.5 * (free * math.log(s2) + t["logdet"] + np.linalg.slogdet(a)[1]), theta, beta, inverse, s2))
    return found


def effect_mixed(events: DataFrame, column: str, ref: str, group: str = "roi", least: int = 10, legs: list[str] | None = None) -> DataFrame:
    """Per leg coefficient against the reference leg, its error, z, p and effect in percent; theta beside them."""
    spark = events.sparkSession
    legs = legs or sorted(r["leg"] for r in events.filter("leg is not null").select("leg").distinct().collect())
    groups = statistics(eligible(events, column, group, least, len(legs))).cache()
    grid, best = GRID, None
    for width in (10.0, 2.0, 1.2):
        found = _likelihood(groups, grid, legs)
        if not found:
            break
        best = max(found, key=lambda f: f[0])
        step = width ** (1 / 4)
        grid = [best[1] * step**k for k in range(-4, 5)] if best[1] else [0.0, 1e-6, 1e-5]
    groups.unpersist()
    rows = []
    if best:
        _, theta, beta, inverse, s2 = best
        k = legs.index(ref)
        for i, leg in enumerate(legs):
            if i != k:
                coef, se = beta[i] - beta[k], math.sqrt(s2 * (inverse[i, i] + inverse[k, k] - 2 * inverse[i, k]))
                rows.append((leg, float(coef), se, float(coef / se), math.erfc(abs(coef / se) / math.sqrt(2)), float((10**coef - 1) * 100), float(theta)))
    return spark.createDataFrame(rows, "leg string, coef double, se double, z double, p double, effect double, theta double")


def _weighted(groups: DataFrame, grid: list[float]) -> DataFrame:
    """Groups at each ratio of the grid: c and w take the group's own intercept out of sums of products and of sums."""
    at = groups.withColumn("theta", F.explode(F.array(*map(F.lit, grid))))
    return at.withColumn("w", 1 / (1 + F.col("n_g") * F.col("theta"))).withColumn("c", F.col("theta") * F.col("w"))


def _nested_likelihood(groups: DataFrame, inner: list[float], outer: list[float], legs: list[str]) -> list[tuple]:
    """(REML log likelihood, (ratio of groups, of outer groups), coefficients, their covariance over s2, s2) of all pairs."""
    at = _weighted(groups, inner)
    place, k = {leg: i for i, leg in enumerate(legs)}, len(legs)
    total = {r["theta"]: r for r in at.groupBy("theta").agg(F.sum("n_g").alias("n"), F.sum(F.log1p(F.col("n_g") * F.col("theta"))).alias("logdet"), F.sum(F.col("q_g") - F.col("c") * F.col("s_g") * F.col("s_g")).alias("q")).collect()}
    one = at.select("theta", "outer", "c", "w", "s_g", "cells", F.explode("cells").alias("a"))
    a, b = {t: np.zeros((k, k)) for t in inner}, {t: np.zeros(k) for t in inner}
    for r in one.groupBy("theta", "a.leg").agg(F.sum("a.n").alias("n"), F.sum(F.col("a.s") - F.col("c") * F.col("a.n") * F.col("s_g")).alias("b")).collect():
        a[r["theta"]][place[r["leg"]], place[r["leg"]]] += r["n"]
        b[r["theta"]][place[r["leg"]]] = r["b"]
    for r in one.select("theta", "c", "a", F.explode("cells").alias("d")).groupBy("theta", F.col("a.leg").alias("x"), F.col("d.leg").alias("z")).agg(F.sum(F.col("c") * F.col("a.n") * F.col("d.n")).alias("v")).collect():
        a[r["theta"]][place[r["x"]], place[r["z"]]] -= r["v"]
    # what each outer group adds: h, its weight, and its weighted sums of y and of each leg's indicator
    legs_of = one.groupBy("theta", "outer", "a.leg").agg(F.sum(F.col("a.n") * F.col("w")).alias("g")).groupBy("theta", "outer").agg(F.collect_list(F.struct("leg", "g")).alias("gs"))
    sums = at.groupBy("theta", "outer").agg(F.sum(F.col("n_g") * F.col("w")).alias("h"), F.sum(F.col("s_g") * F.col("w")).alias("gy"))
    same = [F.col("l.theta") == F.col("r.theta"), F.col("l.outer").eqNullSafe(F.col("r.outer"))]
    outers = sums.alias("l").join(legs_of.alias("r"), same).select("l.theta", "h", "gy", "gs").withColumn("phi", F.explode(F.array(*map(F.lit, outer)))).withColumn("k", F.col("phi") / (1 + F.col("phi") * F.col("h")))
    more = {(r["theta"], r["phi"]): r for r in outers.groupBy("theta", "phi").agg(F.sum(F.log1p(F.col("phi") * F.col("h"))).alias("logdet"), F.sum(F.col("k") * F.col("gy") * F.col("gy")).alias("q")).collect()}
    each = outers.select("theta", "phi", "k", "gy", "gs", F.explode("gs").alias("x"))
    minus_b, minus_a = {p: np.zeros(k) for p in more}, {p: np.zeros((k, k)) for p in more}
    for r in each.groupBy("theta", "phi", "x.leg").agg(F.sum(F.col("k") * F.col("x.g") * F.col("gy")).alias("v")).collect():
        minus_b[r["theta"], r["phi"]][place[r["leg"]]] = r["v"]
    for r in each.select("theta", "phi", "k", "x", F.explode("gs").alias("z")).groupBy("theta", "phi", F.col("x.leg").alias("i"), F.col("z.leg").alias("j")).agg(F.sum(F.col("k") * F.col("x.g") * F.col("z.g")).alias("v")).collect():
        minus_a[r["theta"], r["phi"]][place[r["i"]], place[r["j"]]] = r["v"]
    found = []
    for (theta, phi), t in more.items():
        full, rhs = a[theta] - minus_a[theta, phi], b[theta] - minus_b[theta, phi]
        inverse = np.linalg.inv(full)
        beta = inverse @ rhs
        free = total[theta]["n"] - k
        s2 = max(total[theta]["q"] - t["q"] - rhs @ beta, 1e-300) / free
        found.append((-0.5 * (free * math.log(s2) + total[theta]["logdet"] + t["logdet"] + np.linalg.slogdet(full)[1]), (theta, phi), beta, inverse, s2))
    return found


def effect_nested(events: DataFrame, column: str, ref: str, group: str = "roi", outer: str = "recording", least: int = 10, legs: list[str] | None = None) -> DataFrame:
    """As effect_mixed with an intercept for each outer group and one for each group in it; theta and theta_outer are their ratios to the residual variance.

    Groups of one name in two outer groups are two groups. A null outer group is one of its own.
    """
    spark = events.sparkSession
    legs = legs or sorted(r["leg"] for r in events.filter("leg is not null").select("leg").distinct().collect())
    named = events.withColumn("g_", F.struct(F.col(outer).alias("outer"), F.col(group).alias("inner")))
    groups = written(statistics(eligible(named, column, "g_", least, len(legs))).withColumn("outer", F.col("g.outer")), "groups")
    inner, around, best = GRID, GRID, None
    for width in (10.0, 4.0, 2.0, 1.3, 1.1):
        found = _nested_likelihood(groups, inner, around, legs)
        if not found:
            break
        best = max(found, key=lambda f: f[0])
        step = width ** (1 / 2)
        inner, around = ([x * step**k for k in range(-2, 3)] if x else [0.0, 1e-6, 1e-5] for x in best[1])
    rows = []
    if best:
        _, (theta, phi), beta, inverse, s2 = best
        k = legs.index(ref)
        for i, leg in enumerate(legs):
            if i != k:
                coef, se = beta[i] - beta[k], math.sqrt(s2 * (inverse[i, i] + inverse[k, k] - 2 * inverse[i, k]))
                rows.append((leg, float(coef), se, float(coef / se), math.erfc(abs(coef / se) / math.sqrt(2)), float((10**coef - 1) * 100), float(theta), float(phi)))
    return spark.createDataFrame(rows, "leg string, coef double, se double, z double, p double, effect double, theta double, theta_outer double")
