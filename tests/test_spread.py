"""Small tables that grow before their next shuffle are dealt over all tasks."""

from pyspark.sql import functions as F

from tracemill.operators import calibration as ca
from tracemill.operators import clusters as cl
from tracemill.operators import events as ev
from tracemill.operators import filters as fl
from tracemill.operators import linescans as ls
from tracemill.operators import pulses as pu
from tracemill.operators import traces as tr
from tracemill.sources import bindings as b


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_autocorrelation_2d_joins_nothing(spark):
    px = spark.createDataFrame([(0, 0, y, x, float(y * 3 + x * x)) for y in range(3) for x in range(3)], "recording int, frame int, y int, x int, value double")
    found = ls.autocorrelation_2d(px, [0, 1], [0, 2])
    assert "Join" not in plan_of(found)
    r = {(r["dy"], r["dx"]): r["r"] for r in found.collect()}
    assert set(r) == {(0, 0), (0, 2), (1, 0), (1, 2)}
    assert abs(r[0, 0] - 1) < 1e-9 and abs(r[0, 2] - 1) < 1e-9


def test_pixels_are_dealt_before_vectors_unfold(spark, sf_dir):
    px = b.pixels(spark, sf_dir)
    assert tasks(px) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one exchange for the frames' numbers, one that deals them: the blur's sums by place need none
    assert plan_of(px.groupBy("recording", "frame", "y", "x").agg(F.sum("value"))).count("Exchange") == 2


def test_running_percentiles_round_as_sql(spark):
    """The SQL engine rounds low x (1 - share) + high x share once; F.percentile differs in 20 of these 180."""
    import math

    pairs = [(a, a + b) for a in range(1, 60, 4) for b in range(1, 60, 5)]
    values = [(roi, i, float(i), float(v)) for roi, (a, b) in enumerate(pairs) for i, v in enumerate([a, a, *[b] * 11])] + [(999, i, float(i), None) for i in range(13)]
    rows = spark.createDataFrame(values, "roi int, i int, t double, value double")
    got = {r["roi"]: r["p"] for r in tr.running(rows, 13, {"p": 0.1}).filter("i = 6").collect()}
    share = 12 * 0.1 - 1
    assert [got[roi] for roi in range(len(pairs))] == [math.fma(float(a), 1 - share, b * share) for a, b in pairs]
    assert got[999] is None
    plain = [(1 - share) * a + share * b for a, b in pairs]
    assert sum(x != got[roi] for roi, x in enumerate(plain)) > 0


def test_rows_are_dealt_before_they_meet_replicates(spark):
    points = spark.createDataFrame([(k, float(k % 5 + 1), 100.0 - k) for k in range(40)], "k long, concentration double, measurement double").coalesce(1)
    fits = ca.dose_response(points, "k", [2.0, 4.0], [1.0], True, 3)
    assert "REPARTITION_BY_NUM" in plan_of(fits)
    found = ca.infer_concentrations(points, "k", fits, 0.0, True)
    assert "REPARTITION_BY_NUM" in plan_of(found)
    assert found.count() == 40


def test_candidates_are_not_dealt_by_timescale(spark):
    z = spark.createDataFrame([(0, 1, 2.0), (0, 2, 4.0), (1, 1, 8.0)], "its int, roi int, deviation double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fl.scaled(z, ["roi"], "soft")
        assert "SortMergeJoin" not in plan_of(found)
        assert sorted(r["scale"] for r in found.collect()) == [3.0, 3.0, 8.0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_weekly_traces_are_dealt_by_supplier(spark, tmp_path):
    """Empty weeks, weeks before the first one and nulls, on a grid without a join."""
    days = [(7, "1995-01-17", 2.0), (7, "1995-01-18", 3.0), (7, "1995-02-06", 1.0), (8, "1994-12-01", 9.0), (9, "1995-01-02", None), (9, None, 4.0)]
    rows = spark.createDataFrame(days, "l_suppkey long, l_shipdate string, l_quantity double").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    week = b.traces_week(spark, str(tmp_path))
    got = {(r["roi"], r["i"]): (r["t"], r["value"]) for r in week.collect()}
    assert got == {(roi, i): (7.0 * i, {(7, 2): 5.0, (7, 5): 1.0}.get((roi, i), 0.0)) for roi in (7, 8, 9) for i in range(6)}
    assert "SortMergeJoin" not in plan_of(week)
    assert week.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = week.groupBy("roi").agg(F.sum("value"))
    assert plan_of(summed).count("Exchange hashpartitioning(roi") == 2


def test_hard_rescale_reads_its_traces_once(spark):
    z = spark.createDataFrame([(r, i, float(v)) for r in (1, 2) for i, v in enumerate([0, r, 2 * r, 3 * r, 10 * r])] + [(None, 0, 1.0)], "roi int, i int, z double")
    found = tr.rescale(z, "hard", ())
    assert "Join" not in plan_of(found)
    got = {(r["roi"], r["i"]): r["z"] for r in found.collect()}
    assert set(got) == {(r, i) for r in (1, 2) for i in range(5)}
    assert all(abs(got[r, i] - v / 1.4826) < 1e-12 for r in (1, 2) for i, v in enumerate([0, 1, 2, 3, 10]))


def test_batches_are_worked_in_portions():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([[float(k)] * (k % 3) for k in range(600)])], names=["rows"])
    parts = list(fl.portions(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= fl.PORTION
    assert pa.Table.from_batches(parts).column("rows").to_pylist() == batch.column("rows").to_pylist()


def test_pairs_of_traces_are_not_shuffled(spark):
    """Stretches of a cell are added up where they meet; traces may lack samples or whole stretches."""
    import numpy as np

    made = np.random.default_rng(5)
    values = {roi: {i: float(made.normal()) for i in range(12) if (i + roi) % 5 and not (roi == 3 and i < 8)} for roi in range(6)}
    rows = spark.createDataFrame([("a", roi, i, v) for roi, own in values.items() for i, v in own.items()], "recording string, roi int, i int, value double")
    found = cl.correlation_matrix(rows, block=2, stretch=4)
    plan = plan_of(found)
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
    centred = {roi: {i: v - np.mean(list(own.values())) for i, v in own.items()} for roi, own in values.items()}
    got = {(r["roi_a"], r["roi_b"]): r["r"] for r in found.collect()}
    for a in range(6):
        for c in range(a + 1, 6):
            both = sorted(set(values[a]) & set(values[c]))
            assert abs(got.pop((a, c)) - np.corrcoef([centred[a][i] for i in both], [centred[c][i] for i in both])[0, 1]) < 1e-9
    assert not got


def test_edges_are_made_once(spark):
    from tracemill.operators.components import components

    made = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(1, 1), (1, 2), (2, 1), (3, 3), (5, 4)]).map(lambda e: made.add(1) or e)
    found = components(spark.createDataFrame(rows, "a long, b long"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)}
    assert made.value == 5


def test_range_join_has_every_pair_and_few_copies(spark):
    made = [(k, float(t0), t0 + hw) for k, (t0, hw) in enumerate((t0 / 7, 2.0**e / 3) for t0 in range(0, 300, 13) for e in (-2, 0, 1, 2, 3, 5))]
    rows = spark.createDataFrame([(0, *e) for e in made], "roi int, b_id int, b_t0 double, b_tend double")
    seeds = rows.select("roi", F.col("b_id").alias("a_id"), F.col("b_t0").alias("a_t0"), F.col("b_tend").alias("a_tend"), (F.col("b_tend") - F.col("b_t0")).alias("a_hw"))
    for tol in (0.2, 0.45):
        got = sorted((r["a_id"], r["b_id"]) for r in ev.binned(seeds, rows, tol, ["roi"]).collect())
        near = lambda a, c: abs(a[1] - c[1]) < tol * (a[2] - a[1]) and abs(a[2] - c[2]) < tol * (a[2] - a[1])
        assert got == sorted((a[0], c[0]) for a in made for c in made if near(a, c))


def test_fits_of_a_row_are_one_array(spark):
    fits = spark.createDataFrame([(rep, 4.0, 1.0, 0.0, 10.0 + rep) for rep in range(41)], "rep int, ec50 double, h double, bottom double, top double")
    measured = spark.createDataFrame([(k, m) for k, m in enumerate([5.0, 2.0, 9.5, -1.0, None])], "k long, measurement double")
    found = ca.infer_concentrations(measured, "k", fits, 0.1)
    assert "Explode" not in plan_of(found) and "keys=[row_key" not in plan_of(found)
    got = {r["k"]: r for r in found.collect()}
    assert abs(got[0]["inferred"] - 4.0) < 1e-12
    each = sorted(4.0 * (5.0 / (10.0 + rep)) / (1 - 5.0 / (10.0 + rep)) for rep in range(1, 41))
    assert abs(got[0]["low"] - (each[0] * 0.025 + each[1] * 0.975)) < 1e-9
    assert got[3]["inferred"] is None and got[4]["inferred"] is None and got[3]["low"] is None


def test_pulses_are_dealt_before_they_become_samples(spark):
    pulses = spark.createDataFrame([(1, "gamma", 10.0, 4.0, 2.0, 3.0), (1, "lognormal", 14.0, 4.0, 0.3, 1.0)], "roi int, model string, loc double, width double, form double, amplitude double")
    samples = spark.range(40).selectExpr("1 as roi", "cast(id as int) as i")
    found = pu.sum_of_pulses(pulses, samples, 1.0)
    plan = plan_of(found)
    sums = plan[plan.index("HashAggregate") : plan.index("Generate")]
    assert "Exchange" not in sums
    assert found.filter("pulses > 1").count() > 0 and found.count() == 40
