import datetime
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracemill.sources import readers as rd


def test_protocol_text(spark, tmp_path):
    (tmp_path / "p.txt").write_text("compound,concentration,begin,end\nglucose,8 mM,00:00,20:00\nglucose,6mM,77:57,\nCa,,,\npH,7.4\nx,1mM,00:10,00:20,extra\n")
    got = {(r.compound, r.t_begin): (r.t_end, r.conc, r.unit) for r in rd.read_protocol(spark, str(tmp_path / "p.txt"), 5.0, 5133.9).collect()}
    assert got == {("glucose", 0.0): (1200.0, "8", "mM"), ("glucose", 4677.0): (5133.9, "6", "mM"), ("Ca", 5.0): (5133.9, "", ""), ("pH", 5.0): (5133.9, "7.4", ""), ("x", 10.0): (20.0, "1", "mM")}


def test_experiments(spark, tmp_path):
    (tmp_path / "e.csv").write_text("legs,strain,path\n\"{'stim':(100, 500.5),'rest':(600,900)}\",wt,/a\n{},ko,/b\n")
    got = {r.strain: [tuple(x) for x in r.legs] for r in rd.read_experiments(spark, str(tmp_path / "e.csv")).collect()}
    assert got == {"wt": [("stim", 100.0, 500.5), ("rest", 600.0, 900.0)], "ko": []}


def test_events_round_trip(spark, tmp_path):
    rows = [(1, 2, 4.0, 0.5, 1.5, 1.0, 1.0, 7.0, 0.1, 0.2, [0.5, 1.0, 1.5], [1.0, 2.5])]
    schema = rd.EVENT_SCHEMA.replace("time string, trace string", "time array<double>, trace array<double>")
    df = spark.createDataFrame(rows, schema).withColumn("log10_halfwidth", F.lit(0.0))
    rd.write_events(df, str(tmp_path / "ev"))
    got = rd.read_events(spark, str(tmp_path / "ev")).collect()
    assert [tuple(r) for r in got] == [tuple(df.drop("log10_halfwidth").first())]
    assert spark.range(1).select(rd.parse_array(F.lit("[1.0 2.0\n 3.5]"))).first()[0] == [1.0, 2.0, 3.5]


def test_frames_are_pruned(spark, tmp_path):
    px = spark.range(1000).select((F.col("id") % 2).alias("recording"), (F.col("id") % 10).cast("int").alias("frame"), (F.col("id") % 5).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("x"), F.lit(1.0).alias("value"))
    px.write.partitionBy("recording").parquet(str(tmp_path / "px"))
    df = rd.read_frames(spark, str(tmp_path / "px"), frames=(2, 4), recordings=[0])
    assert {(r.recording, r.frame) for r in df.collect()} == {(0, 2)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(recording" in plan and "GreaterThanOrEqual(frame,2)" in plan


def test_rois_and_tables(spark, tmp_path):
    doc = {"tag": {"0": "a", "1": "b"}, "size": {"0": "3", "1": "4"}}
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(doc, f)
    got = rd.read_rois_json(spark, str(tmp_path / "r.json.gz")).groupBy("roi").pivot("name", ["tag", "size"]).agg(F.first("cell")).collect()
    assert {tuple(r) for r in got} == {(0, "a", "3"), (1, "b", "4")}
    df = spark.createDataFrame([("r", 1, [1.0, 2.0])], "recording string, roi int, trace array<double>")
    rd.write_rois(df, str(tmp_path / "rois"), ["roi", "trace"], "2024-05-06")
    assert spark.read.parquet(str(tmp_path / "rois")).first().saved_on == datetime.date(2024, 5, 6)
    rd.save_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        rd.save_table(df, str(tmp_path / "t"))
    rd.save_table(df, str(tmp_path / "t"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "t")).first().trace == [1.0, 2.0]
    meta = spark.createDataFrame([("s", 3, datetime.datetime(2024, 1, 2, 3, 4, 5))], "name string, n int, start timestamp")
    assert rd.cache_metadata(meta, str(tmp_path / "m")).first() == meta.first()


def test_catalog(spark, tmp_path):
    for name in ("a/x.tif", "a/y.txt", "b/z.tif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1")
    got = rd.catalog(spark, str(tmp_path), ["tif"], "/a/, /c/").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["x.tif"] and got[0].length == 1
