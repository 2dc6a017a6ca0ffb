"""Readers and writers of the text formats that recordings come with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.protocols import parse_times, split_concentration

PROTOCOL_COLUMNS = ["compound", "concentration", "begin", "end"]
EVENT_SCHEMA = "event_id long, roi long, ts double, t0 double, tend double, peakpoint double, halfwidth double, z_max double, height double, auc double, time string, trace string"


def read_protocol(spark: SparkSession, path: str, t0: float = 0.0, tend: float = 0.0) -> DataFrame:
    """Lines compound,concentration,begin,end: short lines are padded, long ones cut, blanks are null; one recording a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("recording"), F.split("value", ",").alias("f"))
    field = lambda k: F.nullif(F.trim(F.coalesce(F.try_element_at("f", F.lit(k + 1)), F.lit(""))), F.lit(""))
    rows = lines.select("recording", *(field(k).alias(c) for k, c in enumerate(PROTOCOL_COLUMNS))).filter("compound is not null and lower(compound) != 'compound'")
    return parse_times(split_concentration(rows.fillna("", ["concentration"])), t0, tend)


def parse_legs(text: Column) -> Column:
    """{'name': (begin, end), ...} as an array of structs leg, leg_begin, leg_end."""
    items = F.regexp_extract_all(text, F.lit(r"'?\w+'?\s*:\s*\(\s*[0-9.]+\s*,\s*[0-9.]+\s*\)"), F.lit(0))
    part = lambda s, k: F.regexp_extract(s, r"'?(\w+)'?\s*:\s*\(\s*([0-9.]+)\s*,\s*([0-9.]+)\s*\)", k)
    return F.transform(items, lambda s: F.struct(part(s, 1).alias("leg"), part(s, 2).cast("double").alias("leg_begin"), part(s, 3).cast("double").alias("leg_end")))


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of experiments; a column legs is parsed to an array."""
    df = spark.read.csv(path, header=True, quote='"')
    return df.withColumn("legs", parse_legs(F.col("legs"))) if "legs" in df.columns else df


def parse_array(text: Column) -> Column:
    """"[1.0 2.0 ...]" over any number of lines as doubles."""
    return F.transform(F.split(F.trim(F.regexp_replace(text, r"[\[\],\s]+", " ")), " +"), lambda x: x.try_cast("double"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, schema=EVENT_SCHEMA)
    return df.withColumn("time", parse_array(F.col("time"))).withColumn("trace", parse_array(F.col("trace")))


def write_events(events: DataFrame, path: str) -> None:
    """CSV; arrays become text, logarithms are left out."""
    text = lambda c: F.concat(F.lit("["), F.concat_ws(" ", F.transform(c, lambda x: x.cast("string"))), F.lit("]"))
    kept = [c for c in events.columns if not c.startswith("log10_")]
    arrays = {f.name for f in events.schema if f.dataType.typeName() == "array"}
    events.select(*(text(c).alias(c) if c in arrays else F.col(c) for c in kept)).write.csv(path, header=True)


def read_frames(spark: SparkSession, path: str, frames: tuple[int, int] | None = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None, recordings: list | None = None) -> DataFrame:
    """A parquet table of pixels, pruned to half-open ranges and recordings by the scan."""
    df = spark.read.parquet(path)
    for column, span in (("frame", frames), ("y", y), ("x", x)):
        if span is not None:
            df = df.filter((F.col(column) >= span[0]) & (F.col(column) < span[1]))
    return df.filter(F.col("recording").isin(recordings)) if recordings is not None else df


def write_rois(rois: DataFrame, path: str, columns: list[str], saved_on: str) -> None:
    """Chosen columns by recording, with the date of saving."""
    rois.select("recording", *columns).withColumn("saved_on", F.lit(saved_on).cast("date")).write.partitionBy("recording").parquet(path)


def read_rois_json(spark: SparkSession, path: str) -> DataFrame:
    """A column-oriented document {column: {index: value}} as one row an index; gzip is read as it is."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("d"))
    cells = raw.select(F.explode("d").alias("name", "cells")).select("name", F.explode("cells").alias("roi", "cell"))
    return cells.select(F.col("roi").cast("long").alias("roi"), "name", "cell")


def save_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Any table, vectors included; an existing path is an error unless overwrite."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_sweeps(df: DataFrame, path: str) -> None:
    """One folder of CSV a sweep."""
    df.write.partitionBy("sweep").csv(path, header=True)


def write_shifts(shifts: DataFrame, path: str) -> None:
    """Shifts of a recording's frames as CSV in order of frames, one folder a recording."""
    shifts.select("recording", "frame", "dy", "dx").repartitionByRange("recording", "frame").sortWithinPartitions("recording", "frame").write.partitionBy("recording").csv(path, header=True)


def cache_metadata(series: DataFrame, path: str) -> DataFrame:
    """Series metadata through a CSV beside the data, read back with its types."""
    series.write.csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return series.sparkSession.read.csv(path, header=True, schema=series.schema, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")


def catalog(spark: SparkSession, root: str, extensions: list[str], constraint: str = "") -> DataFrame:
    """path, length and time of files under root with one of the extensions whose path holds any part of the constraint."""
    from tracemill.operators.recordings import constrained

    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
    return constrained(files, "path", constraint)


def tidy_calibration(wide: DataFrame, key: str = "concentration") -> DataFrame:
    """key, replicate, measurement: the columns of replicates one below the other; empty cells go."""
    names = [c for c in wide.columns if c != key]
    return wide.unpivot([key], names, "replicate", "measurement").filter("measurement is not null")


def read_calibration(spark: SparkSession, path: str, key: str = "concentration") -> DataFrame:
    """A table of concentrations and replicate measurements (CSV with a header), tidy."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    return tidy_calibration(wide.select(*(F.col(c).cast("double").alias(c) for c in wide.columns)), key)


def wide_traces(traces: DataFrame, number: str = "value") -> DataFrame:
    """A row a time: t, n_rois and row_values, the rois' values in order of roi, joined by commas. number is an expression of the value."""
    in_order = F.sort_array(F.collect_list(F.struct("roi", F.expr(number).cast("string").alias("v"))))
    return traces.groupBy("t").agg(F.count(F.lit(1)).alias("n_rois"), F.array_join(F.transform(in_order, lambda x: x["v"]), ",").alias("row_values"))


def roi_coordinates(roi_pixels: DataFrame) -> DataFrame:
    """roi, y, x: the mean place of each roi's pixels."""
    return roi_pixels.groupBy("roi").agg(F.avg("y").alias("y"), F.avg("x").alias("x"))


def write_wide_traces(traces: DataFrame, roi_pixels: DataFrame, path: str) -> None:
    """A recording's traces and roi coordinates as blank-separated text: path/traces has a line a time, time first,
    path/coords a line a roi; both in order of time and of roi over their files."""
    rows = wide_traces(traces).withColumn("line", F.concat_ws(" ", F.col("t").cast("string"), F.translate("row_values", ",", " ")))
    rows.repartitionByRange("t").sortWithinPartitions("t").select("line").write.text(f"{path}/traces")
    coords = roi_coordinates(roi_pixels).withColumn("line", F.concat_ws(" ", F.col("y").cast("string"), F.col("x").cast("string")))
    coords.repartitionByRange("roi").sortWithinPartitions("roi").select("line").write.text(f"{path}/coords")
