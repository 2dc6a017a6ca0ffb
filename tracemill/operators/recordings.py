"""Operators on series(recording, series, start, end, duration, size_t, px_size) and on catalogs of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def own():
    """The series of a recording in order."""
    return Window.partitionBy("recording").orderBy("series")


def gaps(series: DataFrame) -> DataFrame:
    """Time from the end of the series before; null for the first."""
    return series.withColumn("gap", F.col("start") - F.lag("end").over(own()))


def group_series(series: DataFrame, most: float) -> DataFrame:
    """Series in sequence: a new group where the gap is unknown or beyond most either way, or the pixel size changes."""
    new = F.col("gap").isNull() | (F.abs("gap") > most) | (F.col("px_size") != F.lag("px_size").over(own()))
    rows = gaps(series).withColumn("new", new.cast("int")).withColumn("part", F.sum("new").over(own()))
    found = rows.groupBy("recording", "part").agg(F.min("series").alias("first"), F.max("series").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("size_t").alias("frames"))
    label = F.when(F.col("first") == F.col("last"), F.format_string("Series%03d", F.col("first").cast("int"))).otherwise(F.format_string("Series%03d-%d", F.col("first").cast("int"), F.col("last").cast("int")))
    return found.withColumn("label", label)


def merged_offsets(series: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """First frame of each series when all of a recording are joined, and whether its frequency fits their mean."""
    f = F.col("size_t") / F.nullif(F.col("duration"), F.lit(0.0))
    before = own().rowsBetween(Window.unboundedPreceding, -1)
    mean = F.avg("frequency").over(Window.partitionBy("recording"))
    rows = series.withColumn("frequency", f).withColumn("mean_frequency", mean)
    return rows.withColumn("first_frame", F.coalesce(F.sum("size_t").over(before), F.lit(0))).withColumn("fits", F.abs(F.col("frequency") - F.col("mean_frequency")) <= tolerance * F.col("mean_frequency"))


def timing(series: DataFrame) -> DataFrame:
    """Frequency from frames and duration, and the end floored to a whole unit."""
    return series.withColumn("frequency", F.col("size_t") / F.nullif(F.col("duration"), F.lit(0.0))).withColumn("floor_end", F.floor(F.col("start") + F.col("duration")))


def clock(x: Column) -> Column:
    """Seconds as h:mm:ss without leading zeros and colons."""
    text = F.format_string("%d:%02d:%02d", F.floor(x / 3600), F.floor(F.pmod(x, F.lit(3600)) / 60), F.pmod(x, F.lit(60)).cast("bigint"))
    return F.regexp_replace(text, "^[0:]+(?=.)", "")


def durations_text(series: DataFrame) -> DataFrame:
    """Cumulative ranges of the series of a recording, one a line."""
    w = own().rowsBetween(Window.unboundedPreceding, 0)
    rows = series.withColumn("until", F.sum("duration").over(w)).withColumn("line", F.concat_ws("-", clock(F.col("until") - F.col("duration")), clock(F.col("until"))))
    return rows.groupBy("recording").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("series", "line"))), lambda s: s["line"]), "\n").alias("ranges"))


def constrained(paths: DataFrame, column: str, constraint: str) -> DataFrame:
    """Paths that hold any of the comma-separated parts."""
    parts = [p.strip() for p in constraint.split(",") if p.strip()]
    keep = F.lit(not parts)
    for p in parts:
        keep = keep | F.contains(F.col(column), F.lit(p))
    return paths.filter(keep)


def frequency_from_name(name: Column) -> Column:
    """Number before "Hz" in a name."""
    return F.nullif(F.regexp_extract(name, r"([0-9.]+)[ _]*Hz", 1), F.lit("")).try_cast("double")


def additional_info(df: DataFrame, column: str) -> DataFrame:
    """Lines "key:value" as a map."""
    pairs = F.filter(F.split(F.col(column), "\n"), lambda line: F.contains(line, F.lit(":")))
    return df.withColumn("info", F.map_from_entries(F.transform(pairs, lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)), F.trim(F.substr(line, F.instr(line, ":") + 1))))))


def searched(catalog: DataFrame, column: str, part: str, order: str, n: int) -> DataFrame:
    """The first n rows, in order, whose column holds the part: a report of a fixed length."""
    return catalog.filter(F.contains(F.col(column), F.lit(part))).orderBy(order).limit(n)


def catalog_rows(files: DataFrame) -> DataFrame:
    """A row for each folder of files(path, length, modificationTime): recording, series, channel, time_range, begin, end, movies, movie, images, protocol.

    A folder is named series[_begin-end][_cN] inside its recording's folder; without _cN the channel is 0, without a
    range it is the whole series. movies (.mp4) and images (.png) are the newest first, by path where times are equal,
    movie is the newest. protocol is the largest file that ends in protocol.txt, of equal ones the last by path, or
    where it would be. Paths without a folder are left out.
    """
    folder, name = F.regexp_extract("path", "^(.+)/[^/]*$", 1), F.regexp_extract("folder", "([^/]*)$", 1)
    rows = files.withColumn("folder", folder).filter("folder != ''")
    newest = lambda end: F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("path").endswith(end), F.struct("modificationTime", "path"))))), lambda x: x["path"])
    largest = F.max(F.when(F.col("path").endswith("protocol.txt"), F.struct("length", "path")))["path"]
    found = rows.groupBy("folder").agg(newest(".mp4").alias("movies"), newest(".png").alias("images"), largest.alias("protocol"))
    own = F.regexp_replace(name, "_c[0-9]+$", "")
    spans = F.nullif(F.regexp_extract(own, "^[^_]*_(.*)$", 1), F.lit(""))
    end = lambda k: F.regexp_extract("time_range", r"^([0-9.]+)s?-([0-9.]+)s?$", k).try_cast("double")
    named = found.withColumn("recording", F.regexp_extract("folder", "^(.*)/[^/]*$", 1)).withColumn("series", F.regexp_extract(own, "^([^_]*)", 1)).withColumn("time_range", spans)
    named = named.withColumn("channel", F.coalesce(F.nullif(F.regexp_extract(name, "_c([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0)))
    default = F.concat("folder", F.lit("/"), F.regexp_extract("recording", "([^/]*)$", 1), F.lit("_"), "series", F.lit("_protocol.txt"))
    return named.select("folder", "recording", "series", "channel", "time_range", end(1).alias("begin"), end(2).alias("end"), "movies", F.try_element_at("movies", F.lit(1)).alias("movie"), "images", F.coalesce("protocol", default).alias("protocol"))
