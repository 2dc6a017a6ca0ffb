"""Operators on treatment protocols: protocol(recording, compound, concentration, begin, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_concentration(df: DataFrame) -> DataFrame:
    """conc and unit: cut after the first digit that stands before a letter; blanks are stripped.

    Without such a place a leading digit means all number, else all unit. More than one place is an error.
    """
    c = F.regexp_replace("concentration", r"\s", "")
    cuts = F.regexp_count(c, F.lit("[0-9](?=[A-Za-z])"))
    number = F.regexp_extract(c, "^(.*?[0-9])(?=[A-Za-z])", 1)
    conc = F.when(cuts == 1, number).when(cuts == 0, F.when(c.rlike("^[0-9]"), c).otherwise(F.lit(""))).otherwise(F.raise_error(F.concat(F.lit("more than one unit in "), c)))
    return df.withColumn("conc", conc).withColumn("unit", F.substr(c, F.length("conc") + 1))


def seconds(text: Column) -> Column:
    """mm:ss as seconds; minutes may exceed 59."""
    part = F.split(text, ":")
    return part[0].cast("double") * 60 + part[1].cast("double")


def parse_times(df: DataFrame, t0: float = 0.0, tend: float = 0.0) -> DataFrame:
    """t_begin and t_end; a missing begin is t0, a missing end the later of tend and the recording's largest end."""
    last = F.greatest(F.max(seconds(F.col("end"))).over(Window.partitionBy("recording")), F.lit(tend))
    return df.withColumn("t_begin", F.coalesce(seconds(F.col("begin")), F.lit(t0))).withColumn("t_end", F.coalesce(seconds(F.col("end")), last, F.lit(tend)))


def legs(df: DataFrame) -> DataFrame:
    """Each time at which something begins or ends, with the treatment then and the earliest end among it."""
    points = df.select("recording", F.explode(F.array("t_begin", "t_end")).alias("t")).filter("t is not null").distinct().withColumn("k", F.row_number().over(Window.partitionBy("recording").orderBy("t")))
    # A row covers a range of numbered time points, so rows meet only the points at which they are active.
    first, last = (points.select("recording", F.col("t").alias(c), F.col("k").alias(k)) for c, k in (("t_begin", "k0"), ("t_end", "k1")))
    active = df.join(first, ["recording", "t_begin"]).join(last, ["recording", "t_end"]).filter("k0 < k1").withColumn("k", F.explode(F.sequence("k0", F.col("k1") - 1)))
    item = F.concat_ws("=", F.lower("compound"), "concentration")
    found = active.groupBy("recording", "k").agg(F.min("t_end").alias("leg_end"), F.array_join(F.array_sort(F.collect_set(item)), ";").alias("treatment"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.lower("compound")).alias("n_compounds"))
    return found.join(points, ["recording", "k"]).select("recording", F.col("t").alias("leg_begin"), "leg_end", "treatment", "n_rows", "n_compounds")


def invalid(found: DataFrame) -> DataFrame:
    """Legs with one compound twice at once, and gaps between a leg and the next."""
    after = F.lead("leg_begin").over(Window.partitionBy("recording").orderBy("leg_begin"))
    problem = F.when(F.col("n_rows") > F.col("n_compounds"), "compound twice").when(F.col("after") > F.col("leg_end"), "gap")
    return found.withColumn("after", after).withColumn("problem", problem).filter("problem is not null").select("recording", "leg_begin", "problem")


def active_at(df: DataFrame, step: float, last: float) -> DataFrame:
    """Compounds active at each of a grid of times, as text."""
    first = F.ceil(F.col("t_begin") / step)
    final = F.ceil(F.least(F.col("t_end"), F.lit(last)) / step) - 1
    at = df.filter(first <= final).withColumn("k", F.explode(F.sequence(first, final)))
    item = F.concat_ws(" ", "compound", "concentration")
    return at.groupBy("recording", "k").agg(F.array_join(F.array_sort(F.collect_set(item)), ", ").alias("active"))


def scheme(found: DataFrame) -> DataFrame:
    """Symbols of treatments in order of first sight: one more star each."""
    first = found.groupBy("recording", "treatment").agg(F.min("leg_begin").alias("seen"))
    number = first.withColumn("symbol", F.expr("repeat('*', CAST(dense_rank() OVER (PARTITION BY recording ORDER BY seen, treatment) - 1 AS INT))"))
    return found.join(number.select("recording", "treatment", "symbol"), ["recording", "treatment"]).select("recording", "leg_begin", "symbol")


def replaced(df: DataFrame, names: dict[str, str], column: str = "compound") -> DataFrame:
    """Values of a column under other names; those not named stay."""
    return df.replace(names, subset=[column])


def summary(df: DataFrame) -> DataFrame:
    """Per recording its distinct "compound:concentration", sorted, in one text."""
    item = F.concat_ws(":", "compound", "concentration")
    return df.groupBy("recording").agg(F.array_join(F.array_sort(F.collect_set(item)), " ").alias("summary"))
