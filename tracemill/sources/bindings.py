"""The driver's tables as the tables of this library.

traces: roi, i, t, value (and recording); events: event_id, roi, recording, t0, tend, peakpoint,
halfwidth, z_max, height, auc, its, ts; pixels: recording, frame, y, x, value; series: recording,
series, start, duration and sizes; protocol: recording, compound, concentration, begin, end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.tables import spread

LEGS = [("a", 48.0, 216.0), ("b", 264.0, 456.0), ("c", 504.0, 696.0)]
LEGS_DAYS = [("a", 140.0, 840.0), ("b", 910.0, 1610.0), ("c", 1680.0, 2380.0)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legs(spark: SparkSession, rows=LEGS) -> DataFrame:
    return spark.createDataFrame(rows, "leg string, leg_begin double, leg_end double")


def traces_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly shipped quantity per supplier on a full grid of weeks, dealt by supplier: what goes by roi needs no further shuffle."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("roi"), F.floor(day / 7).cast("int").alias("week"), "l_quantity")
    sums = spread(rows.groupBy("roi", "week").agg(F.sum("l_quantity").alias("q")), "roi").crossJoin(F.broadcast(rows.agg(F.max("week").alias("last"))))  # one row
    # Each week stands for itself and the empty ones up to the next, the first also for those before it: no join with a grid.
    order = Window.partitionBy("roi").orderBy("week")
    first = F.when(F.row_number().over(order) == 1, 0).otherwise(F.greatest("week", F.lit(0)))
    held = sums.withColumn("first", first).withColumn("end", F.coalesce(F.lead("week").over(order), F.col("last") + 1)).filter("first < end")
    grid = held.select("roi", "week", "q", F.explode(F.sequence("first", F.col("end") - 1)).alias("i"))
    own = F.when((F.col("week") == F.col("i")) & F.col("roi").isNotNull(), F.col("q"))
    return grid.select("roi", "i", (F.col("i") * 7).cast("double").alias("t"), F.coalesce(own, F.lit(0.0)).alias("value"))


def traces_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as short traces, by label."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("recording"), F.col("vec_id").alias("roi"), F.posexplode("embedding").alias("i", "value"))
    return rows.select("recording", "roi", "i", F.col("i").cast("double").alias("t"), F.col("value").cast("double").alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = read(spark, sf_dir, "events")
    kinds = source.select("event_type").distinct().select("event_type", (F.dense_rank().over(Window.orderBy("event_type")) - 1).alias("its"))
    rows = source.join(kinds, "event_type")
    t0 = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 3.6e9
    halfwidth = 1 + F.col("value") / 10
    return rows.select("event_id", F.col("user_id").alias("roi"), (F.col("user_id") % 3).alias("recording"), t0.alias("t0"), halfwidth.alias("halfwidth"), "value", "its").select(
        "event_id", "roi", "recording", "t0", "halfwidth", (F.col("t0") + F.col("halfwidth")).alias("tend"), (F.col("t0") + F.col("halfwidth") / 2).alias("peakpoint"),
        F.col("value").alias("z_max"), (F.col("value") / 100).alias("height"), (F.col("value") * F.col("halfwidth") / 1000).alias("auc"), "its", F.pow(F.lit(2.0), "its").alias("ts"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is an 8 x 8 frame of the recording named by its label."""
    by_label = Window.partitionBy("label").orderBy("vec_id")
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("recording"), "embedding", (F.row_number().over(by_label) - 1).alias("frame"))
    flat = spread(rows, "recording", "frame").select("recording", "frame", F.posexplode("embedding").alias("p", "value"))
    return flat.select("recording", "frame", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("value").cast("double").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("recording"), (F.row_number().over(own) - 1).alias("series"), day.alias("start"), (F.col("o_orderkey") % 40).cast("double").alias("duration"),
        (1 + F.col("o_orderkey") % 500).alias("size_t"), F.substring("o_orderpriority", 1, 1).cast("double").alias("px_size"),
    ).withColumn("end", F.col("start") + F.col("duration"))


def protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.col("p_partkey") % 60
    text = lambda m: F.concat(F.lpad(m.cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("p_partkey") % 7 * 8).cast("string"), 2, "0"))
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("recording"), "p_partkey", F.split("p_name", " ")[0].alias("compound"), F.concat(F.col("p_size").cast("string"), F.lit("mM")).alias("concentration"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(text(minute)).alias("begin"), F.when(F.col("p_partkey") % 13 == 0, F.lit(None)).otherwise(text(minute + F.col("p_partkey") % 30)).alias("end"),
    )


#: The same bindings as SQL for DuckDB.
SQL = {
    "week": """wk AS (SELECT l_suppkey AS roi, CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) AS i, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
grid AS (SELECT roi, CAST(unnest(generate_series(0, (SELECT max(i) FROM wk))) AS INTEGER) AS i FROM (SELECT DISTINCT roi FROM wk)),
tr AS (SELECT roi, i, CAST(i * 7 AS DOUBLE) AS t, coalesce(q, 0.0) AS value FROM grid LEFT JOIN wk USING (roi, i))""",
    "emb": """em AS (SELECT label AS recording, vec_id AS roi, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS i, embedding FROM embeddings),
tr AS (SELECT recording, roi, i, CAST(i AS DOUBLE) AS t, CAST(embedding[i + 1] AS DOUBLE) AS value FROM em)""",
    "events": """kinds AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS its FROM (SELECT DISTINCT event_type FROM events)),
e0 AS (SELECT event_id, user_id AS roi, user_id % 3 AS recording, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS DOUBLE) / 3.6e9 AS t0, 1 + value / 10 AS halfwidth, value, its FROM events JOIN kinds USING (event_type)),
ev AS (SELECT event_id, roi, recording, t0, halfwidth, t0 + halfwidth AS tend, t0 + halfwidth / 2 AS peakpoint, value AS z_max, value / 100 AS height, value * halfwidth / 1000 AS auc, its, pow(2.0, its) AS ts FROM e0)""",
    "pixels": """fr AS (SELECT label AS recording, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding, unnest(generate_series(0, 63)) AS p FROM embeddings),
px AS (SELECT recording, frame, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, CAST(embedding[p + 1] AS DOUBLE) AS value FROM fr)""",
    "series": """se AS (SELECT o_custkey AS recording, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS series, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS start, CAST(o_orderkey % 40 AS DOUBLE) AS duration, 1 + o_orderkey % 500 AS size_t, CAST(o_orderpriority[1:1] AS DOUBLE) AS px_size, start + duration AS "end" FROM orders)""",
    "protocol": """pr AS (SELECT p_brand AS recording, p_partkey, split_part(p_name, ' ', 1) AS compound, p_size || 'mM' AS concentration,
CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 7 * 8 AS VARCHAR), 2, '0') END AS "begin",
CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE lpad(CAST(p_partkey % 60 + p_partkey % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 7 * 8 AS VARCHAR), 2, '0') END AS "end" FROM part)""",
    "legs": "legs AS (SELECT * FROM (VALUES ('a', 48.0, 216.0), ('b', 264.0, 456.0), ('c', 504.0, 696.0)) v(leg, leg_begin, leg_end))",
    "legs_days": "legs AS (SELECT * FROM (VALUES ('a', 140.0, 840.0), ('b', 910.0, 1610.0), ('c', 1680.0, 2380.0)) v(leg, leg_begin, leg_end))",
}


def sql(*names: str, then: str = "") -> str:
    """WITH clause of these bindings, and further table expressions."""
    return "WITH RECURSIVE " + ",\n".join([SQL[n] for n in names] + ([then] if then else [])) + "\n"
