"""Segmentation and geometry on images(recording, y, x, value) and roi_pixels(recording, roi, y, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.numbers import correlation
from tracemill.functions.tables import written
from tracemill.operators.components import components

WIDTH = 1 << 31  # a roi is named by its peak, y x WIDTH + x: no two pixels of an image share a number


def place(y, x):
    return y.cast("long") * WIDTH + x.cast("long")


def climb(image: DataFrame, diagonal: bool = True) -> DataFrame:
    """Each pixel points to its largest neighbour if that is strictly larger, else to itself.

    Ties go to the first neighbour in row-major order.
    """
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not dy * dx)]
    o = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(a).alias("dy"), F.lit(b).alias("dx")) for i, (a, b) in enumerate(steps))))
    around = image.withColumn("o", o).select("recording", "y", "x", F.col("value").alias("own"), (-F.col("o.rank")).alias("rank"), (F.col("y") + F.col("o.dy")).alias("ny"), (F.col("x") + F.col("o.dx")).alias("nx"))
    near = image.select("recording", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("value").alias("v"))
    best = around.join(near, ["recording", "ny", "nx"]).groupBy("recording", "y", "x").agg(F.max(F.struct("v", "rank", "ny", "nx")).alias("b"), F.first("own").alias("own"))
    up = F.col("b.v") > F.col("own")
    found = best.select("recording", place(F.col("y"), F.col("x")).alias("p"), F.when(up, place(F.col("b.ny"), F.col("b.nx"))).otherwise(place(F.col("y"), F.col("x"))).alias("to"))
    return found


def grow_basins(image: DataFrame, diagonal: bool = True, rounds: int = 20) -> DataFrame:
    """roi_pixels of the basins: pixels that climb to the same peak, by pointer jumping."""
    now = written(climb(image, diagonal), "climb")
    for _ in range(rounds):
        up = now.select("recording", F.col("p").alias("to"), F.col("to").alias("next"))
        jumped = written(now.join(up, ["recording", "to"], "left").select("recording", "p", F.coalesce("next", "to").alias("to")), "climb")
        moved = jumped.join(now.withColumnRenamed("to", "was"), ["recording", "p"]).filter("to != was").limit(1).count()
        now = jumped
        if not moved:
            break
    else:
        raise RuntimeError("basins did not converge")
    return now.select("recording", F.col("to").alias("roi"), F.floor(F.col("p") / WIDTH).cast("int").alias("y"), (F.col("p") % WIDTH).cast("int").alias("x"))


def roi_summary(roi_pixels: DataFrame, image: DataFrame) -> DataFrame:
    """Size, centre and the brightest pixel (first in row-major order) with its value."""
    best = F.max(F.struct("value", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx")))
    out = roi_pixels.join(image, ["recording", "y", "x"]).groupBy("recording", "roi").agg(F.count(F.lit(1)).alias("size"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), best.alias("b"))
    return out.select("recording", "roi", "size", "cy", "cx", (-F.col("b.ny")).alias("peak_y"), (-F.col("b.nx")).alias("peak_x"), F.col("b.value").alias("peak_value"))


def roi_edges(roi_pixels: DataFrame) -> DataFrame:
    """Unit edges on the border of a roi: those that only one of its pixels has.

    An edge is (side, y, x): side h lies above pixel (y, x), side v to its left.
    """
    sides = F.array(
        F.struct(F.lit("h").alias("side"), F.col("y").alias("ey"), F.col("x").alias("ex")), F.struct(F.lit("h").alias("side"), (F.col("y") + 1).alias("ey"), F.col("x").alias("ex")),
        F.struct(F.lit("v").alias("side"), F.col("y").alias("ey"), F.col("x").alias("ex")), F.struct(F.lit("v").alias("side"), F.col("y").alias("ey"), (F.col("x") + 1).alias("ex")),
    )
    each = roi_pixels.select("recording", "roi", F.explode(sides).alias("e")).groupBy("recording", "roi", "e.side", "e.ey", "e.ex").agg(F.count(F.lit(1)).alias("n"))
    return each.filter("n = 1").drop("n")


def adjacency(edges: DataFrame) -> DataFrame:
    """Pairs of rois that share edges, with their number; both directions."""
    other = edges.withColumnRenamed("roi", "roi_j")
    return edges.withColumnRenamed("roi", "roi_i").join(other, ["recording", "side", "ey", "ex"]).filter("roi_i != roi_j").groupBy("recording", "roi_i", "roi_j").agg(F.count(F.lit(1)).alias("n_shared"))


def boundary_nodes(edges: DataFrame) -> DataFrame:
    """End points of the edges of each roi."""
    h = F.col("side") == "h"
    ends = F.array(F.struct(F.col("ey").alias("ny"), F.col("ex").alias("nx")), F.struct(F.when(h, F.col("ey")).otherwise(F.col("ey") + 1).alias("ny"), F.when(h, F.col("ex") + 1).otherwise(F.col("ex")).alias("nx")))
    return edges.select("recording", "roi", F.explode(ends).alias("n")).select("recording", "roi", "n.ny", "n.nx").distinct()


def peak_to_boundary(summary: DataFrame, nodes: DataFrame, pairs: DataFrame, most: float) -> DataFrame:
    """Of the neighbours whose boundary is within most of a roi's peak the largest, with the distance."""
    distance = F.sqrt(F.pow(F.col("ny") - 0.5 - F.col("peak_y"), F.lit(2)) + F.pow(F.col("nx") - 0.5 - F.col("peak_x"), F.lit(2)))
    own = summary.select("recording", F.col("roi").alias("roi_i"), "peak_y", "peak_x")
    near = pairs.join(own, ["recording", "roi_i"]).join(nodes.withColumnRenamed("roi", "roi_j"), ["recording", "roi_j"]).groupBy("recording", "roi_i", "roi_j").agg(F.min(distance).alias("distance")).filter(F.col("distance") <= most)
    size = summary.select("recording", F.col("roi").alias("roi_j"), "size")
    best = F.max(F.struct("size", (-F.col("roi_j")).alias("k"), "distance"))
    return near.join(size, ["recording", "roi_j"]).groupBy("recording", "roi_i").agg(best.alias("b")).select("recording", "roi_i", (-F.col("b.k")).alias("roi_j"), "b.distance", F.col("b.size").alias("size_to"))


def merge_graph(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """Directed pairs; of a mutual pair only the one out of the lower peak (of equals, the lower id)."""
    value = summary.select("recording", F.col("roi").alias("k"), "peak_value")
    rows = pairs.join(value.withColumnsRenamed({"k": "roi_i", "peak_value": "v_i"}), ["recording", "roi_i"]).join(value.withColumnsRenamed({"k": "roi_j", "peak_value": "v_j"}), ["recording", "roi_j"])
    back = pairs.select("recording", F.col("roi_i").alias("roi_j"), F.col("roi_j").alias("roi_i"), F.lit(True).alias("mutual"))
    lower = (F.col("v_i") < F.col("v_j")) | ((F.col("v_i") == F.col("v_j")) & (F.col("roi_i") < F.col("roi_j")))
    return rows.join(back, ["recording", "roi_i", "roi_j"], "left").filter(F.col("mutual").isNull() | lower).select("recording", "roi_i", "roi_j")


def propose_by_shared_edges(pairs: DataFrame, edges: DataFrame, summary: DataFrame) -> DataFrame:
    """Each roi's neighbour with the most shared edges (then size, then lowest id), and the share of its border."""
    size = summary.select("recording", F.col("roi").alias("roi_j"), "size")
    best = F.max(F.struct("n_shared", "size", (-F.col("roi_j")).alias("k")))
    own = edges.groupBy("recording", F.col("roi").alias("roi_i")).agg(F.count(F.lit(1)).alias("n_edges"))
    chosen = pairs.join(size, ["recording", "roi_j"]).groupBy("recording", "roi_i").agg(best.alias("b"))
    return chosen.join(own, ["recording", "roi_i"]).select("recording", "roi_i", (-F.col("b.k")).alias("roi_j"), (F.col("b.n_shared") / F.col("n_edges")).alias("weight"))


def purge_lones(summary: DataFrame, pairs: DataFrame, least: int = 4) -> DataFrame:
    """Rois of at least so many pixels, or with a neighbour."""
    linked = pairs.select("recording", F.col("roi_i").alias("roi")).distinct().withColumn("linked", F.lit(True))
    return summary.join(linked, ["recording", "roi"], "left").filter((F.col("size") >= least) | F.col("linked")).drop("linked")


def roi_traces(px: DataFrame, roi_pixels: DataFrame) -> DataFrame:
    """Mean pixel value per roi and frame."""
    return px.join(roi_pixels, ["recording", "y", "x"]).groupBy("recording", "roi", "frame").agg(F.avg("value").alias("value"))


def sorted_from_centre(summary: DataFrame, cy: float, cx: float) -> DataFrame:
    """Numbers by distance of the peak from the centre, and by row-major order of the peak."""
    d = F.pow(F.col("peak_y") - cy, F.lit(2)) + F.pow(F.col("peak_x") - cx, F.lit(2))
    w = Window.partitionBy("recording")
    return summary.withColumn("from_centre", F.row_number().over(w.orderBy(d, "peak_y", "peak_x")) - 1).withColumn("in_order", F.row_number().over(w.orderBy("peak_y", "peak_x")) - 1)


def intra_roi_correlation(px: DataFrame, roi_pixels: DataFrame, diff: bool = False) -> DataFrame:
    """Correlation of each pixel with the rest of its roi, or of their steps from frame to frame; null for a level one."""
    rows = px.join(roi_pixels, ["recording", "y", "x"])
    total = F.sum("value").over(Window.partitionBy("recording", "roi", "frame"))
    rows = rows.withColumn("rest", total - F.col("value"))
    if diff:
        order = Window.partitionBy("recording", "roi", "y", "x").orderBy("frame")
        rows = rows.select("recording", "roi", "y", "x", *((F.col(c) - F.lag(c).over(order)).alias(c) for c in ("value", "rest"))).filter("value is not null")
    return rows.groupBy("recording", "roi", "y", "x").agg(correlation(F.col("value"), F.col("rest")).alias("r"), F.count(F.lit(1)).alias("n"))


def tag_rois(summary: DataFrame, condition, tag: str) -> DataFrame:
    """The tag appended after a bar, unless it is already part of the tag."""
    old = F.coalesce("tag", F.lit(""))
    new = F.when(old == "", F.lit(tag)).otherwise(F.concat_ws("|", old, F.lit(tag)))
    return summary.withColumn("tag", F.when(condition & (F.instr(old, tag) == 0), new).otherwise(old))


def discard(summary: DataFrame, chosen) -> DataFrame:
    """Rois that are not chosen; nothing goes if that were more than half of a recording."""
    w = Window.partitionBy("recording")
    share = F.avg(chosen.cast("double")).over(w)
    return summary.withColumn("share", share).filter(~chosen | (F.col("share") > 0.5)).drop("share")


def threshold(summary: DataFrame, column: str, fraction: float) -> DataFrame:
    """Rois at or under a percentile of their recording."""
    low = summary.groupBy("recording").agg(F.percentile(column, F.lit(fraction)).alias("limit"))
    return summary.join(low, "recording").filter(F.col(column) <= F.col("limit")).drop("limit")


def colour_scale(summary: DataFrame, column: str, low: float = 0.01, high: float = 0.95) -> DataFrame:
    """(value - low percentile) / (high - low percentile)."""
    ends = summary.groupBy("recording").agg(F.percentile(column, F.lit(low)).alias("a"), F.percentile(column, F.lit(high)).alias("z"))
    return summary.join(ends, "recording").withColumn("scaled", (F.col(column) - F.col("a")) / (F.col("z") - F.col("a"))).drop("a", "z")


def merged(graph: DataFrame, summary: DataFrame) -> DataFrame:
    """Each roi with the one that its component merges into: of the rois without a way out the one of the highest peak."""
    number = lambda c: F.struct("recording", F.col(c).alias("roi"))
    ends = graph.select(number("roi_i").alias("a"), number("roi_j").alias("b"))
    every = summary.select("recording", "roi", "size", "peak_value", number("roi").alias("node"))
    roots = components(ends.union(every.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    sinks = every.join(ends.select(F.col("a").alias("node")).distinct(), "node", "left_anti").join(roots, "node")
    best = F.max(F.struct("peak_value", (-F.col("roi")).alias("k"))).alias("b")
    survivor = sinks.groupBy("root").agg(best).select("root", (-F.col("b.k")).alias("survivor"))
    return every.join(roots, "node").join(survivor, "root").select("recording", "roi", "survivor", "size")


def merged_traces(traces: DataFrame, found: DataFrame) -> DataFrame:
    """Traces of the survivors: size-weighted sums over their rois, divided by the new size."""
    rows = traces.join(found, ["recording", "roi"])
    return rows.groupBy("recording", F.col("survivor").alias("roi"), "frame").agg((F.sum(F.col("value") * F.col("size")) / F.sum("size")).alias("value"))
