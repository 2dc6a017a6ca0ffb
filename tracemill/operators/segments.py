"""Splitting and closer merging of rois: roi_pixels(recording, roi, y, x), a roi named by its peak."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.tables import discard, written
from tracemill.operators import rois
from tracemill.operators.components import components


def split_unconnected(roi_pixels: DataFrame, image: DataFrame) -> DataFrame:
    """roi_pixels with every roi 4-connected: the part with the peak keeps the name, others take their brightest pixel's."""
    node = lambda roi, y, x: F.struct("recording", F.col(roi).alias("roi"), y.alias("y"), x.alias("x"))
    beside = F.explode(F.array(F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx")), F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx"))))
    moved = roi_pixels.withColumn("o", beside).select("recording", "roi", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), node("roi", F.col("y"), F.col("x")).alias("a"))
    edges = moved.join(roi_pixels, ["recording", "roi", "y", "x"]).select("a", node("roi", F.col("y"), F.col("x")).alias("b"))
    own = node("roi", F.col("y"), F.col("x"))
    roots = components(edges.union(roi_pixels.select(own.alias("a"), own.alias("b"))))
    parts = roots.select("node.recording", "node.roi", "node.y", "node.x", "root")
    best = F.max(F.struct("value", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx")))
    name = F.when(F.bool_or(rois.place(F.col("y"), F.col("x")) == F.col("roi")), F.col("roi")).otherwise(rois.place(-best["ny"], -best["nx"]))
    named = parts.join(image, ["recording", "y", "x"]).groupBy("recording", "roi", "root").agg(name.alias("part"))
    return parts.join(named, ["recording", "roi", "root"]).select("recording", F.col("part").alias("roi"), "y", "x")


def boundary_distances(summary: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per directed pair of neighbours the least distance of roi_i's peak from the boundary of roi_j, and how many nodes have it."""
    distance = F.sqrt(F.pow(F.col("ny") - 0.5 - F.col("peak_y"), F.lit(2)) + F.pow(F.col("nx") - 0.5 - F.col("peak_x"), F.lit(2)))
    own = summary.select("recording", F.col("roi").alias("roi_i"), "peak_y", "peak_x")
    each = pairs.select("recording", "roi_i", "roi_j").join(own, ["recording", "roi_i"]).join(nodes.withColumnRenamed("roi", "roi_j"), ["recording", "roi_j"])
    tied = each.groupBy("recording", "roi_i", "roi_j", distance.alias("distance")).agg(F.count(F.lit(1)).alias("n"))
    return tied.groupBy("recording", "roi_i", "roi_j").agg(F.min(F.struct("distance", "n")).alias("b")).select("recording", "roi_i", "roi_j", "b.distance", F.col("b.n").alias("n_nearest"))


def peak_boundary_trace_table(summary: DataFrame, nodes: DataFrame, pairs: DataFrame, traces: DataFrame) -> DataFrame:
    """boundary_distances with both sizes and the correlation of the frame-to-frame steps of both traces.

    Only neighbours meet, so the correlation's rows are neighbours x frames.
    """
    step = F.col("value") - F.lag("value").over(Window.partitionBy("recording", "roi").orderBy("frame"))
    steps = traces.withColumn("step", step).filter("step is not null")
    once = pairs.filter("roi_i < roi_j").select("recording", "roi_i", "roi_j")
    side = lambda k, name: steps.select("recording", F.col("roi").alias(k), "frame", F.col("step").alias(name))
    met = once.join(side("roi_i", "u"), ["recording", "roi_i"]).join(side("roi_j", "v"), ["recording", "roi_j", "frame"])
    corr = met.groupBy("recording", F.col("roi_i").alias("low"), F.col("roi_j").alias("high")).agg(F.corr("u", "v").alias("step_corr"))
    size = lambda k, name: summary.select("recording", F.col("roi").alias(k), F.col("size").alias(name))
    out = boundary_distances(summary, nodes, pairs).join(size("roi_i", "size_from"), ["recording", "roi_i"]).join(size("roi_j", "size_to"), ["recording", "roi_j"])
    out = out.withColumn("low", F.least("roi_i", "roi_j")).withColumn("high", F.greatest("roi_i", "roi_j"))
    return out.join(corr, ["recording", "low", "high"], "left").drop("low", "high")


def peak_edge_barrier(summary: DataFrame, edges: DataFrame, image: DataFrame) -> DataFrame:
    """Per roi the neighbour across the edge nearest to its peak, if under a pixel away, and the image step across it.

    Among a neighbour's nearest edges the highest step counts; among neighbours the least (distance, barrier, roi_j).
    """
    h = F.col("side") == "h"
    my, mx = F.when(h, F.col("ey") - 0.5).otherwise(F.col("ey").cast("double")), F.when(h, F.col("ex").cast("double")).otherwise(F.col("ex") - 0.5)
    first = F.struct(F.when(h, F.col("ey") - 1).otherwise(F.col("ey")).alias("y"), F.when(h, F.col("ex")).otherwise(F.col("ex") - 1).alias("x"))
    second = F.struct(F.col("ey").alias("y"), F.col("ex").alias("x"))
    peak = summary.select("recording", F.col("roi").alias("roi_i"), "peak_y", "peak_x")
    shared = edges.withColumnRenamed("roi", "roi_i").join(edges.withColumnRenamed("roi", "roi_j"), ["recording", "side", "ey", "ex"]).filter("roi_i != roi_j").join(peak, ["recording", "roi_i"])
    near = shared.withColumn("distance", F.sqrt(F.pow(my - F.col("peak_y"), F.lit(2)) + F.pow(mx - F.col("peak_x"), F.lit(2)))).filter("distance < 1")
    # An edge under a pixel from the peak borders the peak's own pixel: the other side is the neighbour's.
    inside = (first["y"] == F.col("peak_y")) & (first["x"] == F.col("peak_x"))
    sides = near.withColumn("iy", F.col("peak_y")).withColumn("ix", F.col("peak_x")).withColumn("o", F.when(inside, second).otherwise(first)).withColumn("oy", F.col("o.y")).withColumn("ox", F.col("o.x"))
    value = lambda y, x, name: image.select("recording", F.col("y").alias(y), F.col("x").alias(x), F.col("value").alias(name))
    steps = sides.join(value("iy", "ix", "v_in"), ["recording", "iy", "ix"]).join(value("oy", "ox", "v_out"), ["recording", "oy", "ox"]).withColumn("barrier", F.col("v_out") - F.col("v_in"))
    per = steps.groupBy("recording", "roi_i", "roi_j").agg(F.min(F.struct("distance", (-F.col("barrier")).alias("nb"))).alias("b"))
    best = per.groupBy("recording", "roi_i").agg(F.min(F.struct(F.col("b.distance").alias("distance"), (-F.col("b.nb")).alias("barrier"), "roi_j")).alias("b"))
    return best.select("recording", "roi_i", "b.roi_j", "b.distance", "b.barrier")


def propose_by_close_peaks(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each roi's neighbour with the nearest peak (then the lowest id).

    Where more than half of a recording's rois have one, only rois under the recording's median size propose.
    """
    own = lambda k, s: summary.select("recording", F.col("roi").alias(k), F.col("peak_y").alias(f"y{s}"), F.col("peak_x").alias(f"x{s}"))
    d = F.sqrt(F.pow(F.col("ya") - F.col("yb"), F.lit(2)) + F.pow(F.col("xa") - F.col("xb"), F.lit(2)))
    near = pairs.join(own("roi_i", "a"), ["recording", "roi_i"]).join(own("roi_j", "b"), ["recording", "roi_j"]).groupBy("recording", "roi_i").agg(F.min(F.struct(d.alias("distance"), "roi_j")).alias("b"))
    whole = summary.groupBy("recording").agg(F.count(F.lit(1)).alias("n_rois"), F.percentile("size", F.lit(0.5)).alias("middle"))
    some = near.groupBy("recording").agg(F.count(F.lit(1)).alias("n_proposed"))
    size = summary.select("recording", F.col("roi").alias("roi_i"), "size")
    rows = near.join(size, ["recording", "roi_i"]).join(whole.join(some, "recording"), "recording")
    return rows.filter((2 * F.col("n_proposed") <= F.col("n_rois")) | (F.col("size") < F.col("middle"))).select("recording", "roi_i", "b.roi_j", "b.distance")


def _merge_round(roi_pixels: DataFrame, image: DataFrame, fraction: float, most: float) -> tuple[DataFrame, DataFrame]:
    summary = rois.roi_summary(roi_pixels, image)
    edges = rois.roi_edges(roi_pixels)
    small = rois.threshold(summary, "size", fraction).select("recording", F.col("roi").alias("roi_i"))
    pairs = rois.adjacency(edges).join(small, ["recording", "roi_i"])
    chosen = rois.peak_to_boundary(summary, rois.boundary_nodes(edges), pairs, most)
    return rois.merge_graph(chosen.select("recording", "roi_i", "roi_j"), summary), summary


def merge_closest(roi_pixels: DataFrame, image: DataFrame, fraction: float = 0.1, most: float = 1.0, rounds: int = 20) -> DataFrame:
    """roi_pixels after merging small rois into neighbours whose boundary is within most of their peak.

    Each round takes the rois at or under the size percentile of their recording; it ends without
    candidates, or after rounds, which is the caller's limit. Every round is written, so lineage stays short.
    """
    now = written(roi_pixels.select("recording", "roi", "y", "x"), "closest")
    for _ in range(rounds):
        found, summary = _merge_round(now, image, fraction, most)
        graph = written(found, "graph")
        if not graph.limit(1).count():
            discard(graph)
            break
        to = rois.merged(graph, summary).select("recording", "roi", "survivor")
        last, now = now, written(now.join(to, ["recording", "roi"]).select("recording", F.col("survivor").alias("roi"), "y", "x"), "closest")
        discard(last)
        discard(graph)
    return now
