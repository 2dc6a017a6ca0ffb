"""Connected components by alternating large-star and small-star rounds.

Edges stay a DataFrame throughout; each round is written to the shared folder, so lineage stays
short and a lost executor costs its tasks alone. A node with very many neighbours is split by
adaptive execution in the joins, and minima are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.tables import discard, written

MOST_ROUNDS = 50


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on edges(a, b).

    Large star: every neighbour larger than the node links to the node's least neighbour. Small
    star: the node and its smaller neighbours link to the least of them.
    """
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = around.join(least, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b); root is the least node reachable.

    Self edges only name their node. Null ends are dropped; an empty table gives no row. Raises if
    MOST_ROUNDS double rounds do not converge, which takes paths of astronomical length.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    # written with the self edges, so that what makes the edges, often a wide join, runs once
    given = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "given")
    now = written(given.filter("a != b"), "edges")
    nodes = given.filter("a = b").select("a")
    sign = None
    for _ in range(MOST_ROUNDS):
        last, now = now, written(_star(_star(now, True), False), "edges")
        discard(last)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == sign:
            found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            alone = nodes.distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
            found = found.union(roots)
            return found.union(alone.join(found.select("node"), "node", "left_anti"))
        sign = new
    raise RuntimeError("components did not converge")
