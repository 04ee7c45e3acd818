"""Node orders that keep the ends of edges close together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.components import connected_components
from chronoweave.operators.distributions import row_numbers
from chronoweave.operators.paths import neighbours
from chronoweave.session import stored


def _peripheral(near: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """For each component a node that no node of its last level exceeds in eccentricity, from ``starts`` (component, node)."""
    best = stored(starts.select("component", "node", F.lit(-1).alias("far")))
    asked = best
    while True:
        front, hop, last = stored(asked.select("component", "node")), 0, []
        before = front.limit(0)
        while not front.isEmpty():
            last.append(front.withColumn("far", F.lit(hop)))
            reached = front.join(near, front["node"] == near["a"]).select("component", F.col("b").alias("node")).distinct()
            after = stored(reached.join(front.unionByName(before), ["component", "node"], "left_anti"))
            before, front, hop = front, after, hop + 1
        seen = last[0]
        for level in last[1:]:
            seen = seen.unionByName(level)
        end = seen.join(nodes.select("node", "degree"), "node").groupBy("component").agg(F.min(F.struct(-F.col("far"), "degree", "node")).alias("end"))
        end = stored(end.select("component", (-F.col("end")["col1"]).alias("reach"), F.col("end.node").alias("end")))
        # the asked node becomes the best one if it reaches farther than the one before
        both = asked.select("component", F.col("node").alias("new")).join(end, "component").join(best, "component", "right")
        farther = F.coalesce(F.col("reach") > F.col("far"), F.lit(False))
        both = stored(both.select("component", F.when(farther, F.col("new")).otherwise(F.col("node")).alias("node"), F.when(farther, F.col("reach")).otherwise(F.col("far")).alias("far"), farther.alias("farther"), "end"))
        best = both.select("component", "node", "far")
        asked = both.where("farther").select("component", F.col("end").alias("node"))
        if asked.isEmpty():
            return best.select("component", "node")


def cuthill_mckee(edges: DataFrame, reverse: bool = True, peripheral: bool = False) -> DataFrame:
    """(node, number): the (reverse) Cuthill-McKee order of all end points, numbers from 0.

    Each component starts at its node of least (degree, id), or with ``peripheral`` at one from which a search from
    there in both directions reaches no farther; components follow each other in the order of these starts. Level
    by level, the unnumbered neighbours of numbered nodes are numbered by (least number among their numbered
    neighbours, degree, id), all components together. Self loops count for nothing; nodes with no other edge come
    first before reversal. Every level is numbered by ranges, so neither the driver nor a task holds a level.
    """
    near = neighbours(edges)
    all_nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    degree = near.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    nodes = stored(all_nodes.join(degree, "node", "left").join(connected_components(edges), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("component", "node").alias("component")))
    least = nodes.groupBy("component").agg(F.min(F.struct("degree", "node")).alias("s")).select("component", F.col("s.node").alias("node"))
    starts = _peripheral(near, nodes, least) if peripheral else least
    level = row_numbers(starts.select("node").join(nodes, "node").select("node", "degree"), "degree", "node", name="place")
    level = stored(level.select("node", F.col("place").alias("root"), "place"))
    levels = [level.withColumn("level", F.lit(0))]
    before = level.limit(0)
    while True:
        reached = level.join(near, level["node"] == near["a"]).groupBy(F.col("b").alias("node")).agg(F.min(F.struct("place", "root")).alias("by"))
        reached = reached.join(level.unionByName(before).select("node"), "node", "left_anti").join(nodes.select("node", "degree"), "node")
        after = row_numbers(reached.select("node", "degree", F.col("by.place").alias("parent"), F.col("by.root").alias("root")), "parent", "degree", "node", name="place")
        after = stored(after.select("node", "root", "place"))
        if after.isEmpty():
            break
        levels.append(after.withColumn("level", F.lit(len(levels))))
        before, level = level, after
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    out = row_numbers(out, "root", "level", "place")
    if reverse:
        out = out.join(F.broadcast(out.agg(F.max("number").alias("_last")))).withColumn("number", F.col("_last") - F.col("number"))
    return out.select("node", "number")


def bandwidth(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(src, dst, gap) of each edge row that is no self loop: how far apart its ends are in ``order`` (node, number)."""
    a = order.select(F.col("node").alias("src"), F.col("number").alias("_a"))
    b = order.select(F.col("node").alias("dst"), F.col("number").alias("_b"))
    return edges.where("src <> dst").join(a, "src").join(b, "dst").select("src", "dst", F.abs(F.col("_a") - F.col("_b")).alias("gap"))
