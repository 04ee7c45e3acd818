"""Orbit counts of the induced subgraphs of up to four nodes, from counting equations.

Only triangles, four-cycles (under their highest corner) and cliques of four are found one by one, all by the order of
(degree, id), so a hub costs no more than the root of the edges for each of its neighbours. Triangles and cycles come
from one pass of packed lists of neighbours along the edges (``graph.corners_met``); pairs of neighbours are no rows.
Paths, stars and tailed triangles are never listed: how often a node is part of one, induced or not, follows from its
own and its neighbours' degrees and triangles, and the induced counts from subtracting those inside denser subgraphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import graph
from chronoweave.session import stored


def orbit_counts(edges: DataFrame) -> DataFrame:
    """(node, orbits): for each node of an edge that is no self loop, its 15 orbit counts in the usual numbering.

    0 edge; 1, 2 end and middle of a path of three; 3 triangle; 4, 5 end and inside of a path of four; 6, 7 leaf and
    centre of a star; 8 four-cycle; 9, 10, 11 tail, plain corner and tailed corner of a tailed triangle; 12, 13 corners
    of degree two and three of a four-cycle with a chord; 14 clique of four. On the way nodes go by their ranks.
    """
    nodes, pairs = graph.ranked(edges)
    met = graph.corners_met(pairs, cycles=True)
    cycles = met.where("n is not null").groupBy("x").agg(F.sum("n").alias("cycles"))
    corners = met.where("n is null").select("x", "y", "z")
    sides = corners.select(F.explode(F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(r).alias("c")) for p, q, r in (("x", "y", "z"), ("x", "z", "y"), ("y", "z", "x"))])).alias("s")).select("s.*")
    shared = stored(sides.groupBy("a", "b").agg(F.count("*").alias("common")))
    # diamonds in which a node is opposite to a chord: for each triangle, the other triangles on the far side
    far = sides.join(shared, ["a", "b"]).groupBy(F.col("c").alias("x")).agg(F.sum(F.col("common") - 1).alias("far"))
    t = corners.select(F.explode(F.array("x", "y", "z")).alias("x")).groupBy("x").agg(F.count("*").alias("t"))
    near = pairs.select(F.col("lo").alias("x"), F.col("hi").alias("y"), F.col("khi").alias("dy")).union(pairs.select("hi", "lo", "klo"))
    dy, common = F.col("dy"), F.col("common")
    own = near.groupBy("x").agg(F.count("*").alias("d"), F.sum(dy - 1).alias("ends"), F.sum((dy - 1) * (dy - 2) / 2).cast("long").alias("leaf"))
    own = stored(own.join(t, "x", "left").na.fill(0, ["t"]))
    # of neighbours: their triangles, less those with the node itself, and their own neighbours' ends
    seen = near.join(own.select(F.col("x").alias("y"), F.col("ends").alias("e"), F.col("t").alias("ty")), "y")
    sums = seen.groupBy("x").agg(F.sum("ty").alias("ty"), F.sum("e").alias("second"))
    linked = shared.select(F.col("a").alias("x"), F.col("b").alias("y"), "common").union(shared.select("b", "a", "common"))
    linked = linked.join(own.select(F.col("x").alias("y"), F.col("d").alias("dy")), "y")
    chords = linked.groupBy("x").agg(F.sum(common * (dy - 2)).alias("plain"), F.sum(common * (common - 1) / 2).cast("long").alias("chord"))
    cliques = graph.four_cliques_of(corners, pairs).select(F.explode(F.array("x", "y", "z", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("k4"))
    row = own.join(sums, "x").join(nodes.select(F.col("rank").alias("x"), "node"), "x")
    for some in (chords, far, cliques, cycles):
        row = row.join(some, "x", "left")
    row = row.na.fill(0, ["plain", "chord", "far", "k4", "cycles"]).withColumn("tail", F.col("ty") - 2 * F.col("t"))
    d, t, ends, second, k4 = (F.col(c) for c in ("d", "t", "ends", "second", "k4"))
    o = {14: k4, 13: F.col("chord") - 3 * k4, 12: F.col("far") - 3 * k4}
    row = row.withColumns({"o12": o[12], "o13": o[13]})
    o12, o13 = F.col("o12"), F.col("o13")
    # counts of subgraphs, induced or not, less those inside denser ones
    row = row.withColumns(
        {
            "o8": F.col("cycles") - o12 - o13 - 3 * k4,
            "o9": F.col("tail") - 2 * o12 - 3 * k4,
            "o10": F.col("plain") - 2 * o12 - 2 * o13 - 6 * k4,
            "o11": t * (d - 2) - 2 * o13 - 3 * k4,
        }
    )
    o8, o9, o10, o11 = (F.col(f"o{k}") for k in (8, 9, 10, 11))
    row = row.withColumns(
        {
            "o4": second - d * (d - 1) - 2 * t - 2 * o8 - 2 * o9 - o10 - 4 * o12 - 2 * o13 - 6 * k4,
            "o5": (d - 1) * ends - 2 * t - 2 * o8 - o10 - 2 * o11 - 2 * o12 - 4 * o13 - 6 * k4,
            "o6": F.col("leaf") - o9 - o10 - 2 * o12 - o13 - 3 * k4,
            "o7": (d * (d - 1) * (d - 2) / 6).cast("long") - o11 - o13 - k4,
        }
    )
    all_ = [d, ends - 2 * t, (d * (d - 1) / 2).cast("long") - t, t, *[F.col(f"o{k}") for k in range(4, 14)], k4]
    return row.select("node", F.array(*[c.cast("long") for c in all_]).alias("orbits"))
