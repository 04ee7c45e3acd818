"""Graph kernels on pairs of neighbourhoods: sparse features by hashing, compared as means of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import stored


def neighbourhood_pairs(edges: DataFrame, by: str, radius: int = 2, distance: int = 1) -> DataFrame:
    """(by, feature, weight): for each snapshot, its pairs of neighbourhoods as one sparse vector of length 1.

    A node's neighbourhood of radius 0 is its degree; that of radius r + 1 hashes its own of radius r with those of its
    neighbours (in no order: their hashes are summed, so a hub is a sum and no list). A feature is (radius, hops between
    two nodes, their two neighbourhoods in order); nodes pair with themselves at 0 hops, and each pair of nodes counts
    once. Features of one (radius, hops) are scaled to length 1 before all are. Pairs at d hops are the d-hop frontiers of all
    nodes: about degree ** d rows a node, so ``distance`` should be small on large graphs.
    """
    pairs = edges.where("src <> dst").select(by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    near = stored(pairs.select(by, "a", "b").union(pairs.select(by, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(near.groupBy(by, "a").agg(F.array(F.xxhash64(F.count("*"))).alias("h")))
    for _ in range(radius):
        last = labels.select(by, F.col("a").alias("b"), F.element_at("h", -1).alias("hb"))
        around = near.join(last, [by, "b"]).groupBy(by, "a").agg(F.sum(F.pmod(F.xxhash64("hb"), F.lit(1 << 31))).alias("s"))
        labels = stored(labels.join(around, [by, "a"]).select(by, "a", F.concat("h", F.array(F.xxhash64(F.element_at("h", -1), "s"))).alias("h")))
    at = stored(labels.select(by, "a", F.col("a").alias("b"), F.lit(0).alias("hops")))
    front, before = at, at.limit(0)
    for hop in range(1, distance + 1):
        step = near.select(by, F.col("a").alias("b"), F.col("b").alias("c"))
        reached = front.join(step, [by, "b"]).select(by, "a", F.col("c").alias("b")).distinct()
        after = stored(reached.join(front.unionByName(before), [by, "a", "b"], "left_anti").withColumn("hops", F.lit(hop)))
        at, before, front = at.unionByName(after), front, after
    rows = at.where("a <= b").join(labels, [by, "a"]).join(labels.select(by, F.col("a").alias("b"), F.col("h").alias("g")), [by, "b"])
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda r: F.struct(r.alias("radius"), F.least(F.get("h", r), F.get("g", r)).alias("low"), F.greatest(F.get("h", r), F.get("g", r)).alias("high"))))
    counts = rows.select(by, "hops", each.alias("f")).groupBy(by, "hops", "f").agg(F.count("*").cast("double").alias("n"))
    counts = stored(counts.select(by, F.struct("f.radius", "hops", "f.low", "f.high").alias("feature"), F.col("f.radius").alias("radius"), "hops", "n"))
    part = counts.groupBy(by, "radius", "hops").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("long"))
    whole = part.groupBy(by).agg(F.sqrt(F.count("*")).alias("parts"))
    return counts.join(part, [by, "radius", "hops"]).join(whole, by).select(by, "feature", (F.col("n") / F.col("long") / F.col("parts")).alias("weight"))


def kernel_mmd(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """One row (mmd) of two sets of sparse vectors: mean dot products within a and within b less twice that between them.

    This is the squared length of the difference of the two mean vectors, so no two snapshots are paired.
    """
    sides = []
    for k, side in enumerate((a, b)):
        n = side.agg(F.countDistinct(by).alias("_n"))
        mean = side.groupBy("feature").agg(F.sum("weight").alias("_s")).join(F.broadcast(n))
        sides.append(mean.select("feature", ((1 - 2 * k) * F.col("_s") / F.col("_n")).alias("m")))
    gap = sides[0].union(sides[1]).groupBy("feature").agg(F.sum("m").alias("m"))
    return gap.agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0)).alias("mmd"))
