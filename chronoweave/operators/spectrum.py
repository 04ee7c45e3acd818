"""Spectral densities of graphs of any size, from Chebyshev moments: the matrix stays an edge table."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.sampling import uniform
from chronoweave.session import stored


#: Edges of a snapshot that one task takes by itself, some 200 MB; the vectors of a larger one are tables, one join a step.
WHOLE = 2_000_000


def _by_tasks(pairs: DataFrame, signs: DataFrame, by: str, steps: int, probes: int) -> DataFrame:
    """(by, n, odd, even, k): the products of ``_by_joins`` for snapshots of at most ``WHOLE`` edges, a task for each and one probe after the other."""

    def products(key, edges, nodes):
        order, signs = np.sort(nodes["node"].to_numpy()), nodes.set_index("node")["x"]
        a, b = (np.searchsorted(order, edges[c].to_numpy()) for c in ("a", "b"))
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        degree = np.bincount(a, minlength=len(order))
        m = -1 / np.sqrt(degree[a] * degree[b].astype(float))
        bits = signs.loc[order].to_numpy()
        odd, even = np.zeros(steps), np.zeros(steps)
        times = lambda v: np.bincount(a, weights=m * v[b], minlength=len(order))
        for r in range(probes):
            x = np.where((bits >> r) & 1, -1.0, 1.0)
            y = times(x)
            for k in range(steps):
                if k:
                    x, y = y, 2 * times(y) - x
                odd[k] += x @ y
                even[k] += y @ y
        return pd.DataFrame({"by": [key[0]] * steps, "n": len(order), "odd": odd, "even": even, "k": range(steps)})

    kind = pairs.schema[by].dataType.simpleString()
    bits = signs.select(F.col(by).alias("_by"), F.col("a").alias("node"), F.aggregate(F.transform("x", lambda x, r: F.when(x < 0, F.pow(F.lit(2.0), r).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x).alias("x"))
    return pairs.groupBy(by).cogroup(bits.groupBy("_by")).applyInPandas(products, f"by {kind}, n long, odd double, even double, k int").withColumnRenamed("by", by)


def _by_joins(pairs: DataFrame, signs: DataFrame, by: str, steps: int, probes: int) -> DataFrame:
    """(by, n, odd, even, k): products T_k v . T_k+1 v and T_k+1 v . T_k+1 v, summed over nodes and probes.

    A step is one join with the edge table and one sum, for all snapshots and probes at once.
    """
    near = pairs.select(by, "a", "b").union(pairs.select(by, F.col("b").alias("a"), F.col("a").alias("b")))
    degree = stored(near.groupBy(by, "a").agg(F.count("*").alias("k")))
    other = degree.select(by, F.col("a").alias("b"), F.col("k").alias("kb"))
    # of the Laplacian less one: -1 / sqrt(product of the degrees)
    matrix = stored(near.join(degree, [by, "a"]).join(other, [by, "b"]).select(by, "a", "b", (-1 / F.sqrt(F.col("k") * F.col("kb"))).alias("m")))

    def times(v: DataFrame) -> DataFrame:
        """The matrix times each probe: one sum a probe, added up before the shuffle."""
        terms = matrix.join(v.select(by, F.col("a").alias("b"), "x"), [by, "b"])
        sums = [F.sum(F.col("m") * F.col("x")[r]).alias(f"_{r}") for r in range(probes)]
        return terms.groupBy(by, "a").agg(*sums).select(by, "a", F.array(*[f"_{r}" for r in range(probes)]).alias("y"))

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    last, parts = stored(signs), []
    both = stored(last.join(times(last), [by, "a"]))  # x: T_0 v, y: T_1 v
    for k in range(steps):
        if k:
            ahead = times(both.select(by, "a", F.col("y").alias("x"))).select(by, "a", F.col("y").alias("z"))
            step = F.zip_with("z", "x", lambda z, x: 2 * z - x)
            both = stored(both.join(ahead, [by, "a"]).select(by, "a", F.col("y").alias("x"), step.alias("y")))
        parts.append(both.groupBy(by).agg(F.count("*").alias("n"), F.sum(dot(F.col("x"), F.col("y"))).alias("odd"), F.sum(dot(F.col("y"), F.col("y"))).alias("even"), F.lit(k).alias("k")))
    return reduce(DataFrame.unionByName, parts)


def moments(edges: DataFrame, by: str, count: int, probes: int = 16, seed: int = 17) -> DataFrame:
    """(by, nodes, moments): for each snapshot the mean Chebyshev moments 0 to ``count`` - 1 of its normalised Laplacian less one.

    Each probe is a vector of signs, from a hash of (node, probe), which any task can make again; the mean over probes
    of v . T_k v estimates the trace of T_k, by the recursion T_k+1 v = 2 M T_k v - T_k-1 v. Products of two vectors of the
    recursion give two moments a step, so ``count`` moments take count / 2 steps. The error of a moment falls with the root
    of nodes times probes. A snapshot of at most ``WHOLE`` edges is one task's, whatever the steps; larger ones go by joins.
    """
    pairs = stored(edges.where("src <> dst").select(by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    sign = F.transform(F.sequence(F.lit(1), F.lit(probes)), lambda r: F.when(uniform(seed, "a", r) < 0.5, -1.0).otherwise(1.0))
    signs = pairs.select(by, "a").union(pairs.select(by, "b")).distinct().select(by, "a", sign.alias("x"))
    # the signs of a node go to its task as bits of one number
    large = stored(pairs.groupBy(by).agg(F.count("*").alias("_n")).select(by, ((F.col("_n") > WHOLE) | F.lit(probes > 62)).alias("_large")))
    steps, parts = max(1, math.ceil(count / 2)), []
    for way, rule in ((_by_tasks, "not _large"), (_by_joins, "_large")):
        of = large.where(rule).select(by)
        if not of.isEmpty():
            parts.append(way(*[x.join(F.broadcast(of), by, "left_semi") for x in (pairs, signs)], by, steps, probes))
    if not parts:
        parts = [_by_joins(pairs, signs, by, 1, probes)]
    rows = reduce(DataFrame.unionByName, parts)
    # 2 T_k+1 T_k = T_2k+1 + T_1 and 2 T_k+1 T_k+1 = T_2k+2 + T_0; v . v is the number of nodes
    scale = F.col("n") * probes
    table = rows.groupBy(by).agg(F.max("n").alias("nodes"), F.sort_array(F.collect_list(F.struct("k", (F.col("odd") / scale).alias("odd"), (F.col("even") / scale).alias("even")))).alias("t"))
    first = F.col("t")[0]["odd"]
    pair = F.transform("t", lambda p: F.array(F.when(p.k == 0, p.odd).otherwise(2 * p.odd - first), 2 * p.even - 1))
    return table.select(by, "nodes", F.slice(F.concat(F.array(F.lit(1.0)), F.flatten(pair)), 1, count).alias("moments"))


def density(found: DataFrame, by: str, bins: int) -> DataFrame:
    """(by, nodes, h): shares of the eigenvalues in ``bins`` bins of [0, 2], from ``moments``, damped by Jackson's factors.

    The series of the density is integrated over each bin, so shares sum to 1. An eigenvalue is spread over about
    pi / (number of moments); shares far from any eigenvalue may be slightly off 0.
    """
    n = F.size("moments")
    angle = F.lit(math.pi) / (n + 1)
    damp = lambda k: ((n - k + 1) * F.cos(angle * k) + F.sin(angle * k) * F.cos(angle) / F.sin(angle)) / (n + 1)

    def upto(edge):
        """The share below an eigenvalue: the series integrated from there to angle pi."""
        theta = F.acos(edge - 1)
        terms = F.transform("moments", lambda m, k: F.when(k == 0, F.lit(math.pi) - theta).otherwise(-2 * damp(k) * m * F.sin(theta * k) / k))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / math.pi

    width = 2.0 / bins
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda b: upto(F.least(b * F.lit(width), F.lit(2.0))))
    return found.select(by, "nodes", shares.alias("_c")).select(by, "nodes", F.zip_with(F.slice("_c", 2, bins), F.slice("_c", 1, bins), lambda x, y: x - y).alias("h"))


def spectra(edges: DataFrame, by: str, bins: int, count: int = 64, probes: int = 8) -> DataFrame:
    """(by, nodes, h): shares of each snapshot's normalised-Laplacian eigenvalues in bins of [0, 2]; nodes without edges have none."""
    return density(moments(edges, by, count, probes), by, bins)
