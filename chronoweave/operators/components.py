"""Connected components of an undirected edge list: union-find inside tasks, star contractions between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import stored

#: Nodes that one task's union-find holds before it emits its stars and starts anew.
FOREST = 500_000
#: Edges that one task unites by itself, in place of further rounds; longer lists shrink by rounds until they are as few.
FEW = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _root(parent: dict, x):
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of the same components as the task's edges, one (node, least node) each, in bounded memory."""
    parent: dict = {}

    def emit():
        return pd.DataFrame({"a": list(parent), "b": [_root(parent, x) for x in list(parent)]})

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = _root(parent, a), _root(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST:
            yield emit()
            parent.clear()
    if parent:
        yield emit()


def _contracted(edges: DataFrame) -> DataFrame:
    return stored(edges.select("a", "b").mapInPandas(_stars, edges.select("a", "b").schema))


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two lower ends, or is both a child and a root."""
    ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), "b"))
    return not ends.groupBy("a").agg(F.min("b").alias("_low"), F.max("b").alias("_high")).where("_low < _high").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for every node of a non-loop edge.

    Each task first unites its own edges and keeps a forest of stars. Large-star then small-star rounds unite
    what different tasks hold; both end in a grouped minimum, so Spark combines before it shuffles, and a
    node of any degree is a group for an aggregate, never a list in memory. The edge list shrinks to one
    star per component, in about log2(diameter) rounds; once it has at most ``FEW`` edges, one task ends it. Null end points are ignored; an empty edge list
    gives no rows.
    """
    edges = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    edges = _contracted(edges.where("a is not null and b is not null and a <> b"))
    for _ in range(max_rounds):
        if edges.count() <= FEW:
            edges = stored(edges.coalesce(1).mapInPandas(_stars, edges.schema))
            return edges.union(edges.select("b", "b")).distinct().toDF("node", "component")
        if not _unsettled(edges):
            return edges.union(edges.select("b", "b")).distinct().toDF("node", "component")
        near = _both_ways(edges)
        low = stored(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))  # stored: AQE splits a hub only where both sides are plain shuffles
        large = near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b"))
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = _contracted(stored(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
