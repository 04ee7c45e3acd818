"""Random projections of temporal graphs to small matrices, with Gaussian entries made from hashes and stored nowhere."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators.sampling import gaussians
from chronoweave.session import stored


def scaled(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with each column mapped to (x - least) / (most - least + 1e-6)."""
    span = df.agg(*[f(c).cast("double").alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    out = df.join(F.broadcast(span))
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}") + 1e-6))
    return out.drop(*span.columns)


def node_projections(edges: DataFrame, message: list[str], dims: int, seed: int, longest: int = 100_000, features: DataFrame | None = None) -> DataFrame:
    """(node, z): each node's events in order of time, set side by side as one long vector, times a Gaussian matrix.

    An event counts for both its ends: the other end's features (with ``features``: node, x), the scaled message
    columns, the scaled time and the role (0 source, 1 destination); with ``features`` the node's own come last.
    Vectors differ in length; entry i meets row i of the one matrix (``longest`` rows, variance 1 / ``longest``), made anew
    from a hash of (i, column) and broadcast: ``longest`` x ``dims`` numbers, whatever the data. Entries from ``longest`` on are
    cut off, so no node sorts more events than that.
    A node or other end without features counts as all 0. Sums are added up before the shuffle by node.
    """
    e = scaled(edges.select("edge_id", "src", "dst", "t", *message), "t", *message)
    event = F.array(*[F.col(c).cast("double") for c in (*message, "t")])
    ends = [e.select(F.col(a).alias("node"), F.col(b).alias("other"), "edge_id", F.col("t").alias("_t"), F.concat(event, F.array(F.lit(float(k)))).alias("x")) for k, (a, b) in enumerate((("src", "dst"), ("dst", "src")))]
    rows, width = ends[0].union(ends[1]), len(message) + 2
    if features is not None:
        size = F.size("f")
        span = features.select(F.array_min("x").alias("lo"), F.array_max("x").alias("hi")).agg(F.min("lo").cast("double").alias("_lo"), F.max("hi").cast("double").alias("_hi"))
        known = features.join(F.broadcast(span)).select("node", F.transform("x", lambda v: (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6)).alias("f"))
        known = stored(known)
        width_of = known.agg(F.max(size)).first()[0] or 0
        nothing = F.array_repeat(F.lit(0.0), width_of)
        rows = rows.join(known.select(F.col("node").alias("other"), "f"), "other", "left").withColumn("x", F.concat(F.coalesce("f", nothing), "x")).drop("f")
        width += width_of
    place = F.row_number().over(Window.partitionBy("node").orderBy("_t", "edge_id", "other"))
    most = math.ceil(longest / width)
    rows = rows.withColumn("_k", place).where(F.col("_k") <= most).select("node", ((F.col("_k") - 1) * width).alias("at"), "x")
    if features is not None:
        count = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("_n"))
        own = count.join(known, "node", "left").select("node", (F.col("_n") * width).alias("at"), F.coalesce("f", nothing).alias("x"))
        rows = rows.unionByName(own.where(F.col("at") < longest))
    entries = rows.select("node", F.posexplode("x").alias("_i", "v"), "at").withColumn("at", F.col("at") + F.col("_i")).where((F.col("at") < longest) & (F.col("v") != 0))
    matrix = edges.sparkSession.range(longest).select(F.col("id").alias("at"), gaussians(dims, seed, "id").alias("g"))
    entries = entries.join(F.broadcast(matrix), "at")
    sums = entries.groupBy("node").agg(*[F.sum(F.col("v") * F.col("g")[c]).alias(f"_{c}") for c in range(dims)])
    z = F.array(*[F.coalesce(F.col(f"_{c}"), F.lit(0.0)) / math.sqrt(longest) for c in range(dims)])
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(sums, "node", "left").select("node", z.alias("z"))


def graph_projection(nodes: DataFrame, node_dims: int, dims: int, seed: int) -> DataFrame:
    """(i, row): the ``node_dims`` x ``dims`` matrix of a graph, the sum over nodes of z times a Gaussian row made from the node's id, variance 1 / nodes."""
    n = nodes.agg(F.count("*").alias("_n"))
    g = nodes.select("z", gaussians(dims, seed + 1, "node").alias("g"))
    sums = g.select(F.posexplode("z").alias("i", "v"), "g").groupBy("i").agg(*[F.sum(F.col("v") * F.col("g")[c]).alias(f"_{c}") for c in range(dims)])
    return sums.join(F.broadcast(n)).select("i", F.array(*[F.col(f"_{c}") / F.sqrt("_n") for c in range(dims)]).alias("row"))


def projection(edges: DataFrame, message: list[str], node_dims: int = 16, dims: int = 8, seed: int = 7, longest: int = 100_000, features: DataFrame | None = None) -> DataFrame:
    """(i, row): a temporal graph as a small matrix; graphs of the same seed and sizes can be compared."""
    return graph_projection(stored(node_projections(edges, message, node_dims, seed, longest, features)), node_dims, dims, seed)


def similarity(a: DataFrame, b: DataFrame, dims: int) -> DataFrame:
    """One row (similarity): the mean over columns of the cosine between two graphs' matrices."""
    both = a.select("i", F.posexplode("row").alias("c", "x")).join(b.select("i", F.posexplode("row").alias("c", "y")), ["i", "c"])
    x, y = F.col("x"), F.col("y")
    cosine = both.groupBy("c").agg((F.sum(x * y) / ((F.sqrt(F.sum(x * x)) + 1e-8) * (F.sqrt(F.sum(y * y)) + 1e-8))).alias("cosine"))
    return cosine.agg((F.sum("cosine") / dims).alias("similarity"))
