"""What was known before each event: ordered histories, lists of earlier neighbours, common neighbours so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators import graph
from chronoweave.operators.distributions import row_numbers
from chronoweave.session import stored


def ordered_history(edges: DataFrame) -> DataFrame:
    """(node, nbr, t, edge_id, place): the events of each node from either end, numbered from 0 by (t, edge_id, nbr).

    All events are numbered by ranges of (node, t, edge_id, nbr), so a node of a third of all events is several
    ranges; a node's numbers start at its least one.
    """
    rows = row_numbers(graph.both_ways(edges).select("node", "t", "edge_id", "nbr"), "node", "t", "edge_id", "nbr", name="_at")
    first = rows.groupBy("node").agg(F.min("_at").alias("_first"))
    return rows.join(first, "node").select("node", "nbr", "t", "edge_id", (F.col("_at") - F.col("_first")).alias("place"))


def first_hop_lists(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, node, t, neighbours): for each query (qid, node, t), all events of its node strictly before t, as structs (nbr, t, edge_id) in order.

    A query needs only how many events its node has before t; these come from counts by moment. It then takes the
    places below that from the numbered history, so what is shuffled is the lists themselves and nothing else.
    """
    h = stored(ordered_history(edges))
    moments = h.groupBy("node", "t").agg(F.max("place").alias("last")).select("node", "t", (F.col("last") + 1).alias("upto"), F.lit(None).cast("long").alias("qid"))
    asked = queries.select("node", "t", F.lit(None).cast("long").alias("upto"), "qid")
    # a moment counts for queries after it: at equal times, queries come first
    w = Window.partitionBy("node").orderBy("t", F.col("qid").isNull(), "qid").rowsBetween(Window.unboundedPreceding, 0)
    upto = moments.unionByName(asked).withColumn("upto", F.max("upto").over(w)).where("qid is not null")
    places = upto.where("upto > 0").select("qid", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("upto") - 1)).alias("place"))
    found = places.join(h.select("node", "place", F.struct("nbr", "t", "edge_id").alias("e")), ["node", "place"])
    lists = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "e"))).alias("l")).select("qid", F.col("l.e").alias("neighbours"))
    return upto.select("qid", "node", "t").join(lists, "qid", "left").select("qid", "node", "t", F.coalesce("neighbours", F.array()).alias("neighbours"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(edge_id, common): how many neighbours both ends of an edge have in common when it has been read.

    Edges are read source by source, in the order in which sources first appear, and by (t, edge_id) within one. A common
    neighbour counts from the later of the first two edges that link it with the two ends, so each triangle gives one
    such moment to each of its sides, and an edge counts its pair's moments up to its own. No sets are carried.
    """
    e = edges.where("src <> dst")
    first = e.groupBy("src").agg(F.min(F.struct("t", "edge_id")).alias("_first"))
    e = stored(e.join(first, "src").select("edge_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.struct("_first", F.struct("t", "edge_id").alias("_own")).alias("at")))
    met = stored(e.groupBy("a", "b").agg(F.min("at").alias("at")))
    corners = graph.triangles(edges).select(F.array_sort(F.array("x", "y", "z")).alias("c")).select(*[F.col("c")[k].alias(n) for k, n in enumerate("xyz")])
    for p, q in ("xy", "xz", "yz"):
        corners = corners.join(met.select(F.col("a").alias(p), F.col("b").alias(q), F.col("at").alias(p + q)), [p, q])
    sides = [F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.greatest(r, s).alias("at")) for p, q, r, s in (("x", "y", "xz", "yz"), ("x", "z", "xy", "yz"), ("y", "z", "xy", "xz"))]
    closed = corners.select(F.explode(F.array(*sides)).alias("s")).select("s.*", F.lit(None).cast("long").alias("edge_id"), F.lit(1).alias("n"))
    both = closed.unionByName(e.select("a", "b", "at", "edge_id", F.lit(0).alias("n")))
    w = Window.partitionBy("a", "b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("common", F.sum("n").over(w)).where("edge_id is not null").select("edge_id", "common")


def future_references(queries: DataFrame, future: DataFrame, k: int = 3) -> DataFrame:
    """(qid, labels): for each (qid, src, dst) the first ``k`` labels to come: those of src's edges in order, then those of edges to dst.

    No query takes more than ``k`` from either side, so each node keeps its first ``k`` edges before any are joined.
    """
    sides = []
    for side, end in enumerate(("src", "dst")):
        order = Window.partitionBy(end).orderBy("t", "edge_id")
        few = future.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        few = few.groupBy(end).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "label"))), lambda x: x["label"]).alias(f"_l{side}"))
        sides.append(few)
    found = queries.join(sides[0], "src", "left").join(sides[1], "dst", "left")
    none = F.array().cast("array<string>")
    return found.select("qid", F.slice(F.concat(F.coalesce("_l0", none), F.coalesce("_l1", none)), 1, k).alias("labels"))
