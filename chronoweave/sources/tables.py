"""The driver tables as temporal graphs: edges, node vectors, report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.session import table

DAY = 86400


def epoch(ts):
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")


def social_edges(spark, d) -> DataFrame:
    """(edge_id, src, dst, t, label): an event and the next event's user of its type; no self loops.

    Event types are few, so events are put in order day by day: the last event of a day takes the first one of
    the type's next day, which are one row a type and day and go by broadcast.
    """
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("_day"))
    inside = Window.partitionBy("event_type", "_day").orderBy("ts", "event_id")
    first = e.groupBy(F.col("event_type").alias("_type"), F.col("_day").alias("_of")).agg(F.min_by(F.struct("user_id"), F.struct("ts", "event_id")).alias("_first"))
    first = first.withColumn("_next", F.lead("_first").over(Window.partitionBy("_type").orderBy("_of"))).drop("_first")
    e = e.withColumn("_in", F.lead(F.struct("user_id")).over(inside))
    e = e.join(F.broadcast(first), e["event_type"].eqNullSafe(first["_type"]) & e["_day"].eqNullSafe(first["_of"]))
    e = e.withColumn("dst", F.coalesce("_in", "_next")["user_id"])
    return e.where("dst is not null and dst <> user_id").select(F.col("event_id").alias("edge_id"), F.col("user_id").alias("src"), "dst", epoch(F.col("ts")).alias("t"), F.col("event_type").alias("label"))


def trade_edges(spark, d) -> DataFrame:
    """(src customer, dst supplier, t, label) of every line item."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag")
    return i.join(o, i["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), epoch(F.col("l_shipdate")).alias("t"), F.col("l_returnflag").alias("label"))


def report_rows(spark, d) -> DataFrame:
    """(model, dataset, m1, m2): customers' nations as models, market segments as datasets."""
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("model"), F.col("c_mktsegment").alias("dataset")).agg(F.avg("c_acctbal").alias("m1"), F.count("*").cast("double").alias("m2"))
