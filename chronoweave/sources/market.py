"""A market data set of several files as tables: interactions between members with their items' code lists, and members' features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import stored


def read_market(spark: SparkSession, interactions: str, items: str, mapping: str, members: str, window: int = 86400) -> tuple[DataFrame, DataFrame]:
    """(edges, features) from the files of a market data set.

    ``interactions``: CSV of src_member_id, dst_member_id, id (of an item) and ds (a date or time). ``items``: JSON lines of id and
    codes, a list of numbers of any length. ``mapping``: CSV of member_id and node. ``members``: CSV of member_id and feature_list,
    numbers between colons.

    edges: (src, dst, t, w, id, codes) with both ends mapped to nodes, seconds in UTC, and the window counted from the first
    second. An interaction with an end or a date that is not known is left out; an item without codes has an empty list.
    features: (node, features) of the members that are mapped and have a list; an entry that is no number is null. All joins
    are on ids; items and members may be as many as interactions.
    """
    nodes = spark.read.option("header", True).csv(mapping).select(F.col("member_id"), F.col("node").try_cast("long").alias("node")).where("node is not null")
    codes = spark.read.schema("id string, codes array<long>").json(items)
    e = spark.read.option("header", True).csv(interactions).withColumn("t", F.unix_timestamp(F.try_to_timestamp("ds")))
    e = e.join(nodes.toDF("src_member_id", "src"), "src_member_id").join(nodes.toDF("dst_member_id", "dst"), "dst_member_id").where("t is not null")
    e = e.join(codes, "id", "left").select("src", "dst", "t", F.col("id").try_cast("long").alias("id"), F.coalesce("codes", F.array().cast("array<long>")).alias("codes"))
    e = stored(e)  # the first second is looked for in all rows: files are read and joined once
    first = e.agg(F.min("t").alias("_t0"))
    e = e.join(F.broadcast(first)).withColumn("w", F.floor((F.col("t") - F.col("_t0")) / window).cast("long")).select("src", "dst", "t", "w", "id", "codes")
    numbers = F.transform(F.split(F.btrim("feature_list", F.lit(":")), ":"), lambda x: x.try_cast("double"))
    f = spark.read.option("header", True).csv(members).where("feature_list is not null").join(nodes, "member_id").select("node", numbers.alias("features"))
    return e, f
