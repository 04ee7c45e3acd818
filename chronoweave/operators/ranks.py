"""Ranks mapped to a target distribution, without a global sort task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators.distributions import running_sums


def mapped(have: DataFrame, value: str, target: DataFrame, to: str, ties: str) -> DataFrame:
    """``have`` with ``mapped``: the target's value at the row's quantile, between its two nearest.

    ``ties``: "mean", equal values share their mean rank divided by the rows; or a column by which they are told
    apart, with (rank - 1) / (rows - 1). Equal values are counted first and summed by ranges, so no task sorts
    all rows; where a column tells them apart, only rows of one value are numbered together.
    """
    k = running_sums(have.groupBy(value).agg(F.count("*").alias("_n")), value, "_n")
    n = have.agg(F.count("*").alias("_all"))
    m = target.agg(F.count("*").alias("_m"))
    rows = have.join(k, value).join(F.broadcast(n)).join(F.broadcast(m))
    if ties == "mean":
        q = (F.col("_n_before") + 1 + (F.col("_n") - 1) / 2) / F.col("_all")
    else:
        own = F.row_number().over(Window.partitionBy(value).orderBy(ties))
        q = (F.col("_n_before") + own - 1) / F.greatest(F.col("_all") - 1, F.lit(1))
    rows = rows.withColumn("_pos", q * (F.col("_m") - 1)).withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))
    t = running_sums(target.groupBy(F.col(to).alias("_v")).agg(F.count("*").alias("_k")), "_v", "_k")
    # targets are counts: with a sum of s there are fewer than sqrt(2 s) different ones, so they can be broadcast
    places = rows.select(F.explode(F.array("_lo", "_hi")).alias("_p")).distinct()
    at = places.join(F.broadcast(t), (F.col("_p") >= F.col("_k_before")) & (F.col("_p") < F.col("_k_before") + F.col("_k"))).select("_p", "_v")
    out = rows.join(at.toDF("_lo", "_a"), "_lo").join(at.toDF("_hi", "_b"), "_hi")
    mapped_to = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.col("_lo"))
    return out.select(*have.columns, mapped_to.alias("mapped"))
