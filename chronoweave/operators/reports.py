"""Report algebra: normalise, rank, pivot and pick over (model, dataset, metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``; ValueError if it lacks one of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def min_max(df: DataFrame, metric: str, by: str = "dataset", reverse: bool = False) -> DataFrame:
    w = Window.partitionBy(by)
    x = F.coalesce(metric, F.lit(0.0))
    scaled = F.coalesce((x - F.min(x).over(w)) / F.nullif(F.max(x).over(w) - F.min(x).over(w), F.lit(0.0)), F.lit(0.0))
    return df.withColumn(f"{metric}_scaled", 1 - scaled if reverse else scaled)


def ranked(df: DataFrame, metric: str, by: str = "dataset", ascending: bool = False, method: str = "min") -> DataFrame:
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    r = F.rank().over(Window.partitionBy(by).orderBy(order))
    if method == "max":
        r = r + F.count("*").over(Window.partitionBy(by, metric)) - 1
    return df.withColumn(f"{metric}_rank", r.cast("long"))


def best(df: DataFrame, metric: str, by: str = "dataset", key: str = "model") -> DataFrame:
    """The first row of each group by (metric descending, key)."""
    return df.groupBy(by).agg(F.min_by(F.struct(key, metric), F.struct(-F.col(metric), key)).alias("b")).select(by, f"b.{key}", f"b.{metric}")


def marked(df: DataFrame, metric: str, by: str = "dataset", ascending: bool = False, near: float = 1e-6) -> DataFrame:
    """``df`` with mark: bold for the best value of its group, underline for the second of the sorted values."""
    values = F.slice(F.sort_array(F.collect_list(metric), ascending), 1, 2)
    two = df.groupBy(by).agg(values.alias("_v"))
    at = lambda i: F.abs(F.col(metric) - F.try_element_at("_v", F.lit(i))) < near
    return df.join(two, by).withColumn("mark", F.when(at(1), "bold").when(at(2), "underline").otherwise("")).drop("_v")


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """``df``, one row per number ``key``, with id: 1, 2, ... in the order of ``key``."""
    from chronoweave.operators.distributions import running_sums

    return running_sums(df.withColumn("_one", F.lit(1)), key, "_one").withColumn("id", F.col("_one_before").cast("long") + 1).drop("_one", "_one_before")


def quantile_rank(df: DataFrame, value: str) -> DataFrame:
    """``df`` with q: the mean rank of its value among all rows, divided by their number."""
    from chronoweave.operators.distributions import running_sums

    k = running_sums(df.groupBy(value).agg(F.count("*").alias("_n")), value, "_n")
    n = df.agg(F.count("*").alias("_all"))
    ranks = k.join(F.broadcast(n)).select(value, ((F.col("_n_before") + (F.col("_n") + 1) / 2) / F.col("_all")).alias("q"))
    return df.join(ranks, value)


def interpolated(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with {value}_filled: linear between known neighbours in row order; the last known value after them, null before."""
    w = Window.partitionBy(*by).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rn, v = F.col("_r"), F.col(value)
    known = F.when(v.isNotNull(), F.struct(rn.alias("r"), v.alias("v")))
    out = df.withColumn("_r", F.row_number().over(w)).withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (rn - a["r"]) / (b["r"] - a["r"])
    return out.withColumn(f"{value}_filled", F.when(v.isNotNull(), v).when(b.isNull(), a["v"]).otherwise(line)).drop("_r", "_a", "_b")


def strided(df: DataFrame, by: list[str], order: list[str], item: str, size: int, stride: int) -> DataFrame:
    """(by..., start, items): windows of ``size`` ordered rows at every ``stride``; rows go to the windows they stand in."""
    i = F.col("_i")
    first = F.greatest(F.ceil((i - size + 1) / stride), F.lit(0))
    e = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)
    e = e.select(*by, "_i", F.col(item).cast("string").alias("_x"), F.explode(F.sequence(first, F.floor(i / stride))).alias("_s"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda x: x["_x"])
    return e.groupBy(*by, (F.col("_s") * stride).alias("start")).agg(F.array_join(items, ",").alias("items"))


def batch_weights(rows: DataFrame, batch: str, length: str, difficulty: str | None = None) -> DataFrame:
    """``rows`` with ``weight``: harder samples weigh more, longer ones less, and the weights of a batch sum to its number of rows.

    The difficulty, cut to [0, 1], gives 0.5 to 2; the length, scaled to [0, 1] within the batch, gives 1.5 to 0.5. A null
    difficulty gives 1, a null length counts as 0, a null batch is a batch of its own. The sum over a batch follows from the
    extremes and two sums, so one aggregate, one row a batch, is all that is shuffled before the join.
    """
    d = F.lit(1.0) if difficulty is None else F.when(F.col(difficulty).isNull(), 1.0).otherwise(0.5 + 1.5 * F.least(F.greatest(F.col(difficulty), F.lit(0.0)), F.lit(1.0)))
    x = rows.withColumn("_d", d).withColumn("_n", F.coalesce(F.col(length).cast("double"), F.lit(0.0)))
    s = x.groupBy(F.col(batch).alias("_batch")).agg(F.count("*").alias("_rows"), F.min("_n").alias("_lo"), (F.max("_n") - F.min("_n") + 1e-8).alias("_range"), F.sum("_d").alias("_sum"), F.sum(F.col("_d") * F.col("_n")).alias("_dot"))
    s = s.select("_batch", "_rows", "_lo", "_range", (1.5 * F.col("_sum") - (F.col("_dot") - F.col("_lo") * F.col("_sum")) / F.col("_range")).alias("_total"))
    own = F.col("_d") * (1.5 - (F.col("_n") - F.col("_lo")) / F.col("_range"))
    x = x.join(s, F.col(batch).eqNullSafe(F.col("_batch")))
    return x.withColumn("weight", own * F.col("_rows") / (F.col("_total") + 1e-8)).select(*rows.columns, "weight")
