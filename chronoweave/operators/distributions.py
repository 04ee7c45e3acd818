"""Distributions over groups: ranks without one global sort task, histograms, distances, classification scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.session import stored

#: Ranges into which a global running sum is cut; only their totals meet in one task.
RANGES = 64


def running_sums(df: DataFrame, key: str, *values: str) -> DataFrame:
    """``df`` with, per value column v, v_before: the sum of v over rows with a smaller ``key``.

    Rows should be one per key (group first). Keys are cut into ``RANGES`` ranges of about as many rows each, by
    approximate quantiles; each is summed by itself and the totals of the ranges, few whatever the data, are added
    by a broadcast join.
    """
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = df.agg(F.approx_percentile(F.col(key).cast("double"), shares, F.lit(1000)).alias("_bounds"))
    part = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(key).cast("double"))), F.lit(0))
    cut = df.join(F.broadcast(bounds)).withColumn("_part", part).drop("_bounds")
    totals = cut.groupBy("_part").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_t{i}") for i in range(len(values))])
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(totals), "_part")
    for i, v in enumerate(values):
        out = out.withColumn(f"{v}_before", F.col(f"_t{i}") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.drop("_part", *[f"_t{i}" for i in range(len(values))])


def row_numbers(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``df``, stored, with the place from 0 of each row in the order of some columns that tell all rows apart.

    Ranges of the order are sorted each by itself; their sizes, one row a partition, are summed up in one task.
    """
    low = (1 << 33) - 1  # of an increasing id, the row's place in its partition
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit(low))).drop("_id", "_part", "_before")


def running_counts(df: DataFrame, flag: str, *order: str, name: str = "count") -> DataFrame:
    """``df``, stored, with how many rows up to and with each one, in the order of some columns, have ``flag`` 1 and not 0.

    As ``row_numbers``, by ranges of the order: no task holds more than a range, whatever the keys.
    """
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.sum(flag).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_in", F.sum(flag).over(inside)).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_id", "_part", "_before", "_in")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], discrete: bool = False) -> DataFrame:
    """One row: exact quantiles by name, between the two nearest values, or the first value that covers the share.

    Equal values are counted before they are sorted, and sorted range by range, so no task holds all of them.
    """
    k = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    total = k.agg(F.sum("_n").alias("_all"))
    r = running_sums(k, value, "_n").join(F.broadcast(total))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n")), F.col(value)))

    out = []
    for name, p in shares.items():
        place = F.lit(p) * (F.col("_all") - 1)
        if discrete:
            out.append(at(F.greatest(F.ceil(F.lit(p) * F.col("_all")) - 1, F.lit(0))).alias(name))
        else:
            low, high = at(F.floor(place)), at(F.ceil(place))
            out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return r.agg(*out)


def gini(df: DataFrame, value: str, first: int = 0) -> DataFrame:
    """One row: 2 sum(i x_i) / (n sum x) - (n + 1) / n over ascending x, i counting from ``first`` (0 as in the definition kept here, 1 for the usual index)."""
    k = df.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("c"))
    r = running_sums(k, "x", "c")
    c, b = F.col("c").cast("double"), F.col("c_before").cast("double")
    index = F.sum(F.col("x") * (c * b + c * (c - 1) / 2 + first * c))
    n, total = F.sum(c), F.sum(F.col("x") * c)
    return r.agg((2 * index / (n * total) - (n + 1) / n).alias("gini"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the chance that a positive outscores a negative, ties counting half; null without both kinds."""
    k = df.groupBy(F.col(score).alias("x")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    r = running_sums(k, "x", "q")
    p, q, below = (F.col(c).cast("double") for c in ("p", "q", "q_before"))
    return r.agg((F.sum(p * (below + q / 2)) / F.nullif(F.sum(p) * F.sum(q), F.lit(0.0))).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: sum over falling thresholds of (recall step) x precision, one threshold per distinct score."""
    k = df.groupBy((-F.col(score)).alias("x")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    r = running_sums(k, "x", "p", "n")
    precision = (F.col("p_before") + F.col("p")) / (F.col("n_before") + F.col("n"))
    return r.agg((F.sum(F.col("p") * precision) / F.nullif(F.sum("p"), F.lit(0))).alias("ap"))


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n): equal-width bins over the value's own range, the last one closed on the right."""
    span = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    place = F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins)
    at = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("long")
    return df.join(F.broadcast(span)).where(F.col(value).isNotNull()).groupBy(*(by or []), at.alias("bin")).agg(F.count("*").alias("n"))


def dense_bins(h: DataFrame, bins: int, side: Column) -> DataFrame:
    """(bin, p, q): shares of the bins where ``side`` holds and where not, zeros filled in; ``bins`` rows."""
    grid = h.sparkSession.range(bins).select(F.col("id").alias("bin"))
    k = h.groupBy("bin").agg(F.sum(F.when(side, F.col("n"))).alias("x"), F.sum(F.when(~side, F.col("n"))).alias("y"))
    total = k.agg(F.sum("x").alias("_x"), F.sum("y").alias("_y"))
    d = grid.join(F.broadcast(k), "bin", "left").join(F.broadcast(total))
    return d.select("bin", (F.coalesce("x", F.lit(0)) / F.col("_x")).alias("p"), (F.coalesce("y", F.lit(0)) / F.col("_y")).alias("q"))


def distances(d: DataFrame) -> DataFrame:
    """One row of distances between the shares p and q of few ordered bins: wasserstein (bins apart), total variation, KL, Gaussian kernel."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = d.withColumn("c", F.abs(F.sum(F.col("p") - F.col("q")).over(w)))
    gap = F.col("p") - F.col("q")
    kl = F.sum(F.when(F.col("p") > 0, F.col("p") * F.log((F.col("p") + 1e-10) / (F.col("q") + 1e-10))).otherwise(0.0))
    return c.agg(F.sum("c").alias("wasserstein"), (F.sum(F.abs(gap)) / 2).alias("total_variation"), kl.alias("kl"), F.exp(-F.sum(gap * gap) / 2).alias("gaussian"))


def classification(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(class, support, precision, recall, f1) for each value of either column; a ratio with nothing below is 0."""
    k = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("z")).agg(F.count("*").alias("n"))
    sides = k.select(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).alias("named"), F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(0).alias("right"))
    sides = sides.union(k.select("z", F.lit(0), "n", F.lit(0)))
    s = sides.where("class is not null").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "named", "right")])
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r, f = ratio(F.col("right"), F.col("named")), ratio(F.col("right"), F.col("support")), ratio(2 * F.col("right"), F.col("named") + F.col("support"))
    return s.select("class", "support", p.alias("precision"), r.alias("recall"), f.alias("f1"))
