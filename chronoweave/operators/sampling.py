"""Seeded sampling by hash: the same rows whatever the partitioning, and nothing is ranked that need not be."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from the keys' text: 32 bits of an md5, which any engine can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def gaussians(n: int, seed: int, *keys: str | Column) -> Column:
    """``n`` standard normal numbers from the keys' text: four from the four 32-bit quarters of an md5, by Box and Muller."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])

    def four(block: Column) -> Column:
        digest = F.md5(F.concat_ws(":", text, block.cast("string")))
        part = lambda i: (F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
        both = [f(2 * math.pi * part(i + 1)) * F.sqrt(-2 * F.log(part(i))) for i in (0, 2) for f in (F.cos, F.sin)]
        return F.array(*both)

    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 4)), four)), 1, n)


def fraction(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """The rows whose hash is under ``share``: a fraction sample, a Bernoulli sub-sample or a split flag alike."""
    return df.where(uniform(seed, key) < share)


def n_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement: those of the least hashes. Each task keeps its own least ``n`` before they meet."""
    return df.orderBy(uniform(seed, key), key).limit(n)


def weighted(df: DataFrame, by: str, key: str, weight: Column, k: int, seed: int = 0) -> DataFrame:
    """k rows of each ``by`` without replacement, with chances in proportion to ``weight``: the least -ln(u) / weight."""
    u = F.greatest(uniform(seed, by, key), F.lit(2.0**-33))
    r = F.row_number().over(Window.partitionBy(by).orderBy("_e", key))
    return df.withColumn("_e", -F.log(u) / weight).withColumn("_r", r).where(F.col("_r") <= k).drop("_e", "_r")


def with_replacement(df: DataFrame, history: str, draws: int, seed: int, *keys: str) -> DataFrame:
    """``df`` with one row per draw (draw, picked): an element of its array, the same one as often as it is drawn."""
    drawn = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).where(F.size(history) > 0)
    at = F.floor(uniform(seed, *keys, "draw") * F.size(history)).cast("int")
    return drawn.withColumn("picked", F.get(history, at))


def recall_size(k: int, partners: Column, alpha: float | None = None) -> Column:
    """Candidates to recall: ``alpha`` times the partners wanted, or ``k`` but no fewer than these."""
    return F.greatest(F.lit(k), partners) if alpha is None else F.floor(alpha * partners).cast("int")


_OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def rule(rules: dict[str, str]) -> Column:
    """Whether any rule {metric: "op number"} holds; rules are read, never evaluated as code, and no rule lets all through."""
    out = None
    for metric, text in rules.items():
        op = next((o for o in sorted(_OPS, key=len, reverse=True) if text.strip().startswith(o)), None)
        if op is None:
            raise ValueError(f"rule {text!r}: expected one of {sorted(_OPS)} and a number")
        number = float(text.strip()[len(op) :])
        if not math.isfinite(number):
            raise ValueError(f"rule {text!r}: the number must be finite")
        part = F.coalesce(_OPS[op](F.col(metric), F.lit(number)), F.lit(False))
        out = part if out is None else out | part
    return F.lit(True) if out is None else out
