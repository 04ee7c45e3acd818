"""Vectors as array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-8))


def summed(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def softmax(a: Column) -> Column:
    """exp(x - max) over their sum, element by element; the maximum and the sum are bound once."""
    e = F.transform(F.array(F.struct(a.alias("v"), F.array_max(a).cast("double").alias("most"))), lambda s: F.transform(s.v, lambda x: F.exp(x.cast("double") - s.most)))
    bound = F.transform(e, lambda v: F.struct(v.alias("v"), summed(v).alias("total")))
    return F.transform(bound, lambda s: F.transform(s.v, lambda x: x / s.total))[0]


def with_norm(a: Column) -> Column:
    """A vector beside its length, for ``unit_cosine``: computed once a vector and not once a pair."""
    return F.struct(a.alias("v"), F.sqrt(dot(a, a)).alias("norm"))


def unit_cosine(a: Column, b: Column) -> Column:
    return dot(a["v"], b["v"]) / F.greatest(a["norm"] * b["norm"], F.lit(1e-8))


def padded(a: Column, n: int, pad: Column) -> Column:
    """The first ``n`` elements, filled up on the right."""
    return F.slice(F.concat(a, F.array_repeat(pad, n)), 1, n)


def time_encoding(dt: Column, dims: int) -> Column:
    """cos(w dt) for ``dims`` frequencies w from 1 down to 1e-9, evenly spaced in their exponent."""
    ws = [10.0 ** (-9.0 * i / max(1, dims - 1)) for i in range(dims)]
    return F.array(*[F.cos(F.lit(w) * dt) for w in ws])


def curriculum(estimate: Column, truth: Column, t: float) -> Column:
    """The estimate plus the truth with a weight that grows from 1 to 5 with the step."""
    return estimate + min(max(0.01 * t, 1.0), 5.0) * truth


def clipped_ratio(logp: Column, old: Column, advantage: Column, clip: float = 0.2, dual: float = 3.0) -> Column:
    """The token loss of a clipped policy ratio; for negative advantages bounded by ``dual`` times them."""
    ratio = F.exp(logp - old)
    loss = F.greatest(-advantage * ratio, -advantage * F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)))
    return F.when(advantage < 0, F.least(loss, -advantage * dual)).otherwise(loss)


def k3(logp: Column, reference: Column) -> Column:
    """The low-variance estimate of the divergence from a reference: exp(r) - r - 1, r = reference - logp."""
    return F.exp(reference - logp) - (reference - logp) - 1
