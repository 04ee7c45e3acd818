"""Packing with optimal length buckets.

A dynamic programme over the global length histogram picks the bucket boundaries that minimise padding;
inside each bucket, sequences padded to the bucket's length fill batches of a token budget.

Scale: one narrow aggregation makes the exact histogram; the driver sees nothing else. Texts of t words in all have
fewer than sqrt(2 t) different lengths, some 20,000 for 1 GB and 6 million for 100 TB, and the programme takes
buckets x lengths x log(lengths) steps, since the best cut never moves back as a bucket's end moves on. Numbering inside a
bucket is split into chunks by a hash; the chunks' counts turn local row numbers into bucket-wide ones, so
no task ever holds a whole bucket. Texts do not move: only ids and lengths are shuffled.

Defined cases: null and empty texts have length 0 and get bucket and batch null (nothing to train on);
repeated rows are separate sequences; an empty table gives no rows; a text longer than the token budget
gets a batch of its own. Other columns are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.session import stored

#: Rows of one numbering chunk, about.
CHUNK_ROWS = 1024


def word_count(text: Column) -> Column:
    """Length in white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _best_cuts(best: np.ndarray, lengths: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, cut) for every end j: least over i < j of best[i] plus the padding of the bins after i up to j.

    The leftmost best cut never falls as j rises, so the middle of a range of ends splits the cuts to be tried for
    the two halves; all ranges of one depth are tried at once.
    """
    m = len(lengths)
    cost, cut = np.full(m, np.inf), np.full(m, -1)
    first, last, low, high = (np.array([x]) for x in (1, m - 1, 0, m - 2))
    while len(first):
        mid = (first + last) // 2
        top = np.minimum(high, mid - 1)
        size = top - low + 1
        start = np.cumsum(size) - size
        i = np.arange(size.sum()) + np.repeat(low - start, size)
        j = np.repeat(mid, size)
        total = best[i] + lengths[j] * (n[j + 1] - n[i + 1]) - (tokens[j + 1] - tokens[i + 1])
        least = np.minimum.reduceat(total, start)
        at = np.flatnonzero(total == np.repeat(least, size))
        at = at[np.searchsorted(at, start)]
        cost[mid], cut[mid] = least, i[at]
        first, last = np.concatenate((first, mid + 1)), np.concatenate((mid - 1, last))
        low, high = np.concatenate((low, i[at])), np.concatenate((i[at], high))
        some = first <= last
        first, last, low, high = first[some], last[some], low[some], high[some]
    return cost, cut


def optimal_boundaries(lengths, counts, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    cost(i, j) pads the bins i..j to lengths[j]; best[k][j] = min over i of best[k-1][i-1] + cost(i, j).
    """
    lengths, counts = np.asarray(lengths, dtype=np.float64), np.asarray(counts, dtype=np.float64)
    if not len(lengths):
        return []
    n = np.concatenate(([0.0], np.cumsum(counts)))
    tokens = np.concatenate(([0.0], np.cumsum(counts * lengths)))
    best = lengths * n[1:] - tokens[1:]
    cuts = []
    for _ in range(1, min(buckets, len(lengths))):
        now, cut = _best_cuts(best, lengths, n, tokens)
        cut[now >= best] = -1
        best = np.minimum(now, best)
        cuts.append(cut)
    out, j = [], len(lengths) - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            out.append(int(lengths[j]))
            j = int(cut[j])
    out.append(int(lengths[j]))
    return out[::-1]


def pack(docs: DataFrame, budget: int = 16384, buckets: int = 16, length: Column | None = None, key: str = "doc_id") -> DataFrame:
    """(columns of docs other than text), n_tokens, bucket, bucket_length, batch, slot for every row of ``docs``.

    A batch of bucket b holds max(1, budget // bucket_length) rows; slot is the place inside the batch.
    Rows are numbered by (hash of key and length, key), so equal input gives equal batches.
    """
    rest = [c for c in docs.columns if c != "text"]
    new = ["n_tokens", "bucket", "bucket_length", "batch", "slot"]
    if set(rest) & set(new):
        docs = docs.drop(*new)
        rest = [c for c in rest if c not in new]
    lengths = docs.select(*rest, (word_count(F.col("text")) if length is None else length).alias("n_tokens"))
    lengths = stored(lengths)
    histogram = lengths.where("n_tokens > 0").groupBy(F.col("n_tokens").alias("l")).count().orderBy("l").collect()
    bounds = optimal_boundaries([r.l for r in histogram], [r["count"] for r in histogram], buckets)
    if not bounds:
        return lengths.select(*rest, "n_tokens", *[F.lit(None).cast("long").alias(c) for c in new[1:]])
    sizes = [sum(r["count"] for r in histogram if lo < r.l <= hi) for lo, hi in zip([0, *bounds], bounds)]
    index = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("n_tokens"))).cast("long")
    chunks = F.array(*[F.lit(-(-s // CHUNK_ROWS)) for s in sizes])
    some = lengths.where("n_tokens > 0").withColumn("bucket", index)
    some = some.withColumn("_h", F.xxhash64(key, "n_tokens")).withColumn("_chunk", F.pmod("_h", chunks[F.col("bucket").cast("int")]))
    counts = some.groupBy("bucket", "_chunk").count()
    before = Window.partitionBy("bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    numbered = some.withColumn("_n", F.row_number().over(Window.partitionBy("bucket", "_chunk").orderBy("_h", key)) - 1)
    top = F.array(*[F.lit(b) for b in bounds])[F.col("bucket").cast("int")].cast("long")
    room = F.greatest(F.floor(F.lit(budget) / top), F.lit(1))
    at = F.col("_n") + F.col("_before")
    packed = numbered.join(counts, ["bucket", "_chunk"]).select(*rest, "n_tokens", "bucket", top.alias("bucket_length"), F.floor(at / room).cast("long").alias("batch"), F.pmod(at, room).cast("long").alias("slot"))
    return packed.unionByName(lengths.where("n_tokens = 0").select(*rest, "n_tokens", *[F.lit(None).cast("long").alias(c) for c in new[1:]]))
