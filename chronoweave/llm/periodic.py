"""Periodic runs of words: maximal stretches that repeat with a smallest period three times or more.

A run is a stretch of consecutive words of one text with smallest period q (words q apart are equal), at least
max(``min_length``, 3 * q) words long, that no neighbouring word extends keeping period q.

For every period q the words at multiples of q are a grid (n / q points, n * log n over all periods). A run of
period q covers three grid points in a row with 2 * q equal pairs behind the first, so only such points whose three
words are equal ask for a common extension; it gives the run's end, and a bisection with the same extensions its
start. Extensions come from ``lce.DifferenceCoverLce``. A stretch that is found for several periods is a run of
the least one, which divides the others.

Scale: texts are cut into words inside the tasks that scan them; nothing is shuffled. Texts of one task are worked
on together up to ``TOGETHER`` bytes, a longer text by itself, in about 200 bytes a word.

Defined cases: a null text has no words and no runs; texts without words, too; a null doc_id stays; repeated rows
each give a row; empty tables give none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.hashing import pieces
from chronoweave.llm.lce import DifferenceCoverLce

MIN_LENGTH = 24
#: Bytes of text that one round of the search takes together.
TOGETHER = 4 << 20
#: Grid points whose extensions are asked together.
AT_ONCE = 1 << 19

_RUNS = "array<struct<start: long, length: long, period: long>>"


def _settle(lce: DifferenceCoverLce, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the stretches whose first grid point is i, with 2 * q equal pairs at least."""
    back = i - q
    inside = np.flatnonzero(back >= 0)
    later = np.zeros(len(i), dtype=bool)
    later[inside] = lce.extension(back[inside], i[inside]) >= q[inside]
    i, q = i[~later], q[~later]
    ahead = lce.extension(i, i + q)
    i, q, ahead = i[ahead > q], q[ahead > q], ahead[ahead > q]
    low, high = np.maximum(i - q, -1) + 1, i.copy()  # the start lies in [low, high]
    while True:
        wide = np.flatnonzero(low < high)
        if not len(wide):
            break
        middle = (low[wide] + high[wide]) // 2
        good = lce.extension(middle, middle + q[wide]) >= i[wide] - middle
        high[wide[good]] = middle[good]
        low[wide[~good]] = middle[~good] + 1
    keep = i + ahead - low >= 2 * q
    return low[keep], (i + q + ahead)[keep], q[keep]


def find_runs(words: np.ndarray, longest: int, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, end, period), by start and period, of the runs of ``words`` (pieces with ends of their own, ``longest`` words at most)."""
    lce, found, held, size = None, [np.zeros((0, 3), dtype=np.int64)], [], 0
    top = longest // 3
    for q in range(1, top + 1):
        grid = words[::q]
        pair = grid[1:] == grid[:-1]
        k = np.flatnonzero(pair[1:] & pair[:-1])
        if len(k):
            held.append((k * q, np.full(len(k), q)))
            size += len(k)
        if held and (size >= AT_ONCE or q == top):
            lce = lce or DifferenceCoverLce(words)
            i, p = (np.concatenate(x).astype(np.int64) for x in zip(*held))
            for at in range(0, len(i), AT_ONCE):
                found.append(np.stack(_settle(lce, i[at : at + AT_ONCE], p[at : at + AT_ONCE]), axis=1))
            held, size = [], 0
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(min_length, 3 * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _together(texts: list[bytes], min_length: int) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """(words, runs) of each text."""
    names: defaultdict = defaultdict()
    names.default_factory = names.__len__
    words = [t.split() for t in texts]  # of bytes: at [\x20\x09-\x0D]
    n = np.array([len(w) for w in words])
    start = np.concatenate(([0], np.cumsum(n + 1)))
    line = np.zeros(start[-1], dtype=np.int64)
    for w, at in zip(words, start):
        line[at : at + len(w)] = list(map(names.__getitem__, w))
    ends = start[1:] - 1
    line[ends] = len(names) + np.arange(len(ends))
    rows = find_runs(line, int(n.max(initial=0)), min_length)
    cut = np.searchsorted(rows[:, 0], start)
    return words, [rows[a:b] - [s, s, 0] for a, b, s in zip(cut, cut[1:], start)]


def _collapsed(words: list[bytes], rows: np.ndarray) -> bytes:
    if not len(rows):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period), and collapsed: the words joined by one space, without those that any run covers after its first period."""

    def search(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            texts = [x.encode("utf-8") if x else b"" for x in column.to_pylist()]
            for a, b in pieces(texts, TOGETHER):
                words, runs = _together(texts[a:b], min_length)
                flat = np.concatenate(runs)
                fields = [pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])]
                found = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32())
                collapsed = [_collapsed(w, r).decode("utf-8") for w, r in zip(words, runs)]
                columns = [ids.slice(a, b - a), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, found), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(search, f"doc_id {kind}, n_words long, runs {_RUNS}, collapsed string")


def rotated(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32 of the decimal doc_id ends in 0, the words from the a-th on repeat the p words there.

    With h that crc32 and g = floor(h / 10): a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), n the number of words.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    n, g = F.col("_n"), F.floor(F.col("_h") / 10)
    a, p = F.col("_a"), F.col("_p")
    tail = F.transform(F.sequence(a, n - 1), lambda i: F.element_at("_words", (a + (i - a) % p + 1).cast("int")))
    turned = F.array_join(F.concat(F.slice("_words", F.lit(1), a.cast("int")), tail), " ")
    return (
        docs.select("doc_id", "text", h.alias("_h"))
        .withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
        .withColumn("_n", F.nullif(F.size("_words").cast("long"), F.lit(0)))
        .withColumn("_a", g % n)
        .withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
        .select("doc_id", F.when(n > 0, turned).otherwise(F.col("text")).alias("text"))
    )


def run_report(docs: DataFrame) -> DataFrame:
    """Per row of the rotated texts: doc_id, n_runs, start, length, period and exponent_milli of the run of the greatest exponent, and digests of all runs and of the collapsed text."""

    def order(x, y):
        more, less = x.length * y.period, y.length * x.period
        return F.when(more > less, -1).when(more < less, 1).when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1)).otherwise(F.when(x.period < y.period, -1).when(x.period > y.period, 1).otherwise(0))

    best = F.try_element_at(F.array_sort("runs", order), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return periodic_runs(rotated(docs)).withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{x}").alias(x) for x in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
