"""Audit of how five document filters interact, kept up to date by incremental retraction streaming.

Filters, by the condition on which a document fails: A under 100 words, B distinct words under 80 % of the words,
C capitals A-Z over 10 % of the code points, D any of ``#$%&*|``, E the text of a smaller doc_id. A to D depend on
the text alone; E depends on all documents, and changes when a smaller doc_id arrives later.

Files are read once, as an available-now stream. Each micro-batch writes the mask of failed filters, the part (the
language) and the digest of the text of its documents, and from these
* counts every document in its part's counter as failing E,
* updates the keyed state, the smallest doc_id of each text: a new smallest one is taken back from that counter and
  counted as passing E; the earlier one, now a copy, is retracted and counted as failing E again.
Counters of micro-batches are signed sums; together they always describe the documents read so far, so a later call
on the same folder reads new files only. The report works on the counters: 128 numbers a part.

Scale: whole texts stay in the scan; 60 bytes a document go on. The state holds as much for each different text
and is written anew by each micro-batch as the next version, so the number of micro-batches should be moderate.
Copies of one text are reduced to their smallest doc_id before the shuffle by text. What a micro-batch writes is
named by its number, so one that is run again after a failure replaces what it left.

Defined cases: null text is the empty one; null language is the part ''; a null doc_id is never smaller nor larger,
so such a document never fails E; rows that repeat a doc_id and its text all pass or fail E together; of several
labels of a document any 1 counts; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import string
import uuid
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.session import shared_dir

FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")
_CAPITALS, _MARKS = string.ascii_uppercase.encode(), b"#$%&*|"
#: Bytes that start a code point in UTF-8.
_STARTS = bytes(b for b in range(256) if b & 0xC0 != 0x80)
_HELD = "array<struct<part: string, label: int, n: long>>"
_STATE = f"digest binary, mask int, doc_id long, held {_HELD}"
_COUNTERS = "part string, mask int, label int, n long"


def failed(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails; A is the lowest."""
    words = text.split()  # of bytes: at [\x20\x09-\x0D]
    points = len(text) - len(text.translate(None, _STARTS))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * points, len(text.translate(None, _MARKS)) < len(text))
    return sum(1 << k for k, x in enumerate(tests) if x)


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of each document."""

    def cut(batches):
        for batch in batches:
            texts = [(x or "").encode("utf-8") for x in batch.column("text").to_pylist()]
            masks = pa.array([failed(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, digests], ["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(cut, "doc_id long, part string, mask int, digest binary")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with label: 1 for quality plus 2 for toxic."""
    flag = lambda c, k: F.max(F.when(F.col(c) == 1, k).otherwise(0))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((flag("quality", 1) + flag("toxic", 2)).alias("label"))
    return rows.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def _merged(state: DataFrame, rows: DataFrame) -> DataFrame:
    """(digest, mask, old, new) of each text: doc_id and held (its rows by part and label) of the smallest doc_id so far and in ``rows``."""
    own = rows.where("doc_id is not null").groupBy("digest", "doc_id", "mask", "part", "label").agg(F.count("*").alias("n"))
    own = own.groupBy("digest", "doc_id", "mask").agg(F.sort_array(F.collect_list(F.struct("part", "label", "n"))).alias("held"))
    both = state.withColumn("old", F.lit(True)).unionByName(own.withColumn("old", F.lit(False)))
    least = F.struct("doc_id", "held")
    return both.groupBy("digest", "mask").agg(F.min(F.when(F.col("old"), least)).alias("old"), F.min(F.when(~F.col("old"), least)).alias("new"))


def _moved(merged: DataFrame) -> DataFrame:
    """Signed counters of the texts whose smallest doc_id, or its rows, changed."""
    first = F.col("old").isNull() | (F.col("new.doc_id") <= F.col("old.doc_id"))
    none = F.array().cast(_HELD)
    come = F.when(F.col("new").isNotNull() & first, F.col("new.held")).otherwise(none)
    go = F.when(F.col("new.doc_id") < F.col("old.doc_id"), F.col("old.held")).otherwise(none)
    signed = lambda held, n: F.transform(held, lambda x: F.struct(x.part.alias("part"), x.label.alias("label"), (x.n * n).alias("n")))
    moves = merged.select("mask", F.explode(F.concat(signed(come, 1), signed(go, -1))).alias("x")).select("mask", "x.*")
    both = F.explode(F.array(F.struct(F.col("mask").alias("to"), F.col("n").alias("by")), F.struct((F.col("mask") + _COPY).alias("to"), (-F.col("n")).alias("by"))))
    return moves.select("part", "label", both.alias("x")).select("part", F.col("x.to").alias("mask"), "label", F.col("x.by").alias("n"))


def _next_state(merged: DataFrame) -> DataFrame:
    """The smallest doc_id of each text after this micro-batch; equal doc_ids join their rows."""
    old, new = F.col("old"), F.col("new")
    doc_id = F.least("old.doc_id", "new.doc_id")
    none = F.array().cast(_HELD)
    held = F.concat(F.when(old["doc_id"] == doc_id, old["held"]).otherwise(none), F.when(new["doc_id"] == doc_id, new["held"]).otherwise(none))
    return merged.select("digest", "mask", doc_id.alias("doc_id"), held.alias("held"))


def update(spark: SparkSession, documents: str, labels: DataFrame, folder: str, micro_batches: int = 4) -> None:
    """Read those files of the Parquet table at ``documents`` that no earlier call on ``folder`` (shared) has read, about ``micro_batches`` micro-batches for the whole table."""
    table = spark.read.parquet(documents)
    files = table.inputFiles()
    if [f.rsplit("/", 1)[-1] for f in files] == [documents.rstrip("/").rsplit("/", 1)[-1]]:
        documents = f"{documents[:-1]}[{documents[-1]}]"  # one file: a stream reads folders, or what a pattern finds
    a_time = max(1, -(-len(files) // micro_batches))
    spark.createDataFrame([], _COUNTERS).write.mode("overwrite").parquet(f"{folder}/counters/batch=-1")
    spark.createDataFrame([], _STATE).write.mode("overwrite").parquet(f"{folder}/state/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        masked(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        rows = _labelled(spark.read.parquet(f"{folder}/rows/batch={number}"), labels)
        state = spark.read.schema(_STATE).parquet(f"{folder}/state/batch={number - 1}")
        merged = _merged(state, rows)
        copies = F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(F.col("mask") + _COPY)
        counted = rows.select("part", copies.alias("mask"), "label", F.lit(1).cast("long").alias("n"))
        _next_state(merged).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        deltas = counted.unionByName(_moved(merged)).groupBy("part", "mask", "label").agg(F.sum("n").alias("n"))
        deltas.where("n <> 0").write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", a_time).parquet(documents)
    stream = stream.select("doc_id", "lang", "text").writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """(part, mask, label, n): the documents read so far, by the filters that they fail."""
    parts = spark.read.schema(_COUNTERS).parquet(f"{folder}/counters/*")
    return parts.groupBy("part", "mask", "label").agg(F.sum("n").alias("n")).where("n <> 0")


def _steps() -> list[dict]:
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": k + 1, "bit": bit, "before": before})
            before |= bit
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the step keeps, removes, would have removed, and loses."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "label", "n")).alias("cells"))
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = cells.select("part", "cells", F.explode(steps).alias("s")).select("part", "cells", "s.*")
    fails = lambda c: c.mask.bitwiseAND(F.col("bit")) != 0
    gone = lambda c: c.mask.bitwiseAND(F.col("before")) != 0
    total = lambda test: F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda s, c: s + c.n)
    rows = rows.select(
        "part",
        "filter_order",
        "step",
        "bit",
        total(lambda c: ~gone(c) & ~fails(c)).alias("kept"),
        total(lambda c: ~gone(c) & fails(c)).alias("removed"),
        total(lambda c: gone(c) & fails(c)).alias("redundant"),
        total(lambda c: c.mask == F.col("bit")).alias("unique_fails"),
        total(lambda c: ~gone(c) & fails(c) & (c.label.bitwiseAND(F.lit(1)) != 0)).alias("good_lost"),
        total(lambda c: ~gone(c) & fails(c) & (c.label.bitwiseAND(F.lit(2)) != 0)).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(spark: SparkSession, documents: str, labels: DataFrame, micro_batches: int = 4) -> DataFrame:
    """The interactions over a whole Parquet table."""
    folder = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    update(spark, documents, labels, folder, micro_batches)
    return interactions(counters(spark, folder))
