"""Exact dedup by deterministic block naming: every document gets one integer identity without collisions.

Texts are compared without the characters [\\x20\\x09-\\x0D]. Each is cut into blocks of ``BLOCK`` bytes (the last
one may be shorter). Sorting all blocks names them: equal blocks, and no others, share an integer, the number of
the first of them. Names of adjacent blocks form pairs, pairs are sorted and named in the same way, and so on until
a document has one name; with the number of rounds, that is its identity. No hash stands for a text. A document
with a block or pair that occurs once is equal to no other, and leaves the rounds at once.

Scale: a task deals its texts into batches of up to ``BATCH_BYTES`` and numbers their blocks; equal blocks and equal
texts leave a batch once, so a text that a third of all rows share crosses the network once a batch and not once a
row. Batches are written to the shared folder, since both the naming and the way back read them and a lost task
may not number its texts anew. Blocks are shuffled once; everything after that is integers. Rounds: the logarithm
of the blocks of the longest text that no single block has told apart.

Defined cases: null counts as the empty text, which has one empty block; of equal texts the row with the most code
points in its original text stays, then the smallest doc_id (null after all others); a row is kept if its doc_id
is the one that stays, so rows that repeat a doc_id stand or fall together, and rows without one are kept if no
equal text has one; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from chronoweave.session import stored

BLOCK = 4096
BATCH_BYTES = 16 << 20
BATCH_ROWS = 20_000
_WHITE = b" \t\n\x0b\x0c\r"
#: Bits of a block's number inside its batch, and of a batch's inside its task.
_NUMBER, _BATCH = 26, 17
#: Rows that hold a block of a batch, a text of a batch (by its first number), or one row of the table.
_BLOCKS, _TEXTS, _ROWS = 0, 1, 2
_PACKED = pa.schema([("kind", pa.int32()), ("number", pa.int64()), ("block", pa.binary()), ("held", pa.int64()), ("blocks", pa.list_(pa.int64())), ("size", pa.int64()), ("chars", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string())])


class _Batch:
    """Blocks and texts of one batch: equal ones share a number."""

    def __init__(self, key: int):
        self.next, self.bytes = key << _NUMBER, 0
        self.blocks: dict[bytes, list[int]] = {}  # number, occurrences
        self.texts: dict[tuple, list] = {}  # number, size, chars, doc_id, sha256
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, text: str, width: int) -> None:
        plain = text.encode("utf-8").translate(None, _WHITE)
        cut = [self.blocks.setdefault(plain[at : at + width], [self.next + k, 0]) for k, at in enumerate(range(0, max(len(plain), 1), width))]
        numbers = tuple(b[0] for b in cut)
        found = self.texts.get(numbers)
        if found is None:
            found = self.texts[numbers] = [self.next, 0, len(text), doc_id, hashlib.sha256(plain).hexdigest()]
            for b in cut:
                b[1] += 1
            self.next += len(cut)
            self.bytes += len(plain)
        found[1] += 1
        if (-len(text), doc_id is None, doc_id or 0) < (-found[2], found[3] is None, found[3] or 0):
            found[2:4] = len(text), doc_id
        self.rows.append((found[0], doc_id))

    def arrow(self) -> pa.RecordBatch:
        out = [(_BLOCKS, number, block, held, None, None, None, None, None) for block, (number, held) in self.blocks.items()]
        out += [(_TEXTS, number, None, None, list(numbers), *rest) for numbers, (number, *rest) in self.texts.items()]
        out += [(_ROWS, number, None, None, None, None, None, doc_id, None) for number, doc_id in self.rows]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PACKED.types)], schema=_PACKED)


def packed(docs: DataFrame, width: int = BLOCK) -> DataFrame:
    """Blocks, texts and rows of batches (``_PACKED``), written to the shared folder."""

    def pack(batches):
        key = TaskContext.get().partitionId() << _BATCH
        batch = _Batch(key)
        for doc_id, text in (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            batch.add(doc_id, text or "", width)
            if batch.bytes >= BATCH_BYTES or len(batch.rows) >= BATCH_ROWS:
                yield batch.arrow()
                key += 1
                batch = _Batch(key)
        if batch.rows:
            yield batch.arrow()

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(pack, from_arrow_schema(_PACKED)))


def named(occurrences: DataFrame, *content: str) -> DataFrame:
    """``occurrences`` (number, held and content) with ``name``, equal for equal content only, and ``held`` summed over it; without content."""
    equal = Window.partitionBy(*content)
    return occurrences.withColumn("name", F.min("number").over(equal)).withColumn("held", F.sum("held").over(equal)).drop(*content)


def identities(pack: DataFrame) -> DataFrame:
    """(number, round, name) of the texts of ``pack`` that no block or pair has told apart from all others."""
    names = stored(named(pack.where(F.col("kind") == _BLOCKS).select("number", "block", "held"), "block"))
    places = pack.where(F.col("kind") == _TEXTS).select(F.col("number").alias("text"), F.posexplode("blocks").alias("at", "number"))
    found, round_ = [], 0
    while True:
        texts = places.join(names, "number").groupBy("text").agg(F.min("held").alias("held"), F.sort_array(F.collect_list(F.struct("at", "name"))).alias("names"))
        texts = stored(texts.where(F.col("held") > 1).select("text", F.col("names.name").alias("names")))
        found.append(texts.where(F.size("names") == 1).select(F.col("text").alias("number"), F.lit(round_).alias("round"), F.col("names")[0].alias("name")))
        texts = texts.where(F.size("names") > 1)
        if texts.isEmpty():
            break
        round_ += 1
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), lambda i: F.struct(F.get("names", 2 * i).alias("left"), F.get("names", 2 * i + 1).alias("right")))
        pairs = texts.select("text", F.posexplode(pairs).alias("at", "pair")).select("text", "at", (F.col("text") + F.shiftleft("at", round_)).alias("number"), "pair.*")
        places = pairs.select("text", "at", "number")
        names = named(pairs.select("number", "left", "right", F.lit(1).alias("held")), "left", "right")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, width: int = BLOCK) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the text as compared)."""
    pack = packed(docs, width)
    texts = pack.where(F.col("kind") == _TEXTS).select("number", "size", "chars", F.col("doc_id").alias("keep_id"), "text_sha256")
    open_ = stored(identities(pack).join(texts.drop("text_sha256"), "number"))
    best = F.min_by("keep_id", F.struct(-F.col("chars"), F.col("keep_id").isNull(), "keep_id"))
    groups = open_.groupBy("round", "name").agg(F.sum("size").alias("group_size"), best.alias("group_keep"))
    groups = open_.select("number", "round", "name").join(groups, ["round", "name"]).select("number", "group_size", "group_keep")
    texts = texts.join(groups, "number", "left")
    alone = F.col("group_size").isNull()
    texts = texts.select("number", F.when(alone, F.col("keep_id")).otherwise(F.col("group_keep")).alias("keep_id"), F.coalesce("group_size", "size").alias("group_size"), "text_sha256")
    rows = pack.where(F.col("kind") == _ROWS).select("number", "doc_id")
    return rows.join(texts, "number").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, width: int = BLOCK) -> DataFrame:
    """``docs``, same columns, without the rows whose text equals that of the row that stays."""
    gone = exact_groups(docs, width).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
