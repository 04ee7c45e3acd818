"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Defined cases: a null, empty or white-space text passes every stage as it is and is packed with length 0; a null
doc_id is never a copy of another row; rows that share a doc_id stand or fall together as near-duplicates, and are
else separate rows; empty tables give no rows; other columns stay, but for those that packing names itself.
"""

from __future__ import annotations

import uuid

from chronoweave.llm import decontam, line_dedup, minhash, packing, toxicity
from chronoweave.session import shared_dir, table


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity grammar scores under 0.5."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark, docs, sf_dir):
    """Documents without the lines that over 2 % of their site's pages have."""
    return line_dedup.drop_boilerplate_lines(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """The document of the smallest doc_id of each group at five words and similarity 0.8."""
    return minhash.drop_near_duplicates(docs)


def drop_benchmark(spark, docs, sf_dir):
    """Documents without benchmark passages; those that are mostly such passages go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """(doc_id, lang, source, n_chars, n_tokens, bucket, bucket_length, batch, slot) of each document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can express neither the learned grammar nor the bucket programme; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
