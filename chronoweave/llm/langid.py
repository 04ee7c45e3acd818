"""Language identification by a blended-spectrum string kernel.

A text is the set of its byte n-grams of 1 to 3 bytes (presence, not counts), hashed to ``BINS`` bins; the
kernel of two texts is the cosine of these sets. Nystroem landmarks give each text a vector in the space
they span; kernel ridge regression, one class against the rest, is solved there. Scores of a batch of texts
are one sparse-times-dense matrix product: kernel values with landmarks are linear in presence, so landmark
vectors and regression weights are multiplied into one table [bins, classes] beforehand.

Scale: the model is fitted on a bounded sample, about ``PER_CLASS`` documents of each language and ``SAMPLE`` in
all, by a bound on the hash of their id, and is a table of BINS x classes floats, whatever the corpus. Scoring is
a narrow map over whole texts.

Defined cases: null text, or text without a letter, gives und with score 0; repeated rows get equal rows; of
several rows of one doc_id the least (text, lang) teaches; without any learnable row every prediction is und; an empty table gives no rows; other columns are kept
out of the result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.hashing import text_bytes
from chronoweave.session import small_batches

BINS = 1 << 15
#: The bound of the labelled sample, by language and in all, and of the landmarks in all (or one for each language).
PER_CLASS, SAMPLE, LANDMARKS = 150, 6000, 192
RIDGE = 1e-2
_PRIMES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def held_out(key: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def presence(raw: bytes, flags: np.ndarray) -> np.ndarray:
    """Bins of the text's n-grams; ``flags`` is a scratch array of zeros of length BINS, left so."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    shift = np.uint32(17)
    h = (b + np.uint32(1)) * _PRIMES[0]
    flags[h >> shift] = 1
    if len(b) > 1:
        h2 = (h[:-1] ^ (b[1:] + np.uint32(257))) * _PRIMES[1]
        flags[h2 >> shift] = 1
        if len(b) > 2:
            flags[((h2[:-1] ^ (b[2:] + np.uint32(769))) * _PRIMES[2]) >> shift] = 1
    bins = np.flatnonzero(flags)
    flags[bins] = 0
    return bins


class KernelClassifier:
    """classes, and the table [BINS, classes] whose rows a text's bins sum up."""

    def __init__(self, classes: list[str], table: np.ndarray):
        self.classes, self.table = classes, table

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> KernelClassifier:
        classes = sorted(set(langs))
        if not classes:
            return cls([], np.zeros((BINS, 0), dtype=np.float32))
        flags = np.zeros(BINS, dtype=np.uint8)
        x = np.zeros((len(texts), BINS), dtype=np.float32)
        for row, t in zip(x, texts):
            bins = presence(text_bytes(t).lower(), flags)
            row[bins] = 1 / np.sqrt(max(1, len(bins)))
        turn = {c: 0 for c in classes}
        rank = []
        for c in langs:  # landmarks take turns between the classes
            rank.append(turn[c])
            turn[c] += 1
        marks = np.argsort(rank, kind="stable")[: max(LANDMARKS, len(classes))]
        z = x[marks]
        value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])  # kernel values with landmarks -> Nystroem features
        f = (x @ z.T).astype(np.float64) @ root
        y = np.array([[c == k for k in classes] for c in langs], dtype=np.float64)
        w = np.linalg.solve(f.T @ f + RIDGE * np.eye(f.shape[1]), f.T @ y)
        return cls(classes, (z.T @ (root @ w).astype(np.float32)).astype(np.float32))

    def predict(self, texts) -> tuple[list[str], list[float]]:
        texts = list(texts)
        flags = np.zeros(BINS, dtype=np.uint8)
        sets = [presence(text_bytes(t).lower(), flags) if self.classes and isinstance(t, str) and any(map(str.isalpha, t)) else None for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, s in enumerate(sets) if s is not None]
        if not some:
            return names, scores
        sizes = np.array([len(sets[i]) for i in some])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        values = np.add.reduceat(self.table[np.concatenate([sets[i] for i in some])], starts, axis=0) / np.sqrt(sizes)[:, None]
        odds = np.exp(8 * (values - values.max(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        for i, best, row in zip(some, values.argmax(axis=1), odds):
            names[i], scores[i] = self.classes[best], float(row[best])
        return names, scores


def sample_bound(label: str, share: dict, key: str = "doc_id"):
    """Whether a row is drawn: the hash of its key is within the share of its class. No row is ranked, so no task holds a class."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / float(1 << 20)
    most = F.coalesce(*[F.when(F.col(label) == c, F.lit(float(x))) for c, x in share.items()], F.lit(0.0)) if share else F.lit(0.0)
    return place < most


def fit(docs: DataFrame) -> KernelClassifier:
    """Learns from text and non-null lang of rows that are not held out."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    count = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    per = min(PER_CLASS, SAMPLE // max(1, len(count)))
    chosen = rows.where(sample_bound("lang", {c: per / n for c, n in count.items()})).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r"))
    sample = sorted(chosen.collect(), key=lambda r: r.doc_id)
    return KernelClassifier.fit([r.r.text for r in sample], [r.r.lang for r in sample])


def identify(docs: DataFrame, model: KernelClassifier) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # by value: executors need no installed package

    def score(batches):
        learned = pickle.loads(shared.value)
        for batch in batches:
            names, scores = [], []
            for a in range(0, len(batch), 256):
                n, s = learned.predict(batch["text"].iloc[a : a + 256])
                names += n
                scores += s
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": scores})

    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return source.mapInPandas(score, "doc_id long, held_out boolean, lang_pred string, score double")
