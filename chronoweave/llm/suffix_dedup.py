"""Exact substring dedup over bytes: every byte covered by a ``length``-byte string that starts earlier goes.

"Earlier" is a smaller doc_id, or the same document and a smaller start.

1. Windows of ``length`` bytes pick the anchor of the least hash among their ``GRAM``-byte strings
   (leftmost on ties), so equal windows pick equal anchors at equal places. The windows that pick one
   anchor lie side by side; the bytes they cover are its context.
2. Anchors with their context's 64-bit fingerprint meet by anchor hash. All but the first occurrence of a
   context are repeated as a whole, so that no text is sorted twice.
3. First occurrences of different contexts round one anchor, as far as the bytes before or after it are shared
   with another of them, go to the shard of that anchor; those of an anchor with over ``COMMON`` of them go to the
   shards of what they share, the anchor with the bytes before it and the anchor with the bytes after it. A shard
   reads them in the order of these keys and sorts the suffixes of about ``PART`` bytes of contexts, but always of whole
   keys, cut to the windows that may be shared (``narrowed``), by induction (``induced_sort``); neighbours with a common prefix of ``length``
   bytes are equal windows, and all but the earliest of them go.
4. The spans found go back to the documents by doc_id.

Scale: about 1 anchor in 35 bytes is shuffled, packed with others of its partition; of several occurrences
of a context in one batch only the first, so a passage that a third of all documents share does not heat one
task. A shard may be far larger than memory: Spark sorts its contexts by key, with spills, and only one part of
them is held at a time; the queues of the sort spill beyond a bound. Nothing reaches the driver.

Defined cases: null and empty texts have 0 bytes; rows that share a doc_id must have equal texts (they then
get equal results; other ones are cut at the union of their spans); null doc_ids are left alone;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.hashing import byte_values, mix, pieces, prefix_sums, slice_hashes, text_bytes
from chronoweave.llm.induced_sort import equal_prefixes
from chronoweave.session import small_batches, stored

GRAM = 32
#: In place of an anchor's offset: a span that its own batch has found to be repeated.
_DONE = 255
#: Anchors that a task reads before it hands them on: repeats among them are settled at once.
TOGETHER = 200_000
#: Contexts of one anchor that are sorted together; beyond it, by the bytes beside the anchor.
COMMON = 1000
#: Bytes of contexts that a task sorts at a time, unless one key has more.
PART = 8 << 20
#: Places of a window round its anchor that ``narrowed`` tells at once.
STEP = 4
SPANS = ("whole_lo", "whole_hi", "edge_lo", "edge_hi")
_U = np.uint64
#: ``h``, ``left`` and ``right`` only bring together what is then compared by ``c`` or by its bytes, so few bits do.
_ENTRY = np.dtype([("doc", "<i8"), ("lo", "<u4"), ("n", "<u2"), ("at", "u1"), ("h", "<u4"), ("left", "<u2"), ("right", "<u2"), ("c", "<u8")])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def half(length: int) -> int:
    """A window has its anchor and at least so many bytes before or after it."""
    return (length - GRAM + 1) // 2


def _half_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole, slice_hashes(sums, start, end) >> _U(48) | _U(1), _U(0))


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, lo, at, n, h, c, left, right) of every anchor: context [lo, lo + n) in its text, the anchor ``at`` bytes into it.

    ``left`` and ``right`` hash the ``half`` bytes before and after the anchor, 0 where the context has fewer.
    """
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(buf) < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(8))
    sums = prefix_sums(buf, byte_values(11))
    start = np.arange(len(buf) - GRAM + 1)
    h = slice_hashes(sums, start, start + GRAM)
    bits = _U(31)  # places fit, for as long as a text can be; the hash's upper 33 bits decide
    packed = ((h >> bits) << bits) | start.astype(_U)
    pick = (_sliding_min(packed, length - GRAM + 1) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    first = np.arange(len(pick))
    text = np.searchsorted(ends, first, side="right")
    inside = first + length <= ends[np.minimum(text, len(ends) - 1)]
    first, pick, text = first[inside], pick[inside], text[inside]
    if not len(first):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(8))
    new = np.ones(len(first), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (first[1:] != first[:-1] + 1)
    lead = np.flatnonzero(new)
    last = np.concatenate((lead[1:], [len(first)])) - 1
    lo, hi, at, text = first[lead], first[last] + length, pick[lead], text[lead]
    c = mix(slice_hashes(prefix_sums(buf, byte_values(23)), lo, hi) ^ ((at - lo).astype(_U) << _U(32)))
    end, width = at + GRAM, half(length)
    left = _half_hash(sums, np.maximum(at - width, 0), at, at - lo >= width)
    right = _half_hash(sums, end, np.minimum(end + width, len(buf)), hi - end >= width)
    return text, lo - np.concatenate(([0], ends))[text], at - lo, hi - lo, h[at], c, left, right


def _first_of(e: np.ndarray) -> np.ndarray:
    """e sorted by (h, c, doc, lo), only the least (doc, lo) of each (h, c)."""
    e = e[np.lexsort((e["lo"], e["doc"], e["c"], e["h"]))]
    new = np.ones(len(e), dtype=bool)
    new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["c"][1:] != e["c"][:-1])
    return new, e


def _shared(e: np.ndarray, side: str) -> np.ndarray:
    """Of which entries another one with the same anchor has the same bytes on that side of it."""
    order = np.lexsort((e[side], e["h"]))
    h, x = e["h"][order], e[side][order]
    equal = (h[1:] == h[:-1]) & (x[1:] == x[:-1]) & (x[1:] > 0)
    out = np.zeros(len(e), dtype=bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def _comparable(head: np.ndarray, length: int, common: int) -> np.ndarray:
    """Contexts that can share a window with another one, cut to the windows that can be shared; ``h`` brings those together.

    Equal windows have the same bytes in the half before or the half after the anchor, whichever is whole in them. Where
    more than ``common`` contexts have one anchor, the windows with a whole half before it and those with a whole half
    after it are two entries, each with a key of its own, made from the anchor and that half.
    """
    left, right = _shared(head, "left"), _shared(head, "right")
    e, left, right = head[left | right], left[left | right], right[left | right]
    _, of, count = np.unique(e["h"], return_inverse=True, return_counts=True)
    many = count[of] > common if len(e) else np.zeros(0, dtype=bool)
    out = [_cut(e[~many], left[~many], right[~many], length)]
    for side, there in (("left", left & many), ("right", right & many)):
        part = _cut(e[there], np.full(there.sum(), side == "left"), np.full(there.sum(), side == "right"), length)
        part["h"] = mix(part["h"].astype(_U) << _U(17) | part[side].astype(_U) << _U(1) | _U(side == "left")) >> _U(32)
        out.append(part)
    return np.concatenate(out)


def _cut(e: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Contexts cut to the windows that have the whole half before the anchor (``left``), after it (``right``) or either."""
    e = e.copy()
    at, n = e["at"].astype(np.int64), e["n"].astype(np.int64)
    n = np.where(right, n, np.minimum(n, at + length - half(length)))
    cut = np.where(left, 0, np.maximum(at - (length - GRAM - half(length)), 0))
    e["lo"], e["at"], e["n"] = e["lo"] + cut, at - cut, n - cut
    return e


def _entries(ids, texts: list[bytes], length: int) -> np.ndarray:
    text, lo, at, n, h, c, left, right = anchors(texts, length)
    e = np.empty(len(text), dtype=_ENTRY)
    e["h"], e["c"], e["doc"], e["lo"], e["at"], e["n"] = h >> _U(32) if len(h) else h, c, np.asarray(ids, dtype=np.int64)[text] if len(text) else 0, lo, at, n
    e["left"], e["right"] = left, right
    return e


def _packed(e: np.ndarray) -> bytes:
    """Entries, sorted by (doc, lo), column by column; doc ids as differences, byte by byte, which compresses well."""
    doc = np.diff(e["doc"], prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T
    lo = np.ascontiguousarray(e["lo"]).view(np.uint8).reshape(-1, 4).T
    return b"".join([doc.tobytes(), lo.tobytes(), *(np.ascontiguousarray(e[c]).tobytes() for c in _ENTRY.names[2:])])


def _unpacked(raw: bytes) -> np.ndarray:
    e = np.empty(len(raw) // _ENTRY.itemsize, dtype=_ENTRY)
    at = 0
    for c in _ENTRY.names:
        part = np.frombuffer(raw, dtype=_ENTRY[c] if c not in ("doc", "lo") else np.uint8, count=len(e) * (1 if c not in ("doc", "lo") else _ENTRY[c].itemsize), offset=at)
        at += part.nbytes
        if c in ("doc", "lo"):
            part = np.ascontiguousarray(part.reshape(_ENTRY[c].itemsize, -1).T).view(_ENTRY[c]).ravel()
        e[c] = np.cumsum(part) if c == "doc" else part
    return e


def _blobs(e: np.ndarray, bucket: np.ndarray, name: str) -> pd.DataFrame:
    order = np.lexsort((e["lo"], e["doc"], bucket))
    e, bucket = e[order], bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return pd.DataFrame({name: bucket[cut], "e": [_packed(x) for x in np.split(e, cut[1:])]})


def repeated_spans(docs: DataFrame, length: int = 100, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, requests): per doc the contexts to remove whole (at -1) and those to compare by window."""
    if not GRAM <= length <= 250:
        raise ValueError(f"length must be from {GRAM} to 250")
    spark = docs.sparkSession
    n = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id is not null")

    def local(batches):
        """Anchors by bucket, and contexts that the texts read together repeat, by document."""
        parts, held = [], 0
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), [text_bytes(t) for t in batch["text"]]
            for a, b in pieces(texts):
                parts.append(_entries(ids[a:b], texts[a:b], length))
                held += len(parts[-1])
                if held >= TOGETHER:
                    yield from settled(np.concatenate(parts))
                    parts, held = [], 0
        if held:
            yield from settled(np.concatenate(parts))

    def settled(e):
        new, e = _first_of(e)
        yield _blobs(e[new], (mix(e["h"][new].astype(_U)) % _U(n)).astype(np.int64), "bucket")
        if not new.all():
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            done = e[~new & ((e["doc"] != e["doc"][lead]) | (e["lo"] != e["lo"][lead]))]
            done["h"], done["c"], done["at"] = 0, 0, _DONE
            yield _blobs(done, done["doc"] % n, "bucket")

    found = source.mapInPandas(local, "bucket long, e binary")

    def meet(key, group):
        """Of one bucket: (doc, lo, hi, 0) for repeated contexts, (doc, lo, hi, rel, 1, h) for those to compare."""
        e = np.concatenate([_unpacked(x) for x in group["e"]])
        done = e[e["at"] == _DONE]
        new, e = _first_of(e[e["at"] != _DONE])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = ~new & ((e["doc"] != e["doc"][lead]) | (e["lo"] != e["lo"][lead]))
        head, gone = e[new], np.concatenate((e[again], done))
        ask = _comparable(head, length, COMMON)
        return pd.DataFrame(
            {
                "doc": np.concatenate((gone["doc"], ask["doc"])),
                "lo": np.concatenate((gone["lo"], ask["lo"])).astype(np.int64),
                "n": np.concatenate((gone["n"], ask["n"])).astype(np.int32),
                "at": np.concatenate((np.full(len(gone), -1, dtype=np.int32), ask["at"].astype(np.int32))),
                "h": np.concatenate((np.zeros(len(gone), dtype=np.int32), ask["h"].view(np.int32))),
            }
        )

    met = found.groupBy("bucket").applyInPandas(meet, "doc long, lo long, n int, at int, h int")
    met = met.groupBy("doc").agg(F.collect_list(F.struct("lo", "n", "at", "h")).alias("r"))
    return source, stored(met)


def _characters(contexts, sizes: np.ndarray) -> np.ndarray:
    """Bytes plus 1, with 0 after each context."""
    out = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.uint16)
    out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.uint16) + 1
    return out


def _columns(array: str, *fields: str) -> list:
    """One array per field of an array of structs: plain numbers reach Python as whole arrays."""
    return [F.col(f"{array}.{f}").alias(f) for f in fields]


def _parts(batches, bound: int, also: tuple = ()) -> Iterator[list[np.ndarray]]:
    """[text, sizes, doc, lo] and other columns of contexts sorted by ``h``: whole keys, up to about ``bound`` bytes or one key."""
    held: list = []
    size, last = 0, None

    def add(batch):
        sizes = batch["context"].map(len).to_numpy(dtype=np.int64)
        held.append((_characters(batch["context"], sizes), sizes, *(batch[c].to_numpy() for c in ("doc", "lo", *also))))
        return int(sizes.sum())

    for batch in batches:
        if not len(batch):
            continue
        if size >= bound:
            other = np.flatnonzero(batch["h"].to_numpy() != last)
            if len(other):
                if other[0]:
                    add(batch[: other[0]])
                yield [np.concatenate(x) for x in zip(*held)]
                held.clear()
                size, batch = 0, batch[other[0] :]
        size += add(batch)
        last = batch["h"].iloc[-1]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def narrowed(text, sizes, doc, lo, at, h, length: int) -> list[np.ndarray]:
    """[text, sizes, doc, lo] of the contexts that may share a window with another one of their ``h``, cut to such windows.

    Equal windows of contexts of one anchor have it at one place. Those with from l to l + ``STEP`` - 1 bytes before it
    share the l bytes before the anchor and what all of them have after it. Where no other context has these bytes, none
    of its windows there is repeated. This only leaves out; what is equal is told by the sort.
    """
    wide = length - GRAM
    buf = (text - 1).astype(np.uint8)  # the 0 after a context is in no slice
    sums = prefix_sums(buf, byte_values(37))
    anchor = np.cumsum(sizes + 1) - sizes - 1 + at
    after = sizes - at - GRAM
    most, least = np.full(len(at), -1), np.full(len(at), wide + 1)
    key = mix(h.astype(np.int64).view(_U))
    for a in range(0, wide + 1, STEP):
        b = min(a + STEP - 1, wide)
        low, high = np.maximum(a, wide - after), np.minimum(b, at)
        k = np.flatnonzero(low <= high)
        code = slice_hashes(sums, anchor[k] - a, anchor[k] + GRAM + wide - b) ^ key[k]
        order = np.argsort(code)
        equal = code[order[1:]] == code[order[:-1]]
        k = np.union1d(k[order[1:][equal]], k[order[:-1][equal]])
        least[k], most[k] = np.minimum(least[k], low[k]), np.maximum(most[k], high[k])
    k = np.flatnonzero(most >= 0)
    start, n = at[k] - most[k], most[k] - least[k] + length
    first = anchor[k] - most[k]
    out = np.zeros(int(n.sum()) + len(n), dtype=text.dtype)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.cumsum(n + 1) - n - 1, n) + place] = text[np.repeat(first, n) + place]
    return [out, n, doc[k], lo[k] + start]


def repeated_windows(text: np.ndarray, sizes: np.ndarray, doc: np.ndarray, lo: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(doc, start) of windows of which an equal one starts earlier, by one induced sort of the contexts.

    ``text`` holds the contexts as characters (byte plus 1, then 0); context k has ``sizes[k]`` bytes and starts at ``lo[k]`` of ``doc[k]``.
    """
    base = np.cumsum(sizes + 1) - sizes - 1
    for pos, group in equal_prefixes(text, length):
        owner = np.searchsorted(base, pos, side="right") - 1
        d, at = doc[owner], lo[owner] + pos - base[owner]
        order = np.lexsort((at, d, group))
        d, at, group = d[order], at[order], group[order]
        lead = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        lead = np.repeat(lead, np.diff(np.append(lead, len(group))))
        later = (d != d[lead]) | (at != at[lead])
        yield d[later], at[later]


def joined_runs(d: np.ndarray, at: np.ndarray, length: int) -> pd.DataFrame:
    """(doc, lo, hi) of runs of neighbouring windows."""
    order = np.lexsort((at, d))
    d, at = d[order], at[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (at[1:] > at[:-1] + 1)
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(d)) - 1 if len(d) else lead
    return pd.DataFrame({"doc": d[lead], "lo": at[lead], "hi": at[last] + length})


def cut_spans(size: int, spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered runs of [0, size)."""
    out: list = []
    for a, b in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist() if len(spans) else ():
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [tuple(x) for x in out]


def removed_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, text, ``SPANS``): each row with the byte spans [lo, hi) to remove, in two unordered lists."""
    source, met = repeated_spans(docs, length)
    ask = met.select("doc", F.filter("r", lambda x: x["at"] >= 0).alias("r")).where(F.size("r") > 0)
    ask = ask.select("doc", *_columns("r", "lo", "n", "at", "h"))
    asked = source.join(ask, source["doc_id"] == ask["doc"]).select("doc_id", "text", "lo", "n", "at", "h")

    def contexts(batches):
        for batch in batches:
            out = {k: [] for k in ("doc", "lo", "at", "h", "context")}
            for d, t, *r in zip(*(batch[c] for c in ("doc_id", "text", "lo", "n", "at", "h"))):
                raw = text_bytes(t)
                for lo, n, at, h in zip(*(x.tolist() for x in r)):
                    if len(raw) >= lo + n:
                        out["doc"].append(d)
                        out["lo"].append(lo)
                        out["at"].append(at)
                        out["h"].append(h)
                        out["context"].append(raw[lo : lo + n])
            yield pd.DataFrame(out)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    context = asked.mapInPandas(contexts, "doc long, lo long, at int, h int, context binary")

    def compare(batches):
        """Repeated windows among the contexts of each part of a shard, joined to spans."""
        for part in _parts(batches, PART, ("at", "h")):
            found = list(repeated_windows(*narrowed(*part, length), length))
            if found:  # neighbouring windows start with different bytes, so runs show only over all of them
                yield joined_runs(*map(np.concatenate, zip(*found)), length)

    edges = context.repartition(n, "h").sortWithinPartitions("h").mapInPandas(compare, "doc long, lo long, hi long")
    edges = edges.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("e")).select("doc", F.col("e.lo").alias("edge_lo"), F.col("e.hi").alias("edge_hi"))
    whole = met.select("doc", F.filter("r", lambda x: x["at"] < 0).alias("w"))
    whole = whole.select("doc", F.col("w.lo").alias("whole_lo"), F.transform("w", lambda x: x["lo"] + x["n"]).alias("whole_hi"))
    spans = whole.join(edges, "doc", "left")
    nothing = docs.where("doc_id is null").select("doc_id", "text", *[F.lit(None).cast("array<bigint>").alias(c) for c in SPANS])
    return source.join(spans, source["doc_id"] == spans["doc"], "left").select("doc_id", "text", *SPANS).union(nothing)


def _spans_of(size: int, whole_lo, whole_hi, edge_lo, edge_hi) -> list[tuple[int, int]]:
    parts = [np.stack(x, axis=1).astype(np.int64) for x in ((whole_lo, whole_hi), (edge_lo, edge_hi)) if x[0] is not None and len(x[0])]
    return cut_spans(size, np.concatenate(parts)) if parts else []


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""

    def cut(batches):
        for batch in batches:
            rows = []
            for d, t, *lists in zip(*(batch[c] for c in ("doc_id", "text", *SPANS))):
                raw = text_bytes(t)
                spans = _spans_of(len(raw), *lists)
                at, kept = 0, []
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((d, len(raw), len(raw) - len(kept), len(spans), kept))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
            yield out.astype({"doc_id": "Int64"})

    return removed_spans(docs, length).mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_report(docs: DataFrame, length: int = 100) -> DataFrame:
    """``remove_repeats`` with the digest of the remaining bytes in place of them."""
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
