"""Media columns in ISO base media containers.

``write`` stores a payload losslessly as 8-bit samples of a track: nested boxes (ftyp, mdat, moov) with
sample tables. ``probe`` walks any such file's boxes and decodes the sample tables into codec, duration and
keyframe byte ranges of every track; payload bytes are addressed, never decoded. ``payload`` follows the sample
ranges. A file's own columns are those of its first video track, or of its first track if it has none.

Scale: a narrow map, one row at a time in Arrow batches; no shuffle. Counts that a file states are checked against
its size before anything of that size is made, so a row takes memory in proportion to its bytes.

Defined cases: null and empty texts are padded to one frame; bytes that are no ISO container, are cut short, state
more samples than they can hold or nest boxes deeper than ``DEPTH`` give null columns from ``media_columns``; a
fragmented file, whose samples are not in its tables, has a codec and null samples and keyframes; equal texts give
equal files; an empty table gives no rows; columns named like the new ones are replaced.
"""

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.hashing import text_bytes
from chronoweave.session import small_batches

FRAME = 576
RATE = 8000  # samples, of one byte each, in a second
KEY_EVERY = 10
DEPTH = 32
# Boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of ``FRAME``."""
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return struct.pack(">I4s", size, kind) + body if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write(data: bytes) -> bytes:
    """A file with one 8-bit mono track; every sample of the table is a frame, every tenth a keyframe."""
    n = len(data) // FRAME
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    mdat = box(b"mdat", data)
    first = len(ftyp) + len(mdat) - len(data)
    unity = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    total = n * FRAME
    mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, total), struct.pack(">IHH8x", 0x10000, 0x100, 0), unity, bytes(24), struct.pack(">I", 2), version=1)
    tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, total), struct.pack(">8xHHHH", 0, 0, 0x100, 0), unity, struct.pack(">II", 0, 0), version=1, flags=3)
    mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, total, 0x55C4, 0), version=1)
    hdlr = full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"payload\0")
    entry = box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, FRAME)),
        full(b"stss", struct.pack(">I", -(-n // KEY_EVERY)), np.arange(1, n + 1, KEY_EVERY, dtype=">u4").tobytes()),
        full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        full(b"co64", struct.pack(">IQ", 1, first)),
    )
    minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    return ftyp + mdat + box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))


def boxes(data: bytes, start: int, end: int):
    """(kind, body start, body end) of the boxes in data[start:end]; ValueError if one does not fit."""
    while start < end:
        if start + 8 > end:
            raise ValueError("box header cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head or start + size > end:
            raise ValueError("box does not fit")
        yield kind, start + head, start + size
        start += size


def _tracks(data: bytes) -> tuple[list[dict], bool]:
    """Per track, the bodies (start, end) of its boxes by kind; whether the file has movie fragments."""
    out: list[dict] = []
    fragments = False
    todo = [(0, len(data), None, 0)]
    while todo:
        start, end, into, depth = todo.pop()
        if depth > DEPTH:
            raise ValueError("boxes nested too deeply")
        inner = []
        for kind, a, b in boxes(data, start, end):
            fragments |= kind == b"moof"
            if kind == b"trak":
                out.append({})
                inner.append((a, b, out[-1], depth + 1))
            elif kind in CONTAINERS:
                inner.append((a, b, into, depth + 1))
            elif into is not None:
                into.setdefault(kind, (a, b))
        todo += reversed(inner)
    return out, fragments


def _table(data: bytes, track: dict, kind: bytes, form: str, columns: int = 1, skip: int = 8) -> np.ndarray:
    """The entries of a table box: a count before ``skip`` and so many rows, all inside the box."""
    a, b = track[kind]
    n = struct.unpack_from(">I", data, a + skip - 4)[0] * columns
    if a + skip + n * np.dtype(form).itemsize > b:
        raise ValueError("table does not fit its box")
    return np.frombuffer(data, form, n, a + skip).astype(np.int64)


def sample_ranges(data: bytes, track: dict) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and size of every sample, from stsz, stsc and stco or co64."""
    a, _ = track[b"stsz"]
    same, n = struct.unpack_from(">II", data, a + 4)
    if same * n > len(data):
        raise ValueError("more samples than bytes")
    sizes = np.full(n, same, dtype=np.int64) if same else _table(data, track, b"stsz", ">u4", skip=12)
    chunks = _table(data, track, b"co64", ">u8") if b"co64" in track else _table(data, track, b"stco", ">u4")
    runs = _table(data, track, b"stsc", ">u4", 3).reshape(-1, 3)
    until = np.concatenate((runs[1:, 0], [len(chunks) + 1])) if len(runs) else np.zeros(0, dtype=np.int64)
    if len(runs) and (runs[0, 0] != 1 or (until < runs[:, 0]).any() or until.max() > len(chunks) + 1):
        raise ValueError("chunk runs out of order")
    per = np.repeat(runs[:, 1], until - runs[:, 0])
    after = np.cumsum(per)
    if n > (after[-1] if len(after) else 0):
        raise ValueError("samples without a chunk")
    chunk = np.searchsorted(after, np.arange(n), side="right")
    before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    lead = after - per
    return chunks[chunk] + before - before[lead[chunk]], sizes


def _probe_track(data: bytes, track: dict, fragments: bool) -> dict:
    a, _ = track[b"stsd"]
    codec = struct.unpack_from(">4s", data, a + 12)[0].decode("latin-1").strip()
    a, _ = track[b"mdhd"]
    rate, length = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, _ = track.get(b"hdlr", (None, None))
    kind = None if a is None else struct.unpack_from(">4s", data, a + 8)[0].decode("latin-1")
    out = {"kind": kind, "codec": codec, "duration": length / rate, "samples": None, "keyframes": None}
    if fragments:
        return out
    at, size = sample_ranges(data, track)
    keys = np.arange(len(at))
    if b"stss" in track:
        keys = _table(data, track, b"stss", ">u4") - 1
        if len(keys) and not 0 <= keys.min() <= keys.max() < len(at):
            raise ValueError("keyframe of no sample")
    return out | {"samples": len(at), "keyframes": list(zip(at[keys].tolist(), size[keys].tolist()))}


def probe(data: bytes) -> dict:
    """kind, codec, duration in seconds, samples, and byte ranges (offset, size) of keyframes; ``tracks`` has those of each track."""
    found, fragments = _tracks(data)
    tracks = [_probe_track(data, t, fragments) for t in found]
    return next((t for t in tracks if t["kind"] == "vide"), tracks[0]) | {"tracks": tracks}


def payload(data: bytes) -> bytes:
    """The first track's sample bytes in order."""
    at, size = sample_ranges(data, _tracks(data)[0][0])
    if not len(at):
        return b""
    if (at[1:] == at[:-1] + size[:-1]).all():
        return data[at[0] : at[-1] + size[-1]]
    return b"".join(data[a : a + s] for a, s in zip(at.tolist(), size.tolist()))


NEW = ("codec", "duration", "samples", "keyframes", "tracks")


def media_columns(df: DataFrame, column: str = "media") -> DataFrame:
    """``df`` with codec, duration, samples, keyframes and tracks read from a binary column; null where it is no container."""

    def row(p: dict) -> tuple:
        return p["codec"], p["duration"], p["samples"], p["keyframes"] and [{"offset": a, "size": n} for a, n in p["keyframes"]]

    def read(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                p = probe(bytes(x))
                rows.append((*row(p), [dict(zip(NEW, row(t))) | {"kind": t["kind"]} for t in p["tracks"]]))
            except (ValueError, KeyError, IndexError, TypeError, struct.error, ZeroDivisionError):
                rows.append((None,) * len(NEW))
        return pd.DataFrame(rows, columns=NEW).astype({"samples": "Int64"})

    one = "codec {0} string, duration {0} double, samples {0} bigint, keyframes {0} array<struct<offset:bigint,size:bigint>>"
    kind = one.format("").replace("  ", " ") + ", tracks array<struct<" + one.format(":").replace(" : ", ":") + ",kind:string>>"
    clash = [c for c in df.columns if c not in NEW]
    return df.select(*clash, F.pandas_udf(read, kind)(F.col(column)).alias("_media_columns")).select(*clash, "_media_columns.*")


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the text's bytes, padded, in a container."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([write(padded(text_bytes(t))) for t in s])

    return docs.select("doc_id", F.pandas_udf(run, "binary")(F.col("text")).alias("media"))


def media_report(docs: DataFrame) -> DataFrame:
    """Per row: sizes and digests of the stored file and of the payload read back from it."""

    def run(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"]):
                raw = text_bytes(t)
                media = write(padded(raw))
                p, back = probe(media), payload(media)
                keys = p["keyframes"]
                feature = f"{p['codec']}|{p['duration']:.3f}|{p['samples']}|{len(keys)}|{keys[0][0]}+{keys[0][1]}|{keys[-1][0]}+{keys[-1][1]}"
                rows.append((d, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
