"""Vectorised hashing of words, shingles and byte windows, for use inside tasks."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _MULT + _U(seed))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2**64, at least n of them."""
    if len(_POWERS.get("up", ())) < n:
        n = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, _U(base))
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the hash of buf[i:j] times base**i, modulo 2**64."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(values[buf] * up[: len(buf)], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], equal for equal slices wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _MULT)


def words(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which is_word holds."""
    flags = np.zeros(len(buf) + 2, dtype=np.int8)
    flags[1:-1] = is_word[buf]
    edge = np.flatnonzero(np.diff(flags))
    return edge[::2], edge[1::2]


def shingle_hashes(word: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of ``width`` words inside one document."""
    if len(word) < width:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=doc.dtype)
    n = len(word) - width + 1
    h = word[:n].copy()
    for j in range(1, width):
        h = mix(h * _MULT + word[j : j + n])
    inside = doc[:n] == doc[width - 1 :]
    return h[inside], doc[:n][inside]


def text_bytes(text) -> bytes:
    """UTF-8 of a text, none for null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def pieces(texts: list[bytes], limit: int = 1 << 18):
    """Consecutive texts whose bytes together pass ``limit`` at most by the last one: (first, after)."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
