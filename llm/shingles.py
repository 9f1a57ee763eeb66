"""Vectorised word and shingle hashing shared by the text operators.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``, with
A-Z lower-cased. Words get a 64-bit polynomial hash from one running sum over a
whole buffer, so no Python object is made per word. Very long texts are cut at
white space into pieces of ``PIECE`` bytes, so memory follows the batch and not
the longest text.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[name] = np.multiply.accumulate(x)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buffer_words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a lower-cased buffer."""
    a = np.frombuffer(buf, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    white = np.empty(len(a) + 2, bool)
    white[0] = white[-1] = True
    np.take(_WHITE, a, out=white[1:-1])
    edge = np.flatnonzero(white[1:] != white[:-1])
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start


def _pieces(text: bytes):
    """A long text in pieces that end at white space."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end


def words_of_batch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts on end, and the offset at which each text's words begin (one more offset than texts)."""
    out, counts = [], np.zeros(len(texts) + 1, np.int64)
    held: list[bytes] = []
    which: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            h, start = _buffer_words(b" ".join(held))
            bounds = np.cumsum([0, *(len(x) + 1 for x in held)])
            n = np.diff(np.searchsorted(start, bounds))
            np.add.at(counts, np.array(which) + 1, n)
            out.append(h)
            held.clear()
            which.clear()
            size = 0

    for k, t in enumerate(texts):
        if not t:
            continue
        b = t.encode("utf-8", "surrogatepass").lower()
        for piece in [b] if len(b) <= PIECE else _pieces(b):
            held.append(piece)
            which.append(k)
            size += len(piece) + 1
            if size >= PIECE:
                flush()
    flush()
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(counts)


def _weights(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has its whole word sequence as its one shingle; a text
    without words, or null, has none.
    """
    h, at = words_of_batch(texts)
    w = _weights(width)
    rolled = np.zeros(len(h), np.uint64)
    for k in range(width):
        rolled[: len(h) - k] += h[k:] * w[k]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        if n >= width:
            x = np.sort(rolled[a : b - width + 1])
            sets.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif n:
            tag = np.array([n], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            sets.append(mix((h[a:b] * w[:n]).sum(dtype=np.uint64, keepdims=True) + tag))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
