"""Vectorised text primitives on numpy buffers, shared by the operators that run in Arrow batches.

A batch of texts is laid end to end as UTF-8 bytes; words, hashes and shingles are then
computed for the whole batch at once instead of text by text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, 0..n-1."""
    base = int(_BASE)
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.empty(n, _U)
        down = np.empty(n, _U)
        up[0] = down[0] = _U(1)
        done = 1
        while done < n:  # doubling: as many again from those known
            m = min(done, n - done)
            up[done : done + m] = up[:m] * _U(pow(base, done, 1 << 64))
            down[done : done + m] = down[:m] * _U(pow(inverse, done, 1 << 64))
            done += m
    return up, down


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = _inverse_powers(max(n, 1 << 20))
    return _POWERS[0][:n], _POWERS[1][:n]


def give_back() -> None:
    """Memory that is no longer used goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """rows, after which a worker gives the memory that it no longer uses back to the system. Workers outlive their
    tasks, so what one long text took would otherwise stay with an executor during all later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            if _POWERS and len(_POWERS[0]) > 1 << 20:
                _POWERS.clear()
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with one space after each, and the place where each begins (plus the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8), starts


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CODE = mix(np.arange(1, 257, dtype=_U))


def spans(is_break: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of False; the last item must be True."""
    edge = np.flatnonzero(np.diff(is_break, prepend=True))
    return edge[0::2], edge[1::2]


def hash_spans(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[b:e] for every span: equal content, equal hash, wherever it stands."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, _U)
    np.cumsum(codes * down[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * up[begin] + (end - begin).astype(_U))


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space words of all texts: word hashes, first word of each text (plus the end), starts, ends."""
    buf, starts = lay_out(texts)
    if not len(buf):
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64), none, none
    begin, end = spans(_SPACE[buf])
    if len(begin) > len(end):
        begin = begin[: len(end)]
    hashed = hash_spans(_CODE[_LOWER[buf] if lower else buf], begin, end)
    return hashed, np.searchsorted(begin, starts), begin, end


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; shorter texts count as one shingle."""
    hashed, first, _, _ = words(texts)
    n = len(hashed)
    rolled = np.zeros(n, _U)
    for k in range(min(width, n)):
        rolled[: n - k] = rolled[: n - k] * _U(0xD6E8FEB86659FD93) + hashed[k:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = _U(0)
            for h in hashed[a:b]:
                whole = whole * _U(0xD6E8FEB86659FD93) + h
            out.append(mix(np.array([whole + _U(b - a)], _U)))
        else:
            out.append(rolled[:0])
    return out
