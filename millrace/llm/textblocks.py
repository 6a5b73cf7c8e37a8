"""Vectorised words and shingles over Arrow string columns.

A batch of texts is handled as one byte array: words are found, lower-cased (A-Z)
and hashed for all texts at once in numpy, without making Python strings.  Texts
are taken whole; a slice holds about ``SLICE_BYTES`` bytes or one longer text.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes by kind: "space" keeps all but ASCII white space, "letters" keeps
#: ASCII letters and digits and every byte of a multi-byte character.
_KINDS = {"space": np.ones(256, bool), "letters": np.zeros(256, bool)}
_KINDS["space"][[32, 9, 10, 11, 12, 13]] = False
_KINDS["letters"][[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix1(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=U))[0])


_POW = np.ones(1, dtype=U)
#: Odd multipliers of the words of a shingle.
_PLACE = [U(mix1(1000 + i) | 1) for i in range(64)]


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 256), U(0x9E3779B97F4A7C15), dtype=U)]))
    return _POW


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Give memory that is free back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, bytes, offsets) of slices of bounded size."""
    data, offsets = utf8(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
    if len(data) > SLICE_BYTES:
        trim()


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the number of words of each text."""
    n = len(offsets) - 1
    inside = _KINDS[kind][data]
    if not inside.any():
        return np.zeros(0, U), np.zeros(n, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    codes = _LOWER[data[inside]].astype(U) + U(1)
    codes *= _powers(int(lens.max()))[place]
    h = np.add.reduceat(codes, at)
    per = np.diff(np.searchsorted(starts, offsets))
    return mix(h + lens.astype(U)), per


def hash_of(word: str) -> int:
    """What ``word_hashes`` gives for one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0, len(data)]))[0][0])


def shingles(words: np.ndarray, per: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text, with repeats, and their number per text.

    A text of fewer words has one: its whole sequence; a text without words has none.
    """
    if not len(words):
        return np.zeros(0, U), np.zeros(len(per), np.int64)
    many = np.where(per >= size, per - size + 1, (per > 0).astype(np.int64))
    first = np.cumsum(per) - per
    long = per >= size
    out = np.zeros(int(many.sum()), U)
    place = np.cumsum(many) - many
    if long.any():
        n = len(words) - size + 1
        all_ = words[:n] * _PLACE[0]
        for i in range(1, size):
            all_ += words[i : i + n] * _PLACE[i]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, first[long], 1)
        np.add.at(cover, first[long] + many[long], -1)
        keep = np.cumsum(cover)[:n] > 0
        into = np.ones(len(out), bool)
        into[place[(~long) & (per > 0)]] = False
        out[into] = all_[keep]
    for i in np.flatnonzero(~long & (per > 0)):
        w = words[first[i] : first[i] + per[i]]
        out[place[i]] = np.append(w * np.array(_PLACE[: len(w)], U), _PLACE[size + len(w)]).sum(dtype=U)
    return mix(out), many


def shingle_sets(words: np.ndarray, per: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the size of each set."""
    s, many = shingles(words, per, size)
    bounds = np.concatenate([[0], np.cumsum(many)])
    for a, b in zip(bounds[:-1], bounds[1:]):
        s[a:b].sort()
    if not len(s):
        return s, many
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[bounds[:-1][many > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], np.diff(total[bounds])
