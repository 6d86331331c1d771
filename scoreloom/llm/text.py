"""Vectorised words and shingles over the UTF-8 buffers of Arrow string columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Words and shingles
are named by 64-bit fingerprints, computed with numpy for many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 18
_PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = ~_SPACE
#: A term: ASCII letters and digits, and all of UTF-8 beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_FORWARD = _powers(_BASE, _PIECE + 1)
_BACK = _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)
_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLDED = _EXACT.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _EXACT[ord("a") : ord("z") + 1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, terms: bool = False, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, or all terms, or runs of the bytes of ``kind``; all end at document borders."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ((_TERM if terms else _WORD) if kind is None else kind)[data]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    inner = offsets[1:]
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words (or terms) of the documents, in order, and each document's first word index.
    ``fold``: A-Z count as a-z."""
    starts, ends = word_bounds(data, offsets, terms)
    return run_hashes(data, starts, ends, fold), np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Fingerprints of the byte runs from ``starts`` to ``ends``, which are in order and don't overlap."""
    letter = _FOLDED if fold else _EXACT
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + _PIECE, "right"))
        if j <= i:  # one word longer than a piece
            raw = data[lo : ends[i]].tobytes()
            out[i] = xxhash.xxh3_64_intdigest(raw.lower() if fold else raw)
            i += 1
            continue
        piece = data[lo : ends[j - 1]]
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        np.cumsum(letter[piece] * _FORWARD[: len(piece)], out=total[1:])
        out[i:j] = mix((total[ends[i:j] - lo] - total[starts[i:j] - lo]) * _BACK[starts[i:j] - lo])
        i = j
    return out


def fold_latin(data: np.ndarray) -> np.ndarray:
    """The bytes with UTF-8's capital letters from U+00C0 to U+00DE as small ones."""
    at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    if not len(at):
        return data
    out = data.copy()
    out[at] += 0x20
    return out


def term_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all terms and of their first bytes, a row for each term, and each document's first
    row. A term without more bytes than a prefix stands for itself there."""
    starts, ends = word_bounds(data, offsets, terms=True)
    whole, first = word_hashes(data, offsets, terms=True)
    out = np.repeat(whole[:, None], 1 + len(prefixes), 1)
    folded = _FOLDED[data]
    for k, n in enumerate(prefixes):
        at = np.flatnonzero(ends - starts > n)
        head = np.full(len(at), n, np.uint64)
        for j in range(n):
            head = head * np.uint64(_BASE) + folded[starts[at] + j]
        out[at, k + 1] = mix(head)
    return out, first


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xA24BAED4963EE407)
        out += words[j : n + j]
    return mix(out)


def document_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one document; with fewer than ``k`` words, its whole sequence as one."""
    n = len(words)
    if n == 0:
        return words[:0]
    if n < k:
        return shingle_hashes(words, n) ^ np.uint64(n)
    found = shingle_hashes(words, k)
    found.sort()
    if len(found) > 1:
        found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    return found


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For ranges of rows: the first row and the shingle set of each row."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        words, first = word_hashes(part, offsets[i : j + 1] - offsets[i])
        yield i, [document_shingles(words[first[d] : first[d + 1]], k) for d in range(j - i)]
