"""Words and hashes of many texts at once, by numpy over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_INV_P = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M = np.uint64(0xD6E8FEB86659FD93)
#: Texts are worked on in pieces of about so many bytes; a longer text is a piece of its own.
PIECE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (and the last ends). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last text, bytes, offsets) of runs of whole texts."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, np.uint64)
        have[0] = 1
        have = _powers[kind] = np.multiply.accumulate(have)
    return have[:n]


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (and one past the last)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_SEP[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    first[begin] |= inside[begin]
    last[end] |= inside[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and each text's offsets among them. lower: A-Z count as a-z."""
    if lower:
        data = _LOWER[data]
    starts, ends, of = spans(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), of
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _P, len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power("down", _INV_P, len(data))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _M), of


def window_hashes(words: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every k consecutive words of one text, and each text's offsets among them."""
    count = np.diff(of)
    many = np.maximum(count - k + 1, 0)
    out_of = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    if not out_of[-1]:
        return np.zeros(0, np.uint64), out_of
    size = len(words) - k + 1
    value = words[:size].copy()
    for j in range(1, k):
        value *= _M
        value += words[j : j + size]
    at = np.arange(out_of[-1]) + np.repeat(of[:-1] - out_of[:-1], many)
    return mix(value[at]), out_of


def column_words(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of a whole column, piece by piece: little memory besides the result."""
    found, offsets, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, _, some, own in pieces(*text_bytes(column)):
        hashes, of = word_hashes(some, own, lower)
        found.append(hashes)
        offsets.append(of[1:] + n)
        n += len(hashes)
    return np.concatenate(found), np.concatenate(offsets)
