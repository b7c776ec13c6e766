"""Words and their hashes from batches of texts, by whole-array operations on the UTF-8 bytes.

Texts arrive as Arrow columns. They are worked on in slices of some 2 MB, so that the arrays
beside the bytes stay small whatever the batch; one text is never divided. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U64 = np.uint64

WORD_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


def byte_table(members: bytes) -> np.ndarray:
    """For each byte value, whether it is one of ``members``."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


IS_SEPARATOR = byte_table(WORD_SEPARATORS)
IS_CONTINUATION = (np.arange(256) & 0xC0) == 0x80  # of a code point's later bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the places where each begins and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of some ``size`` bytes: first text, and one past the last."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, bytes and bounds of each slice of a column."""
    data, bounds = text_bytes(column)
    for first, last in slices(bounds):
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that don't cross texts: starts, ends, and the text of each."""
    cut = np.zeros(len(inside) + 1, dtype=bool)
    cut[bounds] = True
    before = np.r_[False, inside[:-1]] & ~cut[:-1]
    after = np.r_[inside[1:], False] & ~cut[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all 64 bits, one to one."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def weights(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    start = seed * 0x9E3779B97F4A7C15 % (1 << 64)
    return mix(np.arange(1, n + 1, dtype=U64) + U64(start)) | U64(1)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans are not empty and don't overlap)."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    values = data[place + np.repeat(starts, lengths)].astype(U64) + U64(1)
    values *= weights(int(lengths.max()), seed)[place]
    return mix(np.add.reduceat(values, first) ^ (lengths.astype(U64) << U64(40)))


def window_hash(codes: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` neighbouring codes; len(codes) - width + 1 of them."""
    n = max(0, len(codes) - width + 1)
    out = np.zeros(n, U64)
    for j, w in enumerate(weights(width, seed)):
        out += codes[j : j + n] * w
    return mix(out)


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sum of whole-number ``values`` by text."""
    return np.bincount(text, weights=values, minlength=n).astype(np.int64)


def distinct(text: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, code) pairs in order."""
    order = np.lexsort((codes, text))
    text, codes = text[order], codes[order]
    keep = np.r_[True, (text[1:] != text[:-1]) | (codes[1:] != codes[:-1])] if len(text) else np.zeros(0, bool)
    return text[keep], codes[keep]


def words_of(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` in order, and the text it is in."""
    if lower:
        data = LOWER[data]
    starts, ends, text = spans(~IS_SEPARATOR[data], bounds)
    return span_hash(data, starts, ends), text
