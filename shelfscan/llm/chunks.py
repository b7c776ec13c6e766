"""Texts as sequences of codes of chunks, so that each distinct chunk is tokenized only once.

The tokenizers here split a text by a pattern before they merge anything, and no match of it
reaches over a single space between two other characters: the space begins the next match. So
texts are cut before such spaces and each distinct chunk is encoded by itself, with the result
of encoding whole texts. A text with other white space around a cut is one chunk as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfscan.llm import arrays

SLICE_BYTES = 4 << 20
CACHED_CHUNKS = 1_000_000  # some 80 MB
CACHED_IDS = 1_500_000  # some 60 MB


_SPACE = arrays.byte_table(bytes(b for b in range(128) if chr(b).isspace()))
_WIDE_LEADS = arrays.byte_table(b"\xc2\xe1\xe2\xe3")  # first bytes of the other white space


def _edges(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which words begin, and which end, with white space or are empty."""
    data, bounds = arrays.text_bytes(words)
    empty = np.diff(bounds) == 0
    if not len(data):
        return empty, empty
    first, last = np.minimum(bounds[:-1], len(data) - 1), bounds[1:] - 1
    opens, closes = empty | _SPACE[data[first]], empty | _SPACE[data[last]]
    wide_first = _WIDE_LEADS[data[first]]
    wide_last = (data[last] > 127) & (_WIDE_LEADS[data[np.maximum(last - 1, 0)]] | _WIDE_LEADS[data[np.maximum(last - 2, 0)]])
    for i in np.flatnonzero((wide_first | wide_last) & ~empty).tolist():
        word = words[i].as_py()
        opens[i], closes[i] = word[0].isspace(), word[-1].isspace()
    return opens, closes


def split_texts(texts: pa.Array) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray]:
    """Distinct words, heads, codes, and where each text's codes begin.

    A code is the index of a word, which stands for the chunk of a space and that word; codes
    from len(words) on are heads: the first word of each text, without a space before it, or the
    whole text if cutting it would not be safe.
    """
    parts = pc.split_pattern(texts, " ")
    cuts = parts.offsets.to_numpy()
    flat = parts.flatten().dictionary_encode()
    words, codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    n = len(texts)

    first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    first[cuts[:-1]] = True
    last[cuts[1:] - 1] = True
    opens, closes = _edges(words)
    unsure = (opens[codes] & ~first) | (closes[codes] & ~last)
    owner = np.repeat(np.arange(n), np.diff(cuts))
    whole = np.bincount(owner[unsure], minlength=n) > 0

    heads = words.take(pa.array(codes[cuts[:-1]])).to_pylist()
    for i in np.flatnonzero(whole).tolist():
        heads[i] = texts[i].as_py()
    codes[cuts[:-1]] = len(words) + np.arange(n)
    kept = first | ~whole[owner]
    return words, heads, codes[kept], np.r_[0, np.cumsum(kept)][cuts]


def chunk_texts(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Chunks, the code (index of a chunk) of each place, and where each text's codes begin."""
    words, heads, codes, cuts = split_texts(texts)
    return [" " + w for w in words.to_pylist()] + heads, codes, cuts


class IdCache:
    """The ids of chunks by a 64-bit hash of their bytes, in flat arrays of a fixed number of chunks.

    A chunk here is a word behind a space. Python sees only words that are not known yet.
    """

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], size: int = CACHED_IDS):
        self.encode, self.size = encode, size
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of the distinct words, behind a space, lie in ``ids``, and how many they are."""
        data, bounds = arrays.text_bytes(words)
        filled = np.flatnonzero(np.diff(bounds))
        keys = np.zeros(len(words), np.uint64)  # the empty word
        keys[filled] = arrays.span_hash(data, bounds[:-1][filled], bounds[1:][filled], seed=41)
        at, known = self._find(keys)
        if not known.all():
            if len(self.keys) + len(keys) > self.size:
                self._forget()
                known[:] = False
            fresh = np.flatnonzero(~known)
            fresh = fresh[np.argsort(keys[fresh])]
            found = self.encode([" " + w for w in words.take(pa.array(fresh)).to_pylist()])
            counts = np.array([len(x) for x in found], np.int64)
            starts = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, *(np.asarray(x, np.uint32) for x in found)])
            place = np.searchsorted(self.keys, keys[fresh])
            self.starts, self.counts = np.insert(self.starts, place, starts), np.insert(self.counts, place, counts)
            self.keys = np.insert(self.keys, place, keys[fresh])
            at, _ = self._find(keys)
        return self.starts[at], self.counts[at]


class BlobCache:
    """What ``encode`` gives for chunks of a space and a word: a number and some strings of bytes, in flat arrays.

    Chunks are known by a 64-bit hash of their bytes. When ``size`` of them are known, the half
    that was not met for longest goes.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[tuple]], blobs: int, size: int = CACHED_CHUNKS):
        self.encode, self.size, self.turn = encode, size, 0
        self.keys, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.starts = [np.zeros(0, np.int64) for _ in range(blobs)]
        self.lengths = [np.zeros(0, np.int64) for _ in range(blobs)]
        self.bytes = [np.zeros(0, np.uint8) for _ in range(blobs)]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def _keep(self, kept: np.ndarray) -> None:
        self.keys, self.met, self.counts = self.keys[kept], self.met[kept], self.counts[kept]
        for b, flat in enumerate(self.bytes):
            lengths = self.lengths[b][kept]
            self.bytes[b], self.lengths[b] = gathered(flat, self.starts[b][kept], lengths), lengths
            self.starts[b] = np.cumsum(lengths) - lengths

    def look_up(self, words: pa.Array) -> np.ndarray:
        """The index of each of the distinct words, behind a space, in ``counts``, ``starts`` and ``lengths``."""
        self.turn += 1
        data, bounds = arrays.text_bytes(words)
        filled = np.flatnonzero(np.diff(bounds))
        keys = np.zeros(len(words), np.uint64)  # the empty word
        keys[filled] = arrays.span_hash(data, bounds[:-1][filled], bounds[1:][filled], seed=43)
        at, known = self._find(keys)
        self.met[at[known]] = self.turn
        if not known.all():
            if len(self.keys) + len(keys) > self.size and len(self.keys):
                self._keep(np.sort(np.argsort(self.met, kind="stable")[len(self.met) // 2 :]))
                known = self._find(keys)[1]
            fresh = np.flatnonzero(~known)
            fresh = fresh[np.argsort(keys[fresh])]
            counts, *blobs = zip(*self.encode([" " + w for w in words.take(pa.array(fresh)).to_pylist()]), strict=True)
            place = np.searchsorted(self.keys, keys[fresh])
            for b, own in enumerate(blobs):
                lengths = np.fromiter(map(len, own), np.int64, len(own))
                starts = len(self.bytes[b]) + np.cumsum(lengths) - lengths
                self.bytes[b] = np.concatenate([self.bytes[b], np.frombuffer(b"".join(own), np.uint8)])
                self.starts[b], self.lengths[b] = np.insert(self.starts[b], place, starts), np.insert(self.lengths[b], place, lengths)
            self.counts = np.insert(self.counts, place, counts)
            self.met = np.insert(self.met, place, self.turn)
            self.keys = np.insert(self.keys, place, keys[fresh])
            at, _ = self._find(keys)
        return at


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of ``flat`` one behind the other."""
    first = np.cumsum(lengths) - lengths
    return flat[np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)]


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[pa.Array]:
    """The texts of a column, a null one as empty, some 4 MB at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column):
        _, bounds = arrays.text_bytes(column)
        for first, last in arrays.slices(bounds, SLICE_BYTES):
            yield column.slice(first, last - first)
