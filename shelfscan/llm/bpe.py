"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranks.

Each token's bytes are mapped to printable characters, one for one, and become a piece scored by
its negative rank, so that the model merges in the order of the ranks; the normalizer changes
nothing. The bytes of the model follow the public format of sentencepiece models. Texts are
split by the vocabulary's pattern, each match is encoded by itself, and ids are decoded by the
inverse mapping.

Nulls: a null text is empty and has no tokens; a null doc_id stays null. Each row is one result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from shelfscan.llm import chunks

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

# Fields of the model format: message ModelProto and the messages inside it.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_MODEL_TYPE, _VOCAB_SIZE = 3, 4
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5
_BPE, _UNKNOWN = 2, 2
_NEVER = b"\xff"  # a byte that UTF-8 never has
_WHITE = regex.compile(r"\s")


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself in Latin-1 if it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


TO_CHARACTERS = byte_characters()
TO_BYTES = {ord(c): b for b, c in TO_CHARACTERS.items()}


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_CHARACTERS)


def unmapped(text: str) -> bytes:
    return text.translate(TO_BYTES).encode("latin-1")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is token i; one piece more stands for the unknown."""
    pieces = [
        _bytes(_PIECES, _bytes(_PIECE, mapped(token).encode()) + _float(_SCORE, -rank))
        for rank, token in enumerate(tokens)
    ]
    unknown = _bytes(_PIECES, _bytes(_PIECE, b"<unk>") + _float(_SCORE, 0) + _number(_TYPE, _UNKNOWN))
    trainer = _number(_MODEL_TYPE, _BPE) + _number(_VOCAB_SIZE, len(tokens) + 1)
    normalizer = _bytes(_NAME, b"identity") + b"".join(
        _number(field, 0) for field in (_DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES)
    )
    return b"".join([*pieces, unknown, _bytes(_TRAINER, trainer), _bytes(_NORMALIZER, normalizer)])


class Codec:
    """Encodes matches of a pattern and decodes ids."""

    def __init__(self, tokens: list[bytes], pattern: str = public_tokenizers.PATTERN):
        self.tokens = tokens
        self.whole = {mapped(token): rank for rank, token in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))

        self.pieces = [unmapped(self.model.id_to_piece(i)) for i in range(len(tokens))]

    def _encode_matches(self, matches: list[str]) -> list[list[int]]:
        """Ids of each match. One that is a token as a whole is that token, as the ranks' own library has it."""
        text = mapped(_NEVER.join([m.encode() for m in matches])).split(TO_CHARACTERS[_NEVER[0]]) if matches else []
        new = [m for m in dict.fromkeys(text) if m not in self.whole]
        merged = dict(zip(new, self.model.encode(new, num_threads=1), strict=True)) if new else {}
        whole = self.whole
        return [[whole[m]] if m in whole else merged[m] for m in text]

    def encode_chunks(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        matches = [self.pattern.findall(text) for text in texts]
        ids = iter(self._encode_matches([m for found in matches for m in found]))
        return [[i for _ in found for i in next(ids)] for found in matches]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of chunks that are a space and a word each.

        The pattern always splits before a single space, so it runs over all words at once but for
        those that hold white space themselves.
        """
        plain = [len(w) > 1 and not _WHITE.search(w, 1) for w in words]
        matches = self.pattern.findall("".join([w for w, is_plain in zip(words, plain, strict=True) if is_plain]))
        found: list[list[int]] = []
        for match, ids in zip(matches, self._encode_matches(matches), strict=True):
            if match[0] == " ":
                found.append([*ids])
            else:
                found[-1] += ids
        joined, others = iter(found), iter(self.encode_chunks([w for w, is_plain in zip(words, plain, strict=True) if not is_plain]))
        return [next(joined) if is_plain else next(others) for is_plain in plain]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(read_ranks(path))


class _Digester:
    """Number of ids, ids as decimal numbers with a space behind each, and decoded bytes, of words and of texts."""

    def __init__(self, path: str):
        self.codec = codec(path)
        self.decimals = [b"%d " % i for i in range(len(self.codec.tokens))]
        self.cache = chunks.BlobCache(lambda words: self._blobs(self.codec.encode_words(words)), blobs=2)

    def _blobs(self, every: list[list[int]]) -> list[tuple[int, bytes, bytes]]:
        return [(len(ids), b"".join([self.decimals[i] for i in ids]), self.codec.decode(ids)) for ids in every]

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        words, heads, codes, cuts = chunks.split_texts(texts)
        at = self.cache.look_up(words)
        head_counts, *head_blobs = zip(*self._blobs(self.codec.encode_chunks(heads)), strict=True)
        counts = np.r_[self.cache.counts[at], head_counts][codes]
        shas = []
        for b, own in enumerate(head_blobs):
            flat = self.cache.bytes[b]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            starts = np.r_[self.cache.starts[b][at], len(flat) + np.cumsum(lengths) - lengths][codes]
            flat = np.concatenate([flat, np.frombuffer(b"".join(own), np.uint8)])
            lengths = np.r_[self.cache.lengths[b][at], lengths][codes]
            data = memoryview(chunks.gathered(flat, starts, lengths))
            edges = np.r_[0, np.cumsum(lengths)][cuts].tolist()
            shas.append([hashlib.sha256(data[x : max(x, y - (b == 0))]).hexdigest() for x, y in zip(edges[:-1], edges[1:], strict=True)])
        return np.diff(np.r_[0, np.cumsum(counts)][cuts]), *shas


@lru_cache(maxsize=2)
def _digester(path: str) -> _Digester:
    return _Digester(path)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document: doc_id and its ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            ids = [own.encode_chunks([text])[0] for part in chunks.text_slices(batch.column("text")) for text in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of ``encode``: doc_id and the bytes."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            raw = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, bytes binary")


def digests(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of its ids in decimal and of the bytes decoded from them."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _digester(vocabulary)
        for batch in batches:
            done = 0
            for texts in chunks.text_slices(batch.column("text")):
                counts, ids_sha, bytes_sha = own.digests(texts)
                ids = batch.column("doc_id").slice(done, len(texts))
                columns = [ids, pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(texts)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", "text").mapInArrow(digested, schema)
