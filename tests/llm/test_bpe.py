from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfscan.llm import bpe, chunks, packing
from tests.llm.conftest import documents

with open(bpe.VOCABULARY, "rb") as file:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
EXPECTED = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.codec(bpe.VOCABULARY)
PLAIN = Tokenizer.from_file(packing.TOKENIZER)

TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sabc1., ▁\x1c")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encodes_like_the_ranks(text):
    (ids,) = OWN.encode_chunks([text])
    assert ids == EXPECTED.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_chunks_give_the_ids_of_whole_texts(texts):
    names, codes, cuts = chunks.chunk_texts(pa.array(texts, pa.large_string()))
    ids = OWN.encode_chunks(names)
    for i, text in enumerate(texts):
        assert [x for c in codes[cuts[i] : cuts[i + 1]] for x in ids[c]] == EXPECTED.encode_ordinary(text)
        joined = [x for c in codes[cuts[i] : cuts[i + 1]] for x in PLAIN.encode(names[c], add_special_tokens=False).ids]
        assert joined == PLAIN.encode(text, add_special_tokens=False).ids


def test_every_token_alone():
    whole = [OWN.model.encode(bpe.mapped(token)) for token in OWN.tokens]
    assert [i for i, ids in enumerate(whole) if ids != [i]] == []


def test_bytes_map_one_to_one():
    raw = bytes(range(256))
    assert bpe.unmapped(bpe.mapped(raw)) == raw
    assert not any(c.isspace() for c in bpe.mapped(raw))


def digest(text: str | None) -> tuple:
    ids = EXPECTED.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("kind", ["corpus", "odd"])
def test_digests(request, kind):
    df = request.getfixturevalue(kind)
    found = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(df).collect()]
    assert sorted(found, key=str) == sorted([(r["doc_id"], *digest(r["text"])) for r in df.collect()], key=str)


def test_encode_and_decode(spark, nothing):
    df = documents(spark, (1, "a  b\n"), (2, None), (3, "<|endoftext|> é"))
    assert {r["doc_id"]: r["bytes"] for r in bpe.decode(bpe.encode(df)).collect()} == {
        1: b"a  b\n", 2: b"", 3: "<|endoftext|> é".encode()
    }
    assert bpe.digests(nothing).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "a", "é", "word", "x y", "\u00a0", "日本"]), min_size=1, max_size=9, unique=True), max_size=6))
def test_flat_cache_gives_the_ids_of_each_word(lots):
    encode = lambda texts: [list(t.encode()) for t in texts]
    for size in (0, 4, 1000):
        cache = chunks.IdCache(encode, size)
        for words in lots:
            starts, counts = cache.look_up(pa.array(words, pa.large_string()))
            got = [bytes(cache.ids[s : s + n].astype(np.uint8).tolist()) for s, n in zip(starts, counts, strict=True)]
            assert got == [b" " + w.encode() for w in words]


def test_cache_stays_bounded():
    cache = chunks.BlobCache(lambda words: [(len(w), w.upper().encode(), w.encode() * 2) for w in words], 2, size=10)
    for at in range(0, 60, 6):
        names = [f"x{i}" for i in range(at, at + 8)]
        found = cache.look_up(pa.array(names, pa.large_string()))
        for b, want in enumerate(([f" {n}".upper().encode() for n in names], [f" {n} {n}".encode() for n in names])):
            spans = zip(cache.starts[b][found], cache.lengths[b][found], strict=True)
            assert [cache.bytes[b][s : s + n].tobytes() for s, n in spans] == want
        assert cache.counts[found].tolist() == [len(n) + 1 for n in names]
        assert len(cache.keys) <= 18 and sum(map(len, cache.bytes)) == sum(x.sum() for x in cache.lengths)


WORDS = st.lists(st.text(st.one_of(st.characters(codec="utf-8", exclude_characters=" "), st.sampled_from("\n\t'sabc1.,\u00a0")), max_size=9), max_size=9)


@settings(max_examples=300, deadline=None)
@given(WORDS)
def test_words_encoded_at_once(words):
    chunked = [" " + w for w in words]
    assert OWN.encode_words(chunked) == [EXPECTED.encode_ordinary(w) for w in chunked]
