"""Codecs and pure functions against brute force and exact round trips."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelag.llm import bpe, mpeg
from tidelag.llm.common import words_of
from tidelag.llm.jaccard import alike, linked, may_link, prefix_length, signature
from tidelag.llm.media import pad
from tidelag.llm.suffixes import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=5000))
def test_stream_holds_any_payload(data):
    found = mpeg.read_stream(mpeg.write_stream(data))
    assert found.payload == data and found.bad_crc == found.skipped == 0
    assert found.declared_frames == len(found.offsets) and found.samples == 1152 * len(found.offsets)


def test_stream_damage():
    data = bytes(range(256)) * 40
    media = mpeg.write_stream(data)
    clean = mpeg.read_stream(media)
    assert len(clean.toc) == 100 and clean.seconds == pytest.approx(len(clean.offsets) * 1152 / 32000)
    junk = media[: clean.offsets[2]] + b"\xff\xfbnoise\xff" + media[clean.offsets[2] :]
    found = mpeg.read_stream(junk)
    assert found.payload == data and found.skipped == 8 and found.offsets[2] == clean.offsets[2] + 8
    flipped = bytearray(media)
    flipped[clean.offsets[1] + 10] ^= 1  # within the side information
    found = mpeg.read_stream(bytes(flipped))
    assert found.bad_crc == 1 and len(found.offsets) == len(clean.offsets)
    tail = b"TAG" + bytes(125)
    assert mpeg.read_stream(media + tail).payload == data
    assert mpeg.read_stream(b"").payload == b"" and mpeg.read_stream(b"\xff" * 50).skipped == 50
    assert mpeg.read_header(struct.pack(">I", 0xFFFA00C0)) is None


def test_padding():
    assert pad(b"") == bytes(64) and len(pad(b"x" * 64)) == 64 and len(pad(b"x" * 65)) == 128


HARD = [
    "", " ", "aaaaaaaaaaaaaaa bbb", "x<|endoftext|>y  \n\n z²½ éÉ×÷ 中文 '‘s it's   \x1c\x85x _a_ ١٢ \U0001f600\U0001f600", "\t\t a b ​", "don't WE'LL 12345678 ...!!! ",
    "a" * 3000, "́combining é", "<|endoftext|>", "﻿bom\r\n\r\nx  ", "ﬁ ß ŉ İ",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def same_as_library(library, texts):
    v = bpe.load(bpe.default_vocabulary())
    for text, ids in zip(texts, v.encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected, text
        assert v.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_bpe_equals_library(library):
    rng = random.Random(1)
    same_as_library(library, HARD + ["".join(rng.choice("abeé ts'\n1中<|>_.") for _ in range(rng.randrange(60))) for _ in range(300)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_bpe_equals_library_on_any_text(library, texts):
    same_as_library(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_words(text):
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert words_of(text) == re.findall(r"[^\x20\x09-\x0D]+", lower)


@pytest.mark.parametrize(("small", "large", "common"), [(400, 520, 400), (2000, 2600, 1990), (9000, 9100, 8000), (3000, 3000, 1000)])
def test_signatures_of_several_lengths(small, large, common):
    rng = np.random.default_rng(small)
    keys = rng.integers(0, 1 << 62, small + large, dtype=np.uint64)
    x, y = keys[:small], keys[small - common : small - common + large]
    got = may_link(small, large, small, large, *alike([signature(x).tobytes(), signature(y).tobytes()]))
    assert got == linked(small, large, common)  # none lost, and those far from the threshold are told apart


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_signatures_never_lose_a_link(x, y):
    if not x or not y:
        return
    a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
    if linked(len(x), len(y), len(x & y)):
        assert may_link(len(x), len(y), len(x), len(y), signature(a), signature(b))
        small, large = sorted((x, y), key=len)
        assert set(sorted(small)[: prefix_length(len(small))]) & set(sorted(large)[: prefix_length(len(large))])
