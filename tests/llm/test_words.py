"""Hashes of words and lines against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sondage.llm import words
from sondage.llm.words import Hasher, line_keys, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé日 \n\t\r\x0b'.", max_size=40)), max_size=12)


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    hasher = Hasher(3)
    hashes, offsets = word_hashes(pa.array(texts, pa.string()), hasher)
    names = {}
    for i, text in enumerate(texts):
        found = hashes[offsets[i] : offsets[i + 1]]
        expected = plain_words(text)
        assert len(found) == len(expected)
        for h, w in zip(found, expected):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_lines_are_stripped_and_lower(texts):
    got = line_keys(pa.array(texts, pa.string()), [Hasher(11)])
    expected = [
        (i, j, line.strip(" \t\n\x0b\x0c\r").translate(LOWER))
        for i, text in enumerate(texts) for j, line in enumerate((text or "").split("\n"))
    ]
    assert list(zip(got["text"], got["line"])) == [(i, j) for i, j, _ in expected]
    names = {}
    for (_, _, key), chars, h in zip(expected, got["chars"], got["h0"]):
        assert chars == len(key)
        if key:
            assert names.setdefault(key, h) == h


def test_blocks_do_not_cut_words(monkeypatch):
    texts = ["one two  three", "", None, "x" * 100 + " y", "four\tfive"]
    whole, offsets = word_hashes(pa.array(texts, pa.string()), Hasher(3))
    monkeypatch.setattr(words, "BLOCK", 7)
    parts, again = word_hashes(pa.array(texts, pa.string()), Hasher(3))
    assert whole.tolist() == parts.tolist() and offsets.tolist() == again.tolist()


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_no_structure_collides_whatever_the_seed():
    for n in (16, 256, 1024, 4096):
        for seed in range(20):
            hashes, _ = word_hashes(pa.array(thue_morse(n), pa.string()), Hasher(seed))
            assert hashes[0] != hashes[1]


def test_spans_are_alike_wherever_they_stand(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc"), n)) for n in [*range(1, 40), 500]]
    alone = [word_hashes(pa.array([t]), Hasher(2))[0][0] for t in texts]
    assert len(set(alone)) == len(set(texts))
    for pieces in (1, 3, 1 << 17):
        monkeypatch.setattr(words, "PIECES", pieces)
        assert word_hashes(pa.array(["?".join([" ".join(texts), "x"])]), Hasher(2))[0].tolist()[:-1] == alone[:-1]


@pytest.mark.parametrize("block", [1, 5, 17])
def test_blocks_do_not_cut_lines(monkeypatch, block):
    texts = ["one\ntwo two two two two two two\n\n three ", "", None, "\n", "\n\n\n\n\n\n\n", "x" * 100 + "\n" + "y" * 40 + "\n", "z"]
    whole = line_keys(pa.array(texts, pa.string()), [Hasher(3), Hasher(4)])
    monkeypatch.setattr(words, "BLOCK", block)
    parts = line_keys(pa.array(texts, pa.string()), [Hasher(3), Hasher(4)])
    assert {k: v.tolist() for k, v in whole.items()} == {k: v.tolist() for k, v in parts.items()}
