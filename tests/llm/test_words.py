"""Word numbers and shingles against plain Python."""

import random
import re

import numpy as np
import pytest

from shelfmark.llm import _words as W


def plain(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text)


def sample(seed):
    random.seed(seed)
    alphabet = [b"a", b"b", b" ", b"\n", b"\x0b", b"\x1c", "ß".encode(), "一".encode(), b"\xc2\xa0"]
    texts = [b"".join(random.choices(alphabet, k=random.choice([0, 1, 5, 40, 3000]))) for _ in range(60)]
    return [*texts, b"", b"   ", b"x" * (W.CHUNK + 9) + b" y", b"ab " * W.CHUNK, b"q" * W.CHUNK]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_words_have_equal_numbers(seed):
    texts = sample(seed)
    numbers, begins = W.word_numbers(texts)
    known = {}
    for i, text in enumerate(texts):
        words = plain(text)
        assert len(words) == begins[i + 1] - begins[i]
        for word, number in zip(words, numbers[begins[i] : begins[i + 1]], strict=True):
            assert known.setdefault(word, number) == number
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("words", [1, 2, 5])
def test_shingle_sets(words):
    texts = sample(3)[:-3]
    for text, found in zip(texts, W.shingle_sets(texts, words), strict=True):
        tokens = plain(text)
        wanted = {tuple(tokens[i : i + words]) for i in range(len(tokens) - words + 1)} or ({tuple(tokens)} if tokens else set())
        assert len(found) == len(wanted)
        assert (np.diff(found.astype(object)) > 0).all()


def test_short_text_is_no_shingle_of_a_longer_one():
    one, two = W.shingle_sets([b"a", b"a b"], 2)
    assert not set(one.tolist()) & set(two.tolist())
