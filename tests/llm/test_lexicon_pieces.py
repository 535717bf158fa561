"""Texts with contractions, runs of blanks and characters of many scripts: ids as the library gives them, by the automaton and merges."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from shelfmark.llm import _bpe, lexicon_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "S", "don", "'", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'r", "'l", "''", " ", "  ", "    ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x85", "\xa0", " ", "　", " ", "é", "7", "½", "²", "Ж", "ß", "漢字",
        "ひ", "’", "“", "—", "٣", "अ", "क्ष", "́", "😀", "🫠", "", "\U00020000", "​", "᠎", "﻿", "_", "#", "<|", "<|endoftext|>", "\x1c", "\x00", "ǆ", "Ⅰ"]


def encode(texts, words=()):
    v = _bpe.vocabulary(PATH)
    words = sorted(words)
    flat, n = v.merge_words(pa.array([w.decode() for w in words], pa.large_string()))
    cuts = np.cumsum(n)[:-1]
    lexicon = lexicon_bpe.Lexicon.compile(words, np.split(flat, cuts) if words else [])
    ids, lens = lexicon_bpe.encode_texts(pa.array(texts, pa.large_string()), lexicon, v)
    return [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]


@pytest.mark.parametrize("seed", range(4))
def test_any_mixture_gives_the_library_s_ids(seed):
    r = random.Random(seed)
    texts = ["".join(r.choices(BITS, k=r.randrange(14))) for _ in range(4000)] + ["", " ", "  ", "'s", " 's", "\n's", "''s", "it's's", "x  'll", "    def f(x):\n\n        return x  \n", "a \n b", "O'Neill's'"]
    v = _bpe.vocabulary(PATH)
    expected = v.by_library(texts)
    for t, ours, theirs in zip(texts, encode(texts, [b" don", b"    ", b"'s", " é".encode()]), expected, strict=True):
        assert ours == theirs, repr(t)


def test_code_and_quotes_never_reach_the_library(monkeypatch):
    texts = ["    if x == 'a':\n        return \"it's\"  # don't\n\n\n", "“Ça va”, dit-il ; — l'été 2024…  Привет,  мир! 漢字 です。", "\t\tkey:\t'value'\n  - one\n  - two\n", "trailing   "]
    expected = _bpe.vocabulary(PATH).by_library(texts)
    asked = []
    monkeypatch.setattr(_bpe.Vocabulary, "by_library", lambda self, x: asked.extend(x) or [[] for _ in x])
    assert encode(texts) == expected
    assert asked == []
