"""The word cache of the packing operator against the tokenizer itself."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomfield.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def same(tok, plain, texts):
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    return tok.encode(texts) == want


def test_words_with_equal_polynomial_hashes_stay_apart(plain):
    """The Thue-Morse word over two letters and its complement meet in every polynomial hash modulo 2**64."""
    tok = WordTokenizer(PATH)
    for a, b in ("ab", "xy", "qz"):
        for bits in (10, 11, 12):
            word = "".join(a if k.bit_count() % 2 else b for k in range(1 << bits))
            other = word.translate(str.maketrans(a + b, b + a))
            assert same(tok, plain, [word, other]) and tok.encode([word]) != tok.encode([other])


def test_every_block_of_unicode(plain):
    tok = WordTokenizer(PATH)
    texts = []
    for at in range(0, 0x11000, 64):
        own = [chr(c) for c in range(at, at + 64) if not 0xD800 <= c < 0xE000]
        texts += ["".join(own), " ".join(own), "a".join(own), "'s ".join(own)]
    assert same(tok, plain, texts)


def test_random_texts_and_a_cache_that_overflows(plain):
    rng = np.random.default_rng(7)
    signs = list("abcdefgh tSTMDreVEl'''\"\n\t.,;-_0123456789<|>éÖßžĳ ") + ["<|", "'ll", "'re", "don't", " \r\n"]
    for size in (3, 700_000):
        tok = WordTokenizer(PATH, max_words=size)
        for _ in range(40):
            texts = ["".join(rng.choice(signs, int(rng.integers(0, 60)))) for _ in range(50)]
            assert same(tok, plain, texts)
