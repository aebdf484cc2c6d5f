"""Ids from the word cache are the tokenizer's own."""

import random

import numpy as np
import pytest

packing = pytest.importorskip("reliquary.llm.packing")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_word_ids_equal_whole_text_encoding():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.WordIds(path, words=50)
    rng = random.Random(3)
    latin = "".join(map(chr, [*range(9, 14), *range(32, 127), *range(0xC0, 0x100)]))
    wide = latin + "\x00\x1c\x85\xa0­²½ΣσςİıḰ 　漢字😀ﬁ_'"
    texts = ["", " ", "It's WE'LL don't '' 'S 12ab3", "x<|endoftext|>y <|startoftext|>", "É é ÀÉ×÷ß", "Ὀδυσσεύς ΣΑΣ", "a" * 3000]
    texts += ["".join(rng.choices(latin, k=rng.randrange(1, 200))) for _ in range(300)] + ["".join(rng.choices(wide, k=rng.randrange(1, 120))) for _ in range(300)]
    for t in texts:
        want = words.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == want, t


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 300):
        lengths = rng.integers(1, 101, n)
        bins, offsets, made = packing.best_fit_decreasing(lengths, 100)
        assert made >= packing.lower_bound(lengths, 100)
        for b in range(made):
            at = np.flatnonzero(bins == b)
            at = at[np.argsort(offsets[at])]
            assert offsets[at].tolist() == np.concatenate([[0], np.cumsum(lengths[at])[:-1]]).tolist() and lengths[at].sum() <= 100
    assert packing.lower_bound(np.array([51] * 10), 100) == 10 and packing.lower_bound(np.array([34] * 9), 100) == 5
