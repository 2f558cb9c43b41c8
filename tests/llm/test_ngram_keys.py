import numpy as np
import pytest

from logloom.llm.grid import Grid
from logloom.llm.ngram_lm import SPARE_BITS, gram_keys


def key_bytes(n_words):
    return Grid(None, 5 * n_words, 1).key_bytes(SPARE_BITS)


@pytest.mark.parametrize("n_words", [3_000_000, 5_000_000_000])
@pytest.mark.parametrize("fixed", ["word", "context"])
def test_unseen_ngrams_stay_unseen(n_words, fixed):
    """A word after very many contexts, and a context before very many words."""
    rng = np.random.default_rng(3)
    many = np.unique(rng.integers(0, 1 << 64, 3_000_000, dtype=np.uint64))
    rng.shuffle(many)
    one = np.full(len(many), np.uint64(12345))
    size = key_bytes(n_words)
    keys = gram_keys(one, [many], size) if fixed == "word" else gram_keys(many, [one], size)
    seen = keys[: len(many) * 2 // 3]
    assert np.isin(keys[len(many) * 2 // 3 :], seen).mean() < 2.0 ** -(SPARE_BITS - 1)


def test_keys_grow_with_the_tokens():
    assert [key_bytes(n) for n in (10**3, 10**8, 5 * 10**9, 10**13)] == [3, 5, 6, 8]
