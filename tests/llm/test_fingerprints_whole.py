"""op3 on long texts: no likeness by chance, and the true one where there is some."""

import numpy as np

from tessella.llm import fingerprints


def test_long_texts_without_a_common_pair_are_unlike():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 63, 40_000).astype(np.uint64) for _ in range(2))
    assert fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b)) == 0.0


def test_long_texts_keep_the_generalised_jaccard():
    rng = np.random.default_rng(6)
    shared, a, b = (rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(3))
    for times in (1, 3):  # the shared third of the pairs, with weights
        x, y = (np.concatenate([shared] * times + [own] * times) for own in (a, b))
        got = fingerprints.likeness(fingerprints.signature(x), fingerprints.signature(y))
        assert abs(got - 1 / 3) < 0.13


def test_known_terms_change_nothing():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 400, 3000).astype(np.uint64)
    known = fingerprints.drawn(words[:2000])[1] + fingerprints.drawn(words[1500:])[1]
    assert known and (fingerprints.drawn(words, known=known)[0] == fingerprints.signature(words)).all()
