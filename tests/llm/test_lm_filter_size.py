"""The log-frequency filter keeps its bits an entry at every size."""

import numpy as np

from tessella.llm import common, lm_scoring


def test_log_frequency_filter_has_no_ceiling(spark):
    for n in (1_000, 100_000):
        g = common.mix64(np.arange(n, dtype=np.uint64))
        piece = lm_scoring.filled(g, np.full(n, 3))
        assert len(piece) * 8 >= n * 3 * lm_scoring.BITS_PER_ENTRY
        f = lm_scoring.LogFrequencyFilter(piece)
        other = common.mix64(np.arange(n, 2 * n, dtype=np.uint64))
        assert (f.quantised(g) >= 3).all() and (f.quantised(other) > 0).mean() < 0.02


def test_filter_grows_with_the_corpus(spark):
    size = []
    for n in (20, 200):
        rng = np.random.default_rng(n)
        train = spark.createDataFrame([(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 100)).encode(),) for _ in range(n)], "text binary")
        size.append(sum(len(r["piece"]) for r in lm_scoring.counted(train, np.zeros(0, np.uint64), 4).where("piece is not null").collect()))
    assert size[1] > 9 * size[0]
