"""op9 against brute force over all bigrams, and its filter's size."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import lm_scoring


def brute_force(rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = [(i, [*t.lower().split(), "\n"]) for i, t in rows]
    uni, bi = collections.Counter(), collections.Counter()
    for i, t in texts:
        if not held(i):
            uni.update(t)
            bi.update(zip(t, t[1:], strict=False))
    total = sum(uni.values()) + 0.1 * (len(uni) + 1)
    low = {k: max(lm_scoring.BASE ** math.floor(math.log(c) / math.log(lm_scoring.BASE) + 1e-9) - lm_scoring.DISCOUNT, 0) for k, c in bi.items()}
    mass = collections.Counter()
    for (h, _), c in low.items():
        mass[h] += c
    out = {}
    for i, t in texts:
        score = 0.0
        for h, w in zip([None, *t], t, strict=False):
            p = (uni[w] + 0.1) / total
            score += math.log10(low.get((h, w), 0) / uni[h] + max(1e-6, 1 - mass[h] / uni[h]) * p if uni[h] else p)
        out[i] = score
    return out


@pytest.fixture(scope="module")
def many_words():
    """6,000 different words, so that most bigrams are outside any 4,096 words or seen once."""
    rng = np.random.default_rng(8)
    return [(i, " ".join(f"w{x}" for x in rng.integers(0, 6000, 150)) + " of the end of the day") for i in range(60)]


WAYS = [(1 << 20, 1 << 20), (1 << 20, 20), (300, 300), (300, 4), (0, 0)]


@pytest.mark.parametrize(("most", "vocabulary"), WAYS)
def test_lm_scores_count_every_bigram(spark, many_words, most, vocabulary):
    docs = spark.createDataFrame(many_words, "doc_id long, text string").repartition(3)
    want = brute_force(many_words)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.scored(docs, most, vocabulary).collect()}
    assert got.keys() == want.keys()
    # false positives of the filter (about 1 % of the probes) raise a score a little
    assert all(abs(got[i] - want[i]) <= 0.02 * abs(want[i]) + 1e-6 for i in want)
    # with so many bits an entry it has none
    exact = {r["doc_id"]: r["score"] for r in lm_scoring.scored(docs, most, vocabulary, bits_per_entry=512).collect()}
    assert all(abs(exact[i] - want[i]) <= 1e-9 * abs(want[i]) + 1e-6 for i in want)


def test_lm_probabilities_of_a_context_add_up_to_one(spark):
    """From scores of held-out texts: p(w | h) for every w, the end and a word never seen."""
    held = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(30)]
    texts = {i: " ".join(words[int(x)] for x in rng.geometric(0.15, 40) % 30) for i in train}
    asked = ["", "never", *words, *(f"{h} {w}" for h in words[:5] for w in [*words, "never"])]
    rows = [*texts.items(), *zip(held, asked, strict=False)]
    got = {r["doc_id"]: r for r in lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), bits_per_entry=512).collect()}
    of = {t: got[i] for i, t in zip(held, asked, strict=False)}
    first = lambda t: of[t]["base_score"] - of[""]["base_score"]  # noqa: E731  log p(w)
    ends = lambda t: of[t]["score"] - first(t)  # noqa: E731  log p(end | w)
    for h in words[:5]:
        p = [10 ** (of[f"{h} {w}"]["score"] - first(h) - ends(w)) for w in [*words, "never"]]
        assert sum(p) + 10 ** ends(h) == pytest.approx(1, abs=1e-6)


def test_lm_one_hot_context_clashing_columns_and_a_very_long_text(spark):
    """A word that is a third of all tokens, and a text of 30,000 words."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"hot x{x} y{x % 7}" for x in rng.integers(0, 3000, 60))) for i in range(40)]
    rows.append((41, " ".join(f"z{x}" for x in rng.integers(0, 9000, 30_000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("h", "g", "part", "piece", "kind", "rid", "score"):
        docs = docs.withColumn(c, F.lit("mine"))
    want = brute_force(rows)
    for most in (1 << 20, 50):
        got = {r["doc_id"]: r["score"] for r in lm_scoring.scored(docs, most, bits_per_entry=512).collect()}
        assert all(abs(got[i] - want[i]) <= 1e-9 * abs(want[i]) + 1e-6 for i in want)
