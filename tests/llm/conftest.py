import random

import pytest

WORDS = ["the", "of", "red", "Blue", "fox", "tree", "ran", "über", "naïve", "sun", "moon", "sea", "far", "into", "stone", "river", "quiet", "Bright", "seven", "glass", "winter", "letter", "engine", "paper"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def make_docs():
    """Rows (doc_id, text, lang, source, n_chars) with copies, near copies, shared lines and
    passages, nulls, empties, a long text, repeated rows and repeated ids."""
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(40)]
    base = sentence(rng, 150)
    for k in range(8):  # near copies with k changed words
        words = base.split()
        for at in rng.sample(range(len(words)), k):
            words[at] = "changed%d" % rng.randrange(1000)
        texts.append(" ".join(words))
    texts += [texts[3]] * 4 + [texts[7].upper()] + [texts[9] + " \t\n"]
    line = "  This Boilerplate line is repeated in many of the documents, yes  "
    texts += [sentence(rng, 12) + "\n" + line + "\n\n" + line.upper() + "\n" + sentence(rng, 5) for _ in range(6)]
    passage = sentence(rng, 30)
    texts += [sentence(rng, 20) + " " + passage + " " + sentence(rng, 10) for _ in range(5)]
    texts += [None, None, "", " \n\t ", "one", "one", "two words", "\n\n\n", " ".join([sentence(rng, 50)] * 60)]
    rows = [(i, t, "en", "s%d" % (i % 3) if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here at all", "en", "s1", 17), (None, None, None, None, None), (6, "another text with the id of the sixth", "en", "s2", 37)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique_rows(rows):
    """Those with a doc_id of their own."""
    seen, out = set(), []
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


@pytest.fixture(scope="session")
def unique_docs(spark, unique_rows):
    return spark.createDataFrame(unique_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
