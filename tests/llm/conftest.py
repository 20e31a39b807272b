import random

import pytest

#: One word list per language-like group, so that models have something to learn.
SYLLABLES = {"aa": ["ka", "lo", "mi", "ten", "ra"], "bb": ["schu", "ger", "ick", "ung", "zol"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, quality, toxic): prose, copies, near copies, junk, a null, an empty and a long text."""
    rng = random.Random(8)
    rows = []
    for i in range(160):
        lang = "aa" if i % 2 else "bb"
        text = sentence(rng, lang, rng.choice([3, 20, 60, 150]))
        quality, toxic = 1, 0
        if i % 5 == 2:
            text, quality = " ".join(f"{w}###" for w in text.split()), 0
        elif i % 7 == 3:
            words = text.split()
            for k in range(0, len(words), 12):
                words[k] = rng.choice(["vilefool", "nastyscum"])
            text, toxic = " ".join(words), 1
        rows.append([i, text, lang, quality, toxic])
    for i, (of, cut) in enumerate([(11, 0), (11, 0), (21, 1), (31, 2), (41, 0)]):
        words = rows[of][1].split()
        rows.append([200 + i, " ".join(words[cut:]), rows[of][2], rows[of][3], rows[of][4]])
    rows += [[300, None, "aa", None, None], [301, "", "aa", None, None], [302, "12345 !!", None, None, None], [303, sentence(rng, "bb", 9000), "bb", 1, 0]]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """With columns that clash with the operators' own names."""
    rows = [(r[0], r[1], r[2], "s", len(r[1] or ""), "x", 7) for r in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int").repartition(3)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    return spark.createDataFrame([(r[0], r[3], r[4]) for r in corpus if r[3] is not None] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
