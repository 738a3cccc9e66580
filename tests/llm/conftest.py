import pytest

#: Texts that every operator must take: null, empty, blank, one word, repeated, and long ones.
ODD = [None, "", " \t\n ", "one", "one", "é" * 70, "word " * 3000, "\x00\x1c" + chr(0x85) + chr(0x3000) + " x", "a" * 5000]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i if i != 3 else None, t, "x", f"extra {i}") for i, t in enumerate(ODD)] + [(7, ODD[7], "x", "again"), (7, "other text of the same id", "x", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, home string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, id string, home string")


def corpus(n=120, seed=3):
    """Texts with exact copies, edited copies, shared passages and noise."""
    import random

    r = random.Random(seed)
    words = ["w%02d" % i for i in range(60)] + ["é", "ß", "日本", "the", "of"]
    sentence = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [sentence(40) for _ in range(4)]
    texts = []
    for i in range(n):
        t = sentence(r.choice((3, 20, 80, 200)))
        if i % 3 == 0:
            t += r.choice(("\n", "  ", " ")) + r.choice(shared) + " " + sentence(10)
        if i % 10 == 7 and texts:
            t = r.choice(texts)
        if i % 10 == 8 and texts:
            w = r.choice(texts).split()
            w[r.randrange(len(w))] = "edited"
            t = " ".join(w)
        texts.append(t)
    return texts
