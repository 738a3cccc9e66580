import random
import zlib
from collections import Counter

import duckdb
import pytest

from caselight.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=5):
    out = {}
    for w, n in counts.items():
        mine = sorted(((-counts[v], v) for v in counts if near(w, v)))
        fits = bool(mine) and -mine[0][0] >= times * n
        out[w] = [mine[0][1] if fits else None, None, n, len(mine), -mine[0][0] if fits else None]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("most_sent", [0, 1000])
def test_against_all_pairs(spark, most_sent):
    r = random.Random(4)
    counts = {}
    while len(counts) < 250:
        w = "".join(r.choice("abcé") for _ in range(r.choice((1, 4, 5, 6))))
        counts[w] = r.choice((1, 1, 5, 30, 200, 2000, 20000))
    counts |= {"aaaa": 7, "aaaaa": 40, "aaaaaa": 300}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [(None, 3, "x")], "word string, n long, at string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group(df, most_sent=most_sent).collect()}
    assert got == brute(counts)
    assert max(len([1 for v in got.values() if v[1] == x]) for x in counts) > 3


def test_neighbours_are_all_and_once(spark):
    alphabet = ["a", "b", "é"]
    for w in ("a", "ab", "aab", "ébba"):
        got = [r.near for r in spelling.neighbours(spark.createDataFrame([(w,)], "word string"), alphabet).collect()]
        every = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        assert sorted(got) == sorted(every - {w})


def test_words_and_vocabulary(spark, odd, none):
    df = spark.createDataFrame([(1, "Élan ÀB-straße STRASSE x×y Kelvin" + chr(0x212A) + " naïve2naïve"), (None, None), (2, "")], "doc_id long, text string")
    got = [r.word for r in spelling.words(df).collect()]
    assert sorted(got) == sorted(["Élan", "Àb", "straße", "strasse", "x×y", "kelvin", "naïve", "naïve"])
    assert [tuple(r) for r in spelling.vocabulary(spelling.words(df), least_chars=5, least_count=2).collect()] == [("naïve", 2)]
    assert spelling.words(none).collect() == [] and spelling.group(spelling.vocabulary(spelling.words(none))).collect() == []
    plain = Counter(r.word for r in spelling.words(odd).collect())
    assert plain["word"] == 3000 and plain["a" * 5000] == 1 and plain["one"] == 2
    assert spelling.group(spelling.vocabulary(spelling.words(odd), least_chars=1, least_count=1)).count() == len(plain)
    with pytest.raises(ValueError):
        spelling.group(df, times=1)


def test_query_against_sql_and_plain_python(spark):
    got = queries.op12_spelling_variants(spark, SF)
    rows = {tuple(r) for r in got.collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    asked = db.execute(queries.oracle_sql()["op12_spelling_variants"])
    assert [d[0] for d in asked.description] == got.columns
    assert set(asked.fetchall()) == rows
    import re

    counts = Counter()
    for doc_id, text in db.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        for w in re.findall("[A-Za-zÀ-ÿ]+", text):
            w = "".join(c.lower() if c < "\x7f" else c for c in w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    assert {r[0]: r[3] for r in rows} == counts
