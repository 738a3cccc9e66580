import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselight.llm import decontaminate


def plain(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(1, 4), min_size=1, max_size=14)), min_size=1, max_size=4))
def test_alignment(pairs):
    scores, first, end = decontaminate.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert scores.tolist() == [plain(a, b) for a, b in pairs]
    for (a, b), s, f, e in zip(pairs, scores, first, end, strict=True):
        assert s == plain(a, b[f:e]) and 0 <= f <= e <= len(b)


def leaks(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = [text(30) for _ in range(6)]
    edited = list(items[1])
    edited[4], edited[20] = "x", "y"
    del edited[12]
    docs = {
        1: text(50) + items[0] + text(50),
        2: text(10) + edited + text(10),
        3: text(100),
        4: text(20) + items[2][:10] + text(20),  # a third of an item
        5: items[3] + text(2000) + items[4],
        6: [w.upper() + "," for w in items[5]],
    }
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(7, None), (8, ""), (None, " ".join(items[0])), (1, "other text of the same id")]
    tests = [(100 + k, " ".join(w)) for k, w in enumerate(items)] + [(200, "too short an item"), (201, None), (202, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")


def test_copies(spark):
    docs, items = leaks(spark)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, items).collect()}
    assert set(got) == {(1, 100), (2, 101), (5, 103), (5, 104), (6, 105), (None, 100)}
    assert (got[1, 100].score, got[1, 100].first_word, got[1, 100].end_word) == (1.0, 50, 80)
    assert 0.8 <= got[2, 101].score < 1
    kept = [(r.doc_id, r.text) for r in decontaminate.clean(docs, items).collect()]
    assert sorted(i for i, _ in kept) == [1, 3, 4, 7, 8]  # only the row that holds the copy goes, not its id


def test_hot_items_and_passes(spark, monkeypatch):
    docs, items = leaks(spark)
    want = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 50)  # several passes
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == want


def test_odd_rows(spark, odd, none):
    _, items = leaks(spark)
    assert decontaminate.matches(odd, items).collect() == [] and decontaminate.clean(odd, items).count() == odd.count()
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.matches(none, items).collect() == []
    assert decontaminate.matches(odd, items.limit(0)).collect() == []


def test_thousands_of_like_edited_copies(spark):
    item = [f"i{k}" for k in range(55)]
    edited = [f"edit{k}" if k in (10, 22, 34, 46) else w for k, w in enumerate(item)]  # scores (2 * 51 - 4) / 110
    rows = [(i, " ".join([f"a{i}", f"b{i}"] + (edited if i < 3000 else item))) for i in range(4500)]
    rows += [(9000 + i, " ".join(item[:20]) + f" other {i}") for i in range(50)]  # seeds, but a third of the item
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.matches(docs, items).collect()}
    assert sorted(got) == list(range(4500))
    assert {round(got[i], 6) for i in range(3000)} == {round(98 / 110, 6)} and {got[i] for i in range(3000, 4500)} == {1.0}


def edited(r, item, edits):
    out = list(item)
    for _ in range(edits):
        at = r.randrange(len(out) + 1)
        kind = r.choice("ids")
        if kind == "i":
            out.insert(at, f"new{r.randrange(99)}")
        elif at < len(out) and kind == "d" and len(out) > 1:
            del out[at]
        elif at < len(out):
            out[at] = f"new{r.randrange(99)}"
    return out


@pytest.mark.parametrize("least", [0.6, 0.8, 1.0])
def test_matches_against_all_pairs(spark, least):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["the"] * 40  # a frequent word makes frequent grams
    items = [[r.choice(words) for _ in range(r.choice((5, 6, 8, 11, 15, 20, 33, 60)))] for _ in range(40)]
    docs = []
    for i in range(300):
        copies = [w for k in r.sample(range(40), 2) for w in edited(r, items[k], r.randrange(len(items[k]) // 3 + 2))]
        docs.append([r.choice(words) for _ in range(r.randrange(30))] + copies + [r.choice(words) for _ in range(r.randrange(30))])
    want = {}
    for i, d in enumerate(docs):
        for k in range(40):
            score = plain(items[k], d) / (2 * len(items[k])) if len(set(items[k]) & set(d)) else 0
            if score >= least - 1e-9:
                want[i, k] = round(score, 9)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(m.doc_id, m.item_id): round(m.score, 9) for m in decontaminate.matches(df, tests, least).collect()}
    assert got == want and len(want) > 100


def test_heavy_edits_of_short_and_gapped_items(spark):
    gapped = [f"g{i}" for i in range(20)]
    short = [f"s{i}" for i in range(8)]
    with_gaps = [w for i, x in enumerate(gapped) for w in ([x, "gap"] if i % 4 == 3 and i < 19 else [x])]  # (2 * 20 - 4) / 40
    replaced = [*short[:4], "other", *short[5:]]  # (2 * 7 - 1) / 16
    docs = spark.createDataFrame([(1, " ".join(["a", *with_gaps, "b"])), (2, " ".join(["a", *replaced, "b"]))], "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(gapped)), (20, " ".join(short))], "item_id long, text string")
    assert {(m.doc_id, m.item_id, round(m.score, 4)) for m in decontaminate.matches(docs, items).collect()} == {(1, 10, 0.9), (2, 20, 0.8125)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.sampled_from([0.5, 0.7, 0.8, 0.9, 1.0]), st.integers(1, 4), st.randoms())
def test_guaranteed_grams(m, least, n, r):
    item = list(range(m))
    text = [x for i in item for x in r.choice(([i], [i], [i], [-1, i], [-2], []))]
    if text and plain(item, text) >= 2 * m * least - 1e-9:
        shared = {tuple(item[i : i + n]) for i in range(m - n + 1)} & {tuple(text[i : i + n]) for i in range(len(text) - n + 1)}
        assert len(shared) >= decontaminate.guaranteed(m, least, n)


def test_short_items_on_demand(spark):
    docs, items = spark.createDataFrame([(1, "a two word b")], "doc_id long, text string"), spark.createDataFrame([(5, "two word")], "item_id long, text string")
    assert decontaminate.matches(docs, items).collect() == []
    assert [(m.doc_id, m.score) for m in decontaminate.matches(docs, items, least_words=1).collect()] == [(1, 1.0)]
