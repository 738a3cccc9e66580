import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from caselight.llm import quality, toxicity
from caselight.llm.words import buffer


def labelled(n=600, seed=4):
    """Neutral sentences, some with a slur; groups are named in both kinds, in the toxic ones more often."""
    r = random.Random(seed)
    words = [a + b for a in ("ba", "ko", "mi", "re", "tu") for b in ("lan", "sor", "ten", "vik", "dra")]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        w = [r.choice(words) for _ in range(r.choice((8, 40, 150)))]
        if r.random() < (0.7 if toxic else 0.2):
            w.insert(r.randrange(len(w)), "muslims")
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(("vermin", "filth", "scum")))
        rows.append((i, " ".join(w).capitalize() + ".", int(toxic)))
    return rows


def test_toxicity_separates_and_spares_groups():
    rows = labelled()
    train, test = rows[:450], rows[450:]
    y = np.array([r[2] for r in train], float)
    model = toxicity.fit([r[1] for r in train], y)
    scores = model.scores(*buffer(pa.array([r[1] for r in test])))
    assert np.mean((scores >= 0.3) == [r[2] == 1 for r in test]) > 0.97
    pair = ["Balan korten muslims misor.", "Balan korten christians misor."]
    gap = lambda m: np.abs(np.diff(m.scores(*buffer(pa.array(pair)))))[0]
    assert gap(model) < 0.05
    assert gap(model) <= gap(toxicity.fit([r[1] for r in train], y, penalty=0.0)) + 1e-9


def test_swaps():
    assert toxicity._swaps(["Old texts. No group."])[:2] == [(0, "old texts"), (0, "young texts")]
    assert toxicity._swaps([""]) == []


def test_scores_cover_whole_texts():
    model = toxicity.fit([r[1] for r in labelled()], np.array([r[2] for r in labelled()], float))
    long = "balan " * 600_000 + "vermin"  # longer than a block
    a, b = model.scores(*buffer(pa.array([long, "balan " * 600_000])))
    assert a > 0.3 > b


def test_toxicity_of_tables(spark, odd, none):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs, model).collect()
    held = {r.doc_id: r.held_out for r in got}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    y = {i: t for i, _, t in rows}
    assert np.mean([r.predicted == y[r.doc_id] for r in got if r.held_out]) > 0.95
    changed = marks.withColumn("toxic", (marks.toxic != marks.toxic).cast("int"))
    spoiled = marks.join(docs.select("doc_id"), "doc_id").collect()
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.toxic) for r in spoiled], "doc_id long, toxic int")
    again = toxicity.train(docs, flipped)
    assert np.array_equal(again.weights, model.weights) and changed  # held-out labels have no influence
    assert {r.doc_id for r in toxicity.reject(docs, model).collect()} == {r.doc_id for r in got if not r.predicted}
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.reject(odd, model).columns == odd.columns
    assert toxicity.score(none, model).collect() == []
    empty = toxicity.train(none, marks)
    assert 0 <= empty.scores(*buffer(pa.array([""])))[0] <= 1


def judged(n=500, seed=6):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = []
    for i in range(n):
        good = i % 3 > 0
        w = [r.choice(words) for _ in range(r.choice((10, 60, 300)))]
        rows.append((i, " ".join(w if good else [x + r.choice(("###", "%%%", "&&&")) for x in w]), int(good)))
    return rows


def test_quality(spark, odd, none):
    rows = judged()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.train(docs, marks)
    got = quality.score(docs, model).collect()
    y = {i: q for i, _, q in rows}
    assert np.mean([r.predicted == y[r.doc_id] for r in got if r.held_out]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert quality.score(odd, model).count() == odd.count() and quality.score(none, model).collect() == []


def test_convolution_against_loops():
    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), None, None, None, 0.0)
    texts = [b"", b"ab", bytes(rng.integers(0, 256, 5, dtype=np.uint8)), bytes(rng.integers(0, 256, 700, dtype=np.uint8)), b"", bytes(rng.integers(0, 256, 257, dtype=np.uint8))]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    top, _ = model.pooled(data, at)
    begin, doc, _ = quality.chunk_bounds(at)
    for k in range(len(begin)):
        t, first = texts[doc[k]], begin[k] - at[doc[k]]
        places = [i for i in range(first, min(first + quality.CHUNK, len(t))) if i + quality.WIDTH <= len(t)]
        want = np.max([sum(model.tables[j, t[i + j]] for j in range(quality.WIDTH)) for i in places], axis=0) if places else np.zeros(quality.FILTERS)
        assert np.allclose(top[k], want, atol=1e-4)


@pytest.mark.parametrize("f", [toxicity.fit, quality.fit])
def test_fit_on_nothing(f):
    model = f([], np.zeros(0))
    assert 0 <= model.scores(*buffer(pa.array(["", "x", None])))[0] <= 1


def test_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    toxic = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert {(round(r.score, 6), r.predicted) for r in toxic} == {(0.001, 0)}  # nothing is known to be toxic
    assert toxicity.reject(odd, toxicity.train(odd, labels)).count() == odd.count()
    good = quality.score(odd, quality.train(odd, labels)).collect()
    assert {(round(r.score, 6), r.predicted) for r in good} == {(0.5, 1)}


def test_one_label_alone():
    texts = pa.array(["some words here", "", None])
    for share in (0.0, 1.0):
        y = np.full(3, share)
        for f in (toxicity.fit, quality.fit):
            scores = f(["a b c", "d e f", "g"], y).scores(*buffer(texts))
            assert np.allclose(scores, min(0.999, max(0.001, share)))
