import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.llm import ann


def exact(vectors, query, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float32).astype(float)
    s = x @ x[ids == query][0]
    return [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != query][:k], dict(zip(ids.tolist(), s, strict=True))


@pytest.mark.parametrize("block", [40_000, 37])
def test_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 16)).astype(np.float32))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 800, 20):
        want, scores = exact(vectors, q, 10)
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        assert all(abs(m[2] - scores[m[1]]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & set(want))
    assert hits / 400 >= 0.9


def test_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, one) for i in range(60)] + [(100, [0.0] * 4), (101, None), (102, [nan, 1.0, 0.0, 0.0]), (103, [inf, 0.0, 0.0, 0.0]), (104, [1.0, None, 0.0, 0.0]), (105, [1.0]), (None, one), (7, [2.0, 0.0, 0.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 100, 101), 5).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 7, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 3, 1.0), (0, 5, 4, 1.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect() == []
    few = spark.createDataFrame([(1, one), (2, one)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, F.lit(True)).orderBy("query_id").collect()] == [(1, 2), (2, 1)]


def test_rotations_keep_lengths():
    x = np.random.default_rng(2).normal(size=(5, 12)).astype(np.float32)
    for y in ann.rotations(x, 3, 1):
        assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1), atol=1e-4)
    two = ann.buckets(x / np.linalg.norm(x, axis=1, keepdims=True), 6, 2, 2, 1)
    assert two.shape == (5, 2, 6) and two.min() >= 0 and all(len(set(r)) == 6 for t in two for r in t)


@pytest.mark.parametrize("block", [40_000, 20])  # 20: more vectors than axes times a block
def test_recall_does_not_fall_with_size(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    x = np.random.default_rng(5).normal(size=(3000, 64))
    vectors = [(i, v.tolist()) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect()}
    want = {(q, i) for q in range(0, 3000, 100) for i in exact(vectors, q, 20)[0]}
    assert len(got) == 600 and len(got & want) / 600 >= 0.9


@pytest.mark.parametrize("block", [40_000, 4])
def test_few_vectors_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    vectors = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(6).normal(size=(15, 64)).astype(np.float32))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(df, F.lit(True)).collect()}
    assert got == {(q, n): i for q in range(15) for n, i in enumerate(exact(vectors, q, 20)[0], 1)}


def test_two_rotations_ask_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann, "MEMBERS", 2)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(400, 64))
    x = np.repeat(centres, 12, axis=0) + 0.45 * rng.normal(size=(4800, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    second = ann.second_dimensions(len(x), 64)
    assert second == 10
    probes = ann.fit_probes(x.astype(np.float64), len(x), 10, ann.TABLES, second, 17)
    members = ann.buckets(x, 1, ann.TABLES, second, 17)[:, :, 0]
    asked = ann.buckets(x[::40], probes, ann.TABLES, second, 17)
    compared = np.mean([np.any([np.isin(members[:, t], asked[q, t]) for t in range(ann.TABLES)], axis=0).mean() for q in range(len(asked))])
    assert compared < 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 40 == 0, 10).collect()}
    likeness = x.astype(float) @ x.astype(float).T
    want = {(q, int(i)) for q in range(0, 4800, 40) for i in [j for j in np.argsort(-likeness[q], kind="stable") if j != q][:10]}
    assert len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("second", [0, 3, 32])
def test_buckets_are_the_nearest(second):
    x = np.random.default_rng(3).normal(size=(40, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = ann.buckets(x, 9, 2, second, 5)
    assert (found[:, :, 0] == ann.buckets(x, 1, 2, second, 5)[:, :, 0]).all()
    for t, (one, two) in enumerate(ann._axes(x, 2, second, 5)):
        near = one if two is None else (one[:, :, None] + two[:, None, :]).reshape(40, -1)
        assert all(sorted(near[i, found[i, t]], reverse=True) == sorted(near[i], reverse=True)[:9] for i in range(40))


def test_a_hot_bucket_goes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "ASKING", 7)
    x = np.random.default_rng(4).normal(size=(600, 8))
    x[:300] = x[0] + 0.01 * x[:300]  # half of all vectors in one bucket
    vectors = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, 5).collect()}
    hits = sum(got[q, n] == i for q in range(0, 300, 10) for n, i in enumerate(exact(vectors, q, 5)[0], 1))
    assert hits >= 140 and len(got) == 300


@pytest.mark.parametrize("block", [40_000, 50])
def test_an_id_that_stands_often(spark, monkeypatch, block):
    """Equal and different rows of one id are one neighbour, with the best of their scores; they take no other's place."""
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    near = [(i, (centre + 0.05 * rng.normal(size=16)).tolist()) for i in range(1, 61)]
    often = [(500, (centre * 1.5 + 0.01 * rng.normal(size=16) * (j % 7)).tolist()) for j in range(60)] + [(501, (centre * 1.2).tolist())] * 60
    df = spark.createDataFrame([(0, centre.tolist()), *near, *often, (0, (-centre).tolist())], "vec_id long, embedding array<double>")
    best = {}
    for q in (centre, -centre):
        for i, v in [*near, *often]:
            best[i] = max(best.get(i, -np.inf), float(np.dot(q, v)))
    want = sorted(best, key=lambda i: (-best[i], i))[:20]
    got = ann.nearest(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 21)) and len({r.vec_id for r in got}) == 20
    assert len({r.vec_id for r in got} & set(want)) >= 18 and {500, 501} <= {r.vec_id for r in got}
    assert all(abs(r.score - best[r.vec_id]) < 1e-9 for r in got)
