import random
from itertools import combinations

import numpy as np
import xxhash

from caselight.llm import simhash

from .conftest import corpus


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = words.encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, most):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= most:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_against_all_pairs(spark):
    rows = [(10 * i, t) for i, t in enumerate(corpus(90) + ["", None, "One", "one TWO", "one two"])]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    prints = [plain(t) for _, t in rows]
    assert [got[i].fp % 2**64 for i, _ in rows] == prints
    assert [got[i].component_id for i, _ in rows] == [rows[k][0] for k in groups(prints, 3)]
    assert len({r.component_id for r in got.values()}) < len(rows) - 5


def test_positions():
    sets = simhash.position_sets()
    assert len(sets) == 14 and all(len(s) == 4 for s in sets)
    assert all(any(set(s) <= set(five) for s in sets) for five in combinations(range(8), 5))


def test_links_of_close_and_chained_prints(spark, monkeypatch):
    r = random.Random(1)
    centre = r.getrandbits(64)
    prints = {centre}
    for _ in range(60):  # chains: each a few bits from some other one
        p = r.choice(sorted(prints))
        for b in r.sample(range(64), r.choice((1, 2, 3))):
            p ^= 1 << b
        prints.add(p)
    prints |= {r.getrandbits(64) for _ in range(60)}
    monkeypatch.setattr(simhash, "BLOCK", 7)  # hot keys are compared in pairs of blocks
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in sorted(prints)]
    labels = {r.node: r.label for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    found = groups(sorted(prints), 3)
    mine = [labels.get(p, p) for (p,) in signed]
    same = lambda x: {frozenset(i for i, v in enumerate(x) if v == w) for w in set(x)}
    assert same(mine) == same(found)


def test_roots_match_pairs():
    prints = np.array([[0], [7], [15], [1 << 40], [255]], np.uint64)
    one, apart = np.zeros(5, np.int64), np.array([0, 0, 1, 1, 1])
    assert simhash._roots(one, prints, 3, 5).tolist()[:3] == [0, 0, 0]
    assert simhash._roots(apart, prints, 3, 5).tolist()[:3] == [0, 0, 2]


def test_reach_matches_neighbours(monkeypatch):
    rng = np.random.default_rng(4)
    prints = np.repeat(rng.integers(0, 2**63, 6).astype(np.uint64), 50)
    for _ in range(2):
        prints ^= np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64)
    prints, cells = rng.permutation(prints)[:, None], np.repeat([3, 8], [200, 100])
    searched = simhash._roots(cells, prints, 3, 5)
    monkeypatch.setattr(simhash, "MANY", 1000)
    assert searched.tolist() == simhash._roots(cells, prints, 3, 5).tolist()


def test_similar_documents(spark):
    r = random.Random(2)
    vocabulary = [f"word{i}" for i in range(3000)]
    base = [[r.choice(vocabulary) for _ in range(300)] for _ in range(12)]
    rows, family = [], {}
    for f, words in enumerate(base):
        for copy in range(4):
            w = list(words)
            for k in r.sample(range(300), (0, 1, 3, 5)[copy]):  # five edits leave a similarity of about 0.85
                w[k] = "edited"
            family[len(rows)] = f
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c % 4 == 0 and family[c] == family[i] for i, c in got.items())


def test_odd_rows(odd, none):
    for f in (simhash.near_duplicates, simhash.similar_documents):
        got = f(odd).collect()
        assert len(got) == odd.count()
        by = {(r.doc_id, r.component_id) for r in got}
        assert {(0, 0), (1, 0), (2, 0), (None, 4), (4, 4)} <= by  # blank texts are alike; a null id takes its copy's
        assert f(none).collect() == []


def jaccard_roots(sets, least):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        if len(sets[i] | sets[j]) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_alike_is_exact():
    r = random.Random(6)
    sets = [set(r.sample(range(1000), r.choice((1, 5, 20, 60)))) for _ in range(12)] + [set()]
    for _ in range(200):
        s = set(r.choice(sets))
        for _ in range(r.choice((0, 1, 2, 6))):
            s ^= {r.randrange(1000)}
        sets.append(s)
    got = simhash.alike([np.array(sorted(s), np.uint64) for s in sets], 0.8)
    assert got.tolist() == jaccard_roots(sets, 0.8)


def test_shared_passage_is_no_copy(spark, monkeypatch):
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(150))  # a similarity of about 0.6 for each pair of texts
    rows = [(i, passage + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(50))) for i in range(400)]
    rows += [(1000 + i, t.replace("p75 ", "edited ")) for i, t in rows[:5]]  # about 0.95 from its original
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: i % 1000 for i, _ in rows}
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == want
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 60)  # the clump is compared in pairs of blocks
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == want


def test_every_pair_of_like_texts_is_found(spark):
    """Pairs of a similarity from just above to just below the limit, against the exact one."""
    r = random.Random(12)
    docs, want = [], set()
    for k in range(150):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((40, 120, 400)))]
        copy = list(words)
        for at in r.sample(range(len(copy)), max(1, round(len(copy) * r.choice((0.005, 0.01, 0.015, 0.02, 0.03))))):
            copy[at] = f"new{r.randrange(9999)}"
        a, b = (set(zip(*(x[i:] for i in range(5)), strict=False)) for x in (words, copy))
        if len(a & b) >= 0.8 * len(a | b):
            want.add((2 * k, 2 * k + 1))
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    got = {(x.component_id, x.doc_id) for x in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect() if x.component_id != x.doc_id}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 60
