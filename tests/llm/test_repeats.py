
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselight.llm import chunks, repeats, run_length_index, suffix_arrays, suffix_tree, words

from .conftest import corpus


def plain(units_of, rows, width):
    """(units, removed flags) of each row by looking every window up."""
    first = {}
    for i, t in rows:
        u = units_of(t)
        for k in range(len(u) - width + 1):
            key = tuple(u[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        u = units_of(t)
        gone = [False] * len(u)
        for k in range(len(u) - width + 1):
            if first[tuple(u[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, u, gone))
    return out


@pytest.mark.parametrize(("chunk_bytes", "hot"), [(2_000, 50_000), (1_000_000, 50_000), (2_000, 3)])
def test_words(spark, chunk_bytes, hot):
    rows = list(enumerate(corpus()))
    got = {r.doc_id: r for r in suffix_tree.remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk_bytes, hot=hot).collect()}
    found = plain(lambda t: t.encode().split(), rows, 13)
    assert sum(sum(g) for _, _, g in found) > 500
    for i, u, gone in found:
        assert (got[i].n_words, got[i].n_removed) == (len(u), sum(gone))
        assert got[i].kept_text.encode() == b" ".join(x for x, g in zip(u, gone, strict=True) if not g)


@pytest.mark.parametrize(("chunk_bytes", "hot"), [(2_000, 50_000), (1_000_000, 50_000), (2_000, 3)])
def test_bytes(spark, chunk_bytes, hot):
    rows = list(enumerate(corpus()))
    got = {r.doc_id: r for r in run_length_index.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk_bytes, hot=hot).collect()}
    for i, u, gone in plain(lambda t: t.encode(), rows, 50):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(u), sum(gone), spans)
        assert bytes(got[i].kept) == bytes(x for x, g in zip(u, gone, strict=True) if not g)


def test_hot_line_in_other_surroundings(spark):
    line = "the frequent line of six words"
    rows = [(i, f"{line} a{i} b{i} " + " ".join(f"c{k}" for k in range(20)) + f" d{i} {line} {line} e{i % 3} {line} {line} x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (2, 50_000):
        words_of = {r.doc_id: r.n_removed for r in suffix_tree.remove_repeated_words(df, chunk_bytes=1500, hot=hot).collect()}
        bytes_of = {r.doc_id: r.n_removed for r in run_length_index.remove_repeated_bytes(df, chunk_bytes=1500, hot=hot).collect()}
        for i, _, gone in plain(lambda t: t.encode().split(), rows, 13):
            assert words_of[i] == sum(gone)
        for i, _, gone in plain(lambda t: t.encode(), rows, 50):
            assert bytes_of[i] == sum(gone)


def test_odd_rows(odd, none):
    w = suffix_tree.remove_repeated_words(odd).collect()
    b = run_length_index.remove_repeated_bytes(odd).collect()
    assert len(w) == len(b) == odd.count()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in w}[6] == (3000, 0)  # repeats within a document stay
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in b}[0] == (0, 0)
    assert [r.n_removed for r in b if r.doc_id == 7] == [0, 0, 0]
    assert suffix_tree.remove_repeated_words(none).collect() == run_length_index.remove_repeated_bytes(none).collect() == []


def test_same_id_and_null_id(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (9, t)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_tree.remove_repeated_words(df).collect())
    assert got == [(-1, 40), (5, 0), (5, 0), (9, 40)]  # rows of one id are one document; a null id comes last


def test_many_variants_of_one_stretch():
    rng = np.random.default_rng(5)
    core = rng.integers(97, 123, 30).astype(np.uint8)
    parts = [np.concatenate((rng.integers(97, 99, 12), core, rng.integers(97, 99, 12))).astype(np.uint8) for _ in range(60)]
    docs, anchors = np.arange(60), np.zeros(60, np.int64)
    got = run_length_index.long_matches(parts, anchors, docs, 36)
    assert [h.tolist() for h in got] == [h.tolist() for h in suffix_tree.deep_nodes(parts, anchors, docs, 36)]
    seen, total = set(), 0
    for p, h in zip(parts, got, strict=True):
        mine = [p[k : k + 36].tobytes() for k in range(len(p) - 35)]
        assert h.tolist() == [m in seen for m in mine]
        seen |= set(mine)
        total += h.sum()
    assert total > 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=6))
def test_suffix_array(parts):
    whole, ends = suffix_arrays.joined([np.frombuffer(p, np.uint8) for p in parts])
    order, _ = suffix_arrays.suffix_array(whole, ends)
    end_of = ends[np.searchsorted(ends, np.arange(len(whole)))]
    key = [(whole[i : end_of[i]].tobytes() + b"\x00", int(end_of[i])) for i in range(len(whole))]
    assert order.tolist() == sorted(range(len(whole)), key=lambda i: key[i])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=25).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=5), st.binary(min_size=1, max_size=25).map(lambda b: bytes(97 + x % 4 for x in b)))
def test_matching_statistics(parts, pattern):
    index = run_length_index.RunLengthIndex([np.frombuffer(p, np.uint8) for p in parts])
    (got,) = index.matching_statistics([np.frombuffer(pattern, np.uint8)], 50)
    longest = lambda i: max(k for k in range(len(pattern) - i + 1) if any(pattern[i : i + k] in p for p in parts))
    assert got.tolist() == [longest(i) for i in range(len(pattern))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 9))
def test_minimizers(keys, width):
    k = words.mix(np.array(keys, np.uint64))
    chosen, of = words.minimizers(k, width)
    assert [int(chosen[i]) for i in of] == [a + int(np.argmin(k[a : a + width] >> np.uint64(32))) for a in range(max(0, len(keys) - width + 1))]


def test_words_are_ascii_words():
    texts = ["a b\tc\x0bd\x0ce\r\nf\x1cg" + chr(0xA0) + "h", "", "x"]
    data, at = words.buffer(pa.array(texts))
    starts, ends, word_at = words.word_bounds(data, at)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in t.encode().split()]
    assert np.diff(word_at).tolist() == [len(t.encode().split()) for t in texts]


def test_chunks_round_trip(spark):
    rows = [(i % 40, t) for i, t in enumerate(corpus(80))]
    packed = chunks.pack(spark.createDataFrame(rows, "doc_id long, text string"), 5).toArrow()
    back = []
    for home in set(packed.column("home").to_pylist()):
        ids, data, at = chunks.unpack(packed.filter(pc.equal(packed.column("home"), home)))
        back += [(int(i), data[a:b].tobytes().decode()) for i, a, b in zip(ids, at[:-1], at[1:], strict=True)]
    assert sorted(back) == sorted(rows)


def test_suffixes_of_bytes_are_sorted_in_few_rounds(monkeypatch):
    """Stretches of up to 76 bytes need four doublings, as the first key holds seven bytes; end marks are the smallest and differ."""
    r = random.Random(7)
    passage = bytes(r.choice((0, 1, 97, 255)) for _ in range(70))
    parts = [np.frombuffer(x, np.uint8) for x in [passage, passage[3:] + b"abc", b"a", b"", b"\0\0", b"a" * 76, b"a" * 75 + b"b", passage, *(bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(60))]]
    whole, ends = suffix_arrays.joined(parts)
    calls, rank = [], suffix_arrays._rank
    monkeypatch.setattr(suffix_arrays, "_rank", lambda keys: calls.append(len(keys)) or rank(keys))
    order, _ = suffix_arrays.suffix_array(whole, ends)
    units = [int(x) + len(ends) for x in whole]
    for k, e in enumerate(ends.tolist()):
        units[e] = k
    end_of = [int(ends[np.searchsorted(ends, i)]) for i in range(len(whole))]
    assert order.tolist() == sorted(range(len(whole)), key=lambda i: units[i : end_of[i] + 1])
    assert len(calls) <= 4


def test_common_prefixes_of_indexed_suffixes():
    """Seven bytes at once give the lengths that single bytes give, up to the limit and to either end."""
    parts = [np.frombuffer(x, np.uint8) for x in (b"abcdefgh" * 4, b"abcdefgh" * 3 + b"abcdefgX", b"\0\0\0\0\0\0\0\0\0", b"\0" * 20, b"", b"\xff" * 9)]
    index = run_length_index.RunLengthIndex(parts)
    raw, at = [p.tobytes()[i:] for p in parts for i in range(len(p) + 1)], np.arange(sum(len(p) + 1 for p in parts))
    x, y = (z.ravel() for z in np.meshgrid(at, at))
    for most in (0, 6, 7, 8, 50):
        want = [next((k for k, (u, v) in enumerate(zip(raw[i], raw[j], strict=False)) if u != v), min(len(raw[i]), len(raw[j]))) for i, j in zip(x, y, strict=True)]
        assert index._common(x, y, np.full(len(x), most)).tolist() == [min(most, k) for k in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=25).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=5), st.lists(st.binary(max_size=25).map(lambda b: bytes(97 + x % 4 for x in b)), min_size=1, max_size=4), st.integers(1, 9))
def test_stretches_that_cannot_match_are_left(parts, patterns, least):
    index = run_length_index.RunLengthIndex([np.frombuffer(p, np.uint8) for p in parts])
    patterns = [np.frombuffer(p, np.uint8) for p in patterns]
    sizes, text = np.array([len(p) for p in patterns]), np.concatenate(patterns)
    whole, some = index.lengths(text, sizes, 50), index.lengths(text, sizes, 50, least)
    assert ((whole >= least) == (some >= least)).all() and ((some == whole) | (some == 0)).all()


def test_a_stretch_is_left_early():
    index = run_length_index.RunLengthIndex([np.frombuffer(b"abcdefgh", np.uint8)])
    text = np.frombuffer(b"hhhhabcd", np.uint8)
    assert index.lengths(text, np.array([8]), 50).tolist() == [1, 1, 1, 1, 4, 3, 2, 1]
    assert index.lengths(text, np.array([8]), 50, 6).tolist() == [0, 0, 0, 1, 4, 3, 2, 1]


def test_covered_by_windows():
    r = random.Random(2)
    unit_at, width = np.array([0, 100, 100, 300]), 13
    rows = [([r.choice((0, 2)) for _ in range(3)], [r.randrange(30) for _ in range(3)], [r.randrange(1 << 50) & r.randrange(1 << 50) for _ in range(3)]) for _ in range(4)]
    table = pa.table({n: pa.array([np.array(x[i], k).tobytes() for x in rows], pa.binary()) for i, (n, k) in enumerate((("doc", np.uint32), ("at", np.uint32), ("windows", np.uint64)))})
    want = {int(unit_at[d]) + a + j + k for ds, as_, ms in rows for d, a, m in zip(ds, as_, ms, strict=True) for j in range(50) if m >> j & 1 for k in range(width)}
    assert set(np.flatnonzero(repeats.covered(table, unit_at, width)).tolist()) == {x for x in want if x < 300}
    assert not repeats.covered(table.slice(0, 0), unit_at, width).any() and not len(repeats.covered(table.slice(0, 0), np.array([0]), width))
