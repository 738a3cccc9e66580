import random
import threading

import pytest

from caselight.operators import fulltext, text_index
from caselight.operators.text_index import TextIndex

WORDS = "суд право истец ответчик договор займ долг срок сумма решение жалоба отказ акт дом квартира земля налог штраф".split()


def texts(r, ids):
    return [(i, " ".join(r.choice(WORDS[: r.choice((4, 18))]) for _ in range(r.choice((3, 8, 30))))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def fresh(spark, live, query, k):
    index = fulltext.postings(frame(spark, sorted(live.items())), "doc_id", "text")
    return [tuple(r) for r in fulltext.search(index, "doc_id", query, k).collect()]


def test_changes_equal_a_fresh_build(spark, tmp_path):
    r = random.Random(2)
    index = TextIndex(spark, str(tmp_path), "doc_id", block_bits=2)
    assert index.search("займ").collect() == []
    live = dict(texts(r, range(60)))
    index.put(frame(spark, sorted(live.items())), "text")
    changed = texts(r, range(50, 80)) + [(3, "x"), (4, None)]  # replaced, new, and too short from now on
    index.put(frame(spark, [*changed, (None, "займ " * 9)]), "text")
    live |= {i: t or "" for i, t in changed}
    index.remove(frame(spark, [(i, "") for i in (1, 7, 55, 79, 999)]))
    live = {i: t for i, t in live.items() if i not in (1, 7, 55, 79)}
    state = index.state()
    assert state.number == 2 and index.remove(frame(spark, [(999, "")])) == state
    for _ in range(2):
        for query in ("займ долг", "срок срок суммы жалобе", "земля", "нет такого"):
            assert [tuple(x) for x in index.search(query, 7).collect()] == fresh(spark, live, query, 7)
        plain = fulltext.postings(frame(spark, sorted(live.items())), "doc_id", "text")
        assert {tuple(x) for x in index.frequencies().collect()} == {tuple(x) for x in fulltext.document_frequencies(plain).collect()}
        assert {x.id for x in index.documents().collect()} == {x.doc_id for x in plain.select("doc_id").distinct().collect()}
        assert (index.state().texts, index.state().tokens) == (plain.select("doc_id").distinct().count(), plain.groupBy().sum("tf").first()[0])
        index.compact()
        assert len(index.state().segments) == 1 and not index.state().gone


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "FIRST", 2)
    rows = [(i, "договор займ " + " ".join(WORDS[(i + j) % 18] for j in range(30))) for i in range(400)] + [(1000 + i, "земля земля земля налог налог") for i in range(8)]
    index = TextIndex(spark, str(tmp_path), "doc_id", block_bits=3)
    index.put(frame(spark, rows), "text")
    assert [tuple(x) for x in index.search("земля налог", 4).collect()] == fresh(spark, dict(rows), "земля налог", 4)
    assert index.read["scored"] < 0.2 * index.read["blocks"]
    most = index._blocks(index.state()).where("term = 'договор'").selectExpr("count(*) AS n", "max(size(steps)) AS largest").first()
    assert most.n >= 50 and most.largest <= 8  # a term that all texts have is many rows


def test_two_that_change_at_once(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path), "doc_id")
    r = random.Random(3)
    live = dict(texts(r, range(30)))
    index.put(frame(spark, sorted(live.items())), "text")
    gate, commit, failed = threading.Barrier(2), TextIndex._commit, []
    waited = set()

    def late(self, state):
        if threading.get_ident() not in waited:
            waited.add(threading.get_ident())
            gate.wait(60)
        return commit(self, state)

    monkeypatch.setattr(TextIndex, "_commit", late)
    parts = [texts(r, range(10, 20)), texts(r, range(15, 40))]

    def run(rows):
        try:
            TextIndex(spark, str(tmp_path), "doc_id").put(frame(spark, rows), "text")
        except BaseException as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(p,)) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not failed and index.state().number == 2
    ways = [{**live, **dict(a), **dict(b)} for a, b in (parts, parts[::-1])]
    assert [tuple(x) for x in index.search("займ договор", 9).collect()] in [fresh(spark, w, "займ договор", 9) for w in ways]


def test_a_lost_log_is_no_empty_index(spark, tmp_path):
    import shutil

    index = TextIndex(spark, str(tmp_path), "doc_id")
    index.put(frame(spark, [(1, "займ " * 9)]), "text")
    shutil.rmtree(tmp_path / "log")
    with pytest.raises(RuntimeError):
        index.search("займ")
