import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from caselight.llm import sentence_pieces as sp

from .conftest import corpus

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [*corpus(40), "<s></s><0x41><unk>", "▁a ▁▁ b", "  two  spaces \n\n\t x ", " " * 700 + "x" + " " * 17, "a" * 5000, "the" * 300, "日本語テキスト 😀\x00", "e" + chr(0x301), "x" + chr(0xA0) + "y"]


@pytest.fixture(scope="module")
def plain():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return sp.model(open(PATH, "rb").read())


def ids_of(model, texts):
    raw = [t.encode() for t in texts]
    ids, at = model.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))))
    return [ids[u:v].tolist() for u, v in zip(at[:-1], at[1:], strict=True)]


def test_against_the_library(spark, plain):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    rows = sp.encode(df, PATH, decoded=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = plain.encode(TEXTS[r.doc_id])
        text = plain.decode(ids)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, text, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab the in▁\n", max_size=80)), max_size=5))
def test_any_text(plain, model, texts):
    assert ids_of(model, texts) == [plain.encode(t) for t in texts]


@pytest.mark.parametrize("long", [1, 4, 10_000])
def test_queue_and_rounds_agree(plain, model, monkeypatch, long):
    monkeypatch.setattr(sp, "LONG", long)
    r = random.Random(5)
    texts = TEXTS[:20] + ["".join(r.choice("theinr ") for _ in range(300)) for _ in range(30)]
    assert ids_of(model, texts) == [plain.encode(t) for t in texts]


def test_a_long_word(plain, model):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(200_000))
    assert ids_of(model, [text]) == [plain.encode(text)]


def test_decode_of_any_ids(spark, plain, model):
    r = random.Random(2)
    lists = [[r.choice((r.randrange(model.size), r.randrange(3, 259), r.randrange(3))) for _ in range(r.randrange(9))] for _ in range(400)]
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(lists)] + [(-1, None, ""), (-2, [13, -5, 10**9, 13], "")], "i int, ids array<int>, __key string")
    got = {x.i: x.decoded for x in sp.decode(df, PATH).collect()}
    assert got.pop(-1) is None and got.pop(-2) == plain.decode([13, 13])
    assert got == {i: plain.decode(x) for i, x in enumerate(lists)}
    with pytest.raises(ValueError):
        sp.decode(df, PATH, out_col="i")


def test_odd_rows(odd, none):
    got = sp.encode(odd, PATH, decoded=True).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (0, 1)} == {0}
    assert sorted(r.decoded for r in got) == sorted(r.text or "" for r in odd.collect())
    assert sp.encode(none, PATH).collect() == []


def test_other_models_are_refused():
    with pytest.raises(Exception):
        sp.model(b"no model")
