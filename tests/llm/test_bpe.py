import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caselight.llm import bpe

from .conftest import corpus

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [*corpus(40), "a<|endoftext|>b c <|startoftext|>", "ΣΑΣ Σ I'm 've 3.14 ½ 東京", f"x{chr(0xA0)}y{chr(0x2003)}z{chr(0x85)}w", "e" + chr(0x301) + " " + chr(0x301) + "e", "İstanbul ŉ ß ẞ", "\x1c\x1d\x00a\x0bb"]


@pytest.mark.parametrize("chunk_bytes", [500, 1_000_000])
def test_against_the_library(spark, chunk_bytes):
    plain = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    for r in bpe.encode(df, PATH, decoded=True, chunk_bytes=chunk_bytes).collect():
        ids = plain.encode(TEXTS[r.doc_id], add_special_tokens=False).ids
        text = plain.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, text, len(ids))
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_words_encode_alone(text):
    plain = bpe.tokenizer(open(PATH, encoding="utf-8").read())
    whole = plain.encode(text, add_special_tokens=False).ids
    assert whole == [i for w in text.encode().split() for i in plain.encode(w.decode(), add_special_tokens=False).ids]


def test_decode(spark):
    rows = bpe.decode(spark.createDataFrame([([320, 49407],), ([],), (None,)], "ids array<int>"), PATH).collect()
    assert sorted((r.decoded for r in rows), key=repr) == sorted(["a</w> <|endoftext|>", "", None], key=repr)


def test_decode_is_what_encode_digests(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (900, TEXTS[0]), (901, None)], "doc_id long, text string").repartition(3)
    rows = bpe.decode(bpe.encode(df, PATH, decoded=True), PATH, out_col="again").collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.again == r.decoded for r in rows)


def test_odd_rows(odd, none):
    got = bpe.encode(odd, PATH).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert bpe.encode(none, PATH).collect() == []
    with pytest.raises(ValueError):
        bpe.check(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
