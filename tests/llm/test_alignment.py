import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from caselight.llm import alignment

from .conftest import ODD, corpus

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    *corpus(30), *ODD, "a▁b c", "x\n  y \n z\t\t w", "nbsp" + chr(0xA0) + " x" + chr(0x2003) + chr(0xA0) + "  y" + chr(0x3000) + "\n  end \n", "<|endoftext|> <s> don't I'll 3.14 ½",
    "日本語テキスト 😀 été ÀÉ", "tail  ", "tail  ", "same text again", "same text again", chr(0x5DF0) + " " + chr(0x480) + " х",
]


def spans(pieces):
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts):
    """Rows as the operator's, pair by pair: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment._byte_letters()
    a.encode_special_tokens = True
    found, counts = [], Counter()
    for i, t in enumerate(texts):
        whole = (" " + (t or "")).encode()
        x, y = a.encode(" " + t, add_special_tokens=False).ids if t else [], b.encode(t) if t else []
        bytes_x = [bytes(letters[c] for c in a.id_to_token(k)) for k in x]
        bytes_y = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not t or b"".join(bytes_x) != whole or b"".join(bytes_y) != whole:
            found.append((i, 0, 0, 0, [], ""))
            continue
        sx, sy = spans(bytes_x), spans(bytes_y)
        shared = sorted({e for _, e in sx} & {e for _, e in sy})
        links, j = [], 0
        for k, (u, v) in enumerate(sx):
            while sy[j][1] <= u:
                j += 1
            m = j
            while m < len(sy) and sy[m][0] < v:
                links.append((x[k], y[m]))
                m += 1
        groups, last = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(k) for k, (u, v) in zip(ids, s, strict=True) if u >= last and v <= e) for ids, s in ((x, sx), (y, sy))) if len(t) < 9000 else "")
            last = e
        counts.update(links)
        found.append((i, len(x), len(y), len(shared), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if len(t) < 9000 else None))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    return {r[0]: (*r[1:4], len(r[4]), sum(counts[p] == top[p[1]] for p in r[4]), sum(counts[p] for p in r[4]), r[5]) for r in found}


@pytest.fixture(scope="module")
def expected():
    return brute(TEXTS)


@pytest.mark.parametrize("most_sent,block_bytes", [(10**6, 8_000_000), (50, 2_000), (0, 8_000_000)])
def test_against_pair_by_pair(spark, monkeypatch, expected, most_sent, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, row string, words string").repartition(2)
    got = {r[0]: tuple(r)[1:] for r in alignment.linked(df, A, B, most_sent=most_sent).collect()}
    assert got.keys() == expected.keys()
    for i, row in expected.items():
        assert got[i][:6] == row[:6], TEXTS[i]
        assert row[6] is None or got[i][6] == row[6], TEXTS[i]


def test_groups_and_links_of_a_text(spark):
    df = spark.createDataFrame([(5, "été")], "doc_id long, text string")
    row = alignment.align(alignment.tokens(df, A, B), 15).first()
    a, b = Tokenizer.from_file(A).encode(" été").ids, sentencepiece.SentencePieceProcessor(model_file=B).encode("été")
    flat = [[int(x) for part in g.split("|") for x in part.split(",")] for g in row.groups.split(";")]
    assert [x for g in flat for x in g] and sum(len(g) for g in flat) == len(a) + len(b)
    assert {x >> 15 for x in row.links} == set(a) and {x & 32767 for x in row.links} == set(b) and len(row.links) == len(a) + len(b) - row.n_groups


def test_ends_are_aligned_by_arrays(spark):
    """No lambda is interpreted for each token end in the JVM, whose boxed numbers filled its heap."""
    df = spark.createDataFrame([(5, "été")], "doc_id long, text string")
    plan = alignment.align(alignment.tokens(df, A, B), 15)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan


def test_links_of_large_vocabularies(spark):
    """A's ids that need more than 31 bits together with B's."""
    df = spark.createDataFrame([([(7, 1, 1, [0])], [70_000], [3], [5], [3], [3])], alignment._BLOCKS)
    assert [tuple(r) for r in alignment.align(df, 15).collect()] == [(7, 1, 1, 1, "70000|5", [(70_000 << 15) + 5])]


def test_odd_rows(spark, odd, none):
    rows = alignment.linked(odd, A, B).collect()
    assert len(rows) == odd.count() and {r.groups_sha256 for r in rows if r.n_a == 0} == {""}
    assert alignment.linked(none, A, B).collect() == []


def test_white_space_that_words_end_with():
    """Every character that is white space to Python keeps the next word attached."""
    for c in map(chr, range(0x110000)):
        if c.isspace() and c not in " \x1c\x1d\x1e\x1f":
            words, _ = alignment._words([f" x{c} y".encode()])
            assert len(words) == 1, hex(ord(c))


def test_other_descriptions_are_refused():
    with pytest.raises(ValueError):
        alignment.byte_level(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
