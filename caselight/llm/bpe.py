"""BPE encoding and decoding by a distinct-word table.

Texts are split at ASCII white space, where this kind of tokenizer never joins. Each chunk of documents sends its
distinct words to buckets by their hash; a bucket encodes each word once, however many chunks and documents have it, and
replies to the chunks, which join the ids back by the words' positions. The ids of a chunk are then joined with the table of
pieces, which is as large as the vocabulary, and a document's pieces joined by a space are its decoded text.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import chunks
from .words import blocks, spans_hash, word_bounds

#: Text bytes whose distinct words meet in one bucket, on average; at least MIN_BUCKETS buckets.
BUCKET_BYTES, MIN_BUCKETS = 64_000_000, 48
#: Text bytes of a chunk, on average.
CHUNK_BYTES = 8_000_000
#: Words that are encoded at once.
BATCH = 5_000

_WORDS = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("words", pa.binary())])
_IDS = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("ids", pa.binary())])


@lru_cache(maxsize=2)
def tokenizer(description: str) -> Tokenizer:
    """The tokenizer of a JSON description, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    made = Tokenizer.from_str(description)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=2)
def pieces(description: str) -> pa.Table:
    """(id, piece): the table that ids are joined with; pieces in UTF-8."""
    rows = sorted((i, piece.encode()) for piece, i in tokenizer(description).get_vocab(with_added_tokens=True).items())
    return pa.table({"id": pa.array([r[0] for r in rows], pa.uint32()), "piece": pa.array([r[1] for r in rows], pa.large_binary())})


def check(description: str) -> None:
    """Raises unless words can be encoded one by one and pieces decoded one by one."""
    about = json.loads(description)
    if about.get("decoder") is not None:
        raise ValueError("pieces are joined by a space, which is how a tokenizer without decoder decodes")
    if "add_prefix_space\": true" in description or any(t.get("lstrip") or t.get("rstrip") or any(c in t["content"] for c in " \t\n\r\v\f") for t in about.get("added_tokens", ())):
        raise ValueError("white space matters to this tokenizer")


def _press(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _loosen(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _numbers(x: np.ndarray) -> bytes:
    """Numbers below 2**32 in as few bytes as the largest needs, all first bytes before all second ones: so they compress well."""
    k = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([k]) + len(x).to_bytes(8, "little") + x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :k].T.tobytes()


def _read_numbers(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    """The numbers that begin at a place, and where they end."""
    k, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
    out = np.zeros((n, 4), np.uint8)
    out[:, :k] = np.frombuffer(raw, np.uint8, k * n, at + 9).reshape(k, n).T
    return out.view("<u4").ravel(), at + 9 + k * n


def _words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts in order, and the texts' offsets in them."""
    starts, ends, word_at = word_bounds(data, at)
    inside = data[~((data == 32) | ((data >= 9) & (data <= 13)))]
    place = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=place[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(inside)]), word_at


def _distinct(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For all words, their number among the distinct ones; and these, in the order of their first places."""
    if not len(words):
        return np.zeros(0, np.int64), words
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _dealt(distinct: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words' order by bucket, and where each bucket begins in it."""
    _, offsets, raw = distinct.buffers() if len(distinct) else (None, pa.py_buffer(np.zeros(1, np.int64)), None)
    at = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(raw, np.uint8)[: at[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    bucket = (spans_hash(data, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] ... start[0] + size[0] - 1, start[1] ... and so on."""
    total = int(size.sum())
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(total)


def _decoded(ids: np.ndarray, at: np.ndarray, table: pa.Table) -> pa.Array:
    """The text of each run of ids: each distinct id is joined with its piece, and a run's pieces by a space. All ids are the tokenizer's own, so each has a piece."""
    used, which = np.unique(ids, return_inverse=True)
    met = pa.table({"id": pa.array(used, pa.uint32()), "at": pa.array(np.arange(len(used)))}).join(table, "id", join_type="inner", use_threads=False).sort_by("at")
    piece = pa.concat_arrays([pa.array([], pa.large_binary()), *met.column("piece").chunks])
    runs = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), piece.take(pa.array(which)))
    return pc.binary_join(runs, pa.scalar(b" ", pa.large_binary()))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each input row: id_col, n_tokens, ids_sha256, decoded_sha256, and on demand ids (array of int) and decoded (string).

    The ids are those that the tokenizers library gives for the whole text without special tokens added; decoded is the
    text that it gives for the ids, special tokens kept. The digests are of the ids as little-endian unsigned 32-bit
    integers and of the decoded text in UTF-8. A null text is an empty one and has no tokens; repeated rows and null ids keep
    a row each. Other columns are not read.
    """
    description = Path(tokenizer_path).read_text(encoding="utf-8")  # tasks get it with the function: their machines may not have the file
    check(description)
    total = chunks.text_bytes(docs, text_col)
    packed = chunks.pack(docs, chunks.chunks_for(total, chunk_bytes), id_col, text_col)
    buckets = max(MIN_BUCKETS, -(-total // BUCKET_BYTES))

    def send(key: tuple, texts: pa.Table) -> pa.Table:
        _, distinct = _distinct(_words(*chunks.unpack(texts)[1:])[0])
        order, edges = _dealt(distinct, buckets)
        rows = [(b, key[0].as_py(), _press([b"\n".join(distinct.take(pa.array(order[u:v])).to_pylist())])) for b, (u, v) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if v > u]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_WORDS)], schema=_WORDS)

    def reply(key: tuple, asked: pa.Table) -> pa.Table:
        made = tokenizer(description)
        parts = [np.frombuffer(_loosen(x.as_py()), np.uint8) for x in asked.column("words")]
        words, word_at = _words(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts]))))
        which, distinct = _distinct(words)
        sizes, flat = np.zeros(len(distinct), np.int64), []
        for a in range(0, len(distinct), BATCH):
            found = made.encode_batch([w.decode("utf-8", "replace") for w in distinct.slice(a, BATCH).to_pylist()], add_special_tokens=False)
            sizes[a : a + BATCH] = [len(x.ids) for x in found]
            flat.append(np.array([i for x in found for i in x.ids], np.uint32))
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        start = np.cumsum(sizes) - sizes
        rows = []
        for home, u, v in zip(asked.column("home").to_pylist(), word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
            mine = which[u:v]
            rows.append((home, key[0].as_py(), _press([_numbers(sizes[mine]), _numbers(flat[_spread(start[mine], sizes[mine])])])))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_IDS)], schema=_IDS)

    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * ids + [("decoded", pa.string())] * decoded
    schema = pa.schema(fields)

    def join(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        names, data, at = chunks.unpack(texts)
        if not len(names):
            return schema.empty_table()
        words, word_at = _words(data, at)
        which, distinct = _distinct(words)
        order, edges = _dealt(distinct, buckets)
        sizes, start, flat, base = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), [np.zeros(0, np.uint32)], 0
        for b, raw in zip(replies.column("bucket").to_pylist(), replies.column("ids"), strict=True):
            mine = order[edges[b] : edges[b + 1]]
            raw = _loosen(raw.as_py())
            n, after = _read_numbers(raw, 0)
            got, _ = _read_numbers(raw, after)
            sizes[mine], start[mine] = n, base + np.cumsum(n, dtype=np.int64) - n
            flat.append(got)
            base += len(got)
        flat, table = np.concatenate(flat), pieces(description)
        columns: list[list] = [[] for _ in fields[1:]]
        for first, end, _, _ in blocks(data, at):
            mine = which[word_at[first] : word_at[end]]
            tokens = flat[_spread(start[mine], sizes[mine])]
            token_at = np.concatenate(([0], np.cumsum(sizes[mine])))[word_at[first : end + 1] - word_at[first]]
            for u, v, text in zip(token_at[:-1].tolist(), token_at[1:].tolist(), _decoded(tokens, token_at, table).to_pylist(), strict=True):
                row = [v - u, hashlib.sha256(tokens[u:v].astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()]
                for column, x in zip(columns, row + [tokens[u:v].astype(np.int32)] * ids + [text.decode()] * decoded, strict=True):
                    column.append(x)
        return pa.Table.from_arrays([chunks.id_array(names), *(pa.array(c, f[1]) for c, f in zip(columns, fields[1:], strict=True))], schema=schema)

    asked = packed.groupBy("home").applyInArrow(chunks.tidy(send), "bucket int, home int, words binary")
    replies = asked.groupBy("bucket").applyInArrow(chunks.tidy(reply), "home int, bucket int, ids binary")
    sql = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return packed.groupBy("home").cogroup(replies.groupBy("home")).applyInArrow(chunks.tidy_both(join), sql).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col: the pieces of the array ids_col, joined by a space, through a join of its ids with the table of pieces.

    The table has a row for each entry of the vocabulary and is broadcast. Equal arrays are decoded once. A null array gives
    null, an empty one an empty text, an id that is null or without piece nothing.
    """
    description = Path(tokenizer_path).read_text(encoding="utf-8")
    check(description)
    table = pieces(description)
    vocabulary = rows.sparkSession.createDataFrame(list(zip(table.column("id").to_pylist(), [p.decode() for p in table.column("piece").to_pylist()], strict=True)), "__id int, __piece string")
    each = rows.select(F.col(ids_col).alias("__ids")).distinct().select("__ids", F.posexplode("__ids").alias("__at", "__id"))
    met = each.join(F.broadcast(vocabulary), "__id")
    texts = met.groupBy("__ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__piece"))), lambda x: x["__piece"]), " ").alias("__text"))
    out = rows.join(texts, F.col(ids_col).eqNullSafe(F.col("__ids")), "left")
    return out.withColumn(out_col, F.when(F.col(ids_col).isNotNull(), F.coalesce("__text", F.lit("")))).drop("__ids", "__text")
