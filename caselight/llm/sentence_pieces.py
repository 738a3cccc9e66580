"""SentencePiece encoding and decoding by merge rounds over flat arrays.

A text is split where no piece can reach across: before each run of spaces. The distinct words of a block of texts lie one
after another in one array of symbols. In each round every word finds the smallest rank among its neighbouring pairs, all
words merge theirs at once, leftmost first, and the array is compacted; a word leaves when none of its pairs is a piece.
Spark deals the texts; a task needs nothing but its own texts and the model, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .bpe import _spread as spread
from .chunks import tidy_batches
from .words import blocks, buffer

SPACE = "▁"
#: Text bytes whose distinct words are merged together.
BLOCK_BYTES = 8_000_000
#: A word of more symbols would take up to as many rounds as it has symbols: it is merged by a queue of its pairs.
LONG = 400
_NONE = np.int32(2**31 - 1)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


class Model:
    """Pieces, ranks and merges of a byte-pair model with byte fallback and no normalisation but spaces."""

    def __init__(self, raw: bytes):
        plain = sentencepiece.SentencePieceProcessor(model_proto=raw)
        parts = dict(f for f in _fields(raw) if f[0] != 1)
        about, rules = dict(_fields(parts[2])), dict(_fields(parts.get(3, b"")))
        self.size = n = plain.get_piece_size()
        self.piece = [plain.id_to_piece(i) for i in range(n)]
        odd = np.array([plain.is_control(i) or plain.is_unknown(i) for i in range(n)])
        byte = np.array([plain.is_byte(i) for i in range(n)])
        normal = [i for i in range(n) if not (odd[i] or byte[i])]
        # Piece types: 1 normal, 2 unknown, 3 control, 6 byte. User-defined and unused pieces follow other rules.
        kinds = {dict(_fields(v)).get(3, 1) for f, v in _fields(raw) if f == 1}
        if about.get(3, 1) != 2 or not kinds <= {1, 2, 3, 6} or byte.sum() != 256:
            raise ValueError("a byte-pair model with byte fallback, without user-defined or unused pieces, is needed")
        if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1) or about.get(24, 0) or any(SPACE in self.piece[i].lstrip(SPACE) for i in normal):
            raise ValueError("this model changes texts, or has pieces across words")
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(byte):
            self.byte_id[int(self.piece[i][3:5], 16)] = i

        symbol = {self.piece[i]: i for i in normal}
        for c in sorted({c for i in normal for c in self.piece[i]} - symbol.keys()):
            symbol[c] = n + len([s for s in symbol if symbol[s] >= n])
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.symbols = 1 + max(symbol.values())
        scores = np.array([-plain.get_score(i) for i in normal])
        rank = dict(zip(normal, np.unique(scores, return_inverse=True)[1].tolist(), strict=True))
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        hasty = set()
        for i in normal:
            p = self.piece[i]
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = (rank[i], i)
                    hasty.update(x for x in (a, b) if rank.get(x, -1) >= rank[i])
        order = sorted(self.pairs)
        self.keys = np.array([a << 32 | b for a, b in order] + [2**62], np.int64)
        self.ranks = np.array([self.pairs[p][0] for p in order] + [_NONE], np.int32)
        self.made = np.array([self.pairs[p][1] for p in order] + [-1], np.int32)
        #: Pieces that another merge may follow at once: one merge a round in their words.
        self.hasty = np.zeros(self.symbols, bool)
        self.hasty[list(hasty)] = True

        self.surface = [b"" if odd[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        self.surface[plain.unk_id()] = " ⁇ ".encode()
        self.bytes = pa.array(self.surface, pa.large_binary())
        self.widths = np.array([len(x) for x in self.surface], np.int32)
        self.decimal = pa.array([str(i).encode() for i in range(n)], pa.large_binary())
        self.empty, self.is_byte, self.opens = odd & (np.arange(n) != plain.unk_id()), byte, np.array([p.startswith(SPACE) for p in self.piece])

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; no rank where it is no piece."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return self.ranks[at], self.made[at]

    def merge(self, sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols, word k from at[k] to at[k + 1], after all merges, and their offsets."""
        n = len(at) - 1
        size = np.diff(at)
        parts, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(size > LONG):
            parts.append(self._merge_long(sym[at[k] : at[k + 1]]))
            owners.append(np.full(len(parts[-1]), k))
        size = np.where(size > LONG, 0, size)
        word = np.repeat(np.arange(n, dtype=np.int32), size)
        sym = sym[spread(at[:-1], size)].astype(np.int32)
        rank, made = np.full(len(sym), _NONE), np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self.look(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank, first)
            done = np.repeat(best == _NONE, length)
            if done.any():
                parts.append(sym[done])
                owners.append(word[done])
                rest = ~done
                sym, word, rank, made, length, best = sym[rest], word[rest], rank[rest], made[rest], length[best != _NONE], best[best != _NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length))
            owner = word[hit]
            new = np.r_[True, owner[1:] != owner[:-1]]  # a word's leftmost
            run = np.r_[True, (np.diff(hit) != 1)] | new  # pairs that share a symbol make a run, of which every other one is merged
            place = np.arange(len(hit))
            even = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
            alone = np.logical_or.reduceat(self.hasty[made[hit]], np.flatnonzero(new))
            hit = hit[new | (even & ~np.repeat(alone, np.diff(np.r_[np.flatnonzero(new), len(hit)])))]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            there = np.cumsum(keep)[hit] - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            touched = np.zeros(len(sym), bool)
            touched[there] = touched[there[there > 0] - 1] = True
            rank[touched] = _NONE
            touched[:-1] &= word[1:] == word[:-1]
            touched[-1] = False
            touched = np.flatnonzero(touched)
            rank[touched], made[touched] = self.look(sym[touched], sym[touched + 1])
        whole, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return whole[order], np.searchsorted(owner[order], np.arange(n + 1))

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The same for one long word: the best pair, the leftmost of equals, is always the next in a queue."""
        s, pairs = sym.tolist(), self.pairs
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        queue = [(pairs[a, b][0], i, i + 1, a, b) for i, (a, b) in enumerate(zip(s[:-1], s[1:], strict=True)) if (a, b) in pairs]
        heapq.heapify(queue)
        while queue:
            _, i, j, a, b = heapq.heappop(queue)
            if s[i] != a or after[i] != j or s[j] != b:
                continue
            s[i], s[j], after[i] = pairs[a, b][1], -1, after[j]
            if after[i] < len(s):
                before[after[i]] = i
            for u, v in ((before[i], i), (i, after[i])):
                if u >= 0 and v < len(s) and (s[u], s[v]) in pairs:
                    heapq.heappush(queue, (pairs[s[u], s[v]][0], u, v, s[u], s[v]))
        return np.array([x for x in s if x >= 0], np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the texts' offsets among them."""
        texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        texts = [b" " + t.replace(SPACE.encode(), b" ") if t else t for t in texts]
        joined = b"".join(texts)
        try:
            joined.decode()
        except UnicodeDecodeError:
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
            joined = b"".join(texts)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        raw = np.frombuffer(joined, np.uint8)
        opens = np.zeros(len(raw) + 1, bool)
        opens[at] = True
        opens[1:-1] |= (raw[1:] == 32) & (raw[:-1] != 32)
        starts = np.flatnonzero(opens[:-1])
        edges = np.r_[starts, len(raw)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
        which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, id_at = self.encode_words(words.dictionary)
        size = np.diff(id_at)[which]
        tokens = ids[spread(id_at[which], size)] if len(which) else np.zeros(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(size)))
        return tokens, ends[np.searchsorted(starts, at, "left")]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in UTF-8, spaces for the model's mark, and the words' offsets among them."""
        raw, at = buffer(words)
        chars = np.frombuffer(raw.tobytes().decode().replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        count = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[at]
        sym = self.of_char[chars]
        lost = np.flatnonzero(sym < 0)
        unknown, which = np.unique(chars[lost], return_inverse=True)
        sym[lost] = self.symbols + which
        sym, at = self.merge(sym, count)
        # Characters without a piece become their bytes.
        single = np.concatenate((np.arange(self.symbols), self.symbols + np.arange(len(unknown))))
        spelled = [[i] if i < self.size else self.byte_id[list(chr(int(c)).encode())].tolist() for i, c in zip(single.tolist(), np.r_[np.zeros(self.size, np.int64), self._chars_beyond(), unknown].tolist(), strict=True)]
        width = np.array([len(x) for x in spelled])
        flat, start = np.array([i for x in spelled for i in x], np.int32), np.cumsum(width) - width
        ids = flat[spread(start[sym], width[sym])] if len(sym) else np.zeros(0, np.int32)
        return ids, np.concatenate(([0], np.cumsum(width[sym])))[at]

    def _chars_beyond(self) -> np.ndarray:
        """Characters that are part of pieces but none themselves, by their symbols."""
        chars = np.flatnonzero(self.of_char >= self.size)
        return chars[np.argsort(self.of_char[chars])]

    def join(self, table: pa.Array, ids: np.ndarray, at: np.ndarray, between: bytes) -> pa.Array:
        """What the table has for each run of ids, joined."""
        runs = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), table.take(pa.array(ids)))
        return pc.binary_join(runs, pa.scalar(between, pa.large_binary()))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The text of each run of ids. The space before a text's first piece goes; bytes that make no character become U+FFFD each."""
        out = []
        for k, text in enumerate(self.join(self.bytes, ids, at, b"").to_pylist()):
            mine = ids[at[k] : at[k + 1]]
            told = np.flatnonzero(~self.empty[mine])
            opens = bool(len(told)) and bool(self.opens[mine[told[0]]])
            try:
                text.decode()
                broken = self.empty[mine].any() and self.is_byte[mine].any()  # a control id parts the bytes around it
            except UnicodeDecodeError:
                broken = True
            text = self._mended(mine) if broken else text
            out.append(text[1:] if opens else text)
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        out, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode().encode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�".encode())
                run = run[n:]
            if i >= 0:
                out.append(self.surface[i])
        return b"".join(out)


@lru_cache(maxsize=2)
def model(raw: bytes) -> Model:
    return Model(raw)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = False) -> DataFrame:
    """One row for each input row: id_col, n_tokens, ids_sha256, decoded_sha256, and on demand ids (array of int) and decoded (string).

    The ids are those of the sentencepiece library for the whole text, without begin or end; decoded is what it makes of
    them. The digests are of the decimal ids joined by commas and of the decoded text in UTF-8. A null text is an empty one
    and has no tokens; repeated rows and null ids keep a row each. Other columns are not read, whatever their names. A very
    long text is a block of its own in the task's memory.
    """
    raw = Path(model_path).read_bytes()  # tasks get it with the function: their machines may not have the file
    model(raw)
    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * ids + [("decoded", pa.string())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(raw)
        for batch in batches:
            data, at = buffer(batch.column(1))
            for first, end, part, offsets in blocks(data, at, BLOCK_BYTES):
                tokens, token_at = m.encode(part, offsets)
                texts = m.decode(tokens, token_at)
                digests = [hashlib.sha256(x).hexdigest() for x in m.join(m.decimal, tokens, token_at, b",").to_pylist()]
                columns = [batch.column(0).slice(first, end - first), pa.array(np.diff(token_at)), pa.array(digests), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                columns += [pa.ListArray.from_arrays(pa.array(token_at, pa.int32()), pa.array(tokens))] * ids + [pa.array([t.decode() for t in texts], pa.string())] * decoded
                yield pa.RecordBatch.from_arrays(columns, [f[0] for f in fields])

    ship(docs.sparkSession)
    sql = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(tidy_batches(run), sql).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col: the text of the array ids_col. A null array gives null, an empty one an empty text, an id that is null or not the model's nothing."""
    if out_col in rows.columns:
        raise ValueError(f"there is a column {out_col} already")
    raw = Path(model_path).read_bytes()
    size = model(raw).size
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def texts(column):
        m, lists = model(raw), [x if x is not None else [] for x in column]
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
        flat = np.concatenate([np.zeros(0, np.int32), *[np.asarray(x, np.int32) for x in lists]])
        return column.__class__([None if x is None else t.decode() for x, t in zip(column, m.decode(flat, at), strict=True)], dtype=object)

    known = F.filter(F.col(ids_col).cast("array<int>"), lambda i: i.isNotNull() & (i >= 0) & (i < size))
    return rows.withColumn(out_col, texts(known))
