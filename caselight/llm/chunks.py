"""Documents dealt into memory-sized chunks ("homes") by a hash of id and text, packed and compressed for the shuffle.

An operator that asks the whole corpus about parts of its texts works in rounds of questions and answers: a chunk sends
what it asks to groups that are keyed by a hash, once for the whole chunk however often it needs the answer, and the
groups reply to chunks. So a key that a third of all documents hold costs one entry a chunk, and texts are shuffled once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import buffer, spans_hash

#: Text bytes of a chunk, on average; a chunk is held in a task's memory as a whole.
CHUNK_BYTES = 12_000_000
#: Stands for a null id; such documents come after all others.
NO_ID = np.int64(2**63 - 1)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the machine: Python workers outlive their tasks and share an executor with the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(f: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """A function of a group that gives its memory back after each large one."""

    def run(key, table):
        made = f(key, table)
        if table.nbytes > 1_000_000:
            del table
            release()
        return made

    return run


def tidy_both(f: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups of one key."""

    def run(key, left, right):
        made = f(key, left, right)
        if left.nbytes + right.nbytes > 1_000_000:
            del left, right
            release()
        return made

    return run


def tidy_batches(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for a function of a task's batches."""

    def run(batches):
        yield from f(batches)
        release()

    return run


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts, counted over all documents."""
    return int(docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0)


def chunks_for(total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, -(-total_bytes // chunk_bytes))


def pack(docs: DataFrame, n_chunks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(home, ids, lengths, texts): rows of packed documents; all rows of one home make a chunk.

    The home is a hash of id and text, so that rows without id, or of one id, don't meet in one chunk. Equal rows do; their texts compress to one.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
            home = batch.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(home, kind="stable")
            data, at = buffer(batch.column(1).take(pa.array(order)))
            edges = np.flatnonzero(np.r_[True, np.diff(home[order]) != 0, True])
            sizes = np.diff(at)
            rows = [(int(home[order[a]]), ids[order[a:b]].tobytes(), sizes[a:b].astype(np.int64).tobytes(), press.compress(data[at[a] : at[b]].tobytes())) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["home", "ids", "lengths", "texts"])

    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    home = F.pmod(F.xxhash64(key, text), F.lit(n_chunks)).cast("int")
    return docs.select(key.alias("id"), text.alias("text"), home.alias("home")).mapInArrow(tidy_batches(packed), "home int, ids binary, lengths binary, texts binary")


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a chunk's documents, by id, then length, then text: the same order in each round."""
    loose = zstandard.ZstdDecompressor()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("ids")])
    sizes = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("lengths")])
    parts = []
    for lengths, text in zip(table.column("lengths"), table.column("texts"), strict=True):
        whole = int(np.frombuffer(lengths.as_py(), np.int64).sum())
        parts.append(np.frombuffer(loose.decompress(text.as_py(), max_output_size=max(1, whole)), np.uint8) if whole else np.zeros(0, np.uint8))
    data = np.concatenate(parts)
    at = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.zeros(len(ids), np.uint64)
    twice = np.flatnonzero(np.isin(ids, ids[np.flatnonzero(np.diff(np.sort(ids)) == 0)] if len(ids) < 2 else np.sort(ids)[1:][np.diff(np.sort(ids)) == 0]))
    for i in twice:  # only where an id repeats does the text decide
        codes[i] = spans_hash(data[at[i] : at[i + 1]], np.array([0]), np.array([sizes[i]]))[0]
    order = np.lexsort((codes, sizes, ids))
    new_at = np.concatenate(([0], np.cumsum(sizes[order])))
    out = np.empty(len(data), np.uint8)
    for k, i in enumerate(order):
        out[new_at[k] : new_at[k + 1]] = data[at[i] : at[i + 1]]
    return ids[order], out, new_at


def id_array(ids: np.ndarray) -> pa.Array:
    """Ids for a result, with null in place of NO_ID."""
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)
