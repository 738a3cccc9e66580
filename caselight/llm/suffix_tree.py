"""Removal of word sequences that an earlier document has, by prefix-partitioned suffix trees.

The suffixes to compare are split by variable-length prefixes (of their anchor's hash; see `repeats`) into groups that
fit in memory. A group builds one suffix tree as a suffix array with the intervals of equal leading words: each interval
of depth `width` or more is a deep internal node, thus a maximal repeat, and its smallest document keeps the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks
from .repeats import HOT, covered, remove_repeats
from .suffix_arrays import joined, suffix_array
from .words import blocks, word_bounds


def deep_nodes(parts: list[np.ndarray], anchors: np.ndarray, docs: np.ndarray, width: int) -> list[np.ndarray]:
    """For each stretch of units and each of its windows: does a node of depth `width` above it have a leaf of a smaller document?"""
    del anchors
    whole, ends = joined(parts)
    half = 1 << (width.bit_length() - 1)  # two overlapping runs of `half` units make a window
    order, ranks = suffix_array(whole, ends, (half,))
    rank = ranks[half]
    n = len(whole)
    stretch = np.searchsorted(ends, np.arange(n))
    deep = order[np.flatnonzero(ends[stretch[order]] - order >= width)]  # suffixes of `width` units at least, in order
    last = rank[deep + width - half]
    node = np.cumsum(np.r_[True, (rank[deep][1:] != rank[deep][:-1]) | (last[1:] != last[:-1])]) - 1
    begin = np.flatnonzero(np.r_[True, np.diff(node) > 0]) if len(deep) else deep
    least = np.minimum.reduceat(docs[stretch[deep]], begin) if len(deep) else deep
    hit = np.zeros(n, bool)
    hit[deep] = least[node] < docs[stretch[deep]]
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [hit[a : max(a, b - width + 1)] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, gram: int = 5, chunk_bytes: int = chunks.CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """One row for each input row: id_col, n_words, n_removed, kept_text.

    Words are runs without ASCII white space. A word goes if a window of `width` words that covers it also starts in a
    document with a smaller id; windows are judged on the input. kept_text has the other words, joined by one space.
    A null text has no words; a null id comes after all ids, and rows of one id are one document for the judgement but
    keep a row each. Other columns are not read.
    """
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def apply(ids: np.ndarray, data: np.ndarray, at: np.ndarray, found: pa.Table) -> pa.Table:
        counts = np.concatenate([np.diff(word_bounds(raw, o)[2]) for _, _, raw, o in blocks(data, at)])
        unit_at = np.concatenate(([0], np.cumsum(counts)))
        gone = covered(found, unit_at, width)
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[unit_at])
        raw, texts = data.tobytes(), []
        for i in range(len(ids)):
            words = raw[at[i] : at[i + 1]].split()
            if removed[i]:
                words = [w for w, x in zip(words, gone[unit_at[i] : unit_at[i + 1]].tolist(), strict=True) if not x]
            texts.append(b" ".join(words))
        return pa.Table.from_arrays([chunks.id_array(ids), pa.array(counts), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    out = remove_repeats(docs, deep_nodes, True, width, gram, id_col, text_col, apply, schema, "id long, n_words long, n_removed long, kept_text string", chunk_bytes, hot)
    return out.withColumnRenamed("id", id_col)


