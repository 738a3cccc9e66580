"""Removal of byte strings that an earlier document has, by a run-length compressed Burrows-Wheeler index.

Of the stretches that share an anchor (see `repeats`), those of the smallest document are indexed: their transform is
kept as runs, with samples of the suffix array at the ends of runs only. The other stretches stream through the index
from right to left, which gives their matching statistics; a place whose longest match has `width` bytes or more repeats
the indexed document. What is left goes round again with its own smallest documents, until nothing is left to compare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks
from .repeats import HOT, _ranges, covered, remove_repeats
from .suffix_arrays import KEY_BYTES, byte_keys, joined, suffix_array

#: Rounds of index and stream; stretches that are left then (many variants of one anchor) are settled in one sort.
ROUNDS = 6
#: The smallest differences of two keys whose last byte alone differs, whose last two do, and so on.
_FROM = np.left_shift(1, 9 * np.arange(KEY_BYTES, dtype=np.int64))


class RunLengthIndex:
    """Runs of the transform of some stretches, with the suffix array at the first and last row of each run."""

    def __init__(self, parts: list[np.ndarray]):
        text, ends = joined(parts)
        order, _ = suffix_array(text, ends)
        self.next_bytes, self.end_of = byte_keys(text, ends)[0], np.repeat(ends, np.diff(ends, prepend=-1))
        units = text.astype(np.int16)
        units[ends] = -1
        heads = units[order - 1]
        heads[order == 0] = -1
        self.start = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
        self.head = heads[self.start].astype(np.int64)
        size = np.diff(np.append(self.start, len(order)))
        self.run_of = np.repeat(np.arange(len(size), dtype=np.int32), size)  # a row's run, in place of a search for each step
        # Sampled run ends: where in the text the rows point to.
        self.first_at, self.last_at = order[self.start], order[np.append(self.start[1:], len(order)) - 1]
        self.last = self.start + size - 1
        # Where the step to the left leads from each run's first row.
        by_head = np.argsort(self.head, kind="stable")
        to = np.empty(len(size), np.int64)
        to[by_head] = np.cumsum(size[by_head]) - size[by_head]
        self.step = to - self.start  # what it adds to any row of the run
        self.by_head = by_head
        self.keys = self.head[by_head] * (len(size) + 1) + by_head

    def matching_statistics(self, parts: list[np.ndarray], limit: int) -> list[np.ndarray]:
        """For each place of each stretch, the length (up to `limit`) of the longest indexed match that begins there."""
        sizes = np.array([len(x) for x in parts])
        return np.split(self.lengths(np.concatenate(parts), sizes, limit), np.cumsum(sizes)[:-1])

    def lengths(self, text: np.ndarray, sizes: np.ndarray, limit: int, least: int = 0) -> np.ndarray:
        """The same for stretches that stand end to end. A stretch whose match can't reach `least` bytes any more, were all that is left of it to match, is left there, with zeros."""
        out = np.zeros(len(text), np.int16)
        at, left = np.cumsum(sizes)[sizes > 0] - 1, sizes[sizes > 0]  # the place where a stretch is, right to left, and how many are left with it
        row, place, length = np.zeros(len(at), np.int64), np.full(len(at), self.first_at[0], np.int64), np.zeros(len(at), np.int64)
        n_runs = len(self.start)
        while len(at):
            c = text[at].astype(np.int64)
            run = self.run_of[row].astype(np.int64)
            miss = np.flatnonzero(self.head[run] != c)
            if len(miss):
                # Nearest runs of this byte above and below; the one whose suffix shares more with the match so far goes on.
                of = c[miss]
                j = np.searchsorted(self.keys, of * (n_runs + 1) + run[miss])
                below, above = self.by_head[np.minimum(j, n_runs - 1)], self.by_head[np.maximum(j - 1, 0)]
                had, now = np.minimum(length[miss], limit), place[miss]
                a, b = np.full(len(miss), -1), np.full(len(miss), -1)
                some = np.flatnonzero((j > 0) & (self.head[above] == of))
                a[some] = self._common(self.last_at[above[some]], now[some], had[some])
                some = np.flatnonzero((a < had) & (j < n_runs) & (self.head[below] == of))
                b[some] = self._common(self.first_at[below[some]], now[some], had[some])
                up = a >= b
                run[miss] = np.where(up, above, below)
                row[miss] = np.where(up, self.last[above], self.start[below])
                place[miss] = np.where(up, self.last_at[above], self.first_at[below])
                length[miss] = np.maximum(a, b)
            row += self.step[run]
            place -= 1
            length += 1
            if len(miss):
                none = miss[length[miss] == 0]  # the byte isn't indexed
                row[none], place[none] = 0, self.first_at[0]
            out[at] = np.minimum(length, limit)
            at -= 1
            left -= 1
            stay = (left > 0) & (length + left >= least)
            if not stay.all():
                at, left, row, place, length = (x[stay] for x in (at, left, row, place, length))
        return out

    def _common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the indexed suffixes at x and y, up to `most`."""
        most = np.minimum(most, self.end_of[x] - x)  # end marks match nothing
        got = np.zeros(len(x), np.int64)
        going = np.flatnonzero(most > 0)
        while len(going):
            at = got[going]
            same = KEY_BYTES - np.searchsorted(_FROM, self.next_bytes[x[going] + at] ^ self.next_bytes[y[going] + at], "right")
            got[going] = at + same
            going = going[(same == KEY_BYTES) & (got[going] < most[going])]
        return np.minimum(got, most)


def long_matches(parts: list[np.ndarray], anchors: np.ndarray, docs: np.ndarray, width: int) -> list[np.ndarray]:
    """For each stretch and each of its windows: does a stretch of the same anchor in a smaller document have the window?"""
    sizes = np.array([len(x) for x in parts])
    text, at, windows = np.concatenate(parts), np.cumsum(sizes) - sizes, np.maximum(0, sizes - width + 1)
    hit = np.zeros(len(text), bool)  # by the place where a window begins
    hits = [hit[a : a + n] for a, n in zip(at.tolist(), windows.tolist(), strict=True)]
    left = np.arange(len(parts))
    for _ in range(ROUNDS):
        group = np.unique(anchors[left], return_inverse=True)[1]
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, docs[left])
        known = docs[left] == least[group]
        several = np.bincount(group[~known], minlength=len(least)) > 0  # anchors with something to stream
        stream = left[~known]
        if not len(stream):
            return hits
        index = RunLengthIndex([parts[i] for i in left[known & several[group]]])
        places = _ranges(at[stream], sizes[stream])
        hit[places] |= index.lengths(text[places], sizes[stream], width, width) >= width
        known_windows = np.bincount(np.repeat(np.arange(len(stream)), sizes[stream])[hit[places]], minlength=len(stream))
        left = stream[known_windows < windows[stream]]
        if not len(left):
            return hits
    seen: dict[tuple[int, bytes], int] = {}
    for i in left[np.argsort(docs[left], kind="stable")].tolist():
        raw = parts[i].tobytes()
        for j in range(len(hits[i])):
            hits[i][j] |= seen.setdefault((int(anchors[i]), raw[j : j + width]), docs[i]) < docs[i]
    return hits


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 24, chunk_bytes: int = chunks.CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """One row for each input row: id_col, n_bytes, n_removed, n_spans, kept (binary: it may cut a character).

    A byte goes if a string of `width` bytes that covers it also starts in a document with a smaller id; strings are
    judged on the input. n_spans counts maximal removed runs. A null text is empty; a null id comes after all ids, and
    rows of one id are one document for the judgement but keep a row each. Other columns are not read.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def apply(ids: np.ndarray, data: np.ndarray, at: np.ndarray, found: pa.Table) -> pa.Table:
        gone = covered(found, at, width)
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[at])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        firsts = at[:-1][np.diff(at) > 0]
        begins[firsts] = gone[firsts]
        spans = np.diff(np.concatenate(([0], np.cumsum(begins)))[at])
        kept_at = np.concatenate(([0], np.cumsum(np.diff(at) - removed)))
        raw = data[~gone].tobytes()
        kept = [raw[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)]
        return pa.Table.from_arrays([chunks.id_array(ids), pa.array(np.diff(at)), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], schema=schema)

    out = remove_repeats(docs, long_matches, False, width, gram, id_col, text_col, apply, schema, "id long, n_bytes long, n_removed long, n_spans long, kept binary", chunk_bytes, hot)
    return out.withColumnRenamed("id", id_col)
