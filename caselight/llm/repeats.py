"""Exact repeats of a fixed width across documents, in four rounds over chunks of documents.

A window is `width` consecutive units (words or bytes) of one document. Each window has an anchor: the gram of `gram`
units within it whose hash is smallest. Equal windows have equal anchors, so it is enough to compare windows that share
an anchor, and an anchor that one document alone holds needs no more work:

1. each chunk sends the distinct anchors of its documents, as 4-byte codes, to buckets of the code's prefix;
2. each bucket names to each chunk the anchors that some other document holds too (a clash of codes only adds work), and
   splits itself into groups by longer prefixes until a group's share fits in memory;
3. each chunk sends the stretch of text around such an anchor that its windows cover, each distinct stretch once, with its
   places in the chunk's smallest document that has it; in the chunk's later documents it repeats that one, whatever others say;
4. each group compares whole stretches and replies which windows also start in a document with a smaller id.

Then each chunk removes what those windows cover. Nothing is capped. An equal stretch costs one entry a chunk, however many
documents have it. An anchor with more than HOT occurrences (a line that stands in ever other surroundings) is no prefix
that fits in memory: there the prefix is the whole window, so its windows spread over groups by their own hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks
from .words import blocks, byte_windows_hash, minimizers, mix, spans_hash, windows_hash, word_bounds

#: Chunk entries that a group of round 4 gets at most, unless one anchor alone has more.
GROUP_ENTRIES = 60_000
#: Text bytes whose anchors meet in one bucket, on average; at least MIN_BUCKETS buckets.
BUCKET_BYTES, MIN_BUCKETS = 256_000_000, 64

#: Occurrences of an anchor beyond which its windows go one by one.
HOT = 50_000
#: Groups of hot windows are numbered from here; a chunk's messages to itself have numbers below 0.
HOT_PARTS = 1 << 62
#: Mixed into the units for the second half of a window's digest.
SALT = np.uint64(0x5851F42D4C957F2D)

#: Given stretches (arrays of units), the anchor of each and the smallest document of each: for each stretch and window, is it also in a document smaller than its own?
Decide = Callable[[list[np.ndarray], np.ndarray, np.ndarray, int], list[np.ndarray]]


def _anchored(data: np.ndarray, offsets: np.ndarray, by_word: bool, width: int, gram: int) -> Iterator[tuple]:
    """For each block of documents: first document, units, their document offsets, and of each anchor hash, document, first and last window."""
    for first, _, raw, at in blocks(data, offsets):
        if by_word:
            starts, ends, at = word_bounds(raw, at)
            units = spans_hash(raw, starts, ends)
            grams = windows_hash(units, gram)
        else:
            units, grams = raw, byte_windows_hash(raw, gram)
        chosen, of = minimizers(grams, width - gram + 1)
        if not len(of):
            continue
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(of)]
        whole = np.flatnonzero(np.arange(len(of)) + width <= at[doc + 1])  # windows within one document
        if not len(whole):
            continue
        # Windows that share an anchor place and a document are one run.
        key = of[whole]
        new = np.ones(len(whole), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[whole][1:] != doc[whole][:-1])
        begin = np.flatnonzero(new)
        low, high = whole[begin], whole[np.append(begin[1:], len(whole)) - 1]
        yield first, units, at, mix(grams[chosen[key[begin]]]), doc[low], low, high  # anew, as smallest hashes crowd at low values


def _split(values: np.ndarray, order_by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Indices for each distinct value of order_by."""
    if not len(values):
        return
    order = np.argsort(order_by, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(order_by[order]) != 0, True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(order_by[order[a]]), values[order[a:b]]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ASKED = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("alone", pa.binary()), ("several", pa.binary()), ("counts", pa.binary())])
_NAMED = pa.schema([("home", pa.int32()), ("bucket", pa.int32()), ("bits", pa.int32()), ("hot_bits", pa.int32()), ("codes", pa.binary()), ("hot", pa.binary())])
_SENT = pa.schema([("part", pa.int64()), ("home", pa.int32()), *((x, pa.binary()) for x in ("units", "lengths", "anchors", "docs", "times", "where_doc", "where_at"))])
_FOUND = pa.schema([("home", pa.int32()), ("doc", pa.binary()), ("at", pa.binary()), ("windows", pa.binary())])


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def find_repeats(packed: DataFrame, total_bytes: int, decide: Decide, by_word: bool, width: int, gram: int, hot: int = HOT) -> DataFrame:
    """(home, doc, at, windows): for documents of packed chunks, places `at` and a bit for each window from there on that repeats a smaller document."""
    if not 0 < gram <= width < gram + 63:
        raise ValueError("a window needs 1 to 63 places for its anchor")
    buckets = MIN_BUCKETS
    while buckets * BUCKET_BYTES < total_bytes:
        buckets *= 2
    top = buckets.bit_length() - 1
    unit = np.uint64 if by_word else np.uint8

    def codes_of(grams: np.ndarray) -> np.ndarray:
        return grams >> np.uint64(32 - top)  # the bucket's bits and 32 more

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        ids, data, at = chunks.unpack(table)
        held, docs = [], []
        for first, _, _, grams, doc, _, _ in _anchored(data, at, by_word, width, gram):
            held.append(codes_of(grams))
            docs.append(ids[doc + first])
        if not held:
            return _table([], _ASKED)
        codes, docs = np.concatenate(held), np.concatenate(docs)
        order = np.argsort(codes, kind="stable")
        codes, docs = codes[order], docs[order]
        begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        several = np.minimum.reduceat(docs, begin) != np.maximum.reduceat(docs, begin)
        counts = np.diff(np.append(begin, len(codes))).astype(np.uint32)
        codes = codes[begin]
        edges = np.searchsorted(codes >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        low = codes.astype(np.uint32)
        return _table([(b, key[0].as_py(), low[i:j][~several[i:j]].tobytes(), low[i:j][several[i:j]].tobytes(), counts[i:j][several[i:j]].tobytes()) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i], _ASKED)

    def name(key: tuple, table: pa.Table) -> pa.Table:
        alone, several, counts = ([np.frombuffer(x.as_py(), np.uint32) for x in table.column(c)] for c in ("alone", "several", "counts"))
        every, of, times = np.unique(np.concatenate(alone + several), return_inverse=True, return_counts=True)
        total = np.bincount(of, np.concatenate([*(np.ones(len(x)) for x in alone), *counts]), len(every))
        sure = np.unique(np.concatenate(several)) if several else every[:0]
        shared = (times > 1) | np.isin(every, sure)
        is_hot = shared & (total > hot)
        groups = lambda entries: max(0, int(np.ceil(np.log2(max(1.0, entries) / GROUP_ENTRIES))))
        bits, hot_bits = groups(total[shared & ~is_hot].sum()), groups(total[is_hot].sum() * (width - gram + 1))
        every, hot_codes = every[shared], every[is_hot]
        rows = []
        for home, a, s in zip(table.column("home").to_pylist(), alone, several, strict=True):
            both = np.concatenate((a[np.isin(a, every, assume_unique=True)], s))
            if len(both):
                rows.append((home, key[0].as_py(), bits, hot_bits, both.tobytes(), both[np.isin(both, hot_codes)].tobytes()))
        return _table(rows, _NAMED)

    def send(key: tuple, texts: pa.Table, named: pa.Table) -> pa.Table:
        if not named.num_rows or not texts.num_rows:
            return _table([], _SENT)
        ids, data, at = chunks.unpack(texts)
        bits, hot_bits = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        wanted, hot_codes = [], []
        for bucket, n, m, codes, often in zip(*(named.column(c).to_pylist() for c in ("bucket", "bits", "hot_bits", "codes", "hot")), strict=True):
            bits[bucket], hot_bits[bucket] = n, m
            wanted.append(np.frombuffer(codes, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            hot_codes.append(np.frombuffer(often, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
        wanted, hot_codes = np.sort(np.concatenate(wanted)), np.concatenate(hot_codes)
        stretches: list[bytes] = []
        anchors, docs, places = [], [], []
        for first, units, unit_at, grams, doc, low, high in _anchored(data, at, by_word, width, gram):
            codes = codes_of(grams)
            place = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
            use = np.flatnonzero(wanted[place] == codes)
            raw, size = units.tobytes(), units.itemsize
            stretches += [raw[a:b] for a, b in zip((low[use] * size).tolist(), ((high[use] + width) * size).tolist(), strict=True)]
            anchors.append(codes[use])
            docs.append(doc[use] + first)
            places.append(low[use] - unit_at[doc[use]])
        if not stretches:
            return _table([], _SENT)
        anchors, docs, places = np.concatenate(anchors), np.concatenate(docs), np.concatenate(places)
        which, distinct = pd.factorize(np.array(stretches, object))
        del stretches
        home = key[0].as_py()
        order = np.lexsort((places, docs, which))  # documents are in order of their ids
        begin = np.flatnonzero(np.r_[True, np.diff(which[order]) != 0])
        sizes = np.array([len(x) for x in distinct], np.int64) // np.dtype(unit).itemsize - width + 1  # windows of each distinct stretch
        anchor = anchors[order[begin]]
        often = np.isin(anchor, hot_codes)
        rows, later = [], []  # later: document, place and number of windows of what repeats the chunk's own smallest document
        smallest, times, first_of, first_at = _firsts(ids, docs[order], places[order], begin, sizes[which[order]], ~often, later)
        shift = bits[(anchor >> np.uint64(32)).astype(np.int64)]
        part = ((anchor >> np.uint64(32)) << np.uint64(32) | ((anchor & np.uint64(0xFFFFFFFF)) >> (32 - shift).astype(np.uint64))).astype(np.int64)
        some = np.flatnonzero(~often)
        for p, mine in _split(some, part[some]):
            took = _ranges(first_of[mine], times[mine])
            texts_of = [distinct[which[order[begin[i]]]] for i in mine]
            rows.append((p, home, b"".join(texts_of), np.array([len(x) for x in texts_of], np.uint32).tobytes(), anchor[mine].tobytes(), smallest[mine].tobytes(), times[mine].astype(np.uint32).tobytes(), docs[order][took].astype(np.uint32).tobytes(), first_at[took].astype(np.uint32).tobytes()))
        if often.any():
            # Each window of a hot anchor by itself: digest, document, place.
            n = sizes[which[order[begin]]]
            whole = np.frombuffer(b"".join(distinct[which[order[begin[i]]]] for i in np.flatnonzero(often)), unit).astype(np.uint64)
            starts = np.cumsum(n[often] + width - 1) - (n[often] + width - 1)
            inside = _ranges(starts, n[often])  # windows that lie within one stretch
            one, two = windows_hash(mix(whole), width)[inside], windows_hash(mix(whole ^ SALT), width)[inside]
            window_of = np.cumsum(n[often]) - n[often]  # first window of each hot stretch
            stretch = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
            mine = np.flatnonzero(often[stretch])
            rank = np.cumsum(often) - 1
            count = n[stretch[mine]]
            w = _ranges(window_of[rank[stretch[mine]]], count)
            doc_of, place_of = np.repeat(docs[order][mine], count), _ranges(places[order][mine], count)
            bucket = np.repeat(anchor[stretch[mine]] >> np.uint64(32), count).astype(np.int64)
            by = np.lexsort((place_of, doc_of, two[w], one[w]))
            w, doc_of, place_of, bucket = w[by], doc_of[by], place_of[by], bucket[by]
            edge = np.flatnonzero(np.r_[True, (one[w][1:] != one[w][:-1]) | (two[w][1:] != two[w][:-1])])
            least, times, first_of, first_at = _firsts(ids, doc_of, place_of, edge, np.ones(len(w), np.int64), np.ones(len(edge), bool), later)
            digest = np.stack((one[w][edge], two[w][edge]), axis=1)
            bucket = bucket[edge]
            group = HOT_PARTS | bucket << 32 | (digest[:, 0] >> np.uint64(32) >> (32 - hot_bits[bucket]).astype(np.uint64)).astype(np.int64)
            for p, mine in _split(np.arange(len(edge)), group):
                took = _ranges(first_of[mine], times[mine])
                rows.append((p, home, digest[mine].tobytes(), b"", b"", least[mine].tobytes(), times[mine].astype(np.uint32).tobytes(), doc_of[took].astype(np.uint32).tobytes(), first_at[took].astype(np.uint32).tobytes()))
        if later:
            d, at_, n = (np.concatenate(x) for x in zip(*later, strict=True))
            rows.append((-1 - home, home, n.astype(np.uint8).tobytes(), b"", b"", b"", b"", d.astype(np.uint32).tobytes(), at_.astype(np.uint32).tobytes()))
        return _table(rows, _SENT)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        joined = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])
        if part < 0:
            full = np.array([(1 << n) - 1 for n in range(64)], np.uint64)
            return _table([(h, d, a, full[np.frombuffer(n, np.uint8)].tobytes()) for h, d, a, n in zip(*(table.column(c).to_pylist() for c in ("home", "where_doc", "where_at", "units")), strict=True)], _FOUND)
        docs, times, where_doc, where_at = joined("docs", np.int64), joined("times", np.uint32).astype(np.int64), joined("where_doc", np.uint32), joined("where_at", np.uint32)
        homes = np.repeat(np.array(table.column("home").to_pylist(), np.int64), [len(x.as_py()) // 4 for x in table.column("where_doc")])
        entry = np.repeat(np.arange(len(times)), times)
        if part >= HOT_PARTS:
            which = np.unique(joined("units", np.uint64).view("V16"), return_inverse=True)[1]
            least = np.full(which.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, which, docs)
            hit = np.flatnonzero((docs > least[which])[entry])
            return _table([(h, where_doc[i].tobytes(), where_at[i].tobytes(), np.ones(len(i), np.uint64).tobytes()) for h, i in _split(hit, homes[hit])], _FOUND)
        texts: list[bytes] = []
        for raw, lengths in zip(table.column("units"), table.column("lengths"), strict=True):
            raw, ends = raw.as_py(), np.cumsum(np.frombuffer(lengths.as_py(), np.uint32).astype(np.int64)).tolist()
            texts += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        anchors = joined("anchors", np.uint64)
        which, distinct = pd.factorize(np.array(texts, object))
        smallest = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(smallest, which, docs)
        anchor = np.zeros(len(distinct), np.uint64)
        anchor[which] = anchors
        one = np.zeros(len(distinct), bool)  # the only stretch of its anchor: nothing to compare
        _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
        one[:] = size[group] == 1
        own = np.zeros(len(distinct), np.uint64)  # windows of a stretch's first document that repeat a smaller one
        todo = np.flatnonzero(~one)
        if len(todo):
            units = [np.frombuffer(distinct[i], unit) for i in todo]
            hits = decide(units, group[todo], smallest[todo], width)
            sizes = np.array([len(x) for x in hits])  # one at least: a stretch holds a window
            bits = np.concatenate(hits).astype(np.uint64) << _ranges(np.zeros(len(sizes), np.int64), sizes).astype(np.uint64)
            own[todo] = np.bitwise_or.reduceat(bits, np.cumsum(sizes) - sizes)
        windows = np.array([len(x) for x in distinct], np.int64) // np.dtype(unit).itemsize - width + 1
        every = np.array([(1 << int(n)) - 1 for n in windows], np.uint64)
        # A stretch has its own windows, or all if a smaller document has the whole stretch.
        mask = np.where((docs > smallest[which])[entry], every[which][entry], own[which][entry])
        hit = np.flatnonzero(mask)
        return _table([(h, where_doc[i].tobytes(), where_at[i].tobytes(), mask[i].tobytes()) for h, i in _split(hit, homes[hit])], _FOUND)

    tidy, tidy_both = chunks.tidy, chunks.tidy_both
    asked = packed.groupBy("home").applyInArrow(tidy(ask), _sql(_ASKED))
    named = asked.groupBy("bucket").applyInArrow(name, _sql(_NAMED))
    sent = packed.groupBy("home").cogroup(named.groupBy("home")).applyInArrow(tidy_both(send), _sql(_SENT))
    return sent.groupBy("part").applyInArrow(compare, _sql(_FOUND))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] ... start[0] + size[0] - 1, start[1] ... and so on."""
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(int(size.sum()))


def _firsts(ids: np.ndarray, docs: np.ndarray, places: np.ndarray, begin: np.ndarray, windows: np.ndarray, wanted: np.ndarray, later: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of equal content that begin at `begin`, in order of document: the smallest id, how many places are in documents of that id, the first of them, and all places.

    What else wanted runs have goes to `later`: document, place and windows.
    """
    run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(docs))))
    smallest = ids[docs[begin]]
    after = ids[docs] > smallest[run]
    gone = np.flatnonzero(after & wanted[run])
    if len(gone):
        later.append((docs[gone], places[gone], windows[gone]))
    return smallest, np.bincount(run[~after], minlength=len(begin)), begin, places


def covered(table: pa.Table, unit_at: np.ndarray, width: int) -> np.ndarray:
    """For each unit of a chunk, whether a found window covers it; unit_at: the documents' offsets in units."""
    begins = np.zeros(int(unit_at[-1]), bool)
    if table.num_rows:
        doc, at, mask = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)]) for name, kind in (("doc", np.uint32), ("at", np.uint32), ("windows", np.uint64)))
        start = unit_at[doc.astype(np.int64)] + at
        for j in range(64):
            begins[start[(mask >> np.uint64(j)) & np.uint64(1) == 1] + j] = True
    until = np.cumsum(begins, dtype=np.int32)  # windows that begin up to here; those that began `width` before are over
    until[width:] -= until[:-width].copy()
    return until > 0


def remove_repeats(docs: DataFrame, decide: Decide, by_word: bool, width: int, gram: int, id_col: str, text_col: str, apply: Callable, schema: pa.Schema, sql: str, chunk_bytes: int, hot: int = HOT) -> DataFrame:
    """Finds repeats and lets `apply(ids, data, offsets, found)` make each chunk's rows."""
    total = chunks.text_bytes(docs, text_col)
    packed = chunks.pack(docs, chunks.chunks_for(total, chunk_bytes), id_col, text_col)
    found = find_repeats(packed, total, decide, by_word, width, gram, hot)

    def settle(key: tuple, texts: pa.Table, hits: pa.Table) -> pa.Table:
        return apply(*chunks.unpack(texts), hits) if texts.num_rows else schema.empty_table()

    return packed.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(chunks.tidy_both(settle), sql)
