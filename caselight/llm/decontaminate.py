"""Benchmark decontamination: rare n-gram seeds join texts to test items, then Smith-Waterman alignment scores the copies.

An alignment that scores enough has few edits, so for each n it holds a known least number of the item's n-grams, one word
after another. All but that number of an item's n-grams, and one more, are its seeds: every such alignment holds one of
them. Which n-grams are left out is free, so the most frequent ones are, counted over all texts, and of the possible n an
item takes the one with the rarest seeds. A stretch of text around a seed that has enough of the item's words is aligned
with the item word by word. So nothing that scores enough is missed, however often an item or a gram occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import tidy_batches
from .toxicity import _lower
from .words import blocks, buffer, spans_hash, windows_hash

#: Words of the seeds that an item can have.
GRAMS = (1, 2, 3, 4, 5)
#: Words of the shortest item that is looked for by default: a shorter one tells no copy from chance.
LEAST_WORDS = 5
#: Words of the items that are looked for in one pass, on average; more items make more passes.
MOST_WORDS = 1_000_000


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words (runs of letters and digits, A-Z in lower case), and the documents' offsets in them."""
    data = _lower(data)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return spans_hash(data, starts, ends), np.searchsorted(starts, offsets)


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its text: score (2 a match, -1 a mismatch or gap), first and end word in the text.

    All pairs go together, cell by anti-diagonal.
    """
    m, n = max(map(len, items)), max(map(len, texts))
    a, b = np.zeros((len(items), m), np.uint64), np.ones((len(texts), n), np.uint64)
    for k, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    rows = np.arange(1, m + 1)
    valid_a = rows[None, :] <= np.array([len(x) for x in items])[:, None]
    sizes = np.array([len(y) for y in texts])[:, None]
    shape = (len(items), m + 1)
    last, before = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    last_from, before_from = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    best, first, end = (np.zeros(len(items), np.int32) for _ in range(3))
    for d in range(2, m + n + 1):  # row i, column j = d - i, both from 1
        j = d - rows
        ok = (j >= 1) & (j <= n)
        same = np.zeros((len(items), m), bool)
        cols = np.clip(j - 1, 0, n - 1)
        same[:, ok] = (a[:, ok] == b[:, cols[ok]]) & valid_a[:, ok] & (j[ok][None, :] <= sizes)
        diagonal = before[:, :-1] + np.where(same, 2, -1)
        up, left = last[:, :-1] - 1, last[:, 1:] - 1
        now, now_from = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        h = np.maximum(np.maximum(diagonal, up), np.maximum(left, 0))
        origin = np.where(h == diagonal, np.where(before[:, :-1] > 0, before_from[:, :-1], (j - 1)[None, :]), np.where(h == up, last_from[:, :-1], last_from[:, 1:]))
        h[:, ~ok] = 0
        now[:, 1:], now_from[:, 1:] = h, origin
        top = h.argmax(axis=1)
        value = h[np.arange(len(items)), top]
        better = value > best
        best[better], first[better], end[better] = value[better], origin[np.arange(len(items)), top][better], (d - rows[top])[better]
        before, before_from, last, last_from = last, last_from, now, now_from
    return best, first, end


def guaranteed(m: int, least: float, n: int) -> int:
    """n-grams of an item of m words that every alignment with a share `least` of the full score holds, at least.

    With M matched words and E mismatches and gaps the score is 2 M - E, so E is at most 2 M - 2 m least. The matches
    form E + 1 runs at most, and a run loses n - 1 of its words as starts of n-grams.
    """
    counts = [k - (int(np.floor(2 * k - 2 * m * least + 1e-9)) + 1) * (n - 1) if n > 1 else k for k in range(int(np.ceil(m * least - 1e-9)), m + 1)]
    return max(0, min(counts))


def most_edits(m: int, least: float) -> int:
    """Mismatches and gaps of an alignment that scores enough, at most."""
    return int(np.floor(2 * m * (1 - least) + 1e-9))


@dataclass
class Lookup:
    """Distinct n-grams of the items for one n, sorted, and the (item, place) of each occurrence, in the same order."""

    n: int
    grams: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray = field(repr=False)

    @staticmethod
    def of(n: int, grams: np.ndarray, item: np.ndarray, place: np.ndarray) -> Lookup:
        order = np.lexsort((place, item, grams))
        grams, item, place = grams[order], item[order], place[order]
        distinct, begin = np.unique(grams, return_index=True)
        bits = np.zeros(1 << 22, bool)
        bits[(distinct >> np.uint64(42)).astype(np.int64)] = True
        return Lookup(n, distinct, np.append(begin, len(grams)), item, place, bits)

    def hits(self, tokens: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word within all tokens, and number of the gram of each occurrence within one document."""
        found = windows_hash(tokens, self.n)
        may = np.flatnonzero(self.bits[(found >> np.uint64(42)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.grams, found[may]), len(self.grams) - 1)
        ok = self.grams[spot] == found[may] if len(self.grams) else np.zeros(0, bool)
        may, spot = may[ok], spot[ok]
        doc = np.searchsorted(word_at, may, "right") - 1
        ok = may + self.n <= word_at[doc + 1]
        return doc[ok], may[ok], spot[ok]


def _occurrences(words: list[np.ndarray], n: int, which: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, item and place of the n-grams of some items."""
    grams = [windows_hash(words[i], n) for i in which]
    empty = np.zeros(0, np.int64)
    item = np.repeat(np.array(which, np.int64), [len(g) for g in grams]) if which else empty
    place = np.concatenate([np.arange(len(g)) for g in grams]) if which else empty
    return (np.concatenate(grams) if which else np.zeros(0, np.uint64)), item, place


def _counts(source: DataFrame, lookups: list[Lookup]) -> list[np.ndarray]:
    """How often each gram occurs in all texts: partial sums in each task, one number for each gram at the driver."""
    first = np.cumsum([0, *(len(x.grams) for x in lookups)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(first[-1], np.int64)
        for batch in batches:
            for _, _, part, o in blocks(*buffer(batch.column(1))):
                tokens, word_at = _tokens(part, o)
                for k, lookup in enumerate(lookups):
                    _, _, spot = lookup.hits(tokens, word_at)
                    sums[first[k] : first[k + 1]] += np.bincount(spot, minlength=len(lookup.grams))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["gram", "times"])

    sums = np.zeros(first[-1], np.int64)
    rows = source.mapInArrow(tidy_batches(count), "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")).toPandas()
    sums[rows["gram"].to_numpy(np.int64)] = rows["times"].to_numpy(np.int64)
    return [sums[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def seeds(words: list[np.ndarray], least: float, counts: dict[int, tuple[Lookup, np.ndarray]]) -> list[Lookup]:
    """Of each item the seeds of the n for which they occur least often, by n."""
    best: dict[int, tuple[int, int, np.ndarray]] = {}
    for n, (lookup, times) in counts.items():
        at = np.repeat(np.arange(len(lookup.grams)), np.diff(lookup.begin))  # gram of each occurrence
        order = np.lexsort((lookup.place, lookup.item))
        edges = np.flatnonzero(np.r_[True, np.diff(lookup.item[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
        for mine in (order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)):
            i = int(lookup.item[mine[0]])
            often = times[at[mine]]
            picked = mine[np.argsort(often, kind="stable")[: len(mine) - guaranteed(len(words[i]), least, n) + 1]]
            total = int(times[at[picked]].sum())
            if i not in best or total < best[i][0]:
                best[i] = (total, n, picked)
    made = []
    for n, (lookup, _) in counts.items():
        mine = [p for _, k, p in best.values() if k == n]
        if mine:
            mine = np.concatenate(mine)
            grams = np.repeat(lookup.grams, np.diff(lookup.begin))
            made.append(Lookup.of(n, grams[mine], lookup.item[mine], lookup.place[mine]))
    return made


def _pass(docs: DataFrame, items: list[tuple], least: float, id_col: str, text_col: str, least_words: int) -> DataFrame:
    data, at = buffer(pa.array([t for _, t in items], pa.large_string()))
    codes, word_at = _tokens(data, at)
    words = [codes[a:b] for a, b in zip(word_at[:-1], word_at[1:], strict=True)]
    names = [i for i, _ in items]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = []
    for n in GRAMS:
        which = [i for i, w in enumerate(words) if len(w) >= max(n, least_words) and guaranteed(len(w), least, n)]
        if which:
            known.append(Lookup.of(n, *_occurrences(words, n, which)))
    chosen = seeds(words, least, {x.n: (x, t) for x, t in zip(known, _counts(source, known), strict=True)}) if known else []
    # The items' words by number, to tell quickly how many of them a stretch has.
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    numbered = [np.searchsorted(vocabulary, w) for w in words]
    size = np.array([len(w) for w in words], np.int64)
    slack = np.array([most_edits(len(w), least) for w in words], np.int64)
    enough = np.ceil(size * least - 1e-9).astype(np.int64)

    def stretches(part: np.ndarray, o: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(document, item, first word, words) of each stretch of the texts that an item may lie in."""
        tokens, word_at = _tokens(part, o)
        docs, which, low = [], [], []
        for lookup in chosen:
            doc, first, spot = lookup.hits(tokens, word_at)
            count = np.diff(lookup.begin)[spot]
            k = np.repeat(lookup.begin[spot] - np.cumsum(count) + count, count) + np.arange(count.sum())
            docs.append(np.repeat(doc, count))
            which.append(lookup.item[k])
            low.append(np.repeat(first - word_at[doc], count) - lookup.place[k])  # where the item's first word would be
        if not docs:
            return
        docs, which, low = (np.concatenate(x) for x in (docs, which, low))
        # Seeds whose places differ by less than the item's size share a stretch.
        slot = low // size[which]
        order = np.lexsort((slot, which, docs))
        docs, which, slot = docs[order], which[order], slot[order]
        new = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (which[1:] != which[:-1]) | (slot[1:] != slot[:-1])]) if len(docs) else np.zeros(0, np.int64)
        docs, which, slot = docs[new], which[new], slot[new]
        place = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
        place[vocabulary[place] != tokens] = len(vocabulary)
        marks = np.zeros(len(vocabulary) + 1, bool)
        begin = word_at[docs] + np.maximum(0, slot * size[which] - slack[which])
        end = np.minimum(word_at[docs + 1], word_at[docs] + (slot + 2) * size[which] + slack[which])
        for d, i, a, b in zip(docs.tolist(), which.tolist(), begin.tolist(), end.tolist(), strict=True):
            here = place[a:b]
            marks[here] = True
            many = np.count_nonzero(marks[numbered[i]]) >= enough[i]
            marks[here] = False
            if many:
                yield d, i, a - int(word_at[d]), tokens[a:b]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(first + d, i, a, w) for first, _, part, o in blocks(*buffer(batch.column(1))) for d, i, a, w in stretches(part, o)] if chosen else []
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            pairs.sort(key=lambda p: len(words[p[1]]) + len(p[3]))
            a = 0
            while a < len(pairs):  # pairs of like size together, so many that the arrays stay small
                b = a + 1
                while b < len(pairs) and (b - a) * len(words[pairs[b][1]]) < 400_000 and b - a < 4000:
                    b += 1
                scores, firsts, ends = align([words[p[1]] for p in pairs[a:b]], [p[3] for p in pairs[a:b]])
                for (row, i, start, _), s, f, e in zip(pairs[a:b], scores.tolist(), firsts.tolist(), ends.tolist(), strict=True):
                    found = (s / (2 * len(words[i])), -(start + f), start + e)
                    best[row, i] = max(best.get((row, i), found), found)
                a = b
            rows = [(row, names[i], s, -f, e) for (row, i), (s, f, e) in sorted(best.items()) if s >= least - 1e-9]
            at_rows = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at_rows), batch.column(1).take(at_rows), *(pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int32()), (4, pa.int32())))], ["id", "text", "item_id", "score", "first_word", "end_word"])

    judged = source.mapInArrow(tidy_batches(judge), "id long, text string, item_id long, score double, first_word int, end_word int")
    return judged.withColumn("text_code", F.xxhash64("text")).drop("text")


def matches(docs: DataFrame, items: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id_col, text_code, item_id, score, first_word, end_word): for each row of docs and each item, its best alignment if that scores `least` or more.

    A score is the alignment's share of what the whole item would have (1: a verbatim copy); places are words of the
    text. text_code is xxhash64 of the text. All alignments that score so much are found. Null and empty items, and those of
    fewer than least_words words, match nothing; a null text matches nothing, a null id stays null; repeated rows have a row
    each. Ties of the score go to the first place. The items go to the tasks in passes of a bounded size, and each pass
    reads the texts twice: a benchmark is small beside a corpus.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    picked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    size = picked.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    passes = max(1, -(-int(size) // (4 * MOST_WORDS)))  # a word takes four bytes or so
    found = None
    for p in range(passes):  # each pass holds a bounded part of the items
        part = picked.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == p).distinct().orderBy("id", "text").collect() if passes > 1 else picked.distinct().orderBy("id", "text").collect()
        rows = _pass(docs, [(r["id"], r["text"]) for r in part], least, id_col, text_col, least_words)
        found = rows if found is None else found.unionByName(rows)
    return found.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no copy of an item (see `matches`)."""
    bad = matches(docs, items, least, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("text_code").alias("__code")).distinct()
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["__code"]), "left_anti")
