"""Toxicity: a linear classifier of words and word beginnings that is regularised by counterfactuals.

For labelled sentences that mention a group of people, copies are made with the mention swapped for other groups. Training
adds a penalty on the difference of a sentence's and its copies' scores, so that the mention of a group moves the score as
little as possible and neutral mentions don't look toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import tidy_batches
from .words import blocks, buffer, mix, spans_hash

#: Words that name groups of people, in lower case, by language; a swap stays within a language and a line.
IDENTITY_TERMS = {
    "en": (
        ("women", "men", "girls", "boys", "transgender people"),
        ("woman", "man"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual"),
        ("immigrants", "refugees", "foreigners", "citizens", "natives"),
        ("old", "young", "disabled", "blind", "deaf"),
    ),
    "fr": (("femmes", "hommes"), ("musulmans", "chrétiens", "juifs", "athées"), ("noirs", "blancs", "asiatiques"), ("immigrés", "réfugiés", "étrangers", "citoyens")),
    "de": (("frauen", "männer"), ("muslime", "christen", "juden", "atheisten"), ("schwarze", "weiße", "asiaten"), ("einwanderer", "flüchtlinge", "ausländer", "bürger")),
    "es": (("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos", "ateos"), ("negros", "blancos", "asiáticos"), ("inmigrantes", "refugiados", "extranjeros", "ciudadanos")),
}

#: Lengths in bytes of the word beginnings that are features; 0 stands for the whole word.
BEGINNINGS = (0, 5, 6, 7, 8, 9, 10)


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of U+00C0 to U+00DE in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    latin = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1 if len(data) > 1 else []
    out[latin] += 32
    return out


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the runs of letters (of any script: bytes from 128 on count as letters)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data >= 128) | ((data >= 97) & (data <= 122))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, feature codes) of each word of the texts, for whole words and for each beginning."""
    data = _lower(data)
    starts, ends, doc = _letters(data, offsets)
    size = ends - starts
    for n in BEGINNINGS:
        if n == 0:
            yield doc, spans_hash(data, starts, ends)
        else:
            long = np.flatnonzero(size > n)
            yield doc[long], mix(spans_hash(data, starts[long], starts[long] + n) + np.uint64(n))


def code(word: str) -> int:
    """Feature code of a whole word."""
    raw = np.frombuffer(word.lower().encode(), np.uint8)
    return int(spans_hash(raw, np.array([0]), np.array([len(raw)]))[0])


@dataclass(frozen=True)
class ToxicityModel:
    """Scores: sigmoid(bias + sum of weights * log2(1 + count)) over a text's features; codes are sorted."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A score from 0 to 1 for each whole text; an empty one has sigmoid(bias)."""
        table = np.zeros(1 << 20, bool)  # most words are no feature; a bit table says so at once
        table[(self.codes >> np.uint64(44)).astype(np.int64)] = True
        logits = np.full(len(offsets) - 1, self.bias)
        for first, _, raw, at in blocks(data, offsets):
            docs, cols = [], []
            for doc, codes in features(raw, at):
                may = np.flatnonzero(table[(codes >> np.uint64(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.codes, codes[may]), len(self.codes) - 1)
                ok = self.codes[place] == codes[may]
                docs.append(doc[may][ok])
                cols.append(place[ok])
            cell, times = np.unique(np.concatenate(docs) * len(self.codes) + np.concatenate(cols), return_counts=True)
            np.add.at(logits, first + cell // len(self.codes), self.weights[cell % len(self.codes)] * np.log2(1 + times))
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def _counted(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its distinct feature codes and log2(1 + count)."""
    docs, codes = (np.concatenate(x) for x in zip(*features(data, offsets), strict=True))
    order = np.lexsort((codes, docs))
    docs, codes = docs[order], codes[order]
    begin = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (codes[1:] != codes[:-1])]) if len(docs) else np.zeros(0, np.int64)
    times = np.log2(1.0 + np.diff(np.append(begin, len(docs))))
    edges = np.searchsorted(docs[begin], np.arange(len(offsets)))
    return [(codes[begin[a:b]], times[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _swaps(texts: list[str]) -> list[tuple[int, str]]:
    """(index of a text, sentence copy) pairs: for each sentence with a group's name, the sentence and then its copies."""
    by_term = {term: [x for x in line if x != term] for lines in IDENTITY_TERMS.values() for line in lines for term in line if " " not in term}
    out = []
    for i, text in enumerate(texts):
        for sentence in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
            words = sentence.lower().split()
            for at, word in enumerate(words):
                for other in by_term.get(word.strip(",;:\"'()"), ()):
                    out.append((i, " ".join(words)))
                    out.append((i, " ".join([*words[:at], other, *words[at + 1 :]])))
    return out


def constant(labels: np.ndarray, unknown: float) -> ToxicityModel:
    """Scores each text with the share of label 1, kept from 0.001 to 0.999, or `unknown` without labels."""
    share = min(0.999, max(0.001, float(np.mean(labels)) if len(labels) else unknown))
    return ToxicityModel(np.array([0], np.uint64), np.zeros(1), float(np.log(share / (1 - share))))


def fit(texts: list[str], labels: np.ndarray, most_features: int = 600, penalty: float = 2.0, lasso: float = 2e-4, rounds: int = 400) -> ToxicityModel:
    """Fits on whole labelled texts. penalty weighs the squared differences of scores between sentences and their copies.

    If only one label occurs, or no word sets the labels apart, each text scores the share of label 1; without any label, 0.001.
    """
    data, at = buffer(pa.array(texts, pa.large_string()))
    # Features of fewer than three texts are left out first; a table of counts by the code's upper bits says which may have more.
    seen = np.zeros(1 << 22, np.int32)
    for _, _, raw, o in blocks(data, at):
        for c, _ in _counted(raw, o):
            np.add.at(seen, (c >> np.uint64(42)).astype(np.int64), 1)
    often = seen >= 3
    rows = []
    for _, _, raw, o in blocks(data, at):
        rows += [(c[k], v[k]) for c, v in _counted(raw, o) for k in [often[(c >> np.uint64(42)).astype(np.int64)]]]
    y = np.asarray(labels, float)
    if not 0 < y.sum() < len(y):  # one class alone, or none: there is nothing to tell apart
        return constant(y, 0.0)
    every = np.concatenate([c for c, _ in rows]) if rows else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    codes, index = np.unique(every, return_inverse=True)
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    in1 = np.bincount(index, y[owner], len(codes)) if len(codes) else np.zeros(0)
    in0 = np.bincount(index, 1 - y[owner], len(codes)) if len(codes) else np.zeros(0)
    # The features whose share among toxic texts most exceeds that among the others, by a two-sample statistic.
    share = (in1 + in0 + 1) / (n1 + n0 + 2)
    gain = (in1 / n1 - in0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    gain[in1 + in0 < 3] = 0
    terms = np.array(sorted({code(t) for lines in IDENTITY_TERMS.values() for line in lines for t in line if " " not in t}), np.uint64)
    gain[np.isin(codes, terms)] = np.inf  # groups' names stay features, so that the penalty can hold their weights down
    keep = np.sort(np.argsort(-gain, kind="stable")[:most_features])
    keep = keep[gain[keep] > 3]  # three standard errors
    if not len(keep):
        return constant(y, 0.0)
    column = np.full(len(codes), -1)
    column[keep] = np.arange(len(keep))
    col = column[index]
    value = np.concatenate([v for _, v in rows])[col >= 0]
    row, col = owner[col >= 0], col[col >= 0]

    pairs = _swaps(texts)
    pair_col, pair_value, pair_row = np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    if pairs:
        kept = codes[keep]
        raw, o = buffer(pa.array([s for _, s in pairs], pa.large_string()))
        parts = [x for _, _, d, q in blocks(raw, o) for x in _counted(d, q)]
        pc, pv, pr = [], [], []
        for k, (c, v) in enumerate(parts):
            place = np.minimum(np.searchsorted(kept, c), len(kept) - 1)
            ok = kept[place] == c
            pc.append(place[ok])
            pv.append(v[ok] * (1 if k % 2 == 0 else -1))
            pr.append(np.full(ok.sum(), k // 2))
        pair_col, pair_value, pair_row = np.concatenate(pc), np.concatenate(pv), np.concatenate(pr)
    n_pairs = max(1, len(pairs) // 2)

    # Full-batch Adam on weighted log loss + lasso + the counterfactual penalty; both classes weigh alike but for a square root.
    weight = np.where(y > 0, np.sqrt(n0 / n1), 1.0)
    weight /= weight.sum()
    w, b = np.zeros(len(keep)), float(np.log(n1 / n0))
    m, v2, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[col] * value, len(y))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(col, err[row] * value, len(w))
        if len(pair_col):
            gap = np.bincount(pair_row, w[pair_col] * pair_value, n_pairs)
            g += penalty * 2 / n_pairs * np.bincount(pair_col, gap[pair_row] * pair_value, len(w))
        gb = err.sum()
        m, v2 = 0.9 * m + 0.1 * g, 0.999 * v2 + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05
        scale = np.sqrt(v2 / (1 - 0.999**t)) + 1e-8
        w -= rate * (m / (1 - 0.9**t)) / scale
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * lasso / np.maximum(scale, 1e-4))  # most words get no weight
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return ToxicityModel(codes[keep], w, float(b))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held_out: int, id_col: str, text_col: str, most_rows: int, most_bytes: int) -> tuple[list[str], np.ndarray]:
    """At most most_rows labelled whole texts, of at most most_bytes each, outside the held-out fold.

    The rows are those with the smallest hashes of their id: a bounded sample, the same for the same rows. A row without
    id, label or text is none of them.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__label")).where("__label is not null").groupBy("__id").agg(F.max("__label").alias("__label"))
    mine = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).where(F.octet_length("__text").between(1, most_bytes))
    mine = mine.where(F.pmod(F.crc32(F.col("__id").cast("string")), F.lit(fold)) != held_out)
    picked = marks.where(F.pmod(F.crc32(F.col("__id").cast("string")), F.lit(fold)) != held_out).orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    rows = mine.join(F.broadcast(picked), "__id").orderBy(F.xxhash64("__id"), "__id", F.xxhash64("__text")).limit(most_rows).select("__text", "__label").toPandas()  # the bound above holds for what comes here
    return rows["__text"].tolist(), rows["__label"].to_numpy(float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 5000, most_bytes: int = 16_000) -> ToxicityModel:
    """Fits on a bounded sample of labelled rows (see `sample`) whose crc32 of the id modulo 4 is not 2.

    Without such rows nothing is known to be toxic: the model scores each text 0.001, and `reject` keeps all.
    """
    texts, marks = sample(docs, labels, "toxic", 4, 2, id_col, text_col, most_rows, most_bytes)
    return fit(texts, marks)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """One row for each input row: id_col, held_out, score, predicted (1 from `least` on). A null text is an empty one; a null id is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(*buffer(batch.column(1))), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy_batches(run), "id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return rows.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: ToxicityModel, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores below `least`; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(*buffer(batch.column(batch.schema.get_field_index(text_col)))) < least))

    return docs.mapInArrow(tidy_batches(run), docs.schema)

