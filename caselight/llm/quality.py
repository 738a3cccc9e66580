"""Quality: a byte-level convolutional network in numpy over overlapping chunks that cover the whole document.

Each filter gives every byte of a width of WIDTH bytes a learned weight at each position: a one-hot convolution, computed
as sums of table rows. A chunk keeps each filter's highest response, a document the highest and the mean over its chunks;
a hidden layer combines them into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import tidy_batches
from .toxicity import sample
from .words import blocks, buffer

#: Bytes of a filter and filters; bytes of a chunk and bytes that a chunk shares with the next one (a filter's width less one, so that no place is missed).
WIDTH, FILTERS, HIDDEN = 5, 6, 8
CHUNK = 256


@dataclass
class QualityModel:
    """tables: (WIDTH = 5, 256, FILTERS) weights of bytes; then a hidden layer on highest and mean chunk responses and log length."""

    tables: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk, the highest response of each filter (0 if it has no place for a filter), and the responses of each filter at all places."""
        begin, _, end = chunk_bounds(offsets)
        n = len(data)
        padded = np.concatenate((data, np.zeros(WIDTH, np.uint8)))
        pairs = padded[:-1].astype(np.uint16) << 8 | padded[1:]
        # A chunk's places run up to the next one's first place; those that would reach over its document's end are dropped.
        tail = np.maximum(offsets[1:, None] - np.arange(1, WIDTH), offsets[:-1, None])[np.diff(offsets) > 0].ravel()
        full = np.flatnonzero(end > begin)
        top = np.zeros((len(begin), FILTERS), np.float32)
        response = np.empty((FILTERS, n), np.float32)
        for k in range(FILTERS):
            mine = response[k]
            t = self.tables[:, :, k]
            # Two bytes at a time: sums of two tables' rows, looked up at once.
            np.take((t[0][:, None] + t[1]).ravel(), pairs[:n], out=mine)
            mine += np.take((t[2][:, None] + t[3]).ravel(), pairs[2 : n + 2])
            mine += np.take(t[4], padded[4 : n + 4])
            mine[tail] = -1e9
            if len(full):
                best = np.maximum.reduceat(mine, begin[full])
                top[full, k] = np.where(best < -1e8, 0, best)
        return top, response

    def describe(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        top, _ = self.pooled(data, offsets)
        return summary(top, offsets)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each whole text; an empty text has one too."""
        out = np.empty(len(offsets) - 1)
        for first, end, raw, at in blocks(data, offsets, 1_000_000):
            hidden = np.maximum(0, self.describe(raw, at) @ self.w1 + self.b1)
            out[first:end] = 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -40, 40)))
        return out


def chunk_bounds(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of all chunks, their documents, and where their own places end; an empty document has one empty chunk."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // CHUNK))
    doc = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[doc] + number * CHUNK
    return begin, doc, np.minimum(begin + CHUNK, offsets[doc + 1])


def summary(top: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document: highest and mean chunk response of each filter, and the logarithm of its length."""
    _, doc, _ = chunk_bounds(offsets)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.append(first, len(doc)))[:, None]
    return np.hstack((np.maximum.reduceat(top, first, axis=0), np.add.reduceat(top, first, axis=0) / count, np.log1p(np.diff(offsets))[:, None] / 8))


def fit(texts: list[str], labels: np.ndarray, rounds: int = 20, batch: int = 64, seed: int = 7) -> QualityModel:
    """Fits filters and layers together by Adam; both classes weigh alike.

    If only one label occurs, each text scores its share, 0.001 or 0.999; without any label, 0.5.
    """
    rng = np.random.default_rng(seed)
    n_in = 2 * FILTERS + 1
    model = QualityModel(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, n_in**-0.5, (n_in, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    y = np.asarray(labels, float)
    if not 0 < y.sum() < len(y):  # one class alone, or none: there is nothing to tell apart
        share = min(0.999, max(0.001, float(y.mean()) if len(y) else 0.5))
        model.w2, model.b2 = np.zeros(HIDDEN), float(np.log(share / (1 - share)))
        return model
    weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    data, at = buffer(pa.array(texts, pa.large_string()))
    names = ("tables", "w1", "b1", "w2", "b2")
    first = {k: np.zeros_like(getattr(model, k), dtype=float) for k in names}
    second = {k: np.zeros_like(getattr(model, k), dtype=float) for k in names}
    t = 0
    for r in range(rounds):
        rate = 0.02 * (1 - r / rounds) + 0.001
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            mine = order[a : a + batch]
            sizes = np.diff(at)[mine]
            o = np.concatenate(([0], np.cumsum(sizes)))
            raw = np.concatenate([data[at[i] : at[i + 1]] for i in mine]) if o[-1] else np.zeros(0, np.uint8)
            top, response = model.pooled(raw, o)
            begin, doc, end = chunk_bounds(o)
            x = summary(top, o)
            z1 = x @ model.w1 + model.b1
            h = np.maximum(0, z1)
            p = 1 / (1 + np.exp(-np.clip(h @ model.w2 + model.b2, -40, 40)))
            err = weight[mine] * (p - y[mine]) / len(mine)
            g = {"w2": h.T @ err, "b2": err.sum()}
            dh = np.outer(err, model.w2) * (z1 > 0)
            g["w1"], g["b1"] = x.T @ dh, dh.sum(axis=0)
            dx = dh @ model.w1.T
            # To the chunk that has a document's highest response, and evenly to all for the mean; from there to the winning place's bytes.
            count = np.bincount(doc, minlength=len(mine))
            dtop = dx[doc, FILTERS : 2 * FILTERS] / count[doc, None]
            is_top = top == x[doc, :FILTERS].astype(np.float32)
            share = np.add.reduceat(is_top, np.cumsum(count) - count, axis=0)
            dtop += is_top * (dx[:, :FILTERS] / np.maximum(1, share))[doc]
            gt = np.zeros_like(model.tables, dtype=float)
            for k in range(FILTERS):
                hit = np.flatnonzero((response[k] == np.repeat(top[:, k], end - begin)) & (response[k] > -1e8))
                chunk = np.searchsorted(begin, hit, "right") - 1
                once = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(hit) else hit
                hit, chunk = hit[once], chunk[once]
                for j in range(WIDTH):
                    gt[j, :, k] += np.bincount(raw[hit + j], dtop[chunk, k], 256)
            g["tables"] = gt + 1e-5 * model.tables
            t += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * np.square(g[k])
                step = rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                setattr(model, k, (getattr(model, k) - step).astype(np.float32) if k == "tables" else getattr(model, k) - step)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 1200, most_bytes: int = 8_000) -> QualityModel:
    """Fits on a bounded sample of labelled whole texts whose crc32 of the id modulo 5 is not 0.

    Without such rows nothing is known of quality: the model scores each text 0.5.
    """
    return fit(*sample(docs, labels, "quality", 5, 0, id_col, text_col, most_rows, most_bytes))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """One row for each input row: id_col, held_out, score, predicted (1 from `least` on). A null text is an empty one; a null id is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(*buffer(batch.column(1))), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy_batches(run), "id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return rows.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
