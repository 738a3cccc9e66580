"""Chunks, inverted index, BM25 and hybrid search over texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD, stem_of, stops_of, tokenize, words_of
from ..session import folder

#: Characters of a chunk, of the overlap with the next one, and of the shortest chunk kept.
TARGET, OVERLAP, LEAST = 1200, 250, 120
#: Characters of the shortest document that is indexed, and tokens of the shortest chunk.
LEAST_DOCUMENT, LEAST_TOKENS = 80, 5
K1, B = 1.5, 0.75
#: Words whose terms a task keeps in mind, and postings that it hands over at once.
MOST_KNOWN, ROWS_SENT = 500_000, 100_000
#: Postings that a task sorts and writes, on average.
PART_ROWS = 1_000_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[А-ЯA-Z])")


def chunks_of(text: str, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST, repeat_tail: bool = True) -> list[tuple[int, int, str]]:
    """(number, offset, text) of a document's chunks.

    Paragraphs are packed up to `target` characters, and each chunk begins with the end of the one before. With
    repeat_tail a chunk that is cut also has its own end in front, as the reports of record have it; without, it doesn't.
    What comes out over 1.8 * target long is cut again between sentences, numbered on from its own number.
    """
    made: list[tuple[int, int, str]] = []
    held, offset = "", 0

    def emit(front: str) -> None:
        body = (front + held).strip()
        if len(body) >= least:
            made.append((len(made), offset, body))

    for paragraph in filter(None, (p.strip() for p in re.split(r"\n+", text.replace("\r\n", "\n")))):
        if held and len(held) + len(paragraph) + 1 > target:
            tail = held[max(0, len(held) - overlap) :]
            emit(tail if repeat_tail else "")
            offset += 1 if repeat_tail else len(held) + 1
            held = tail + " " if tail else ""
        held = held + " " + paragraph if held else paragraph
    if held.strip():
        emit("")
    out = []
    for number, at, body in made:
        if len(body) <= target * 1.8:
            out.append((number, at, body))
            continue
        held = ""
        for sentence in _SENTENCE.split(body):
            if held and len(held) + len(sentence) + 1 > target:
                if len(held.strip()) >= least:
                    out.append((number, at, held.strip()))
                    number, at = number + 1, at + len(held.strip()) + 1
                tail = held[max(0, len(held) - overlap) :]
                held = tail + " " if tail else ""
            held = held + " " + sentence if held else sentence
        if len(held.strip()) >= least:
            out.append((number, at, held.strip()))
    return out


def chunk(docs: DataFrame, id_col: str, text_col: str, repeat_tail: bool = True) -> DataFrame:
    """(id_col, number, offset, text): the chunks of each document of 80 characters or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *c) for i, t in zip(batch["id"], batch["text"], strict=True) for c in chunks_of(t, repeat_tail=repeat_tail)]
            yield pd.DataFrame(rows, columns=["id", "number", "offset", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    long = docs.where(F.length(text_col) >= LEAST_DOCUMENT).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return long.mapInPandas(run, f"id {kind}, number int, offset int, text string").withColumnRenamed("id", id_col)


def terms_of_texts(batches: Iterator[pa.RecordBatch], stop_words: list[str] | None = None, word: str = WORD) -> Iterator[tuple[object, dict[str, int]]]:
    """(id, how often it has each term) of each text of Arrow batches (id, text); rows of one id must follow each other and are one text.

    The same terms as those of `tokenize`, with each distinct word stemmed once.
    """
    stops, known = set(stops_of(stop_words)), {}

    def term_of(word: str) -> str | None:
        found = stem_of(word) if len(word) >= 2 and word not in stops else ""
        if len(known) >= MOST_KNOWN:
            known.clear()
        known[word] = found = found if found and found not in stops else None
        return found

    def counted(words: Counter) -> dict[str, int]:
        out: dict[str, int] = {}
        for word, n in words.items():
            term = known[word] if word in known else term_of(word)
            if term is not None:
                out[term] = out.get(term, 0) + n
        return out

    held, words = None, None
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if words is None or key != held:
                if words is not None:
                    yield held, counted(words)
                held, words = key, Counter()
            words.update(words_of(text or "", word))
    if words is not None:
        yield held, counted(words)


def term_counts(rows: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None, least: int = LEAST_TOKENS, word: str = WORD) -> DataFrame:
    """(id_col, term, tf, size): how often each text with enough tokens has each term, and its tokens.

    Rows of one id are one text, so they are dealt and sorted by id. `word` is the expression of a lower-case word; all else parts words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, tfs, lengths, kind = [], [], [], [], pa.null()

        def made() -> pa.RecordBatch:
            columns = [pa.array(ids, kind), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(lengths, pa.int32())]
            for x in (ids, terms, tfs, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["id", "term", "tf", "size"])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for key, found in terms_of_texts(seen(), stop_words, word):
            size = sum(found.values())
            if found and size >= least:
                ids += [key] * len(found)
                lengths += [size] * len(found)
                terms += found
                tfs += found.values()
            if len(ids) >= ROWS_SENT:
                yield made()
        if ids:
            yield made()

    kind = rows.schema[id_col].dataType.simpleString()
    dealt = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id").sortWithinPartitions("id")
    return dealt.mapInArrow(run, f"id {kind}, term string, tf long, size int").withColumnRenamed("id", id_col)


def sizes(counts: DataFrame, id_col: str) -> DataFrame:
    """(id_col, size): tokens of each text of term counts."""
    return counts.groupBy(id_col).agg(F.first("size").alias("size"))


def _counted_once(rows: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None, least: int, word: str = WORD) -> DataFrame:
    """The term counts, written once as Parquet: who reads them takes the columns that it needs."""
    path = folder(rows.sparkSession, "term-counts")
    term_counts(rows, id_col, text_col, stop_words, least, word).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def postings(rows: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None, least: int = LEAST_TOKENS, word: str = WORD) -> DataFrame:
    """(id_col, term, tf, size): the inverted index of rows with enough tokens and an id."""
    return _counted_once(rows, id_col, text_col, stop_words, least, word).where(F.col(id_col).isNotNull())


@dataclass(frozen=True)
class Index:
    """A stored full-text index: postings (id, term, tf, size) in files sorted by term, sizes (id, size), terms (term, df) and stats (n, avg_size)."""

    postings: DataFrame
    sizes: DataFrame
    terms: DataFrame
    stats: DataFrame


def store_index(rows: DataFrame, id_col: str, text_col: str, root: str, stop_words: list[str] | None = None, least: int = LEAST_TOKENS) -> Index:
    """Builds the index of rows once and writes it under root as Parquet; postings are dealt and sorted by term, so that a search reads few row groups."""
    counts = _counted_once(rows, id_col, text_col, stop_words, least)
    # By term and id: the postings of a term that all texts have go to as many files as they fill. The number of parts follows the postings: without
    # it, about as many parts as there are cores would be made of them, and each task would sort more as they grow.
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // PART_ROWS))
    counts.where(F.col(id_col).isNotNull()).repartitionByRange(parts, "term", id_col).sortWithinPartitions("term", id_col).write.mode("overwrite").parquet(f"{root}/postings")
    sizes(counts, id_col).write.mode("overwrite").parquet(f"{root}/sizes")
    spark = rows.sparkSession
    spark.read.parquet(f"{root}/postings").groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{root}/terms")
    spark.read.parquet(f"{root}/sizes").agg(F.count("*").alias("n"), F.avg("size").alias("avg_size")).write.mode("overwrite").parquet(f"{root}/stats")
    return load_index(spark, root)


def load_index(spark: SparkSession, root: str) -> Index:
    return Index(*(spark.read.parquet(f"{root}/{part}") for part in ("postings", "sizes", "terms", "stats")))


def corpus(index: DataFrame, id_col: str) -> DataFrame:
    """(n, avg_size) over the indexed rows; one row."""
    return index.groupBy(id_col).agg(F.first("size").alias("size")).agg(F.count("*").alias("n"), F.avg("size").alias("avg_size"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(spark, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """(term, qtf) of a query, as texts are tokenised."""
    return spark.range(1).select(F.explode(tokenize(F.lit(text), stop_words)).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))


def bm25(index: DataFrame | Index, id_col: str, query: str, stop_words: list[str] | None = None) -> DataFrame:
    """(id_col, score) of all rows that share a term with the query. Postings of the query's terms alone are joined and summed."""
    rows = index.postings if isinstance(index, Index) else index
    asked = query_terms(rows.sparkSession, query, stop_words).collect()  # as many rows as the query has words
    terms = rows.sparkSession.createDataFrame(asked, "term string, qtf long")
    met = rows.where(F.col("term").isin([r["term"] for r in asked])).join(F.broadcast(terms), "term")  # files skip what the terms aren't in
    df = index.terms.join(F.broadcast(terms.select("term")), "term") if isinstance(index, Index) else met.groupBy("term").agg(F.count("*").alias("df"))
    stats = index.stats if isinstance(index, Index) else corpus(index, id_col)
    rows = met.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avg_size"))) * F.col("qtf")
    return rows.groupBy(id_col).agg(F.sum(part).alias("score"))


def search(index: DataFrame | Index, id_col: str, query: str, k: int = 10, stop_words: list[str] | None = None, keep: Column | None = None, about: DataFrame | None = None) -> DataFrame:
    """The k best rows, score to four places, ties by id; conditions on `about` come after the cut, so that fewer may be left."""
    best = bm25(index, id_col, query, stop_words).withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), id_col).limit(k)
    if about is not None:
        best = best.join(about, id_col)
    return best if keep is None else best.where(keep)


def hybrid(index: DataFrame | Index, catalogue: DataFrame, id_col: str, query: str, haystack: Column, order: list[Column], limit: int = 15, stop_words: list[str] | None = None) -> DataFrame:
    """Best texts and newest catalogue rows that contain the query, each with its source; the limit is 1 to 50."""
    n = min(50, max(1, limit))
    texts = search(index, id_col, query, n, stop_words).select(id_col, F.lit("text").alias("source"), "score")
    found = catalogue.where(F.contains(haystack, F.lit(query.lower()))).orderBy(*order).limit(n)
    return texts.unionByName(found.select(id_col, F.lit("catalogue").alias("source"), F.lit(None).cast("double").alias("score")))


def reassemble(parts: DataFrame, key: str, number: str, text: str, between: str = "\n\n") -> DataFrame:
    """(key, text): the parts of each key in order; a document's parts fit in one row as the document does."""
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, text))), lambda x: x[text]), between).alias(text))


def remove_case(chunks: DataFrame, key: str, case: str) -> tuple[DataFrame, DataFrame]:
    """The chunks without those of one case, and a row with the number `removed`."""
    gone = F.col(key).eqNullSafe(F.lit(case))
    return chunks.where(~gone), chunks.agg(F.count_if(gone).alias("removed"))


def reindex(docs: DataFrame, chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The chunks, and those of long enough documents that have none yet."""
    new = docs.join(chunks.select(id_col).distinct(), id_col, "left_anti")
    return chunks.select(id_col, "number", "offset", "text").unionByName(chunk(new, id_col, text_col))


def indexed_cases(chunks: DataFrame, key: str, order: str, shown: list[str]) -> DataFrame:
    """Per key the number of chunks and the first present value of each shown column."""
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), *[F.min_by(c, F.when(F.col(c) != "", F.col(order))).alias(c) for c in shown])
