"""A pipeline over the training-data operators: what is toxic, a near copy or a leaked test item goes, secrets are masked, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs;
all but the last return the columns of documents, with n_chars counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.llm import bpe, decontaminate, queries, secrets, simhash, toxicity
from caselight.llm.columns import free
from caselight.session import cut, ship

#: Text bytes of a chunk that is encoded: fewer than by default, as the ids are returned too and earlier stages leave executors with grown heaps.
ENCODED_BYTES = 4_000_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity scores below 0.3. The classifier learns from the documents of this stage that have a label."""
    return toxicity.reject(docs, toxicity.train(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: texts whose shingles of five words have a similarity of 0.8 or more.

    It is the row with the smallest id (null after all others), then the smallest hash of the text, then the smallest
    other columns. Rows of one id or without one are told apart by their texts.
    """
    ship(spark)
    found = simhash.similar_rows(docs)
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_code")).alias("x"))
    own, other, place = free(docs, "id", "code", "place")
    keep = cut(first.select(F.col("x.id").alias(own), F.col("x.text_code").alias(other)))
    code = F.xxhash64(F.col("text").cast("string"))
    held = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (code == F.col(other)), "left_semi")
    order = Window.partitionBy("doc_id", code).orderBy(*(c for c in docs.columns if c != "doc_id"))
    return held.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item that aligns by 0.8 or more."""
    return decontaminate.clean(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    ship(spark)
    (found,) = free(docs, "secrets")
    masked = secrets.redact(secrets.scan_secrets(docs, out_col=found), secrets_col=found).drop(found)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids, and digests of the ids and of the text that they decode to."""
    ship(spark)
    return bpe.encode(docs, queries.tokenizer_path(), ids=True, chunk_bytes=ENCODED_BYTES)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("bpe_encoding", encoding_stage),
]

#: A learned classifier and XXH64 fingerprints are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared checkpoint folder and read from there by the next stage."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
