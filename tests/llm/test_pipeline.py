import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from caselight.llm import decontaminate, queries, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF).cache()
        assert out.columns == columns and out.select("doc_id").exceptAll(seen.select("doc_id")).isEmpty(), name
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        if name == "simhash_near_dedup":
            classes = {r.component_id for r in simhash.similar_documents(seen).collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(classes)
            assert out.select("text").distinct().count() == out.count()  # no exact copies are left
        if name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in r.text for r in out.collect() for i in items)
            assert decontaminate.matches(out, spark.read.parquet(f"{SF}/benchmark.parquet")).isEmpty()
        if name == "secret_scan":
            assert out.count() == seen.count()
            assert secrets.scan_secrets(out).where(F.size("secrets") > 0).isEmpty()
            assert out.where(F.length("text") != F.col("n_chars")).isEmpty()
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in seen.collect()}
    assert {r.doc_id for r in last} == set(texts)
    for r in last[:20]:
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_odd_rows(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, None, None, None, None), (10**6, None, "en", "s", 0), (10**6, "", "en", "s", 0), (10**6 + 1, "x " * 20_000, "en", "s", 40_000), (10**6 + 1, "x " * 20_000, "en", "s", 40_000)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = stage[1](spark, odd, SF).collect()
    assert len(got) > 100
    assert stage[1](spark, docs.limit(0), SF).collect() == []


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() > 0


def test_sql_gives_the_same(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        columns = sorted(df.columns)
        got = con.execute(sql)
        named = [d[0] for d in got.description]
        assert sorted(named) == columns
        assert sorted(repr(tuple(r[named.index(c)] for c in columns)) for r in got.fetchall()) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def test_one_row_of_each_group_of_copies(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [
        (None, text(1), "en", "s", 1), (None, text(2), "en", "s", 1), (None, text(2), "en", "s", 1),  # null ids with different texts
        (5, text(3), "en", "s", 1), (5, text(4), "en", "b", 1), (5, text(4), "en", "a", 1),  # one id with different texts
        (4, text(3) + " more", "en", "s", 1), (None, text(3), "en", "s", 1),  # near copies of one of them
    ]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema).repartition(3)
    got = corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == [(4, text(3) + " more", "en", "s", 1), (5, text(4), "en", "a", 1)]
    assert sorted(r.text for r in got if r.doc_id is None) == [text(1), text(2)]
