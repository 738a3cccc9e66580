import random

from pyspark.sql import functions as F

from caselight.functions.text import stem, stem_of, tokenize, words_of
from caselight.operators import fulltext


def test_tasks_make_the_tokens_of_the_expressions(spark):
    """Every character between letters: lower case, word ends and the letter yo are the same in tasks as in Spark."""
    texts = [" ".join(f"ab{chr(c)}вг x{chr(c)}" for c in range(a, min(a + 4096, 0x110000)) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 4096)]
    r = random.Random(5)
    texts += [" ".join("".join(r.choice("абеиймогхяюьё-1z") for _ in range(r.randint(1, 9))) for _ in range(400)), "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = rows.select("id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    assert sorted(map(tuple, fulltext.term_counts(rows, "id", "text", least=1).select("id", "term", "tf").collect())) == sorted(map(tuple, want.collect()))
    words = sorted({w for t in texts for w in words_of(t or "")})[:20_000]
    stems = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert all(stem_of(x.w) == x.s for x in stems)


def test_rows_of_one_id_are_one_text_and_rows_without_an_id_are_no_posting(spark, tmp_path):
    rows = spark.createDataFrame([(1, "займ долг срок"), (2, "займ " * 6), (1, "срок срок займ"), (None, "долг " * 7), (3, "мало"), (4, None)], "id long, text string").repartition(5)
    assert {tuple(x) for x in fulltext.postings(rows, "id", "text").collect()} == {(1, "займ", 2, 6), (1, "долг", 1, 6), (1, "срок", 3, 6), (2, "займ", 6, 6)}
    index = fulltext.store_index(rows, "id", "text", str(tmp_path))
    assert sorted(index.sizes.collect(), key=str) == sorted([(1, 6), (2, 6), (None, 7)], key=str) and index.stats.first().n == 3


def test_a_term_of_all_texts_goes_to_many_files(spark, tmp_path):
    rows = spark.range(4000).select("id", F.lit("открыто открытая открытый открытое стороной председатель").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with tables that fill their partitions
    try:
        index = fulltext.store_index(rows, "id", "text", str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [x["count"] for x in index.postings.groupBy("term").count().collect()] == [4000] * 3
    each = [x["count"] for x in index.postings.groupBy(F.input_file_name()).count().collect()]
    assert len(each) == 4 and max(each) < 0.5 * sum(each) and index.postings.where("term = 'открыт'").select(F.input_file_name()).distinct().count() > 1


def test_tasks_sort_bounded_shares_of_the_postings(spark, tmp_path, monkeypatch):
    """The postings' files hold PART_ROWS each, about, however many there are, also those of one term."""
    monkeypatch.setattr(fulltext, "PART_ROWS", 500, raising=False)
    rows = spark.range(1000).select("id", F.concat(F.lit("заседание рассмотрено открыто стороной решение "), F.col("id").cast("string")).alias("text"))
    index = fulltext.store_index(rows, "id", "text", str(tmp_path / "index"))
    n = index.postings.count()
    files = index.postings.groupBy(F.input_file_name().alias("file")).count().collect()
    assert n >= 5000 and max(r["count"] for r in files) <= 1500
