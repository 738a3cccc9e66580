"""The registered queries of this subpackage: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import alignment, ann, bpe, decontaminate, html_text, quality, run_length_index, secrets, sentence_pieces, simhash, spelling, suffix_tree, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: counts of the base kinds, their places and a digest of them. A null text has none."""
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = secrets.spans_text(F.col("secrets"))

    def number(kind: str) -> F.Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from the labels of those that aren't held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. A null page has an empty one."""
    found = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and the smallest id that it reaches over links of three bits or fewer."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a tokenizer that a contract names is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's BPE ids and of the text that they decode to."""
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from the labels of those that aren't held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that windows of 13 words repeat from documents with smaller ids, and what is left without them."""
    kept = suffix_tree.remove_repeated_words(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that strings of 50 bytes repeat from documents with smaller ids, and what is left without them."""
    kept = run_length_index.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, by inner product."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that align with benchmark items by 0.8 or more."""
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "end_word")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in each document, and how common the linked pairs are in all."""
    return alignment.linked(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents with their most frequent near word. Of some occurrences, told by a hash, one letter is dropped first: they are the misspellings."""
    found = spelling.words(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (h % F.length("word")).cast("int")
    dropped = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return spelling.group(spelling.vocabulary(found.select(F.when(h % 199 == 0, dropped).otherwise(F.col("word")).alias("word"))))


def op13_sentencepiece_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's SentencePiece ids and of the text that they decode to."""
    return sentence_pieces.encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _spans_sql(kind: str, pattern: str, group: int, least: int, options: str = "") -> str:
    """Places of matches from the pieces between them."""
    flags = f", '{options}'" if options else ""
    return f"""SELECT doc_id, s.i AS i, '{kind}' AS kind, {('assign', 'access', 'hex').index(kind)} AS kind_order,
      list_sum(list_transform(gaps[1:s.i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:s.i - 1], lambda x: length(x))), 0) AS b, length(whole[s.i]) AS n
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0{flags}) AS whole, regexp_extract_all(t, '{pattern}', {group}{flags}) AS part,
      string_split_regex(t, '{"(?i)" if options else ""}{pattern}') AS gaps FROM docs) m, LATERAL (SELECT unnest(range(1, len(whole) + 1)) AS i) s
    WHERE length(part[s.i]) >= {least}"""


#: The misspellings by a CRC-32 table that is made by its rule; near words by patterns with one place left open, not by neighbours.
_SPELLING_SQL = """
WITH RECURSIVE steps AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS w FROM documents)),
each AS (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs GROUP BY doc_id, w),
sums AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
  lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295) AS h FROM each, steps),
words AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM sums),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
open AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS pattern, left(word, i) || substr(word, i + 2) AS shorter FROM vocabulary, LATERAL (SELECT unnest(range(0, length(word))) AS i) s),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM open a JOIN open b USING (pattern) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM open a JOIN vocabulary b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM open a JOIN vocabulary b ON a.shorter = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM vocabulary LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS root FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON w.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.root FROM ways w JOIN forms f ON w.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


def oracle_sql() -> dict[str, str]:
    assign = secrets.BASE_RULES[0].pattern.replace("'", "''")
    return {
        "op1_secret_scan": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_spans_sql("assign", assign, 2, 6, "i")} UNION ALL {_spans_sql("access", "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_spans_sql("hex", "[0-9a-f]{24,}", 0, 24)}),
sums AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT), ',' ORDER BY b, kind_order) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN sums USING (doc_id)""",
        "op7_substring_dedup": r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, s.i AS i, array_to_string(w[s.i:s.i + 12], ' ') AS k FROM docs, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) s),
firsts AS (SELECT k, min(doc_id) AS f FROM wins GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o.o AS i FROM wins JOIN firsts USING (k), (SELECT unnest(range(13)) AS o) o WHERE f < doc_id),
lists AS (SELECT doc_id, list(i) AS g, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, s.i AS i, w[s.i] AS x FROM docs, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) s),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""",
        "op12_spelling_variants": _SPELLING_SQL,
    }
