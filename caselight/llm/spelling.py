"""Spelling variants of words by full neighbourhoods, with DataFrame functions only.

From each word of the vocabulary follow all its neighbours: every distinct deletion of a character, and every replacement
and insertion over the characters that the vocabulary has. Neighbours are joined with the vocabulary by equality; what meets
is near by construction, so no distance is ever computed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Fixed value: what a word's letters are.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Words of a vocabulary that is sent to all executors (some 120 bytes each); neighbours of a larger one are shuffled to it.
MOST_SENT = 2_000_000


def low(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    exact = F.translate(word, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(word.rlike(r"[À-Þ]"), exact).otherwise(F.lower(word))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "word") -> DataFrame:
    """(id_col, out_col): each maximal run of letters in whole texts, A-Z in lower case, once for each place. A null text has none."""
    each = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0)))
    return docs.select(F.col(id_col), each.alias(out_col)).withColumn(out_col, low(F.col(out_col)))


def vocabulary(occurrences: DataFrame, word_col: str = "word", least_chars: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the words of at least so many characters and occurrences; null words count as none."""
    long = occurrences.select(F.col(word_col).alias("word")).where(F.length("word") >= least_chars)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def neighbours(vocabulary: DataFrame, alphabet: list[str]) -> DataFrame:
    """(word, near): for each word every string that differs from it by one character deleted, replaced or inserted, each once.

    Of the places that give one string only one is taken: in a run of equal characters the first is deleted, and none is
    inserted behind its equal.
    """
    word, at = F.col("word"), F.col("at")
    here, left = F.substring(word, at + 1, F.lit(1)), F.substring(word, at, F.lit(1))
    before, behind = F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word))
    places = vocabulary.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    inside, first = at < F.length(word), at == 0
    deleted = places.where(inside & (first | (here != left))).select("word", F.concat(before, behind).alias("near"))
    # (what stands before, what behind, the character that must not come between)
    gaps = F.array(
        F.when(inside, F.struct(before.alias("before"), behind.alias("behind"), here.alias("other"))),
        F.struct(before.alias("before"), F.substring(word, at + 1, F.length(word)).alias("behind"), F.when(first, F.lit("")).otherwise(left).alias("other")),
    )
    wide = places.select("word", F.explode(gaps).alias("gap")).where("gap is not null").select("word", "gap.*")
    each = wide.select("*", F.explode(F.array(*[F.lit(c) for c in alphabet])).alias("new")).where("new <> other")
    return deleted.unionByName(each.select("word", F.concat("before", "new", "behind").alias("near")))


def group(vocabulary: DataFrame, times: int = 5, most_sent: int = MOST_SENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of a vocabulary (word, n) of distinct words.

    Two words are near if they differ by one character inserted, deleted or replaced. A word's form is its near word with
    the largest n (of equals the first in the order of code points) if that is at least `times` (2 or more) its own n, else
    null; the root is where the forms of forms end, the word itself if it has none. n_near counts all near words. An empty
    vocabulary gives no rows; a word of one character is near the others of one (and of two that hold it). Null words and
    other columns are left out.
    """
    if times < 2:
        raise ValueError("forms must be more frequent, or they could go round in circles")
    known = cut(vocabulary.select("word", F.col("n").cast("long").alias("n")).where("word is not null"))
    size = known.count()
    # As many characters as the writing systems of the words have.
    alphabet = [r["c"] for r in known.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().orderBy("c").collect()]
    if not alphabet:
        return known.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    near = known.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    parts = max(1, min(size // 500 + 1, 20 * known.sparkSession.sparkContext.defaultParallelism))  # a word has some thousand neighbours
    made = neighbours(known.repartition(parts, "word"), alphabet)
    met = made.join(near.hint("broadcast" if size <= most_sent else "shuffle_hash"), "near")
    best = met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    both = known.join(best, "word", "left").withColumn("fits", F.coalesce(-F.col("best.minus") >= times * F.col("n"), F.lit(False)))
    form = F.when(F.col("fits"), F.col("best.near"))
    rows = cut(both.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), -F.col("best.minus")).alias("form_n")))
    # Each round doubles the steps that are taken at once; n grows with each step, so the ways are short.
    ways = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return rows.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
