"""Joins by substrings: pairs of values of which one contains the other, found by their rarest common piece instead of by comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import entity
from ..session import cut

#: Characters of a piece.
PIECE = 3


def _pieces(text: Column, size: int) -> Column:
    """The distinct pieces of a text, in time that grows with its length."""
    letters = F.split(text, "")
    made = letters
    for i in range(1, size):  # not by index: a lambda would split the text again for each of its pieces
        made = F.zip_with(made, F.slice(letters, i + 1, 2_000_000_000), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull()))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): the distinct values of `needles.needle` and `texts.text` where the text contains the needle, in the same case.

    Null and empty needles lie in nothing. Each needle is looked up under the one of its pieces of three characters that
    fewest texts have (a shorter one under itself), and each pair met there is verified. So a needle meets at most the texts
    with its rarest piece, and no side is broadcast by this function; a piece that many texts have is split where adaptive
    execution splits skewed joins.
    """
    own = needles.select("needle").where(F.col("needle") != "").distinct().withColumn("size", F.least(F.size(F.split("needle", "")), F.lit(PIECE)))
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # three values at most
    if not sizes:
        return texts.select(F.lit(None).cast("string").alias("needle"), "text").where(F.lit(False))
    of = lambda c, k: _pieces(F.col(c), k)
    asked = own.select("needle", F.explode(F.coalesce(*[F.when(F.col("size") == k, of("needle", k)) for k in sizes])).alias("piece"))
    held = texts.select("text").where(F.col("text").isNotNull()).distinct().select("text", F.explode(F.concat(*[of("text", k) for k in sizes])).alias("piece"))
    held = held.join(asked.select("piece").distinct(), "piece", "left_semi")
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "piece", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("x"))
    seeds = rarest.where("x.n > 0").select("needle", F.col("x.piece").alias("piece"))
    return seeds.join(held, "piece").where(F.contains("text", F.col("needle"))).select("needle", "text")


def _key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def either_way(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right): distinct pairs of values of `left.left` and `right.right` of which one contains the other."""
    a, b = left.select("left"), right.select("right")
    forth = contained(a.select(F.col("left").alias("needle")), b.select(F.col("right").alias("text"))).select(F.col("needle").alias("left"), F.col("text").alias("right"))
    back = contained(b.select(F.col("right").alias("needle")), a.select(F.col("left").alias("text"))).select(F.col("text").alias("left"), F.col("needle").alias("right"))
    return forth.union(back).distinct()


def find_people(people: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """For each distinct name the person (person, cases) that it means: the same one, else the one with most cases whose name contains it or lies in it, ties by name.

    A table of names at once: (name, person, cases), without names that are blank or mean nobody.
    """
    asked = names.select(F.col(name).alias("name"), _key(F.col(name)).alias("left")).where("left <> ''").distinct()
    near = either_way(asked, people.select(F.col("person").alias("right")))
    known = people.select(F.col("person").alias("right"), "cases")
    best = near.join(known, "right").groupBy("left").agg(F.min(F.struct((F.col("left") != F.col("right")).alias("other"), (-F.col("cases")).alias("minus"), F.col("right").alias("person"))).alias("x"))
    return asked.join(best, "left").select("name", "x.person", (-F.col("x.minus")).alias("cases"))


def cases_of_names(cases: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """(name, id): each case that has one of the names as a part of a participant, plaintiff, defendant, judge or the parties, once for each distinct name."""
    asked = names.select(F.col(name).alias("name"), F.lower(F.trim(F.col(name))).alias("needle")).where("needle <> ''").distinct()
    flat = F.array(*[F.col(c) for c in ("plaintiff", "defendant", "judge", "parties")])
    each = cases.select("id", F.explode(F.array_distinct(F.concat(flat, F.coalesce(F.transform("participants", lambda p: p["name"]), F.array().cast("array<string>"))))).alias("raw"))
    mentions = each.select("id", F.lower("raw").alias("text")).where("text <> ''")
    met = contained(asked, mentions)
    return met.join(mentions, "text").join(asked, "needle").select("name", "id").distinct()


def resolve_table(found: DataFrame, queries: DataFrame, query: str = "query", limit: int = 20) -> DataFrame:
    """(query, key, canonical, case_count, score, place): for each distinct query the records of `lookup.mentions` that fit it, best first.

    100 for its key, 50 for a part of the canonical form, 30 for a part of either key and 20 for each alias that holds it,
    added up; ties by cases, then key. Mentions and queries are written once, as each is asked for several times.
    """
    found = cut(found.select("key", "canonical", "alias", "id"))
    asked = queries.select(F.trim(query).alias("query"), F.lower(F.trim(query)).alias("needle"), entity(F.trim(query))["key"].alias("own")).where("needle <> ''").distinct()
    asked = cut(asked)
    known = found.groupBy("key").agg(F.min_by("canonical", "id").alias("canonical"), F.count("*").alias("case_count"))
    forms, aliases = known.select("key", F.lower("canonical").alias("text")), found.select("key", "alias", F.lower("alias").alias("text")).distinct()
    pair = asked.select("query", "needle")
    same = asked.where(F.col("own").isNotNull()).join(known, F.col("own") == F.col("key")).select("query", "key", F.lit(100).alias("points"))
    by_form = contained(asked, forms).join(forms, "text").join(pair, "needle").select("query", "key", F.lit(50).alias("points"))
    by_key = either_way(asked.select(F.col("needle").alias("left")), known.select(F.col("key").alias("right"))).select(F.col("left").alias("needle"), F.col("right").alias("key"))
    by_key = by_key.join(pair, "needle").select("query", "key", F.lit(30).alias("points"))
    by_alias = contained(asked, aliases).join(aliases, "text").join(pair, "needle").select("query", "key", F.lit(20).alias("points"))
    scored = same.union(by_form).union(by_key).union(by_alias).groupBy("query", "key").agg(F.sum("points").cast("int").alias("score"))
    ranked = scored.join(known, "key").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("case_count"), "key")))
    return ranked.where(F.col("place") <= limit).select("query", "key", "canonical", "case_count", "score", "place")
