"""Resolution of organisations and courts by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import entity, looks_like_organisation, parties


#: Aliases and cases that an answer lists.
ALIASES, CASES = 12, 50


def entities(rows: DataFrame, raw: str, seq: str, case: str) -> DataFrame:
    """Per match key: the first canonical form, distinct aliases and cases, from rows that `entity` understands."""
    named = rows.select(entity(F.col(raw)).alias("e"), F.col(raw).alias("alias"), seq, case).where("e is not null").select("e.*", "alias", seq, case)
    return named.groupBy("key").agg(F.min_by("canonical", seq).alias("canonical"), F.count_distinct("alias").alias("aliases"), F.count_distinct(case).alias("cases"))


def mentions(cases: DataFrame) -> DataFrame:
    """(key, canonical, form, alias, id, at, region, court): organisations in plaintiff, defendant, parts of parties and participants; of each key a case's first mention."""
    names = F.concat(
        F.filter(F.array("plaintiff", "defendant"), lambda n: F.coalesce(n, F.lit("")) != ""), parties(F.col("parties")),
        F.filter(F.transform(F.coalesce("participants", F.array()), lambda p: p["name"]), lambda n: F.coalesce(n, F.lit("")) != ""),
    )
    each = cases.select("id", F.coalesce("courtRegion", F.lit("—")).alias("region"), F.col("courtSubdomain").alias("court"), F.posexplode(names).alias("at", "raw")).where(looks_like_organisation(F.col("raw")))
    named = each.withColumn("e", entity(F.col("raw"))).where("e is not null").select("e.*", F.trim("raw").alias("alias"), "id", "at", "region", "court")
    return named.groupBy("key", "id").agg(F.min_by(F.struct("canonical", "form", "alias", "at", "region", "court"), "at").alias("x")).select("key", "id", "x.*")


def records(found: DataFrame) -> DataFrame:
    """Per key, from `mentions`: canonical form and legal form as first seen, numbers of cases, aliases, regions and courts, and the lists of regions and courts.

    First seen goes by the case's id. Lists are of distinct values, each with its first place.
    """
    base = found.groupBy("key").agg(F.min_by(F.struct("canonical", "form"), "id").alias("x"), F.count("*").alias("case_count"))
    out = base.select("key", "x.*", "case_count").join(found.groupBy("key").agg(F.count_distinct("alias").alias("alias_count")), "key")
    for column in ("region", "court"):
        seen = found.groupBy("key", column).agg(F.min("id").alias("first"))
        out = out.join(seen.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", column))), lambda x: x[column]).alias(f"{column}s")), "key")
    return out


def first_values(found: DataFrame, column: str, most: int) -> DataFrame:
    """(key, values): each key's first distinct values of a column by the case's id, `most` at most; ranked before they are collected."""
    seen = found.groupBy("key", column).agg(F.min("id").alias("__first"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("__first", column))
    kept = seen.withColumn("__rank", rank).where(F.col("__rank") <= most)
    return kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", column))), lambda x: x[column]).alias("values"))


def resolve_records(found: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Records that fit a query, best first: 100 for its key, 50 for a part of the canonical form, 30 for a part of either key and 20 for each alias that holds it, added up; with 12 aliases and 50 cases of each."""
    text = query.strip()
    known = records(found)
    q = F.lit(text.lower())
    aliases = found.where(F.contains(F.lower("alias"), q)).groupBy("key").agg((20 * F.count_distinct("alias")).alias("by_alias"))
    key = entity(F.lit(text))["key"]
    score = F.when(F.col("key") == key, 100).otherwise(0) + F.when(F.contains(F.lower("canonical"), q), 50).otherwise(0) + F.when(F.contains("key", q) | F.contains(q, F.col("key")), 30).otherwise(0) + F.coalesce("by_alias", F.lit(0))
    best = known.join(aliases, "key", "left").withColumn("score", score.cast("int")).where("score > 0").drop("by_alias").orderBy(F.desc("score"), F.desc("case_count"), "key").limit(limit)
    mine = found.join(F.broadcast(best.select("key")), "key")  # `limit` keys
    return best.join(first_values(mine, "alias", ALIASES).withColumnRenamed("values", "aliases"), "key").join(first_values(mine.select("key", "id", F.col("id").alias("case")), "case", CASES).withColumnRenamed("values", "case_ids"), "key")


def entity_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("entities"), F.count_if(F.col("alias_count" if "alias_count" in index.columns else "aliases") > 1).alias("with_aliases"))


def resolve(index: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Entities by the same score as `resolve_records`, without aliases; ties by cases, then key."""
    q = index.sparkSession.range(1).select(F.coalesce(entity(F.lit(query))["key"], F.lower(F.trim(F.lit(query)))).alias("k"), F.lower(F.trim(F.lit(query))).alias("q"))
    rows = index.crossJoin(F.broadcast(q))  # one row
    score = F.when(F.col("key") == F.col("k"), 100).otherwise(0) + F.when(F.contains(F.lower("canonical"), F.col("q")), 50).otherwise(0) + F.when(F.contains("key", F.col("q")) | F.contains("q", F.col("key")), 30).otherwise(0)
    return rows.withColumn("score", score).where("score > 0").drop("q", "k").orderBy(F.desc("score"), F.desc("cases"), "key").limit(limit)


#: Words of a court's name that say nothing, and hints at a region.
COURT_STOPS = "суд районный городской межрайонный мировой участок г города город области область края край республики республика рф рф. первой инстанции".split()
REGION_HINTS = ((r"мордов", "13"), (r"саранск", "13"), (r"адыге", "1"), (r"башкорт|уф[ае]", "2"), (r"дагестан", "5"), (r"москв", "77"), (r"петербург|спб|ленинград", "78"))
COURT_RANKS = {"oblsud": 5, "vs": 4, "ray": 3, "garb": 2, "other": 1}
#: A best hit below the first is none; one that leads by less than the second is ambiguous.
FOUND, CLEAR = 30, 40


def _norm(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(col), "ё", "е"), r"\s+", " "))


def _has_word(name: Column, token: str) -> Column:
    """The token as a word of the name; from five characters also as the beginning of one, or one as its beginning."""
    whole = name.rlike(f"(?:^|[^a-zа-яё0-9]){re.escape(token)}(?:[^a-zа-яё0-9]|$)")
    if len(token) < 5:
        return whole
    words = F.filter(F.split(name, "[^a-zа-яё0-9]+"), lambda w: w != "")
    near = F.exists(words, lambda w: w.startswith(token) | F.startswith(F.lit(token), w))
    return F.contains(name, F.lit(token)) & (whole | near)


def search_courts(courts: DataFrame, query: str, limit: int = 10, name: str = "name", code: str = "subdomain", region: str = "region", kind: str | None = "type", hints: tuple[tuple[str, str], ...] = REGION_HINTS, stops: list[str] = COURT_STOPS, collation: str | None = "ru") -> DataFrame:
    """Courts by score: 1000 for the code, 500 for the name or 200 for a phrase of it, 40 a word of the name or 15 of the code, 80 for all words, 60 for a hinted region, and the kind's rank for short queries."""
    q = re.sub(r"\s+", " ", query.lower().replace("ё", "е")).strip()
    if not q:
        return courts.withColumn("score", F.lit(0)).limit(0)
    tokens = [t for t in re.split(r"[^a-zа-яё0-9]+", q) if len(t) >= 2 and t not in stops]
    title, place = _norm(F.col(name)), F.regexp_replace(_norm(F.col(code)), "--", " ")
    score = F.when(title == q, 500).when(F.contains(title, F.lit(q)) & F.lit(len(q) >= 8), 200).otherwise(0)
    matched = F.lit(0)
    for t in tokens:
        in_title, in_place = _has_word(title, t), _has_word(place, t)
        score = score + F.when(in_title, 40).when(in_place, 15).otherwise(0)
        matched = matched + F.when(in_title | in_place, 1).otherwise(0)
    if tokens:
        score = score + F.when(matched == len(tokens), 80).otherwise(0)
    hinted = [r for p, r in hints if re.search(p, query, re.I)]
    if hinted:
        score = score + F.when(F.col(region).cast("string").isin(hinted), 60).otherwise(0)
    if kind and len(tokens) <= 2 and not re.search("суд|район|город", q):
        score = score + F.coalesce(F.create_map(*[F.lit(x) for p in COURT_RANKS.items() for x in p])[F.col(kind)], F.lit(0))
    scored = courts.withColumn("score", F.when(_norm(F.col(code)) == q, 1000).otherwise(score)).where("score > 0")
    tie = F.collate(F.col(name), collation) if collation else F.col(name)
    return scored.orderBy(F.desc("score"), tie, code).limit(limit)


def best_court(courts: DataFrame, query: str, **how) -> DataFrame:
    """The best hit of 30 or more, if any, with `ambiguous` if the next one is closer than 40."""
    two = search_courts(courts, query, 2, **how)
    return two.withColumn("second", F.lead("score").over(Window.orderBy(F.desc("score")))).withColumn("ambiguous", F.coalesce(F.col("score") - F.col("second") < CLEAR, F.lit(False))).orderBy(F.desc("score")).limit(1).where(F.col("score") >= FOUND).drop("second")
