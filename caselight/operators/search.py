"""Searches over the catalogue and the text index together, and plans of searches for a person."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ListRequest, list_page
from .containment import contained
from .fulltext import Index, search
from .lookup import CLEAR, search_courts

#: Courts of a person's search, catalogue rows, texts and characters of a text that it shows, and the categories that it goes through.
COURTS, ROWS, TEXTS, SHOWN = 5, 30, 15, 500
CATEGORIES = (5, 4, 41)
#: Kinds of courts in the order in which a person's search takes them.
KINDS = ("vs", "oblsud", "ray", "garb", "other")


def with_region(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Text hits (case_uid, ...) with `region`: of the case with that id, else of the newest one whose uid contains it, in any case of letters."""
    asked = hits.select("case_uid", F.lower("case_uid").alias("needle")).where(F.col("case_uid").isNotNull()).distinct()
    own = cases.select(F.col("id").alias("case_uid"), F.struct("courtRegion").alias("__own"))
    uids = cases.where(F.col("caseUid").isNotNull()).select(F.lower("caseUid").alias("text"), "courtRegion", "collectedAt", "id")
    near = contained(asked, uids).join(uids, "text").groupBy("needle").agg(F.max_by(F.struct("courtRegion"), F.struct("collectedAt", "id")).alias("__near"))
    near = asked.join(near, "needle").select("case_uid", "__near")
    return hits.join(own, "case_uid", "left").join(near, "case_uid", "left").withColumn("region", F.coalesce("__own", "__near")["courtRegion"]).drop("__own", "__near")


def collected(index: DataFrame | Index, chunks: DataFrame, cases: DataFrame, r: ListRequest, chunk_col: str = "chunk_id", stop_words: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The catalogue's page and the texts for one request; the limit is 1 to 50.

    The best texts come first and are then held against court (a part of its name), case number and region, so fewer may
    be left. chunks: (chunk_col, case_uid, court, case_number, text, ...).
    """
    n = min(50, max(1, r.limit))
    page = list_page(cases, ListRequest(**{**r.__dict__, "limit": n, "offset": 0, "hearing_from": None, "hearing_to": None}))
    hits = search(index, chunk_col, r.q or "", n, stop_words, about=chunks)
    if r.of("court"):
        hits = hits.where(F.contains(F.lower(F.coalesce("court", F.lit(""))), F.lit(r.of("court").lower())))
    if r.of("case_number"):
        hits = hits.where(F.col("case_number") == r.of("case_number"))
    if r.of("region"):
        hits = with_region(hits, cases).where(F.col("region") == r.of("region"))
    return page, hits


def pick_courts(courts: DataFrame, queries: list[str], most: int = COURTS, **how) -> DataFrame:
    """The courts of several queries, supreme and regional ones first, then by score; ambiguous if the first two are closer than 40."""
    parts = [search_courts(courts, q, **how).withColumn("__query", F.lit(i)) for i, q in enumerate(queries) if q and q.strip()]
    if not parts:
        return courts.limit(0).withColumns({"score": F.lit(0), "ambiguous": F.lit(False)})
    code = how.get("code", "subdomain")
    both = reduce(DataFrame.unionByName, parts)
    first = both.groupBy(code).agg(F.min_by(F.struct(*[c for c in both.columns if c not in (code, "__query")]), "__query").alias("x")).select(code, "x.*")
    kind = how.get("kind", "type")
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])[F.col(kind)], F.lit(len(KINDS))) if kind else F.lit(0)
    best = first.withColumn("__rank", rank).orderBy("__rank", F.desc("score"), code).limit(most)
    two = best.agg(F.array_sort(F.collect_list(F.struct("__rank", (-F.col("score")).alias("minus"), code))).alias("x"))  # `most` rows
    unclear = two.select(F.coalesce((F.size("x") > 1) & (F.get("x", F.lit(1))["minus"] - F.get("x", F.lit(0))["minus"] < CLEAR), F.lit(False)).alias("ambiguous"))
    return best.crossJoin(F.broadcast(unclear)).drop("__rank")


def participant_search(name: str, index: DataFrame | Index, chunks: DataFrame, cases: DataFrame, courts: DataFrame, region: str | None = None, chunk_col: str = "chunk_id", **how) -> dict[str, DataFrame]:
    """What is known of a person by name: `courts` for a deep search, `cases` (30) with their total, and `texts` (15) cut to 500 characters."""
    texts = search(index, chunk_col, name.strip(), TEXTS, about=chunks).withColumn("text", F.substring("text", 1, SHOWN))
    return {"courts": pick_courts(courts, [region or "", name], **how), "cases": list_page(cases, ListRequest(q=name.strip(), limit=ROWS)), "texts": texts}


def deep_search(courts: DataFrame, categories: DataFrame, results: DataFrame) -> DataFrame:
    """The results (court, category, caseNumber, caseUid, ...) of every court and category that is asked, each case of a court once: the first by category's place."""
    plan = courts.select("court").crossJoin(F.broadcast(categories.select("category", "place")))  # a few courts and three categories
    met = results.join(plan, ["court", "category"])
    key = ["court", "caseNumber", F.coalesce("caseUid", F.lit("")).alias("__uid")]
    rest = [c for c in met.columns if c not in ("court", "caseNumber")]
    return met.groupBy(*key).agg(F.min(F.struct("place", *[c for c in rest if c != "place"])).alias("x")).select("court", "caseNumber", "x.*").drop("place")


def with_courts(hearings: DataFrame, courts: DataFrame, name: Column, region: Column) -> DataFrame:
    """Hearings (court, ...) with the court's registry row; for an unknown court a default one with the given name and region."""
    known = courts.select(F.col("subdomain").alias("court"), F.struct("name", "region", "type", "vnkod", "captcha", "http").alias("__c"))
    default = F.struct(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.col("court")).alias("name"), region.alias("region"), F.lit("ray").alias("type"), F.lit("").alias("vnkod"), F.lit(True).alias("captcha"), F.lit(True).alias("http"))
    return hearings.join(F.broadcast(known), "court", "left").withColumn("registry", F.coalesce("__c", default)).drop("__c")  # the registry is a small dimension


def search_params(category: Column, filters: dict[str, Column]) -> Column:
    """The form fields of a court's search, as a map: category (delo_id, case_type, prefix), filters by name; absent and empty ones are left out."""
    low, up = category["prefix"], F.upper(category["prefix"])
    civil = category["delo_id"].isin(5, 2800001)
    # The form's field names.
    fixed = {"name": F.lit("sud_delo"), "srv_num": F.lit("1"), "name_op": F.lit("sr"), "nc": F.lit("1"), "delo_id": category["delo_id"].cast("string"), "case_type": category["case_type"].cast("string"), "delo_table": F.concat(low, F.lit("case")), "Submit": F.lit("Искать")}
    named = {"case_number": (low, "case__CASE_NUMBERSS"), "uid": (low, "case__JUDICIAL_UIDSS"), "inn": (up, "PARTS__INN_STRSS"), "kpp": (up, "PARTS__KPP_STRSS"), "ogrn": (up, "PARTS__OGRN_STRSS"), "judge": (up, "CASE__JUDGE"), "entry_from": (low, "case__ENTRY_DATE1D"), "entry_to": (low, "case__ENTRY_DATE2D"), "result_from": (low, "case__RESULT_DATE1D"), "result_to": (low, "case__RESULT_DATE2D"), "law_article": (up, "DEFENDANT__LAW_ARTICLESS")}
    pairs = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fixed.items()]
    pairs += [F.struct(F.concat(p, F.lit(n)).alias("k"), filters[f].alias("v")) for f, (p, n) in named.items() if f in filters]
    if "participant" in filters:
        pairs.append(F.struct(F.concat(up, F.when(civil, "PARTS__NAMESS").otherwise("DEFENDANT__NAMESS")).alias("k"), filters["participant"].alias("v")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: F.coalesce(x["v"], F.lit("")) != ""))

