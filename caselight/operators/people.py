"""People across cases: index, facets, ratings, heat maps, dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import duration_days, record_date
from ..functions.names import SKIP, category_head, clean_name, family_matches, is_masked, representative_kind, role_family, role_matches
from ..functions.text import collapse, pattern, present, slug
from ..session import cut

#: Families of roles, the one that names a person first.
FAMILIES = ("representative", "plaintiff", "defendant", "third", "judge", "other")
#: Case numbers and courts that an index shows of each person, categories and cases of a dossier.
NUMBERS, COURTS, CATEGORIES, CASES, MOST_CASES = 5, 4, 20, 80, 200


def appearances_of(cases: DataFrame) -> DataFrame:
    """(name, role, family, case_id, court, number, act, enriched, at): participants of cases, and plaintiff, defendant and judge of the flat fields; placeholders are left out."""
    flat = [F.struct(F.col(c).alias("name"), F.lit(role).alias("role"), F.lit(family).alias("family")) for c, role, family in (("plaintiff", "ИСТЕЦ", "plaintiff"), ("defendant", "ОТВЕТЧИК", "defendant"), ("judge", "СУДЬЯ", "judge"))]
    card = F.transform(F.coalesce("participants", F.array()), lambda p: F.struct(p["name"].alias("name"), F.coalesce(F.nullif(p["role"], F.lit("")), F.lit("?")).alias("role"), role_family(p["role"]).alias("family")))
    each = cases.select("id", "caseNumber", "courtSubdomain", "hasActText", "enrichedAt", F.posexplode(F.concat(card, F.array(*flat))).alias("at", "p"))
    named = each.withColumn("n", collapse(F.col("p.name"))).withColumn("name", clean_name(F.col("n"), True)).drop("n")
    # As a generated row: a filter of the name itself would move below the projections and judge each name twice, collapsed for each rule.
    named = named.select(F.explode_outer(F.array(F.struct("*"))).alias("x")).where("x.name IS NOT NULL").select("x.*")
    return named.select("name", collapse(F.col("p.role")).alias("role"), "p.family", F.col("id").alias("case_id"), F.col("courtSubdomain").alias("court"), F.col("caseNumber").alias("number"), F.coalesce("hasActText", F.lit(False)).alias("act"), present(F.col("enrichedAt")).alias("enriched"), "at")


def full_index(found: DataFrame) -> DataFrame:
    """Per person, from `appearances_of`: index columns, roles, cases with acts and enriched, first case numbers and courts by case id, and person_id.

    Counts are by person and case first, then by person and court, which is cut. The first case numbers are limited where
    the rows are made, and roles and courts are made distinct first, so no group grows with its cases.
    """
    rows = found.withColumn("person", F.lower("name"))
    families = [F.max(F.col("family") == f).alias(f) for f in FAMILIES]
    by_case = rows.groupBy("person", "case_id").agg(F.count("*").alias("n"), F.min(F.struct("at", "name")).alias("said"), F.min("court").alias("court"), F.max("act").alias("act"), F.max("enriched").alias("enriched"), *families)
    first = F.min(F.struct("case_id", "said")).alias("first")
    by_court = cut(by_case.groupBy("person", "court").agg(F.sum("n").alias("n"), F.count("*").alias("cases"), F.count_if("act").alias("with_acts"), F.count_if("enriched").alias("enriched_cases"), first, *[F.max(f).alias(f) for f in FAMILIES]))
    sums = by_court.groupBy("person").agg(
        F.min("first")["said"]["name"].alias("name"), F.sum("n").alias("appearances"), F.sum("cases").alias("cases"), F.count("court").alias("courts"), F.sum("with_acts").alias("with_acts"), F.sum("enriched_cases").alias("enriched_cases"), *[F.max(f).alias(f) for f in FAMILIES]
    )
    held = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in FAMILIES]), lambda x: x.isNotNull())
    out = sums.withColumns({"families": held, "primary_family": held[0], "person_id": F.concat(F.lit("p:"), slug(F.col("name")))}).drop(*FAMILIES)

    of_person = Window.partitionBy("person")
    shown = lambda ranked_, column, name: ranked_.groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", column))), lambda x: x[column]).alias(name))
    few = rows.select("person", "case_id", "number", "at").withColumn("__i", F.dense_rank().over(of_person.orderBy("case_id"))).where(F.col("__i") <= NUMBERS)
    numbers = shown(few.groupBy("person", "__i").agg(F.min_by("number", "at").alias("number")), "number", "numbers")
    courts = shown(by_court.select("person", "court", F.row_number().over(of_person.orderBy("first.case_id")).alias("__i")).where(F.col("__i") <= COURTS), "court", "first_courts")
    roles = rows.select("person", "role").distinct().groupBy("person").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    for more in (roles, numbers, courts):
        out = out.join(more, "person")
    return out


def index(appearances: DataFrame) -> DataFrame:
    """Per person, from (name, family, case_id, court): appearances, distinct cases and courts, families and the primary one.

    First one row for each person and case, then one for each person: no group is collected.
    """
    by_case = appearances.groupBy(F.lower("name").alias("person"), "case_id").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.min("court").alias("court"), *[F.max(F.col("family") == f).alias(f) for f in FAMILIES])
    out = by_case.groupBy("person").agg(F.min("name").alias("name"), F.sum("n").alias("appearances"), F.count("*").alias("cases"), F.count_distinct("court").alias("courts"), *[F.max(f).alias(f) for f in FAMILIES])
    held = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in FAMILIES]), lambda x: x.isNotNull())
    return out.select("person", "name", "appearances", "cases", "courts", held.alias("families"), held[0].alias("primary_family"))


def facets(people: DataFrame) -> DataFrame:
    """(family, people, appearances): every family, also empty ones."""
    counted = people.select(F.explode("families").alias("family"), "appearances").groupBy("family").agg(F.count("*").alias("people"), F.sum("appearances").alias("appearances"))
    every = people.sparkSession.createDataFrame([(f,) for f in FAMILIES], "family string")
    return F.broadcast(every).join(counted, "family", "left").na.fill(0)


def professional_rating(cases: Column, courts: Column, acts: Column, enriched: Column, documents: Column, categories: Column, regions: Column, lawyer: Column) -> Column:
    """55 to 99: capped factors, summed and scaled."""
    factors = F.least(cases * 3, F.lit(28)) + F.least(courts * 2, F.lit(12)) + F.least(acts, F.lit(10)) + F.least(enriched, F.lit(12)) + F.least(F.floor(documents / 2), F.lit(8)) + F.least(categories, F.lit(6))
    factors = factors + F.when(regions > 1, 4).when(regions == 1, 1).otherwise(0) + F.when(lawyer, 6).otherwise(4)
    return F.least(F.lit(99), F.greatest(F.lit(55), F.floor(55 + factors * 0.45 + 0.5))).cast("int")


def professional_tier(rating: Column) -> Column:
    return F.when(rating >= 88, "gold").when(rating >= 78, "silver").when(rating >= 68, "bronze").otherwise("common")


def dossier_rating(cases: Column, win_rate: Column, acts: Column) -> Column:
    return F.least(F.lit(99), F.least(F.lit(90), 40 + cases * 2 + acts) + F.coalesce(F.floor(win_rate * 20 + 0.5), F.lit(0))).cast("int")


def dossier_tier(cases: Column, win_rate: Column) -> Column:
    return F.when((cases >= 20) & (F.coalesce(win_rate, F.lit(0.0)) >= 0.55), "gold").when(cases >= 10, "silver").when(cases >= 4, "bronze").otherwise("common")


def main_value(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """(key, value, n): each key's most frequent value, the first seen on ties."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(seq).alias("seen"))
    best = counts.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("m"), "seen", value)).alias("b"))
    return best.select(key, f"b.{value}", "b.n")


def heat(rows: DataFrame, place: str, person: str) -> DataFrame:
    """Per place: appearances, distinct people, and the share of the largest place's appearances."""
    out = rows.groupBy(place).agg(F.count("*").alias("appearances"), F.count_distinct(person).alias("people"))
    top = out.agg(F.max("appearances").alias("top"))
    return out.crossJoin(F.broadcast(top)).select(place, "appearances", "people", (F.col("appearances") / F.col("top")).alias("intensity"))  # top is one row


def matrix(rows: DataFrame, person: str, place: str, most_people: int = 18, places: DataFrame | None = None) -> DataFrame:
    """(person, place, n) for the people with most appearances and all places, 0 where a person doesn't appear."""
    top = rows.groupBy(person).agg(F.count("*").alias("total")).orderBy(F.desc("total"), person).limit(min(40, max(5, most_people))).select(person)
    where = (places if places is not None else rows.select(place)).select(place).distinct()
    counts = rows.join(F.broadcast(top), person).groupBy(person, place).agg(F.count("*").alias("n"))
    grid = where.crossJoin(F.broadcast(top))  # 40 people at most
    return grid.join(counts, [person, place], "left").select(person, place, F.coalesce("n", F.lit(0)).alias("n"))


def totals(rows: DataFrame, kind: str, person: str) -> DataFrame:
    """Distinct people and appearances of each kind, and of all (kind null)."""
    return rows.groupingSets([[F.col(kind)], []], F.col(kind)).agg(F.count_distinct(person).alias("people"), F.count("*").alias("appearances"))


def representatives(cases: DataFrame) -> DataFrame:
    """(name, person, kind, court, court_name): one row for each representative on a case's card; placeholders are left out."""
    each = cases.select("courtSubdomain", F.coalesce(F.nullif("courtName", F.lit("")), "courtSubdomain").alias("court_name"), F.explode("participants").alias("p"))
    rows = each.select(collapse(F.coalesce("p.name", F.lit(""))).alias("name"), representative_kind(F.col("p.role")).alias("kind"), F.col("courtSubdomain").alias("court"), "court_name")
    keep = F.col("kind").isNotNull() & ~F.col("name").rlike(pattern(SKIP)) & ~is_masked(F.col("name"), True)
    # As a generated row: a filter would move below the projection and collapse the name again for each of its rules.
    rows = rows.select(F.explode_outer(F.array(F.struct("*", keep.alias("keep")))).alias("x")).where("x.keep").select("x.name", "x.kind", "x.court", "x.court_name")
    return rows.withColumn("person", F.concat(F.lit("p:"), slug(F.col("name"))))


def representative_heat(cases: DataFrame) -> DataFrame:
    """(court, appearances, people, a pair of both for each kind, intensity): courts without representatives too."""
    kinds = ("representative", "advocate", "jurist")
    of = lambda k: F.when(F.col("kind") == k, F.col("person"))
    by = representatives(cases).groupBy("court").agg(F.count("*").alias("appearances"), F.count_distinct("person").alias("people"), *[c for k in kinds for c in (F.count(of(k)).alias(f"{k}_appearances"), F.count_distinct(of(k)).alias(f"{k}_people"))])
    every = cases.select(F.col("courtSubdomain").alias("court")).distinct()
    out = every.join(by, "court", "left").na.fill(0)
    top = out.agg(F.greatest(F.max("appearances"), F.lit(1)).alias("top"))
    return out.crossJoin(F.broadcast(top)).withColumn("intensity", F.col("appearances") / F.col("top")).drop("top")  # top is one row


def find(people: DataFrame, q: str | None = None, family: str | None = None, least: int = 1) -> DataFrame:
    """People with a part of their name, a family or role and a number of cases."""
    where = F.col("cases") >= least
    if q and q.strip():
        where &= F.contains("person", F.lit(q.strip().lower()))
    if family and family != "all":
        kinds = [f for f in FAMILIES if family_matches(f, family)]
        hit = F.arrays_overlap("families", F.array(*[F.lit(f) for f in kinds])) if kinds else F.lit(False)
        where &= hit | F.exists("roles", lambda r: role_matches(r, family)) if "roles" in people.columns else hit
    return people.where(where)


def find_person(people: DataFrame, name: str) -> DataFrame:
    """The person of a name, else the one with most cases whose name contains it or lies in it; at most one row."""
    key = " ".join(name.split()).lower()
    if not key:
        return people.limit(0)
    same = F.col("person") == key
    near = same | F.contains("person", F.lit(key)) | F.contains(F.lit(key), F.col("person"))
    return people.where(near).orderBy(F.desc(same), F.desc("cases"), "person").limit(1)


def has_participant(name: str, role: str | None = None) -> Column:
    """Whether a case has a person by a part of the name in a role: among its participants, or in the flat fields that the role admits."""
    n, wanted = name.lower(), role if role and role != "all" else None
    part = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(n))
    out = F.exists(F.coalesce("participants", F.array()), lambda p: part(p["name"]) & role_matches(p["role"], wanted))
    for field in ("plaintiff", "defendant", "judge"):
        if wanted is None or family_matches(field, wanted):
            out |= part(F.col(field))
    return out | part(F.col("parties")) if wanted is None else out


def cases_of(cases: DataFrame, name: str, role: str | None = None, limit: int = 50) -> DataFrame:
    """Cases with a person, by id; none for a blank name."""
    return cases.where(has_participant(name.strip(), role)).orderBy("id").limit(limit) if name.strip() else cases.limit(0)


def role_on_case(name: str) -> Column:
    """The role in which a case has a person: of the first participant whose name contains it or lies in it, else by the flat fields, else `?`."""
    n = name.lower()
    part = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(n))
    met = F.filter(F.coalesce("participants", F.array()), lambda p: part(p["name"]) | F.contains(F.lit(n), F.lower(F.coalesce(p["name"], F.lit("")))))
    first = F.when(F.size(met) > 0, F.trim(F.coalesce(F.nullif(F.get(met, F.lit(0))["role"], F.lit("")), F.lit("?"))))
    return F.coalesce(first, F.when(part(F.col("plaintiff")), "ИСТЕЦ").when(part(F.col("defendant")), "ОТВЕТЧИК").when(part(F.col("judge")), "СУДЬЯ"), F.lit("?"))


def person_dossier(facts: DataFrame, name: str, role: str | None = None, limit: int = CASES, suffix: str = "--mor", code: str = "13") -> dict[str, DataFrame]:
    """One person's dossier over `cases.facts`: `summary` (one row with counts, win rate, median days, rating, tier), `outcomes`, `courts`, `categories` (20), `years`, `regions`, `factors` and `cases` (200 at most), the newest first."""
    mine = facts.where(has_participant(name, role))
    region = F.coalesce(F.nullif("courtRegion", F.lit("")), F.when(F.lower("courtSubdomain").endswith(suffix), F.lit(code)))
    year = F.coalesce(F.year(record_date(F.col("entryDate"))).cast("string"), F.nullif(F.regexp_extract(F.coalesce("caseNumber", F.lit("")), r"/(20\d{2})", 1), F.lit("")))
    days = duration_days(record_date(F.col("entryDate")), record_date(F.col("resultDate")), 3999)
    won, lost = F.col("outcome").isin("granted", "granted_partial"), F.col("outcome") == "denied"
    sums = mine.select("*", days.alias("__days"), region.alias("__region")).agg(
        F.count("*").alias("cases"), F.count_distinct("courtSubdomain").alias("courts"), F.count_if(F.coalesce("hasActText", F.lit(False))).alias("with_acts"), F.count_if(present(F.col("enrichedAt"))).alias("enriched_cases"),
        F.count_if(F.col("outcome") != "unknown").alias("known"), F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"), F.count_if((F.col("outcome") != "unknown") & ~won & ~lost).alias("neutrals"), F.median("__days").alias("median_days"), F.count_distinct("__region").alias("regions"),
    )
    sums = sums.withColumn("win_rate", F.when(F.col("wins") + F.col("losses") > 0, F.col("wins") / (F.col("wins") + F.col("losses"))))
    sums = sums.withColumns({"rating": dossier_rating(F.col("cases"), F.col("win_rate"), F.col("with_acts")), "tier": dossier_tier(F.col("cases"), F.col("win_rate"))})
    # Factors of a dossier with their highest scores.
    scores = {"cases": (F.col("cases") * 2, 28), "courts": (F.col("courts") * 2, 12), "acts": (F.col("with_acts"), 10), "enriched": (F.col("enriched_cases"), 12), "win": (F.coalesce(F.floor(F.col("win_rate") * 16 + 0.5), F.lit(0)), 16), "geo": (F.col("regions") * 2, 6)}
    factors = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.least(v.cast("long"), F.lit(m).cast("long")).alias("score"), F.lit(m).alias("max")) for k, (v, m) in scores.items()])).alias("x")).select("x.*")
    count = lambda key, name_: mine.groupBy(key.alias(name_)).agg(F.count("*").alias("n"))
    shown = mine.orderBy(F.desc(F.coalesce(F.nullif("enrichedAt", F.lit("")), "collectedAt")), "id").limit(min(limit, MOST_CASES))
    shown = shown.select("id", "caseNumber", "courtSubdomain", "courtName", category_head(F.col("category")).alias("category"), "status", role_on_case(name).alias("role"), "hasActText", present(F.col("enrichedAt")).alias("enriched"), "outcome", "entryDate", "resultDate", "judge")
    return {
        "summary": sums, "outcomes": count(F.col("outcome"), "outcome"), "courts": count(F.col("courtSubdomain"), "court"), "categories": count(category_head(F.col("category")), "category").orderBy(F.desc("n"), "category").limit(CATEGORIES),
        "years": count(year, "year").where("year is not null"), "regions": count(region, "region").where("region is not null"), "factors": factors, "cases": shown,
    }


def dossier(rows: DataFrame, name: str, facts: list[str]) -> dict[str, DataFrame]:
    """One person's cases, from (name, case_id, court, category, outcome, duration_days, entry, ...): the rows, and counts by outcome, court, category and year."""
    mine = rows.where(F.contains(F.lower("name"), F.lit(name.lower())) | F.contains(F.lit(name.lower()), F.lower("name")))
    mine = mine.groupBy("case_id").agg(F.min(F.struct(*[c for c in mine.columns if c != "case_id"])).alias("x")).select("case_id", "x.*")  # the same row of a case each time
    by = {c: mine.groupBy(c).agg(F.count("*").alias("n")) for c in facts}
    wins, losses = F.count_if(F.col("outcome").isin("granted", "granted_partial")), F.count_if(F.col("outcome") == "denied")
    summary = mine.agg(F.count("*").alias("cases"), wins.alias("wins"), losses.alias("losses"), F.median("duration_days").alias("median_days"))
    return {"cases": mine, "summary": summary.withColumn("win_rate", F.when(F.col("wins") + F.col("losses") > 0, F.col("wins") / (F.col("wins") + F.col("losses")))), **by}


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with its rank by a total order, for reports of bounded size."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
