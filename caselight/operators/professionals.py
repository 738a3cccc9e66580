"""Lawyers and judges across cases: cards with ratings and heats, judges' practice, regional counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import BANK, category_head, may_hold_names, name_fields, names_of_field, professional_name, region_label, split_names
from ..functions.text import collapse, pattern, present, slug
from ..session import cut
from .people import professional_rating, professional_tier

#: Words of civil and criminal categories.
CIVIL, CRIMINAL = r"граждан|спор|иск|экон|банкрот|семейн|трудов|жилищ", r"уголов"
#: Factors of the rating in order, each with its highest score.
FACTORS = (("cases", 28), ("courts", 12), ("acts", 10), ("enriched", 12), ("docs", 8), ("cats", 6), ("geo", 4), ("role", 6))
#: Cases that a card shows, courts and categories of its heats, and categories that it names.
RECENT, COURTS, CATEGORIES, NAMED = 24, 16, 12, 8


def appearances(cases: DataFrame, suffix: str = "--mor", code: str = "13") -> DataFrame:
    """(person, name, role, at, id and a case's columns): one row for each person and case, in the role found first.

    A court without region that has the suffix belongs to the region of the code. Each distinct field is split and its names
    are judged once, however many cases have it; fields that can't hold a name, those of the most frequent parties among them,
    aren't dealt by their text. The rows are cut, as cards, heats and practice all read them.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    asked = cases.where(present(F.trim("judge")) | (F.coalesce(F.size("participants"), F.lit(0)) > 0) | text("parties").rlike("(?iu)адвокат|представ|юрискон") | present(F.col("enrichedAt")))
    found = asked.select(
        F.posexplode(name_fields({c: F.col(c) for c in ("judge", "participants", "events", "parties", "plaintiff", "defendant")})).alias("field", "f"),
        "id", "caseNumber", "courtSubdomain", "courtName", F.nullif("courtRegion", F.lit("")).alias("region"), "category", "status", "hearingDate", "collectedAt",
        F.coalesce("documentsCount", F.lit(0)).alias("documents"), F.coalesce("hasActText", F.lit(False)).alias("act"), present(F.col("enrichedAt")).alias("enriched"),
        F.coalesce(F.nullif("courtRegion", F.lit("")), F.when(F.lower("courtSubdomain").endswith(suffix), F.lit(code))).alias("place"),
    ).where((F.col("f.raw") != "") & may_hold_names(F.col("f.kind"), F.col("f.about"), F.col("f.raw"))).select("*", "f.kind", "f.about", "f.raw").drop("f")
    field = ["kind", "about", "raw"]
    named = found.select(*field).distinct().select(*field, names_of_field(*(F.col(c) for c in field)).alias("names")).where("names.role IS NOT NULL")
    each = named.select(*field, F.col("names.role").alias("role"), F.posexplode("names.names").alias("part", "said")).withColumn("name", professional_name(F.col("said"), F.col("role") == "judge")).where("name IS NOT NULL")
    met = found.join(each.drop("said").withColumn("person", F.lower("name")), field).withColumn("at", F.struct("field", "part")).drop("field", "part", *field)
    first = met.groupBy("person", "id").agg(F.min_by(F.struct(*[c for c in met.columns if c not in ("person", "id")]), "at").alias("x"))
    return cut(first.select("person", "id", "x.*"))


def cards(found: DataFrame) -> DataFrame:
    """One row for each person: role, counts, rating and tier, main court, region.

    From `appearances`. First-seen values and ties go by the case's id. A person who is a lawyer in any case is a lawyer.
    """
    words = lambda rule: F.coalesce("category", F.lit("")).rlike(pattern(rule))
    base = found.groupBy("person").agg(
        F.min_by("name", "id").alias("name"), F.when(F.max(F.col("role") == "lawyer"), "lawyer").otherwise("judge").alias("primary_role"), F.max(F.col("role") == "judge").alias("is_judge"),
        F.count("*").alias("cases"), F.count_distinct("courtSubdomain").alias("courts"), F.sum("documents").alias("documents"), F.count_distinct(F.nullif("category", F.lit(""))).alias("categories"),
        F.count_if("enriched").alias("enriched_cases"), F.count_distinct("region").alias("regions"), F.count_if(words(CIVIL)).alias("civil_cases"), F.count_if(words(CRIMINAL)).alias("criminal_cases"),
        F.count_if(F.col("act") | (F.col("documents") > 0)).alias("with_acts"), F.max("collectedAt").alias("last_active"), F.min_by("region", F.when(F.col("region").isNotNull(), F.col("id"))).alias("first_region"),
    )
    by_court = found.groupBy("person", "courtSubdomain").agg(F.count("*").alias("n"), F.min("id").alias("seen"), F.max_by(F.struct("courtName", "region"), "id").alias("court"))
    main = by_court.groupBy("person").agg(F.min_by(F.struct("courtSubdomain", "court"), F.struct((-F.col("n")).alias("m"), "seen")).alias("main"))
    out = base.join(main, "person").withColumns({"main_court": F.col("main.court.courtName"), "main_court_code": F.col("main.courtSubdomain"), "region": F.coalesce("main.court.region", "first_region")})
    rating = professional_rating(F.col("cases"), F.col("courts"), F.col("with_acts"), F.col("enriched_cases"), F.col("documents"), F.col("categories"), F.col("regions"), F.col("primary_role") == "lawyer")
    out = out.withColumns({"rating": rating, "card_id": slug(F.col("name"), "e")}).withColumn("tier", professional_tier(F.col("rating")))
    return out.drop("main", "first_region")


def factors(cards: DataFrame) -> DataFrame:
    """(person, key, score, max): what a rating is made of."""
    score = {
        "cases": F.col("cases") * 3, "courts": F.col("courts") * 2, "acts": F.col("with_acts"), "enriched": F.col("enriched_cases"), "docs": F.floor(F.col("documents") / 2), "cats": F.col("categories"),
        "geo": F.when(F.col("regions") > 1, 4).when(F.col("regions") == 1, 1).otherwise(0), "role": F.when(F.col("primary_role") == "lawyer", 6).otherwise(4),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.least(score[k].cast("long"), F.lit(m).cast("long")).alias("score"), F.lit(m).alias("max")) for k, m in FACTORS])
    return cards.select("person", F.explode(rows).alias("x")).select("person", "x.*")


def _top(counts: DataFrame, by: str, most: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("cases"), by))
    return counts if most is None else counts.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def court_heat(found: DataFrame) -> DataFrame:
    """(person, courtSubdomain, court, cases): the courts of each person, the 16 with most cases."""
    return _top(found.groupBy("person", "courtSubdomain").agg(F.max_by("courtName", "id").alias("court"), F.count("*").alias("cases")), "courtSubdomain", COURTS)


def category_heat(found: DataFrame) -> DataFrame:
    """(person, category, cases): heads of categories, the 12 with most cases of each person."""
    return _top(found.groupBy("person", category_head(F.col("category"), 60).alias("category")).agg(F.count("*").alias("cases")), "category", CATEGORIES)


def geo_heat(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(person, region, label, cases) with labels from `region_labels`; a region without one has its number."""
    counts = found.where("place is not null").groupBy("person", F.col("place").alias("region")).agg(F.count("*").alias("cases"))
    return counts.join(F.broadcast(labels), "region", "left").select("person", "region", F.coalesce("label", F.concat(F.lit("Рег. "), "region")).alias("label"), "cases")  # labels: a row for each region of the country


def recent_cases(found: DataFrame) -> DataFrame:
    """(person, rank, id, caseNumber, courtName, category, status, hearingDate, has_documents): the 24 cases of each person that were collected last."""
    rank = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("collectedAt"), "id"))
    shown = found.withColumn("rank", rank).where(F.col("rank") <= RECENT)
    return shown.select("person", "rank", "id", "caseNumber", "courtName", "category", "status", "hearingDate", (F.col("act") | (F.col("documents") > 0)).alias("has_documents"))


def region_labels(courts: DataFrame) -> DataFrame:
    """(region, label) of the registry's regions, by the first court of each (column seq)."""
    first = courts.where(present(F.col("region")) & (F.col("region") != "0")).groupBy("region").agg(F.min_by("name", "seq").alias("name"))
    return first.select("region", region_label(F.col("region"), F.col("name")).alias("label"))


def find_cards(cards: DataFrame, found: DataFrame, labels: DataFrame, q: str | None = None, role: str | None = None, limit: int = 48, offset: int = 0) -> DataFrame:
    """Cards of a role with a part of their name, main court, one of their categories or a region's label, best first; 120 at most."""
    out = cards
    if role in ("lawyer", "judge"):
        out = out.where((F.col("primary_role") == role) | (F.lit(role == "judge") & F.col("is_judge")))
    if q and q.strip():
        needle = F.lit(q.strip().lower())
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), needle)
        named = found.join(F.broadcast(labels), "region", "left").where(has(F.col("category")) | has(F.coalesce("label", F.concat(F.lit("Рег. "), "region")))).select("person").distinct().withColumn("__by", F.lit(True))
        out = out.join(named, "person", "left").where(has(F.col("name")) | has(F.col("main_court")) | F.col("__by").isNotNull()).drop("__by")
    return out.orderBy(F.desc("rating"), F.desc("cases"), "person").offset(max(0, offset)).limit(min(limit, 120))


def get_card(cards: DataFrame, key: str) -> DataFrame:
    """The best card whose id or name is the key, else one whose name contains it; at most one row."""
    k = key.lower()
    exact = (F.col("card_id") == k) | (F.col("person") == k)
    return cards.where(exact | F.contains("person", F.lit(k))).orderBy(F.desc(exact), F.desc("rating"), F.desc("cases"), "person").limit(1)


def card_of_profile(cards: DataFrame, last: str = "", first: str = "", patronymic: str = "", role: str | None = None) -> DataFrame:
    """The card of a person's profile: the same name, or surname and name in it, or a surname of three letters or more and a word with the name's initial.

    Of several the first of the wanted role, if any, else the one with the highest rating; at most one row.
    """
    full = " ".join(x for x in (last.strip(), first.strip(), patronymic.strip()) if x).lower()
    ln, fn = last.strip().lower(), first.strip().lower()
    if len(full) < 4:
        return cards.limit(0)
    hit = F.col("person") == full
    if ln and fn:
        hit |= F.contains("person", F.lit(ln)) & F.contains("person", F.lit(fn))
        if len(ln) >= 3:
            hit |= F.contains("person", F.lit(ln)) & F.exists(F.split("person", r"\s+"), lambda w: w.startswith(fn[0]))
    wanted = ((F.col("primary_role") == role) | (F.lit(role == "judge") & F.col("is_judge"))) if role in ("lawyer", "judge") else F.lit(False)
    return cards.where(hit).orderBy(F.desc(wanted), F.desc("rating"), F.desc("cases"), "person").limit(1)


def regional(cards: DataFrame, regions: DataFrame, labels: DataFrame, role: str | None = None, most: int = 30) -> DataFrame:
    """(region, label, lawyers, judges, total, mode): professionals by region; without any, cases by region (regions: region, n), the 30 largest."""
    lawyer, judge = F.col("primary_role") == "lawyer", (F.col("primary_role") == "judge") | F.col("is_judge")
    rows = cards.where("region is not null")
    if role in ("lawyer", "judge"):
        rows = rows.where(lawyer if role == "lawyer" else judge)
    by = rows.groupBy("region").agg(F.count_if(lawyer).alias("lawyers"), F.count_if(judge).alias("judges"))
    total = F.col("judges") if role == "judge" else F.col("lawyers") if role == "lawyer" else F.col("lawyers") + F.col("judges")
    by = by.withColumn("total", total).where("total > 0").withColumn("mode", F.lit("professionals"))
    none = regions.orderBy(F.desc("n"), "region").limit(most).select("region", F.lit(0).cast("long").alias("lawyers"), F.lit(0).cast("long").alias("judges"), F.col("n").alias("total"), F.lit("cases").alias("mode"))
    any_ = by.agg((F.count("*") > 0).alias("__any"))  # one row
    cells = by.unionByName(none.crossJoin(F.broadcast(any_)).where("not __any").drop("__any"))
    return cells.join(F.broadcast(labels), "region", "left").select("region", F.coalesce("label", F.concat(F.lit("Рег. "), "region")).alias("label"), "lawyers", "judges", "total", "mode")


def practice(facts: DataFrame) -> DataFrame:
    """(person, first_instance, appeal_like, with_duration, median_days, p75_days, known, favourable, denied, banks, bank_favourable, reviewed, changed, rates): judges' practice, from `cases.facts`.

    A case counts for each judge that its field names; an appeal with a decision also for the judge of the first instance.
    """
    own = facts.where(present(F.trim("judge"))).select(
        F.explode(split_names(collapse(F.col("judge")))).alias("name"), F.lit(True).alias("own"), "outcome", F.col("caseNumber").startswith("2").alias("one"), F.col("caseNumber").startswith("11-").alias("two"),
        F.col("duration_days").alias("days"), F.coalesce("plaintiff", F.lit("")).rlike(pattern(BANK.removesuffix("|киви|qiwi"))).alias("bank"),
    )
    lower = facts.where(F.trim("caseNumber").startswith("11-") & present(F.trim(F.col("firstInstance.judge"))) & F.col("outcome").isin("appealed_upheld", "appealed_changed"))
    lower = lower.select(collapse(F.col("firstInstance.judge")).alias("name"), F.lit(False).alias("own"), "outcome", F.lit(False).alias("one"), F.lit(False).alias("two"), F.lit(None).cast("int").alias("days"), F.lit(False).alias("bank"))
    fav, known = F.col("outcome").isin("granted", "granted_partial"), F.col("outcome") != "unknown"
    days = F.when(F.col("one"), F.col("days"))
    out = own.unionByName(lower).withColumn("d", days).groupBy(F.lower(collapse(F.col("name"))).alias("person")).agg(
        F.count_if(F.col("own") & F.col("one")).alias("first_instance"), F.count_if(F.col("own") & F.col("two")).alias("appeal_like"), F.count("d").alias("with_duration"), F.median("d").alias("median_days"),
        F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY d)").alias("p75_days"), F.count_if(F.col("one") & known).alias("known"), F.count_if(F.col("one") & known & fav).alias("favourable"), F.count_if(F.col("one") & (F.col("outcome") == "denied")).alias("denied"),
        F.count_if(F.col("one") & F.col("bank")).alias("banks"), F.count_if(F.col("one") & F.col("bank") & fav).alias("bank_favourable"), F.count_if(~F.col("own")).alias("reviewed"), F.count_if(~F.col("own") & (F.col("outcome") == "appealed_changed")).alias("changed"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({"favourable_rate": share("favourable", "known"), "bank_rate": share("bank_favourable", "banks"), "change_rate": share("changed", "reviewed")})


def practice_outcomes(facts: DataFrame) -> DataFrame:
    """(person, outcome, n): how often each outcome occurs in a judge's own cases."""
    own = facts.where(present(F.trim("judge"))).select(F.explode(split_names(collapse(F.col("judge")))).alias("name"), "outcome")
    return own.groupBy(F.lower(collapse(F.col("name"))).alias("person"), "outcome").agg(F.count("*").alias("n"))


def with_practice(cards: DataFrame, practice: DataFrame) -> DataFrame:
    """The cards; those of judges by their primary role with their practice, zeros and nulls for judges without cases, nulls for others."""
    judge = F.col("primary_role") == "judge"
    counts = [c for c in practice.columns if c != "person" and not c.endswith(("_days", "_rate"))]
    out = cards.join(practice, "person", "left")
    out = out.withColumns({c: F.when(judge, F.coalesce(c, F.lit(0))) for c in counts})
    return out.withColumns({c: F.when(judge, F.col(c)) for c in practice.columns if c.endswith(("_days", "_rate"))})
