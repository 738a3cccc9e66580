"""A region's dashboard, rankings of judges, views of the collector's state and compact payloads for a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import case_prefix, category_head, in_region, is_appeal, is_first_instance, signals
from ..functions.text import collapse, present
from .catalog import has_documents

#: Rows of the lists.
TOP, RECENT, TASKS = 15, 20, 40


def scope(cases: DataFrame, code: str = "13", suffix: str = "--mor") -> DataFrame:
    """The cases of a region."""
    return cases.where(in_region(F.col("courtRegion"), F.col("courtSubdomain"), code, suffix))


def totals(cases: DataFrame) -> DataFrame:
    """One row: cases, enriched ones, and among those with act text, with documents, of first instance and appeals; and pending ones."""
    done = present(F.col("enrichedAt"))
    return cases.agg(
        F.count("*").alias("catalog"), F.count_if(done).alias("enriched"), F.count_if(done & F.coalesce("hasActText", F.lit(False))).alias("with_act_text"),
        F.count_if(done & ((F.coalesce("documentsCount", F.lit(0)) > 0) | (F.coalesce(F.size("documents"), F.lit(0)) > 0))).alias("with_documents"),
        F.count_if(done & is_first_instance(F.col("caseNumber"))).alias("first_instance"), F.count_if(done & is_appeal(F.col("caseNumber"))).alias("appeal_like"), F.count_if(present(F.col("caseUrl")) & ~done).alias("pending"),
    )


def prefixes(cases: DataFrame) -> DataFrame:
    """(prefix, n) of the enriched cases' numbers."""
    return cases.where(present(F.col("enrichedAt"))).groupBy(case_prefix(F.col("caseNumber")).alias("prefix")).agg(F.count("*").alias("n"))


def top_categories(cases: DataFrame, most: int = TOP) -> DataFrame:
    """(category, n): heads of the enriched cases' categories, the most frequent first."""
    counts = cases.where(present(F.col("enrichedAt"))).groupBy(category_head(F.col("category")).alias("category")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "category").limit(most)


def top_judges(cases: DataFrame, most: int = TOP) -> DataFrame:
    """(judge, n) of the enriched cases, the most frequent first."""
    rows = cases.where(present(F.col("enrichedAt")) & present(F.trim("judge")))
    return rows.groupBy(collapse(F.col("judge")).alias("judge")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "judge").limit(most)


def courts(cases: DataFrame) -> DataFrame:
    """(court, name, total, enriched, with_act_text, first_instance, appeal_like, identifiable, intensity); identifiable: enriched cases with a representative who can be told."""
    done = present(F.col("enrichedAt"))
    told = done & signals(F.col("participants"), F.col("documents"))["identifiable"]
    out = cases.groupBy(F.col("courtSubdomain").alias("court")).agg(
        F.min_by("courtName", "id").alias("name"), F.count("*").alias("total"), F.count_if(done).alias("enriched"), F.count_if(F.coalesce("hasActText", F.lit(False))).alias("with_act_text"),
        F.count_if(is_first_instance(F.col("caseNumber"))).alias("first_instance"), F.count_if(is_appeal(F.col("caseNumber"))).alias("appeal_like"), F.count_if(told).alias("identifiable"),
    )
    top = out.agg(F.greatest(F.max("total"), F.lit(1)).alias("top"))  # one row
    return out.crossJoin(F.broadcast(top)).withColumn("intensity", F.col("total") / F.col("top")).drop("top")


def recent(cases: DataFrame, most: int = RECENT) -> DataFrame:
    """The cases that were enriched last."""
    rows = cases.where(present(F.col("enrichedAt"))).select("id", "caseNumber", F.col("courtSubdomain").alias("court"), "status", "hasActText", "enrichedAt")
    return rows.orderBy(F.desc("enrichedAt"), "id").limit(most)


def deep_judges(facts: DataFrame, least: int = 5, least_appeals: int = 3, most: int = 40) -> DataFrame:
    """Judges over `cases.facts` of enriched cases: cases, durations, outcomes, bank plaintiffs, appeals and the share of the busiest judge's cases.

    An appeal with a decision counts for the judge of the first instance, if named, else for its own.
    """
    done = facts.where(present(F.col("enrichedAt"))).withColumn("__own", F.nullif(collapse(F.coalesce("judge", F.lit(""))), F.lit("")))
    first = done.where(F.col("first_instance") & F.col("__own").isNotNull()).select(F.col("__own").alias("judge"), F.lit(True).alias("one"), F.col("duration_days").alias("days"), "outcome", (F.col("plaintiff_kind") == "bank").alias("bank"))
    lower = F.coalesce(F.nullif(collapse(F.coalesce(F.col("firstInstance.judge"), F.lit(""))), F.lit("")), F.col("__own"))
    appeals = done.where(F.col("appeal") & lower.isNotNull() & F.col("outcome").isin("appealed_upheld", "appealed_changed")).select(lower.alias("judge"), F.lit(False).alias("one"), F.lit(None).cast("int").alias("days"), "outcome", F.lit(False).alias("bank"))
    fav, one = F.col("outcome").isin("granted", "granted_partial"), F.col("one")
    out = first.unionByName(appeals).groupBy("judge").agg(
        F.count_if(one).alias("cases"), F.count("days").alias("with_duration"), F.median("days").alias("median_days"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY days)").alias("p75_days"),
        F.count_if(one & (F.col("outcome") != "unknown")).alias("known"), F.count_if(one & fav).alias("favourable"), F.count_if(one & (F.col("outcome") == "denied")).alias("denied"), F.count_if(F.col("bank")).alias("bank_cases"), F.count_if(F.col("bank") & fav).alias("bank_favourable"),
        F.count_if(~one).alias("reviewed"), F.count_if(~one & (F.col("outcome") == "appealed_changed")).alias("changed"),
    )
    top = out.agg(F.greatest(F.max("cases"), F.lit(1)).alias("top"))  # one row
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    rates = {"favourable_rate": share("favourable", "known"), "bank_rate": share("bank_favourable", "bank_cases"), "change_rate": share("changed", "reviewed"), "intensity": F.col("cases") / F.col("top")}
    kept = out.crossJoin(F.broadcast(top)).where((F.col("cases") >= least) | (F.col("reviewed") >= least_appeals)).withColumns(rates).drop("top")
    return kept.orderBy(F.desc("cases"), "judge").limit(most)


def rankings(judges: DataFrame) -> DataFrame:
    """(ranking, place, judge, value) over `deep_judges`: the 12 slowest and fastest by median, the 15 most overturned, the 15 most in favour of banks, each with three cases of its kind at least."""
    rules = (("slow", "median_days", "with_duration", True, 12), ("fast", "median_days", "with_duration", False, 12), ("overturned", "change_rate", "reviewed", True, 15), ("banks", "bank_rate", "bank_cases", True, 15))
    parts = []
    for name, value, count, down, most in rules:
        best = judges.where((F.col(count) >= 3) & F.col(value).isNotNull()).orderBy(F.desc(value) if down else F.asc(value), "judge").limit(most)
        kept = best.agg(F.array_sort(F.collect_list(F.struct(((-F.col(value)) if down else F.col(value)).alias("k"), "judge", F.col(value).cast("double").alias("value")))).alias("x"))  # 15 rows at most
        parts.append(kept.select(F.lit(name).alias("ranking"), F.posexplode("x").alias("place", "y")).select("ranking", (F.col("place") + 1).alias("place"), "y.judge", "y.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def insight(parts: dict[str, tuple[DataFrame, list[str], int]]) -> DataFrame:
    """(part, place, payload): compact rows of several reports for a text that is written from them: of each part, given as rows in order, columns and limit, its first rows as JSON."""
    out = None
    for name, (rows, columns, most) in parts.items():
        row = rows.select(*columns).limit(most).agg(F.collect_list(F.to_json(F.struct(*columns))).alias("x"))  # `most` rows
        row = row.select(F.lit(name).alias("part"), F.posexplode("x").alias("place", "payload"))
        out = row if out is None else out.unionByName(row)
    return out


def collector_tasks(tasks: DataFrame, most: int = TASKS) -> DataFrame:
    """(court, last, found, parsed, next): tasks that found or parsed something, the latest first."""
    return tasks.where((F.col("found") > 0) | (F.col("parsed") > 0)).orderBy(F.desc("last"), "court").limit(most)


def collector_stats(tasks: DataFrame, cases: DataFrame, now) -> DataFrame:
    """One row: tasks, those that are due, what they found and parsed, and the catalogue's counts."""
    state = tasks.agg(F.count("*").alias("tasks"), F.count_if(F.col("next") <= now).alias("ready"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"), F.coalesce(F.sum("parsed"), F.lit(0)).alias("parsed"), F.max("last").alias("last"))
    open_ = present(F.col("caseUrl")) & ~present(F.col("enrichedAt"))
    counts = cases.agg(F.count("*").alias("catalog"), F.count_if(open_).alias("pending"), F.count_if(has_documents(cases)).alias("with_documents"), F.count_if(F.coalesce("hasActText", F.lit(False))).alias("with_act_text"))
    return state.crossJoin(F.broadcast(counts))  # one row each
