"""Facts of each case, computed once, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, names
from ..functions.text import amounts, collapse, percent, present

FAVOURABLE = ("granted", "granted_partial")


def facts(cases: DataFrame) -> DataFrame:
    """The columns of cases with outcome, duration_days, instance flags, kind of plaintiff and season bucket; no shuffle."""
    texts = F.array_join(F.transform("documents", lambda d: F.coalesce(d["text"], F.lit(""))), "\n")
    acts = F.array_max(F.transform("documents", lambda d: dates.record_date(d["date"])))
    found = names.outcome(F.col("status"), names.events_text(F.col("events")), texts)
    start, end = dates.record_date(F.col("entryDate")), F.coalesce(dates.record_date(F.col("resultDate")), acts)
    return cases.withColumns(
        {
            "outcome": found["label"],
            "outcome_confidence": found["confidence"],
            "entry": start,
            "ended": end,
            "duration_days": dates.duration_days(start, end),
            "first_instance": names.is_first_instance(F.col("caseNumber")),
            "appeal": names.is_appeal(F.col("caseNumber")),
            "plaintiff_kind": names.party_kind(F.coalesce("plaintiff", F.lit(""))),
            "season": names.season_bucket(F.col("category"), F.col("status"), F.col("plaintiff")),
            "amounts": amounts(texts),
        }
    )


def label_counts(rows: DataFrame, label: str, labels: tuple[str, ...], unknown: str = "unknown") -> DataFrame:
    """(label, n, total, known): every label, also those that no row has."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], f"{label} string")
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    out = F.broadcast(every).join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))  # as many rows as labels
    whole = Window.partitionBy(F.lit(1))
    return out.withColumns({"total": F.sum("n").over(whole), "known": F.sum(F.when(F.col(label) != unknown, F.col("n")).otherwise(0)).over(whole)})


def win_rates(rows: DataFrame, key: str, result: Column, court: Column, sample: Column, seq: Column, least: int = 2, samples: int = 5) -> DataFrame:
    """Per key: cases, wins, losses, neutrals, win_rate (null without a decision), courts, first samples. result: win, loss or neutral.

    Samples come from a bounded minimum of (seq, value) pairs, never from a whole group.
    """
    ranked = rows.select(F.col(key), result.alias("r"), court.alias("c"), sample.alias("s"), F.row_number().over(Window.partitionBy(key).orderBy(seq)).alias("i"))
    out = ranked.groupBy(key).agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("r") == "win").alias("wins"),
        F.count_if(F.col("r") == "loss").alias("losses"),
        F.count_if(F.col("r") == "neutral").alias("neutrals"),
        F.count_distinct("c").alias("courts"),
        F.array_sort(F.collect_list(F.when(F.col("i") <= samples, F.struct("i", "s")))).alias("first"),
    )
    decided = F.col("wins") + F.col("losses")
    return out.where(F.col("cases") >= least).select(key, "cases", "wins", "losses", "neutrals", F.when(decided > 0, F.col("wins") / decided).alias("win_rate"), "courts", F.transform("first", lambda x: x["s"]).alias("samples"))


def judge_report(first: DataFrame, appeals: DataFrame, least: int = 5, least_appeals: int = 3, most: int = 40) -> DataFrame:
    """Per judge, from (judge, days, result) of first instances and (judge, result) of appeals on their cases.

    result of a first instance: granted, denied, other known ones or unknown; of an appeal: changed or upheld.
    """
    both = first.select("judge", F.lit("first").alias("what"), "days", "result").unionByName(appeals.select("judge", F.lit("appeal").alias("what"), F.lit(None).cast("int").alias("days"), "result"))
    one, two = F.col("what") == "first", F.col("what") == "appeal"
    out = both.groupBy("judge").agg(
        F.count_if(one).alias("cases"),
        F.count("days").alias("n_durations"),
        F.median("days").alias("median_days"),
        F.percentile_disc(0.75, "days").alias("p75_days") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY days)").alias("p75_days"),
        F.count_if(one & (F.col("result") != "unknown")).alias("known"),
        F.count_if(one & (F.col("result") == "granted")).alias("granted"),
        F.count_if(one & (F.col("result") == "denied")).alias("denied"),
        F.count_if(two).alias("appeals"),
        F.count_if(two & (F.col("result") == "changed")).alias("changed"),
    )
    out = out.where((F.col("cases") >= least) | (F.col("appeals") >= least_appeals))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    rates = {"granted_rate": share("granted", "known"), "denied_rate": share("denied", "known"), "overturn_rate": share("changed", "appeals")}
    return out.withColumns(rates).orderBy(F.desc("cases"), "judge").limit(most)


def months(rows: DataFrame, month: Column, bucket: Column, buckets: list[str]) -> DataFrame:
    """(month 1 to 12, total, a column for each bucket): zero where nothing is."""
    spark = rows.sparkSession
    counted = rows.groupBy(month.alias("month")).agg(F.count("*").alias("total"), *[F.count_if(bucket == b).alias(b) for b in buckets])
    year = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return year.join(F.broadcast(counted.where(F.col("month").between(1, 12))), "month", "left").na.fill(0)


def lifecycle(rows: DataFrame, days: str) -> DataFrame:
    """n, median, lower and upper quartile (nearest rank), mean."""
    quartile = lambda p, name: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {days})").alias(name)
    return rows.where(F.col(days).isNotNull()).agg(F.count(days).alias("n"), F.median(days).alias("median_days"), quartile(0.25, "p25_days"), quartile(0.75, "p75_days"), F.avg(days).alias("mean_days"))


#: Shares between which a median is looked for exactly, and the accuracy of the estimates that bound them: their error is a twentieth of the margin.
_MIDDLE, _ACCURACY = (0.499, 0.501), 20_000


def medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact median of each column of numbers, as doubles; nulls don't count.

    Estimates bound the middle of each column. Only values within are told apart, those below and above are counted, so that no
    task holds a column's values.
    """
    bounds = rows.agg(*[F.percentile_approx(c, _MIDDLE, _ACCURACY).alias(c) for c in columns])  # one row
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v IS NOT NULL")
    limits = bounds.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)[0].cast("double").alias("lo"), F.col(c)[1].cast("double").alias("hi")) for c in columns])).alias("x")).select("x.*")
    side = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), 1).otherwise(0)
    met = each.join(F.broadcast(limits), "column").withColumn("side", side)  # a row for each column
    counts = met.groupBy("column", "side", F.when(F.col("side") == 0, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    total, upto = Window.partitionBy("column"), Window.partitionBy("column").orderBy("side", "v")
    counts = counts.withColumns({"all": F.sum("n").over(total), "until": F.sum("n").over(upto)})
    ranks = lambda k: (F.col("until") >= k) & (F.col("until") - F.col("n") < k)
    low, high = ranks(F.floor((F.col("all") + 1) / 2)), ranks(F.floor(F.col("all") / 2) + 1)
    found = F.when(F.col("side") != 0, F.raise_error(F.lit("a median outside its bounds"))).otherwise(F.col("v"))
    middle = counts.where(low | high).select("column", low.alias("low"), high.alias("high"), found.alias("v"))
    value = lambda c: 0.5 * F.max(F.when((F.col("column") == c) & F.col("low"), F.col("v"))) + 0.5 * F.max(F.when((F.col("column") == c) & F.col("high"), F.col("v")))
    return middle.agg(*[value(c).alias(c) for c in columns])


def amounts_report(rows: DataFrame, claim: Column, award: Column, most_ratio: float = 5) -> DataFrame:
    ratio = F.when((claim > 0) & award.isNotNull(), F.least(award / claim, F.lit(float(most_ratio))))
    each = rows.select(claim.alias("claim"), award.alias("award"), ratio.alias("ratio"))
    sums = each.agg(F.count("claim").alias("n_claim"), F.count("award").alias("n_award"), F.count("ratio").alias("n_both"), F.sum("claim").alias("total_claim"), F.sum("award").alias("total_award"))
    middle = medians(each, ["claim", "award", "ratio"]).toDF("median_claim", "median_award", "median_ratio")
    return sums.crossJoin(F.broadcast(middle)).select("n_claim", "n_award", "n_both", "median_claim", "median_award", "median_ratio", "total_claim", "total_award")  # one row each


def frequent(rows: DataFrame, key: str, seq: Column, value: Column, least: int = 4, samples: int = 4, most: int = 30) -> DataFrame:
    """Keys with at least `least` rows, the most frequent first, each with its first samples; ties by key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("cases")).where(F.col("cases") >= least).orderBy(F.desc("cases"), key).limit(most)
    mine = rows.select(key, seq.alias("q"), value.alias("v")).join(F.broadcast(counts), key)  # `most` rows
    first = mine.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("q", "v"))).where(F.col("i") <= samples)
    return first.groupBy(key, "cases").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("samples"))


def stuck(rows: DataFrame, age: Column, key: str, least_days: int = 60, most: int = 40) -> DataFrame:
    """Rows without outcome whose age is unknown or at least least_days: the oldest first, unknown ages last."""
    return rows.withColumn("age_days", age).where(F.col("age_days").isNull() | (F.col("age_days") >= least_days)).orderBy(F.desc(F.coalesce("age_days", F.lit(0))), key).limit(most)


def practice(rows: DataFrame, day: Column, result: Column, most: int = 36) -> DataFrame:
    """Per month: total, known, granted, denied and the granted rate; the last `most` months, in order."""
    out = rows.where(day.isNotNull()).groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("total"), F.count_if(result != "unknown").alias("known"), F.count_if(result == "granted").alias("granted"), F.count_if(result == "denied").alias("denied")
    )
    return out.withColumn("rate", F.when(F.col("known") > 0, F.col("granted") / F.col("known"))).orderBy(F.desc("month")).limit(most)


def funnel(totals: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    """One row for each (stage, column of totals): its count and its share of the first."""
    first = F.col(stages[0][1])
    each = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(c).cast("long").alias("n"), percent(F.col(c), first).alias("pct")) for i, (s, c) in enumerate(stages)])
    return totals.select(F.explode(each).alias("x")).select("x.*")


def coverage(cases: DataFrame, indexed: DataFrame, region: str | None = None) -> DataFrame:
    """Totals over the catalogue: with link, enriched, with documents, acts, full texts, pending, in the index. indexed: ids (column id) of indexed cases."""
    rows = cases if region is None else cases.where(F.col("courtRegion") == region)
    full = F.coalesce("hasActText", F.lit(False)) | F.exists("documents", lambda d: F.coalesce(d["hasText"], F.lit(False)) | (F.coalesce(F.length(F.trim(d["text"])), F.lit(0)) > 50))
    # Only flags go through the joins. A row without a uid meets nothing; a key of its own keeps these rows from one task. One key,
    # as of two Spark would deal the rows by the uid alone, by which the ids are dealt already.
    flags = rows.select(
        "id", F.coalesce(F.concat(F.lit("u"), "caseUid"), F.concat(F.lit("-"), "id")).alias("__uid"),
        present(F.col("caseUrl")).alias("url"), present(F.col("enrichedAt")).alias("enriched"), ((F.coalesce("documentsCount", F.lit(0)) > 0) | (F.size("documents") > 0)).alias("documents"), F.coalesce("hasActText", F.lit(False)).alias("act"), full.alias("full"),
    )
    ids = indexed.select("id").distinct().withColumn("__in", F.lit(True))
    by_id = flags.join(ids, "id", "left").withColumnRenamed("__in", "__a")
    both = by_id.join(ids.select(F.concat(F.lit("u"), "id").alias("__uid"), F.col("__in").alias("__b")), "__uid", "left")  # two keys, so two equi-joins
    return both.agg(
        F.count("*").alias("size"), F.count_if("url").alias("with_url"), F.count_if("enriched").alias("enriched"), F.count_if("documents").alias("with_documents"), F.count_if("act").alias("with_act_text"),
        F.count_if("full").alias("with_full_text"), F.count_if(F.col("url") & ~F.col("enriched")).alias("pending"), F.count_if(F.coalesce("__a", "__b", F.lit(False))).alias("in_index"),
    )


def coverage_by(cases: DataFrame, column: str, most: int) -> DataFrame:
    """(place, total, enriched, with_documents, with_act_text) by region or court, a dash for none; the `most` largest."""
    rows = cases.groupBy(F.coalesce(F.nullif(column, F.lit("")), F.lit("—")).alias("place")).agg(
        F.count("*").alias("total"), F.count_if(present(F.col("enrichedAt"))).alias("enriched"), F.count_if((F.coalesce("documentsCount", F.lit(0)) > 0) | (F.coalesce(F.size("documents"), F.lit(0)) > 0)).alias("with_documents"),
        F.count_if(F.coalesce("hasActText", F.lit(False))).alias("with_act_text"),
    )
    return rows.orderBy(F.desc("total"), "place").limit(most)


def representative_winrates(facts: DataFrame, least: int = 2, samples: int = 5) -> DataFrame:
    """(person, name, cases, with_outcome, wins, losses, neutrals, win_rate, courts, samples) of identifiable representatives over `facts`; first-seen values go by the case's id.

    A decision for the plaintiff counts as won, a denial as lost, whoever the representative stood for.
    """
    texts = F.array_join(F.transform("documents", lambda d: F.coalesce(d["text"], F.lit(""))), "\n")
    each = facts.select("id", "caseNumber", "courtSubdomain", "outcome", F.explode(names.representatives(F.col("participants"), texts)).alias("name"))
    each = each.groupBy(F.lower("name").alias("person"), "id").agg(F.min("name").alias("name"), F.first("caseNumber").alias("caseNumber"), F.first("courtSubdomain").alias("courtSubdomain"), F.first("outcome").alias("outcome"))  # a case's columns are the same in its rows
    result = F.when(F.col("outcome").isin(*FAVOURABLE), "win").when(F.col("outcome") == "denied", "loss").otherwise("neutral")
    out = win_rates(each, "person", result, F.col("courtSubdomain"), F.col("caseNumber"), F.col("id"), least, samples)
    more = each.groupBy("person").agg(F.min_by("name", "id").alias("name"), F.count_if(F.col("outcome") != "unknown").alias("with_outcome"))
    return out.join(more, "person")


def serial_plaintiffs(facts: DataFrame, least: int = 4, samples: int = 4, most: int = 30) -> DataFrame:
    """(name, cases, known, wins, losses, win_rate, kind, samples): plaintiffs of enriched first instances with at least `least` cases, by the name without quotes; first-seen values go by the case's id."""
    plain = F.substring(F.lower(F.trim(F.regexp_replace(collapse(F.coalesce("plaintiff", F.lit(""))), '["«»]', ""))), 1, 120)
    rows = facts.where(present(F.col("enrichedAt")) & F.col("first_instance") & (F.length(F.trim("plaintiff")) >= 3)).select(plain.alias("key"), F.substring(F.trim("plaintiff"), 1, 100).alias("name"), "id", "caseNumber", "outcome").where(F.length("key") >= 3)
    out = rows.groupBy("key").agg(
        F.min_by("name", "id").alias("name"), F.count("*").alias("cases"), F.count_if(F.col("outcome") != "unknown").alias("known"), F.count_if(F.col("outcome").isin(*FAVOURABLE)).alias("wins"), F.count_if(F.col("outcome") == "denied").alias("losses")
    )
    best = out.where(F.col("cases") >= least).orderBy(F.desc("cases"), "key").limit(most)
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    shown = rows.join(F.broadcast(best.select("key")), "key").withColumn("i", rank).where(F.col("i") <= samples)  # `most` keys
    shown = shown.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "caseNumber"))), lambda x: x["caseNumber"]).alias("samples"))
    decided = F.col("wins") + F.col("losses")
    return best.join(shown, "key").select("name", "cases", "known", "wins", "losses", F.when(decided > 0, F.col("wins") / decided).alias("win_rate"), names.party_kind(F.col("name")).alias("kind"), "samples")


def collection_rate(rows: DataFrame, at: Column, as_of: Column, target: int) -> DataFrame:
    """Rows of the last day and week before as_of (later ones count too), the daily rate of the week and days until the target, null if nothing comes in."""
    out = rows.agg(F.count("*").alias("size"), F.count_if(at >= as_of - F.expr("interval 1 day")).alias("last_day"), F.count_if(at >= as_of - F.expr("interval 7 days")).alias("last_week"))
    rate = F.floor(F.col("last_week") / 7 * 10 + 0.5) / 10
    left = F.greatest(F.lit(target) - F.col("size"), F.lit(0))
    return out.withColumn("per_day", rate).withColumn("eta_days", F.when(F.col("per_day") > 0, F.ceil(left / F.col("per_day"))))


def depersonalization(rows: DataFrame, kind: Column) -> DataFrame:
    """Counts of signals, identifiable and masked ones, the identifiable rate and what follows from it."""
    out = rows.agg(F.count("*").alias("total"), F.count_if(kind.isin("identifiable", "depersonalized")).alias("signals"), F.count_if(kind == "identifiable").alias("identifiable"), F.count_if(kind == "depersonalized").alias("masked"))
    rate = F.when(F.col("signals") > 0, F.col("identifiable") / F.col("signals"))
    say = F.when(F.col("signals") < 20, "insufficient").when(rate >= 0.4, "go").when(rate >= 0.2, "borderline").otherwise("no-go")
    return out.withColumns({"identifiable_rate": rate, "verdict": say})
