"""The catalogue's list, search, facet and queue queries."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_key
from ..functions.names import role_accepted, role_rule
from ..functions.text import Rule, blank_to_null, label_of, pattern, present

#: A page has 50 rows unless asked otherwise, and 100 at most.
PAGE, LARGEST_PAGE = 50, 100

#: Groups of categories by words in their names; what none of them names is `other`.
CATEGORY_GROUPS = (Rule("civil", r"граждан|спор|иск|экон|банкрот|семейн|трудов|жилищ"), Rule("criminal", r"уголов"), Rule("admin", r"админ"), Rule("appeal", r"апелляц|кассац"))


def haystack(*cols: Column) -> Column:
    """Present fields in lower case, joined by spaces: what a free search looks through."""
    return F.lower(F.concat_ws(" ", *[blank_to_null(c) for c in cols]))


def has_text(col: Column, needle: str) -> Column:
    """Case-insensitive substring; false for null."""
    return F.coalesce(F.contains(F.lower(col), F.lit(needle.lower())), F.lit(False))


def any_participant(participants: Column, needle: str, role: Column | None = None) -> Column:
    """Whether an element's name contains the needle and its role fulfils a condition on `role` (a column built on `x`)."""
    return F.exists(participants, lambda p: has_text(p["name"], needle) & (F.lit(True) if role is None else role))


def between_dates(col: Column, first: str | None = None, last: str | None = None) -> Column:
    """Inclusive on both sides; an open side is no condition; null dates fail as soon as one side is given."""
    parts = [col >= F.lit(first).cast("timestamp_ntz")] * (first is not None) + [col < F.lit(last).cast("date") + F.expr("interval 1 day")] * (last is not None)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def in_group(category: Column, group: str, groups: tuple[Rule, ...] = CATEGORY_GROUPS) -> Column:
    """Whether a category fulfils a group's rule (it may fulfil several), or none for `other`; an unknown group is no condition."""
    text = F.coalesce(category, F.lit(""))
    if group == "other":
        return ~reduce(lambda a, b: a | b, [text.rlike(pattern(r.pattern)) for r in groups])
    return next((text.rlike(pattern(r.pattern)) for r in groups if r.label == group), F.lit(True))


def group_of(category: Column, groups: tuple[Rule, ...] = CATEGORY_GROUPS) -> Column:
    """The first group whose rule a category fulfils, else `other`."""
    return label_of(F.coalesce(category, F.lit("")), groups, "other")


def category_groups(facets: DataFrame, category: str = "category", n: str = "n") -> DataFrame:
    """(group, category, n, total) of facet rows: each group's categories with its total; to be ordered by total, then n."""
    out = facets.select(group_of(F.col(category)).alias("group"), category, n)
    return out.withColumn("total", F.sum(n).over(Window.partitionBy("group")))  # a row for each category


def courts_by_region(facets: DataFrame, region: str = "region", n: str = "n") -> DataFrame:
    """Facet rows of courts with their region (blank: `Без региона`) and its total; to be ordered by total, then n."""
    out = facets.withColumn(region, F.coalesce(F.nullif(F.trim(region), F.lit("")), F.lit("Без региона")))
    return out.withColumn("total", F.sum(n).over(Window.partitionBy(region)))  # a row for each court


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """One page in an order that must be total; a distributed top-k, as offset and limit are bounded."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(PAGE if limit is None else max(0, limit), LARGEST_PAGE))


def facet(df: DataFrame, key: str, name: str = "n", newest: dict[str, str] | None = None, by: Column | None = None, blanks: bool = True) -> DataFrame:
    """Counts by key, and for each wanted column its value in the key's newest row by `by`."""
    rows = df if blanks else df.where(present(F.col(key)))
    labels = [F.max_by(src, by).alias(out) for out, src in (newest or {}).items()]
    return rows.groupBy(key).agg(F.count("*").alias(name), *labels)


def pending(df: DataFrame, done: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The oldest rows that `done` doesn't have yet."""
    return df.join(done.select(key), key, "left_anti").orderBy(*order).limit(limit)


def enrichment_counts(cases: DataFrame) -> DataFrame:
    """Pending, with documents, with act text: a case is pending if it has a link and isn't enriched."""
    return cases.agg(
        F.count_if(present(F.col("caseUrl")) & ~present(F.col("enrichedAt"))).alias("pending"),
        F.count_if((F.coalesce("documentsCount", F.lit(0)) > 0) | (F.coalesce(F.size("documents"), F.lit(0)) > 0)).alias("with_documents"),
        F.count_if(F.coalesce("hasActText", F.lit(False))).alias("with_act_text"),
    )


def pending_count(cases: DataFrame, region: str | None = None) -> DataFrame:
    """One row with the number of cases that have a link and aren't enriched, of a region if one is given; an unknown region has 0."""
    open_ = present(F.col("caseUrl")) & ~present(F.col("enrichedAt"))
    return cases.agg(F.count_if(open_ if not (region or "").strip() else open_ & (F.col("courtRegion") == region.strip())).alias("pending"))


@dataclass(frozen=True)
class ListRequest:
    """The conditions of a list; blank ones, and `all`, don't count. Raises ValueError for values out of range.

    participant is a part of a name, in participants of the role or, as the role admits, in plaintiff, defendant, parties
    or judge. hearing_from and hearing_to take dd.mm.yyyy and ISO days, both inclusive; rows without such a day then fail.
    """

    q: str | None = None
    case_number: str | None = None
    uid: str | None = None
    participant: str | None = None
    participant_role: str | None = None
    judge: str | None = None
    court: str | None = None
    region: str | None = None
    category: str | None = None
    group: str | None = None
    has_documents: bool | None = None
    enriched: bool | None = None
    hearing_from: str | None = None
    hearing_to: str | None = None
    limit: int = PAGE
    offset: int = 0

    def __post_init__(self) -> None:
        if not isinstance(self.limit, int) or not 1 <= self.limit <= 500:
            raise ValueError("limit must be a whole number from 1 to 500")
        if not isinstance(self.offset, int) or self.offset < 0:
            raise ValueError("offset must be a whole number from 0")
        for name in ("has_documents", "enriched"):
            if not isinstance(getattr(self, name), (bool, type(None))):
                raise ValueError(f"{name} must be true, false or absent")

    def of(self, name: str) -> str | None:
        value = (getattr(self, name) or "").strip()
        return None if value in ("", "all") and name != "q" else value or None


def participant_condition(participant: str | None, role: str | None) -> Column:
    """Whether a case has a participant with a part of a name and a role, by its participants or else by its flat fields."""
    wanted = role if role and role != "all" else None
    accepts = lambda text: wanted is None or bool(re.search(role_rule(wanted) or re.escape(wanted.lower()), text))
    people = F.coalesce(F.col("participants"), F.array())
    if participant is None:
        out = F.exists(people, lambda p: role_accepted(p["role"], wanted))
        for field, text in (("plaintiff", "истец"), ("defendant", "ответчик"), ("judge", "судья")):
            if accepts(text):
                out |= F.trim(F.coalesce(field, F.lit(""))) != ""
        return out
    out = F.exists(people, lambda p: has_text(p["name"], participant) & role_accepted(p["role"], wanted))
    for field, admitted in (("plaintiff", accepts("истец")), ("defendant", accepts("ответчик")), ("parties", wanted is None), ("judge", wanted is None)):
        if admitted:
            out |= has_text(F.col(field), participant)
    return out


def has_documents(cases: DataFrame) -> Column:
    return (F.coalesce("documentsCount", F.lit(0)) > 0) | (F.coalesce(F.size("documents"), F.lit(0)) > 0) | F.coalesce("hasActText", F.lit(False))


def list_cases(cases: DataFrame, q: str | None = None, court: str | None = None, region: str | None = None, category: str | None = None, group: str | None = None, judge: str | None = None, has_documents: bool | None = None, enriched: bool | None = None, **more) -> DataFrame:
    """All cases that fulfil all given conditions (see ListRequest); to be paged by collectedAt, newest first, then id."""
    return matching(cases, ListRequest(q=q, court=court, region=region, category=category, group=group, judge=judge, has_documents=has_documents, enriched=enriched, **more))


def matching(cases: DataFrame, r: ListRequest) -> DataFrame:
    """All cases that fulfil a request's conditions."""
    names = F.array_join(F.transform(F.coalesce("participants", F.array()), lambda p: p["name"]), " ") if "participants" in cases.columns else F.lit("")
    fields = [F.col(c) for c in ("caseNumber", "caseUid", "courtName", "courtSubdomain", "courtRegion", "category", "parties", "plaintiff", "defendant", "judge", "status") if c in cases.columns]
    where = F.lit(True)
    if r.of("q"):
        where &= F.contains(haystack(*fields, names), F.lit(r.of("q").lower()))
    for name, field in (("case_number", "caseNumber"), ("uid", "caseUid"), ("judge", "judge")):
        if r.of(name):
            where &= has_text(F.col(field), r.of(name))
    if r.of("participant") or r.of("participant_role"):
        where &= participant_condition(r.of("participant"), r.of("participant_role"))
    if r.of("court"):
        where &= F.col("courtSubdomain") == r.of("court")
    if r.of("region"):
        where &= F.col("courtRegion") == r.of("region")
    if r.of("category"):
        where &= F.contains(F.coalesce("category", F.lit("")), F.lit(r.of("category")))
    if r.of("group"):
        where &= in_group(F.col("category"), r.of("group"))
    if r.has_documents is not None:
        where &= has_documents(cases) if r.has_documents else ~has_documents(cases)
    if r.enriched is not None:
        where &= present(F.col("enrichedAt")) if r.enriched else ~present(F.col("enrichedAt"))
    if r.of("hearing_from") or r.of("hearing_to"):
        day = date_key(F.col("hearingDate"))
        first, last = (date_key(F.lit(r.of(n))) for n in ("hearing_from", "hearing_to"))
        where &= F.coalesce(first.isNull() & last.isNull() | day.isNotNull() & F.coalesce(day >= first, F.lit(True)) & F.coalesce(day <= last, F.lit(True)), F.lit(False))
    return cases.where(where)


def list_page(cases: DataFrame, r: ListRequest, full: bool = False) -> DataFrame:
    """The request's page, newest first, slim unless full, with `total`: the number of all matches. A page past the end has no row; `list_total` has the number for it."""
    found = matching(cases, r)
    best = page(found, [F.desc("collectedAt"), F.col("id")], r.offset, r.limit)
    return (best if full else slim(best)).crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


def list_total(cases: DataFrame, r: ListRequest) -> DataFrame:
    """(total): the number of all matches of a request, one row whatever its page."""
    return matching(cases, r).agg(F.count("*").alias("total"))


def slim(cases: DataFrame) -> DataFrame:
    """The columns that a list shows: no documents, events and participants."""
    count = F.when(F.coalesce("documentsCount", F.lit(0)) > 0, F.col("documentsCount")).otherwise(F.size("documents")).cast("int")
    plain = "id caseUid caseNumber courtSubdomain courtName courtRegion category plaintiff defendant judge status hearingDate hearingTime".split()
    return cases.select(*plain, count.alias("documentsCount"), "hasActText", F.size("events").alias("eventsCount"), "enrichedAt", "collectedAt")
