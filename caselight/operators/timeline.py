"""A case's milestones, events and documents in one order of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(day: Column, time: Column | None = None) -> Column:
    """A day's time, noon if there is none; null days sort last."""
    clock = F.when(time.rlike(r"^\d{1,2}:\d{2}"), F.regexp_extract(time, r"^(\d{1,2}:\d{2})", 1)) if time is not None else F.lit(None).cast("string")
    return F.to_timestamp_ntz(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lpad(F.coalesce(clock, F.lit("12:00")), 5, "0")), F.lit("yyyy-MM-dd HH:mm"))


def union(parts: dict[str, DataFrame], key: str, at: str, label: str) -> DataFrame:
    """(key, at, kind, label) of several sources, to be ordered by at (nulls last), then kind."""
    return reduce(DataFrame.unionByName, [df.select(key, at, F.lit(kind).alias("kind"), label) for kind, df in parts.items()])


def of_cases(cases: DataFrame) -> DataFrame:
    """(id, at, kind, label): entry, hearing and result, all events and all documents of each case."""
    from ..functions.dates import record_date

    milestones = F.array(*[F.struct(record_date(F.col(c)).alias("day"), F.lit(None).cast("string").alias("time"), F.lit(n).alias("label")) for c, n in (("entryDate", "entry"), ("hearingDate", "hearing"), ("resultDate", "result"))])
    parts = {
        "milestone": cases.select("id", F.explode(milestones).alias("x")).where("x.day is not null").select("id", moment(F.col("x.day")).alias("at"), F.col("x.label").alias("label")),
        "event": cases.select("id", F.explode("events").alias("x")).select("id", moment(record_date(F.col("x.date")), F.col("x.time")).alias("at"), F.col("x.name").alias("label")),
        "document": cases.select("id", F.explode("documents").alias("x")).select("id", moment(record_date(F.col("x.date"))).alias("at"), F.col("x.name").alias("label")),
    }
    return union(parts, "id", "at", "label")
