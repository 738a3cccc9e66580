"""Dates as court records write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = r"(\d{1,2})[./](\d{1,2})[./](\d{4})"


def record_date(raw: Column) -> Column:
    """The first d.m.yyyy or d/m/yyyy anywhere, from 1990 to 2100 and in the calendar; else null."""
    day, month, year = (F.regexp_extract(raw, _DAY, i) for i in (1, 2, 3))
    made = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when((year != "") & (year.try_cast("int").between(1990, 2100)), made)


def date_key(raw: Column) -> Column:
    """dd.mm.yyyy or an ISO date as yyyymmdd, without a look at the calendar; null for anything else."""
    s = F.trim(raw)
    dotted, iso = r"^(\d{2})\.(\d{2})\.(\d{4})$", r"^(\d{4})-(\d{2})-(\d{2})$"

    def number(p: str, order: tuple[int, int, int]) -> Column:
        y, m, d = (F.regexp_extract(s, p, i).try_cast("int") for i in order)
        return y * 10000 + m * 100 + d

    return F.when(s.rlike(dotted), number(dotted, (3, 2, 1))).when(s.rlike(iso), number(iso, (1, 2, 3)))


def duration_days(start: Column, end: Column, most: int = 4000) -> Column:
    """Whole days from start to end if 0 to `most`; else null."""
    n = F.datediff(end, start)
    return F.when(n.between(0, most), n)


def month_windows(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(window_start, window_end): calendar months from first to last, clipped to both."""
    bounds = spark.range(1).select(F.lit(first).cast("date").alias("a"), F.lit(last).cast("date").alias("b"))
    return windows_of(bounds, "a", "b").select("window_start", "window_end")


def windows_of(rows: DataFrame, first: str, last: str) -> DataFrame:
    """All columns of rows, and (window_start, window_end) for each calendar month from one day to the other, clipped to both; none if they are null or the wrong way round."""
    a, b = F.col(first).cast("date"), F.col(last).cast("date")
    month = F.explode(F.sequence(F.trunc(a, "MM"), b, F.expr("interval 1 month")))
    return rows.where(a <= b).withColumn("window_start", month).withColumns({"window_start": F.greatest("window_start", a), "window_end": F.least(F.last_day("window_start"), b)})


def schedule_dates(today: Column, back: int, forward: int, inclusive: bool = False) -> Column:
    """Days from `back` before to `forward` after today; the last one only if inclusive."""
    last = forward if inclusive else forward - 1
    return F.sequence(F.date_add(today, -back), F.date_add(today, last)) if last >= -back else F.expr("cast(array() as array<date>)")


def backoff(base: float, failures: Column, growth: float = 1.5, most: float = 90) -> Column:
    """Minutes until the next try: base * growth ** (failures - 1), up to `most`."""
    return F.least(F.lit(base) * F.pow(F.lit(growth), F.greatest(failures, F.lit(1)) - 1), F.lit(float(most)))


def retry_after(value: Column, now: Column, most_seconds: float) -> Column:
    """Seconds that a Retry-After header asks for, as a number or an HTTP date, up to a bound; null for a past date or anything else."""
    number = F.when(value.rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim(value).cast("double"))
    at = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.unix_timestamp(at) - F.unix_timestamp(now)
    seconds = F.coalesce(number, F.when(wait > 0, wait.cast("double")))
    return F.when(seconds.isNotNull(), F.least(seconds, F.lit(float(most_seconds))))
