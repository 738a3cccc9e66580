"""Plans of searches and the choice of courts to visit next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import backoff, month_windows

#: Minutes until a court's next visit after a hit, a miss and an error, and the longest wait.
HIT, MISS, ERROR, LONGEST = 10, 20, 30, 90


def priority(http: Column, captcha: Column, kind: Column, subdomain: Column) -> Column:
    """Courts that plain requests reach come first, district courts before others, cassation courts last."""
    score = F.when(http & ~captcha, 100).when(http, 40).otherwise(0) + F.when(kind == "ray", 30).when(kind.isin("vs", "oblsud"), 15).otherwise(0)
    return score - F.when(subdomain.rlike("kas$"), 80).otherwise(0)


def ready(courts: DataFrame, order: list[Column], cursor: int, now: Column, due: str, limit: int) -> DataFrame:
    """The next courts that are due, going round from the cursor; the table of courts is a small dimension."""
    whole = Window.partitionBy(F.lit(1))
    placed = courts.withColumn("place", F.row_number().over(whole.orderBy(*order)) - 1).withColumn("size", F.count("*").over(whole))
    return placed.where(F.col(due).isNull() | (F.col(due) <= now)).withColumn("turn", F.pmod(F.col("place") - cursor, F.col("size"))).orderBy("turn").limit(limit).drop("size")


def next_visit(now: Column, result: Column, failures: Column) -> Column:
    """When a court is due again: sooner after a hit than after a miss; errors wait longer each time, up to the longest wait."""
    minutes = F.when(result == "hit", F.lit(float(HIT))).when(result == "miss", F.lit(float(MISS))).otherwise(backoff(ERROR, failures, 1.5, LONGEST))
    return now + F.make_dt_interval(mins=minutes.cast("int"))


def search_plan(courts: DataFrame, categories: DataFrame, first: str, last: str) -> DataFrame:
    """Every court, category and calendar month from first to last: a product of three small dimensions that is asked for as such."""
    return courts.crossJoin(F.broadcast(categories)).crossJoin(F.broadcast(month_windows(courts.sparkSession, first, last)))
