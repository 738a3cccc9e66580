"""Aggregates of a store that are kept up by what changes between its versions, instead of being counted anew."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, present
from ..sources.store import Conflict, Store

#: Times that an advance begins anew after another one was faster.
TRIES = 20
_STREAM = "advances"


@dataclass(frozen=True)
class Maintained:
    """Sums by keys over a store's rows, in a store of their own.

    `shares` makes of rows (key, columns and order of `source`) any number of rows with `keys` and, for each name of `sums`,
    a whole number that the row adds to its group; it must depend on each row alone. A row that changes takes back what it
    had added and adds what it adds now. So only buckets that differ are read, and only groups that change are written. The
    source must still have the version that the sums are of (see `Store.vacuum`).
    """

    source: Store
    root: str
    shares: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    sums: tuple[str, ...]

    @property
    def state(self) -> Store:
        return Store(self.source.spark, self.root, "group", ("names", *self.sums), "at")

    @property
    def at(self) -> int:
        """The version of the source that the sums are of; -1 before the first."""
        return self.state.version().batches.get(_STREAM, -1)

    def _group(self) -> Column:
        """A text that tells groups apart; null and empty keys are different groups."""
        return F.to_json(F.array(*[F.col(k).cast("string") for k in self.keys]))

    def _summed(self, rows: DataFrame) -> DataFrame:
        """(group, names, sums) of rows with a sign, without groups that nothing changes."""
        each = rows.select(self._group().alias("group"), F.struct(*self.keys).alias("names"), *[(F.col(s) * F.col("sign")).cast("long").alias(s) for s in self.sums])
        total = each.groupBy("group").agg(F.max("names").alias("names"), *[F.sum(s).alias(s) for s in self.sums])
        return total.where(" OR ".join(f"`{s}` <> 0" for s in self.sums))

    def _delta(self, since: int, until: int) -> DataFrame:
        """What the groups gain. Rows that are the same on both sides take back what they add, so the sides needn't be joined, and sums alone are shuffled."""
        before, after = self.source.sides(since, until)
        side = lambda rows, sign: self.shares(rows).withColumn("sign", F.lit(sign))
        return self._summed(side(before, -1).unionByName(side(after, 1)))

    def advance(self, until: int | None = None) -> int:
        """Brings the sums to a version of the source, by default the latest, and returns it.

        It is one commit of the state's store: all of it or nothing. Of two at once the slower begins again from what the
        faster left, so that no change counts twice.
        """
        target = self.source.version().number if until is None else until
        for _ in range(TRIES):
            state = self.state
            base = state.version()
            since = base.batches.get(_STREAM, -1)
            if since >= target:
                return since

            def unmoved(_tried: int, state: Store = state, since: int = since) -> None:
                if state.version().batches.get(_STREAM, -1) != since:
                    raise Conflict(f"{self.root} was brought on by another")

            delta = self._delta(since, target)
            if base.number >= 0:
                old = state.read(base.number).select("group", *[F.col(s).alias(f"old_{s}") for s in self.sums])
                delta = delta.join(old, "group", "left").select("group", "names", *[(F.col(s) + F.coalesce(f"old_{s}", F.lit(0))).alias(s) for s in self.sums])
            try:
                state.upsert(delta.withColumn("at", F.lit(target).cast("long")), _STREAM, target, unmoved)
                return target
            except Conflict:
                continue
        raise Conflict(f"{self.root}: {TRIES} advances were late")

    def read(self) -> DataFrame:
        """(keys, sums); groups whose sums are all 0 are gone."""
        held = self.state.read().where(" OR ".join(f"`{s}` <> 0" for s in self.sums))
        return held.select("names.*", *self.sums)

    def rebuilt(self) -> DataFrame:
        """The same rows, counted from the source's version that the sums are of."""
        whole = self._summed(self.shares(self.source.read(self.at)).withColumn("sign", F.lit(1)))
        return whole.select("names.*", *self.sums)


def _one(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("long")


def enrichment_shares(cases: DataFrame) -> DataFrame:
    """By region: cases, those with a link that aren't enriched, with documents, with act text."""
    return cases.select(
        F.coalesce("courtRegion", F.lit("")).alias("region"), F.lit(1).alias("cases"), _one(present(F.col("caseUrl")) & ~present(F.col("enrichedAt"))).alias("pending"),
        _one(F.col("documentsCount") > 0).alias("with_documents"), _one(F.col("hasActText")).alias("with_act_text"),
    )


def people_shares(cases: DataFrame) -> DataFrame:
    """By person and role, of participants, plaintiff, defendant and judge: the cases that have them; a case counts once."""
    flat = [F.struct(F.lit(role).alias("role"), F.col(c).alias("name")) for c, role in (("plaintiff", "ИСТЕЦ"), ("defendant", "ОТВЕТЧИК"), ("judge", "СУДЬЯ"))]
    listed = F.transform(F.coalesce("participants", F.array().cast("array<struct<role:string,name:string>>")), lambda p: F.struct(F.upper(F.trim(p["role"])).alias("role"), p["name"].alias("name")))
    named = F.transform(F.concat(F.array(*flat), listed), lambda p: F.struct(F.coalesce(p["role"], F.lit("")).alias("role"), F.lower(collapse(p["name"])).alias("person")))
    each = cases.select(F.explode(F.array_distinct(F.filter(named, lambda p: F.coalesce(p["person"], F.lit("")) != ""))).alias("p"))
    return each.select("p.person", "p.role", F.lit(1).alias("cases"))
