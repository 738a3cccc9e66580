import random

import pytest
from pyspark.sql import functions as F

from caselight.operators.maintained import Maintained, enrichment_shares, people_shares
from caselight.sources.store import Store

COLUMNS = "courtRegion string, caseUrl string, enrichedAt string, documentsCount int, hasActText boolean, plaintiff string, defendant string, judge string, participants array<struct<role:string,name:string>>"
FIELDS = tuple(c.split()[0] for c in COLUMNS.replace("array<struct<role:string,name:string>>", "x").split(", "))
COUNTERS = (enrichment_shares, ("region",), ("cases", "pending", "with_documents", "with_act_text"))
PEOPLE = (people_shares, ("person", "role"), ("cases",))


def batch(spark, rng, at, n=30):
    person = lambda: rng.choice(["Иванов  И.", "иванов и.", "Петров", "", None])
    rows = [(f"c{rng.randrange(40)}", rng.choice(["1", "2", "", None]), rng.choice(["/x", None]), rng.choice(["", None, "2024"]), rng.choice([0, 3, None]), rng.choice([True, False, None]), person(), person(), person(), rng.choice([None, [], [("адвокат", person()), (None, "Сидоров")]]), at) for _ in range(n)]
    return spark.createDataFrame(rows, f"id string, {COLUMNS}, seq long")


def same(kept):
    got, want = (sorted(map(repr, df.select(*kept.keys, *kept.sums).collect())) for df in (kept.read(), kept.rebuilt()))
    assert got == want
    return got


@pytest.mark.parametrize("how", [COUNTERS, PEOPLE])
def test_equal_to_a_rebuild_after_each_batch(spark, tmp_path, how):
    rng = random.Random(5)
    store = Store(spark, str(tmp_path / "s"), "id", FIELDS, "seq", most_rows=15)
    kept = Maintained(store, str(tmp_path / "k"), *how)
    for at in (4, 9, 2):  # the last one is late
        store.upsert(batch(spark, rng, at))
        assert kept.advance() == store.version().number
        rows = same(kept)
    written = kept.state.version().number
    assert kept.advance() == store.version().number and kept.state.version().number == written  # nothing to do
    assert len(rows) == kept.read().select(*kept.keys).distinct().count()


def test_versions_passed_over_and_groups_that_leave(spark, tmp_path):
    row = lambda i, region, at: (i, region, "/x", None, 1, True, None, None, None, None, at)
    store = Store(spark, str(tmp_path / "s"), "id", FIELDS, "seq")
    kept = Maintained(store, str(tmp_path / "k"), *COUNTERS)
    make = lambda rows: spark.createDataFrame(rows, f"id string, {COLUMNS}, seq long")
    store.upsert(make([row("a", "1", 1), row("b", "1", 1)]))
    kept.advance()
    store.upsert(make([row("a", "2", 2)]))
    store.upsert(make([row("a", "1", 3)]))
    store.upsert(make([row("b", "3", 4)]))
    store.upsert(make([row("a", "3", 5)]))
    kept.advance()
    assert [tuple(r) for r in kept.read().collect()] == [("3", 2, 2, 2, 2)]
    same(kept)


def test_two_at_once_count_each_change_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "id", FIELDS, "seq")
    a, b = (Maintained(store, str(tmp_path / "k"), *COUNTERS) for _ in range(2))
    rng = random.Random(3)
    first = store.upsert(batch(spark, rng, 1))
    a.advance()
    store.upsert(batch(spark, rng, 2))
    store.upsert(batch(spark, rng, 3))

    class Slow(Maintained):
        """Another one commits an older version between what this one reads and what it writes."""

        def _delta(self, since, until):
            if since == first.number:
                b.advance(first.number + 1)
            return super()._delta(since, until)

    Slow(store, str(tmp_path / "k"), *COUNTERS).advance()
    assert a.at == store.version().number
    same(a)


def test_an_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "id", FIELDS, "seq")
    kept = Maintained(store, str(tmp_path / "k"), *COUNTERS)
    assert kept.advance() == -1
    store.upsert(spark.createDataFrame([], f"id string, {COLUMNS}, seq long"))
    kept.advance()
    assert kept.read().agg(F.count("*")).first()[0] == 0


def test_an_advance_joins_no_rows_and_a_batch_is_shuffled_once(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", "id", ("who", "what"), "seq")
    rows = spark.createDataFrame([(f"c{i}", f"p{i % 3}", "x", 1) for i in range(20)], "id string, who string, what string, seq long")
    first = store.upsert(rows)
    store.upsert(rows.where("id = 'c0'").withColumns({"who": F.lit("p1"), "seq": F.lit(2).cast("long")}))
    kept = Maintained(store, f"{tmp_path}/sums", lambda c: c.select("who", F.lit(1).alias("n")), ("who",), ("n",))
    delta = kept._delta(first.number, first.number + 1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert {(x.names.who, x.n) for x in delta.collect()} == {("p0", -1), ("p1", 1)} and "Join" not in plan(delta)
    assert "Exchange" not in plan(store._incoming(rows.repartition(2)).select("key")).replace("Exchange RoundRobinPartitioning", "")
