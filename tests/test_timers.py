import pytest
from pyspark.sql import functions as F

from caselight.streaming import ingest, timers

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(PROVIDER, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def step(spark, root, make, schema, rows):
    """One more file for a stream that begins again from its checkpoint; its rows so far, and the rows of state that are left."""
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    out = make(ingest.files(spark, f"{root}/in", schema))
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    left = [s["numRowsTotal"] for p in q.recentProgress[-1:] for s in p["stateOperators"]]
    return sorted(tuple(map(str, r)) for r in spark.read.schema(out.schema).parquet(f"{root}/out").collect()), left


def test_due_visits_over_restarts(rocks, tmp_path):
    go = lambda rows: step(rocks, tmp_path, timers.visits, "court string, at timestamp, result string", rows)[0]
    got = go([("a", "2024-01-01 00:00:00", "error"), ("a", "2024-01-01 01:00:00", "error"), ("b", "2024-01-01 00:50:00", "hit"), (None, "2024-01-01 00:00:00", "hit")])
    planned = [("a", "planned", "2", "2024-01-01 01:45:00"), ("b", "planned", "0", "2024-01-01 01:00:00")]
    assert [r for r in got if r[1] == "planned"] == planned
    got = go([("c", "2024-01-01 03:00:00", "miss")])
    assert {r[:2] for r in got if r[1] == "due"} == {("a", "due"), ("b", "due")}
    got = go([("a", "2024-01-01 03:10:00", "hit"), ("c", "2024-01-01 04:00:00", "hit")])
    assert ("a", "planned", "0", "2024-01-01 03:20:00") in got and len([r for r in got if r[:2] == ("b", "due")]) == 1


def test_jobs_leave_after_a_day(rocks, tmp_path):
    go = lambda rows: step(rocks, tmp_path, timers.jobs, "job string, at timestamp, status string", rows)
    go([(f"j{i}", "2024-01-01 00:00:00", "running") for i in range(20)] + [("j0", "2024-01-01 12:00:00", "done"), ("j0", "2024-01-01 11:00:00", "late")])
    got, left = go([("k", "2024-01-02 06:00:00", "running")])
    assert ("j0", "kept", "done", "2024-01-01 12:00:00") in got
    assert {r[0] for r in got if r[1] == "evicted"} == {f"j{i}" for i in range(1, 20)}
    got, left = go([("k", "2024-01-02 13:00:00", "done")])
    assert len([r for r in got if r[1] == "evicted"]) == 20 and left and left[0] < 20
