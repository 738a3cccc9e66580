import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from caselight.operators import containment, lookup, people, search


def product(needles, texts):
    return {(n, t) for n in needles if n for t in texts if t is not None and n in t}


def run(spark, needles, texts):
    out = containment.contained(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    return out, [tuple(r) for r in out.select("needle", "text").collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abё😀 ", max_size=6) | st.none(), max_size=8), st.lists(st.text("abё😀 ", max_size=12) | st.none(), max_size=12))
def test_equal_to_the_product(spark, needles, texts):
    _, got = run(spark, needles, texts)
    assert sorted(got) == sorted(product(needles, texts))


def test_repeats_hot_pieces_and_long_texts(spark):
    rng = random.Random(1)
    texts = [f"общество ромашка {rng.randrange(200)}" for _ in range(600)] + ["x" * 50_000 + "игла", None, ""]
    needles = ["ромашка 1", "ромашка 1", "игла", "а", "шк", "нет такого", "", None] + [f"{i}" for i in range(20)]
    out, got = run(spark, needles, texts)
    assert len(got) == len(set(got)) and set(got) == product(needles, texts)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and all("piece" in line for line in plan.splitlines() if "Join " in line)


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(f"c{i}", f"ПАО Банк {i % 3}" if i % 2 else None, "Иванова И.И.", "Судья Петров", "", [("АДВОКАТ", f"Сидоров {i % 4}")] if i % 5 else None) for i in range(24)]
    return spark.createDataFrame(rows, "id string, plaintiff string, defendant string, judge string, parties string, participants array<struct<role:string,name:string>>")


def test_people_as_one_at_a_time(spark, catalogue):
    found = spark.createDataFrame([("иванова", 3), ("иванова и.и.", 9), ("иванова и.и. младшая", 9), ("петров", 1), ("х", 5)], "person string, cases long")
    names = ["Иванова  И.И.", "иванова", "Иванова И.", "Сам Петров и Ко", "Никто", " ", None, "Х", "Иванова И.И. младшая и старшая"]
    got = {r.name: r.person for r in containment.find_people(found, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    one = {n: people.find_person(found, n).collect() for n in names if n}
    assert got == {n: r[0].person for n, r in one.items() if r}


def test_cases_as_one_at_a_time(spark, catalogue):
    names = ["сидоров 1", "БАНК", "петров", "нет", "", None]
    got = {tuple(r) for r in containment.cases_of_names(catalogue, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(n, r.id) for n in names if n for r in people.cases_of(catalogue, n).collect()}


def test_records_as_one_at_a_time(spark):
    rows = [("ООО Ромашка", 1), ("ООО «Ромашка»", 2), ("ООО Ромашка плюс", 3), ("ПАО Сбербанк", 4), ("ПАО Сбербанк", 5), ("АО Луч", 6)]
    cases = spark.createDataFrame([(f"c{i}", n, None, "", None, "1", "x") for n, i in rows], "id string, plaintiff string, defendant string, parties string, participants array<struct<role:string,name:string>>, courtRegion string, courtSubdomain string")
    found = lookup.mentions(cases)
    asked = ["Ромашка", "ООО Ромашка", "сбер", "луч", "Ничего", " "]
    got = {}
    for r in containment.resolve_table(found, spark.createDataFrame([(q,) for q in asked], "query string")).orderBy("place").collect():
        got.setdefault(r["query"], []).append((r["key"], r["score"], r["case_count"]))
    one = {q: [(r["key"], r["score"], r["case_count"]) for r in lookup.resolve_records(found, q).collect()] for q in asked if q.strip()}
    assert got == {q: rows for q, rows in one.items() if rows}


def test_region_of_hits_without_a_nested_loop(spark):
    cases = spark.createDataFrame([("a", "UID-12", "1", "2024"), ("b", "uid-123", "2", "2025"), ("c", None, "3", "2026"), ("uid-1", "zz", "4", "2020")], "id string, caseUid string, courtRegion string, collectedAt string")
    hits = spark.createDataFrame([("uid-12",), ("UID-12",), ("uid-1",), ("none",), (None,)], "case_uid string")
    out = search.with_region(hits, cases)
    assert {r.case_uid: r.region for r in out.collect()} == {"uid-12": "2", "UID-12": "2", "uid-1": "4", "none": None, None: None}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
