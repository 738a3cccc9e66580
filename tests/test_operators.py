import shutil

import pytest
from pyspark.sql import functions as F

from caselight.operators import cases, catalog, fulltext, lookup, merge, people, schedule, timeline
from caselight.sources import catalog as store

CASE = "id string, caseUid string, caseNumber string, courtSubdomain string, courtName string, courtRegion string, category string, parties string, plaintiff string, defendant string, judge string, status string, entryDate string, resultDate string, hearingDate string, caseUrl string, documentsCount int, hasActText boolean, collectedAt string, enrichedAt string"


def small_catalogue(spark):
    rows = [
        ("u1", "u1", "2-1/2024", "oct", "Октябрьский", "13", "Иски о взыскании → займ", "А; Б", "Сбербанк", "Петров", "Иванова И.И.", "Иск удовлетворен", "01.02.2024", "01.03.2024", "", "x", 1, True, "2024-03-01", "2024-03-02"),
        ("u2", "u2", "2-2/2024", "oct", "Октябрьский", "13", "Иски о взыскании → займ", "", "Сидоров", "", "Иванова И.И.", "Отказано в удовлетворении", "01.02.2024", "11.02.2024", "", "x", 0, False, "2024-03-02", "2024-03-02"),
        ("oct:11-1/2024", None, "11-1/2024", "oct", "Октябрьский", "13", "Апелляция", "", "", "", "Иванова И.И.", "Решение отменено", "", "", "", "x", 0, False, "2024-03-03", ""),
        ("u4", "u4", "2-4/2024", "len", "Ленинский", "", "", "", "", "", "", "", "31.02.2024", "", "", "", None, None, "2024-03-04", None),
    ]
    df = spark.createDataFrame(rows, CASE)
    return store.with_arrays(df.withColumns({c: F.lit(None).cast(f"array<{t}>") for c, t in (("documents", store.DOCUMENT), ("participants", store.PARTICIPANT), ("events", store.EVENT), ("changeLog", store.CHANGE))}))


def test_list_and_facets(spark):
    c = small_catalogue(spark)
    assert [r.id for r in catalog.page(catalog.list_cases(c, q="займ"), [F.desc("collectedAt"), F.col("id")]).collect()] == ["u2", "u1"]
    assert catalog.list_cases(c, court="oct", has_documents=True).count() == 1
    assert catalog.list_cases(c, group="appeal").count() == 1
    assert catalog.list_cases(c, group="no such group").count() == 4
    assert catalog.list_cases(c, enriched=False).count() == 2
    assert catalog.list_cases(c, judge="иванова").count() == 3
    assert {(r.courtRegion, r.n) for r in catalog.facet(c, "courtRegion", blanks=False).collect()} == {("13", 3)}
    assert tuple(catalog.enrichment_counts(c).first()) == (1, 1, 1)
    assert catalog.page(c, [F.col("id")], 0, 500).count() == 4


def test_facts_and_coverage(spark):
    f = {r.id: r for r in cases.facts(small_catalogue(spark)).collect()}
    assert (f["u1"].outcome, f["u1"].duration_days, f["u1"].plaintiff_kind, f["u1"].first_instance) == ("granted", 29, "bank", True)
    assert (f["oct:11-1/2024"].outcome, f["oct:11-1/2024"].appeal) == ("appealed_changed", True)
    assert f["u4"].duration_days is None
    indexed = spark.createDataFrame([("u1",), ("oct:11-1/2024",)], "id string")
    got = cases.coverage(small_catalogue(spark), indexed).first().asDict()
    assert (got["size"], got["with_url"], got["enriched"], got["pending"], got["in_index"]) == (4, 3, 2, 1, 2)
    assert cases.coverage(small_catalogue(spark), indexed, "13").first()["size"] == 3


def test_merge(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, name string, n int")
    new = spark.createDataFrame([("a", "", 5), ("c", "z", None)], "k string, name string, n int")
    got = {r.k: tuple(r)[1:] for r in merge.upsert(old, new, "k", ["name", "n"]).collect()}
    assert got == {"a": ("x", 5, False), "b": ("y", 2, False), "c": ("z", None, True)}
    assert {r.k: r.name for r in merge.upsert(old, new, "k", ["name"], blank_overwrites=True).collect()}["a"] == ""
    again = merge.upsert(merge.upsert(old, new, "k", ["name", "n"]).drop("is_new"), new, "k", ["name", "n"])
    assert {r.k: tuple(r)[1:3] for r in again.collect()} == {k: v[:2] for k, v in got.items()}  # merging twice changes nothing
    assert {(r.k, r.field, r["from"], r.to) for r in merge.changes(old, new, "k", ["name", "n"]).collect()} == {("a", "name", "x", ""), ("a", "n", "1", "5")}
    log = spark.range(1).select(merge.append_log(F.sequence(F.lit(1), F.lit(25)), F.sequence(F.lit(26), F.lit(40))).alias("l")).first()["l"]
    assert log == list(range(11, 41))
    assert spark.range(1).select(merge.append_log(F.array(F.lit(1)), F.array(F.lit(2))).alias("l")).first()["l"] == [1, 2]
    first = merge.keep_first([old, new], F.col("k"), ["k"])
    assert {(r.k, r.name) for r in first.collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    assert spark.range(1).select(merge.case_id(F.lit(""), F.lit("oct"), F.lit("2-1")).alias("i")).first()["i"] == "oct:2-1"


def test_enrich_keeps_what_details_lack(spark):
    c = small_catalogue(spark)
    d = c.where("id = 'u1'").select("id", "participants", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.struct(*[F.lit(None).cast("string").alias(x) if x != "name" else i.cast("string").alias("name") for x in ("date", "time", "name", "result", "basis", "note", "courtroom", "publishDate")])).alias("events"), "documents")
    got = {r.id: r for r in merge.enrich(c, d, F.lit("now")).collect()}
    assert len(got) == 4 and len(got["u1"].events) == 30 and got["u1"].enrichedAt == "now" and got["u2"].enrichedAt == "2024-03-02"


def test_bm25(spark):
    rows = spark.createDataFrame([("a", "взыскание задолженности по договору займа сумма"), ("b", "расторжение брака раздел имущества супругов алименты"), ("c", "договор аренды помещения срок плата стороны")], "id string, text string")
    index = fulltext.postings(rows, "id", "text")
    assert [r.id for r in fulltext.search(index, "id", "задолженность по займу", 2).collect()][0] == "a"
    assert fulltext.search(index, "id", "договор", 1).count() == 1
    assert fulltext.search(index, "id", "   ", 5).count() == 0
    once, twice = (fulltext.search(index, "id", q, 1).first()["score"] for q in ("аренда", "аренда аренда"))
    assert abs(twice - 2 * once) < 2e-4
    replaced = merge.replace_rows(rows, spark.createDataFrame([("a", "совсем другое содержание текста документа здесь")], "id string, text string"), "id")
    assert replaced.count() == 3


def test_chunks():
    assert fulltext.chunks_of("x" * 50) == []
    text = "\n".join("слово " * 100 for _ in range(5))
    plain, record = fulltext.chunks_of(text, repeat_tail=False), fulltext.chunks_of(text)
    assert [c[0] for c in plain] == list(range(len(plain))) and len(plain) == len(record) >= 3
    assert all(len(c[2]) <= 1200 for c in plain)
    long = " ".join(f"Предложение номер {i} довольно длинное и подробное." for i in range(120))
    cut = fulltext.chunks_of(long)
    assert len(cut) > 3 and max(len(c[2]) for c in cut) <= 1500


def test_lookup(spark):
    courts = spark.createDataFrame([("oktyabrsky--mor", "Октябрьский районный суд г. Саранска", "13", "ray", "13RS0025", False, True), ("tabasaran--dag", "Табасаранский районный суд", "5", "ray", "05RS0029", False, True), ("vs--mor", "Верховный Суд Республики Мордовия", "13", "vs", "13OS0000", False, True)], store.COURT)
    hits = lookup.search_courts(courts, "Саранск").collect()
    assert [(h.subdomain, h.score) for h in hits] == [("oktyabrsky--mor", 183), ("vs--mor", 64), ("tabasaran--dag", 3)]  # not by a part of a word
    assert lookup.search_courts(courts, "vs--mor").first()["score"] == 1000
    assert lookup.search_courts(courts, " ").count() == 0
    assert lookup.best_court(courts, "Октябрьский районный суд Саранск").first()["subdomain"] == "oktyabrsky--mor"
    names = spark.createDataFrame([(1, 'ООО "Ромашка"', "c1"), (2, "Общество с ограниченной ответственностью Ромашка", "c2"), (3, "ООО Ромашка Плюс", "c3")], "seq int, raw string, case string")
    index = lookup.entities(names, "raw", "seq", "case")
    found = lookup.resolve(index, "ООО Ромашка").collect()
    assert [(r.key, r.score, r.aliases, r.cases) for r in found] == [("ромашка", 180, 2, 2), ("ромашка плюс", 50, 1, 1)]  # 100 for the key, 50 and 30 for parts
    assert tuple(lookup.entity_stats(index).first()) == (2, 1)


def test_people(spark):
    rows = spark.createDataFrame([("Иванов", "plaintiff", "c1", "oct"), ("иванов", "judge", "c1", "oct"), ("Иванов", "plaintiff", "c2", "len"), ("Петров", "other", "c1", "oct")], "name string, family string, case_id string, court string")
    got = {r.person: r for r in people.index(rows).collect()}
    assert (got["иванов"].appearances, got["иванов"].cases, got["иванов"].courts, got["иванов"].families, got["иванов"].primary_family) == (3, 2, 2, ["plaintiff", "judge"], "plaintiff")  # the judge's family names a person last but one
    facets = {r.family: (r.people, r.appearances) for r in people.facets(people.index(rows)).collect()}
    assert len(facets) == 6 and facets["third"] == (0, 0) and facets["judge"] == (1, 3)
    grid = people.matrix(rows, "name", "court", 5).collect()
    assert len(grid) == 6 and sum(r.n for r in grid) == 4
    rating = spark.range(1).select(people.professional_rating(*[F.lit(x) for x in (100, 100, 100, 100, 100, 100, 2)], F.lit(True)).alias("r")).first()["r"]
    assert rating == 94
    assert spark.range(1).select(people.dossier_rating(F.lit(3), F.lit(None).cast("double"), F.lit(1)).alias("r")).first()["r"] == 47


def test_reports_on_empty_input(spark):
    none = spark.createDataFrame([], "key string, label string, days int, day date, seq int")
    assert cases.label_counts(none, "label", ("a", "b")).count() == 2
    assert cases.win_rates(none, "key", F.col("label"), F.col("key"), F.col("key"), F.col("seq")).count() == 0
    assert cases.lifecycle(none, "days").first()["n"] == 0
    assert cases.months(none, F.month("day"), F.col("label"), ["a"]).count() == 12
    assert cases.depersonalization(none, F.col("label")).first()["verdict"] == "insufficient"
    assert people.heat(none, "key", "label").count() == 0


def test_timeline_and_schedule(spark):
    t = timeline.of_cases(small_catalogue(spark)).where("id = 'u1'").orderBy("at").collect()
    assert [(str(r.at), r.label) for r in t] == [("2024-02-01 12:00:00", "entry"), ("2024-03-01 12:00:00", "result")]
    courts = spark.createDataFrame([("a",), ("b",), ("c",)], "court string").withColumn("due", F.lit(None).cast("timestamp"))
    assert [r.court for r in schedule.ready(courts, [F.col("court")], 1, F.lit("2024-01-01").cast("timestamp"), "due", 2).collect()] == ["b", "c"]
    score = spark.range(1).select(schedule.priority(F.lit(True), F.lit(False), F.lit("ray"), F.lit("x")).alias("s")).first()["s"]
    assert score == 130


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.current_version(spark, root) is None
    c = small_catalogue(spark)
    store.write_version(c, root, 1)
    store.write_version(c.limit(1), root, 2)
    assert store.read_version(spark, root).count() == 1 and store.read_version(spark, root, 1).count() == 4
    with pytest.raises(FileExistsError):
        store.write_version(c, root, 2)
    assert store.read_version(spark, root).count() == 1
    shutil.rmtree(tmp_path / "store" / "log")
    with pytest.raises(RuntimeError):
        store.current_version(spark, root)
    (tmp_path / "c.json").write_text('{"version": 1, "cases": {"a": {"id": "a", "caseNumber": "2-1", "events": [{"name": "x"}]}}}')
    row = store.read_json(spark, str(tmp_path / "c.json")).first()
    assert (row.id, row.documents, row.events[0].name) == ("a", [], "x")


def test_medians_are_exact_without_a_task_that_holds_all_values(spark):
    for n in (0, 1, 2, 3, 4, 9_998, 9_999):
        rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("b"), F.lit(7.0).alias("c"))
        expected = rows.agg(F.median("a").alias("a"), F.median("b").alias("b"), F.median("c").alias("c")).first()
        assert cases.medians(rows, ["a", "b", "c"]).first() == expected
    plan = cases.amounts_report(rows, F.col("a"), F.col("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan


def test_cases_without_uid_are_dealt(spark):
    rows = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") == 5, "u5").alias("caseUid"), F.lit("x").alias("caseUrl"), F.lit("").alias("enrichedAt"), F.lit(0).alias("documentsCount"), F.lit(False).alias("hasActText"), F.array().cast("array<struct<text:string,hasText:boolean>>").alias("documents"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = cases.coverage(rows, spark.createDataFrame([("u5",), ("c7",)], "id string"))
    assert (got.first()["size"], got.first()["in_index"]) == (1000, 2)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in x]
    assert any("__uid" in x for x in dealt) and not any("caseUid" in x for x in dealt)
