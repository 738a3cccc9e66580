import pytest
from pyspark.sql import functions as F

from caselight.functions import names
from caselight.operators import catalog, dashboard, fulltext, lookup, merge, people, professionals, search
from caselight.operators.catalog import ListRequest
from caselight.sources import catalog as store
from caselight.sources.store import Store
from caselight.streaming import ingest

from .test_operators import small_catalogue


def values(spark, made, **columns):
    """The value of each expression for a row of strings."""
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)) if columns else spark.range(1)
    return tuple(row.select(*[c.alias(f"c{i}") for i, c in enumerate(made)]).first())


def test_names_and_roles(spark):
    n = F.col("n")
    assert values(spark, [names.clean_name(n)], n="  Иванов   Иван ") == ("Иванов Иван",)
    for bad in ("ФИО1", "12345", "я", "нет данных", "..."):
        assert values(spark, [names.clean_name(n)], n=bad) == (None,)
    assert values(spark, [names.professional_name(n, F.lit(True)), names.professional_name(n, F.lit(False))], n="Цой") == ("Цой", None)
    for bad in ("ООО Ромашка", "не назначен", "отложено", "77"):
        assert values(spark, [names.professional_name(n, F.lit(True))], n=bad) == (None,)
    assert values(spark, [names.split_names(n)], n="Судья: Иванов И.И., Петров П.П. и Сидоров С.С.") == (["Иванов И.И.", "Петров П.П.", "Сидоров С.С."],)
    assert values(spark, [names.lawyers_in_fields(n)], n="адвокат: Семенов Семен Семенович из города; защитник - Ли") == (["Семенов Семен Семенович из"],)
    accepted = [names.role_accepted(n, w) for w in ("rep", "истец", "third", "judge", "ПОМОЩНИК", "all", None)]
    assert values(spark, accepted, n="Помощник адвоката") == (True, False, False, False, True, True, True)
    matched = [names.role_matches(n, w) for w in ("plaintiff", "Истец", "взыскат", "defendant", "*")]
    assert values(spark, matched, n="ВЗЫСКАТЕЛЬ") == (True, True, True, False, True)
    assert [names.family_matches("plaintiff", w) for w in ("истец", "ист", "plain", "judge", "other")] == [True, True, True, False, True]
    assert values(spark, [names.looks_like_organisation(n)], n="Фонд защиты") == (True,)
    assert values(spark, [names.short_court_name(n, F.lit("x"))], n="Октябрьский районный суд  Республики Мордовия") == ("Октябрьский райсуд",)
    assert values(spark, [names.short_court_name(n, F.lit("x"))], n="Республики Мордовия") == ("x",)
    assert values(spark, [F.length(names.short_court_name(n, F.lit("x")))], n="о" * 40) == (27,)
    labels = [names.region_label(F.lit(r), F.lit(c)) for r, c in (("5", "Суд Республики Дагестан"), ("62", "Рязанская область: Рязанская областной"), ("77", "Суд города Москва"), ("99", "Суд"), ("13", "Суд"))]
    assert values(spark, labels) == ("Дагестан", "Рязанская", "Москва", "Рег. 99", "Мордовия")


def test_requests(spark):
    for wrong in ({"limit": 0}, {"limit": 501}, {"offset": -1}, {"enriched": "yes"}, {"limit": "5"}):
        with pytest.raises(ValueError):
            ListRequest(**wrong)
    c = small_catalogue(spark)
    ids = lambda **r: sorted(x.id for x in catalog.matching(c, ListRequest(**r)).collect())
    assert ids() == ids(court="all", group="all", participant_role="all") == sorted(["u1", "u2", "oct:11-1/2024", "u4"])
    assert ids(participant="сбер") == ids(participant="сбер", participant_role="истец") == ["u1"] and ids(participant="сбер", participant_role="judge") == []
    assert ids(participant="А", participant_role="all", court="oct") == ["oct:11-1/2024", "u1", "u2"]  # parties and judge count without a role
    assert ids(participant_role="defendant") == ["u1"] and ids(uid="U2") == ["u2"] and ids(case_number="11-") == ["oct:11-1/2024"]
    assert ids(hearing_from="2024-01-01") == [] and len(ids(hearing_from="no day")) == 4
    with_docs = catalog.list_page(c.withColumn("hearingTime", F.lit(None).cast("string")), ListRequest(limit=2, offset=1)).collect()
    assert [r.id for r in with_docs] == ["oct:11-1/2024", "u2"] and {r.total for r in with_docs} == {4} and with_docs[0].eventsCount == 0
    assert catalog.pending_count(c).first()["pending"] == 1 and catalog.pending_count(c, "99").first()["pending"] == 0


def test_flags_and_index_changes(spark, tmp_path):
    c = small_catalogue(spark)
    once = merge.mark_act_text(c, spark.createDataFrame([("u2",), ("no",)], "id string"))
    again = merge.mark_act_text(once, once.where("id = 'u2'"))
    assert sorted(r.id for r in again.where("hasActText").collect()) == ["u1", "u2"] and again.count() == 4
    chunks = spark.createDataFrame([("u1", 0, 0, "a"), ("u1", 1, 5, "b"), ("u2", 0, 0, "c")], "id string, number int, offset int, text string")
    left, removed = fulltext.remove_case(chunks, "id", "u1")
    assert [r.id for r in left.collect()] == ["u2"] and removed.first()["removed"] == 2
    docs = spark.createDataFrame([("u1", "x" * 200), ("u3", "слово " * 40), ("u4", "short")], "id string, text string")
    assert sorted({r.id for r in fulltext.reindex(docs, chunks, "id", "text").collect()}) == ["u1", "u2", "u3"]
    root = str(tmp_path / "store")
    store.write_version(c, root, 3)
    assert store.changed_since(spark, root, 3) is None and store.changed_since(spark, root, 2).count() == 4
    jobs = spark.createDataFrame([("a", "2024-01-02 00:00:00", None), ("b", "2024-01-01 00:00:00", "2024-01-02 06:00:00"), ("c", "2024-01-01 00:00:00", None)], "job string, created string, finished string").select("job", F.col("created").cast("timestamp").alias("created"), F.col("finished").cast("timestamp").alias("finished"))
    assert sorted(r.job for r in ingest.live(jobs, F.lit("2024-01-02 12:00:00").cast("timestamp")).collect()) == ["a", "b"]


def test_new_query_over_an_old_store(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "store"), "k", ("name",), "seq")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, name string, seq int")
    ingest.upsert_batches(kept, "first")(rows(("a", "x", 1)), 40)
    ingest.upsert_batches(kept, "second")(rows(("b", "y", 1)), 0)  # its own first batch counts
    ingest.upsert_batches(kept, "second")(rows(("b", "z", 9)), 0)  # the same batch again doesn't
    assert {tuple(r) for r in kept.read().select("k", "name").collect()} == {("a", "x"), ("b", "y")}


def test_total_of_a_page_past_the_end(spark):
    r = ListRequest(limit=10, offset=1000)
    assert catalog.list_page(small_catalogue(spark), r, full=True).collect() == [] and catalog.list_total(small_catalogue(spark), r).first().total == 4
    assert catalog.list_total(small_catalogue(spark).limit(0), r).first().total == 0


def test_json_that_other_programs_read(spark, tmp_path):
    import json

    c = small_catalogue(spark).repartition(2)
    store.write_json(c, str(tmp_path / "json"))
    found = [json.loads(p.read_text()) for p in (tmp_path / "json").glob("part-*")]
    assert all(d["version"] == 1 for d in found)
    cases = {k: v for d in found for k, v in d["cases"].items()}
    assert sorted(cases) == sorted(r.id for r in c.collect()) and all(v["id"] == k for k, v in cases.items())
    again = store.read_json(spark, str(tmp_path / "json"))
    assert sorted(again.select("id", "caseNumber", "category").collect()) == sorted(c.select("id", "caseNumber", "category").collect())


def test_cards_of_profiles(spark):
    rows = [("иванов иван петрович", "judge", True, 90, 5), ("иванов и.п.", "lawyer", False, 70, 9), ("петров петр", "lawyer", False, 60, 1)]
    cards = spark.createDataFrame([(p, p.title(), p.replace(" ", "-"), *r) for p, *r in rows], "person string, name string, card_id string, primary_role string, is_judge boolean, rating int, cases int")
    of = lambda *a, **k: [r.person for r in professionals.card_of_profile(cards, *a, **k).collect()]
    assert of("Иванов", "Иван", "Петрович") == ["иванов иван петрович"] and of("Иванов", "Иван", role="lawyer") == ["иванов и.п."]
    assert of("Сидоров", "Иван") == [] and of("Ли") == []
    get = lambda k: [r.person for r in professionals.get_card(cards, k).collect()]
    assert get("петров-петр") == get("Петров Петр") == ["петров петр"] and get("иванов") == ["иванов иван петрович"] and get("x") == []
    labels = spark.createDataFrame([("13", "Мордовия")], "region string, label string")
    none = professionals.regional(cards.withColumn("region", F.lit(None).cast("string")), spark.createDataFrame([("13", 4), ("5", 9)], "region string, n long"), labels).collect()
    assert sorted((r.region, r.label, r.total, r["mode"]) for r in none) == [("13", "Мордовия", 4, "cases"), ("5", "Рег. 5", 9, "cases")]


def test_searches(spark):
    courts = spark.createDataFrame([("vs--mor", "Верховный Суд Республики Мордовия", "13", "vs", "", False, True), ("oktyabrsky--mor", "Октябрьский районный суд г. Саранска", "13", "ray", "", False, True)], store.COURT)
    picked = search.pick_courts(courts, ["Саранск", ""]).collect()
    assert [r.subdomain for r in picked] == ["vs--mor", "oktyabrsky--mor"] and picked[0].ambiguous  # a supreme court first, with fewer points
    assert search.pick_courts(courts, [""]).count() == 0
    c = small_catalogue(spark)
    hits = spark.createDataFrame([("u1", 2.0), ("1", 1.0), ("none", 0.5)], "case_uid string, score double")
    assert {r.case_uid: r.region for r in search.with_region(hits, c).collect()} == {"u1": "13", "1": "13", "none": None}
    chunks = spark.createDataFrame([("k1", "u1", "Октябрьский", "2-1/2024", "взыскание задолженности по договору займа банком " * 3), ("k2", "u4", "Ленинский", "2-4/2024", "договор аренды помещения между сторонами заключен " * 3)], "chunk_id string, case_uid string, court string, case_number string, text string")
    index = fulltext.postings(chunks, "chunk_id", "text")
    rows = c.withColumn("hearingTime", F.lit(None).cast("string"))
    page, texts = search.collected(index, chunks, rows, ListRequest(q="договор", court="октябр"))
    assert [r.chunk_id for r in texts.collect()] == ["k1"] and page.count() == 0
    _, texts = search.collected(index, chunks, rows, ListRequest(q="договор", region="13"))
    assert [r.chunk_id for r in texts.collect()] == ["k1"]
    found = search.participant_search("Сбербанк", index, chunks, rows, courts, region="Саранск")
    assert [r.id for r in found["cases"].collect()] == ["u1"] and found["texts"].count() == 0 and found["courts"].count() == 2
    plan = spark.createDataFrame([(5, 0), (4, 1)], "category int, place int")
    results = spark.createDataFrame([("a", 5, "2-1", None), ("a", 4, "2-1", None), ("a", 41, "2-2", None), ("b", 5, "2-1", "u")], "court string, category int, caseNumber string, caseUid string")
    deep = search.deep_search(spark.createDataFrame([("a",), ("b",)], "court string"), plan, results)
    assert sorted((r.court, r.caseNumber, r.category) for r in deep.collect()) == [("a", "2-1", 5), ("b", "2-1", 5)]
    category = F.struct(F.lit(5).alias("delo_id"), F.lit(1).alias("case_type"), F.lit("g1_").alias("prefix"))
    params = spark.range(1).select(search.search_params(category, {"participant": F.lit("Иванов"), "uid": F.lit(""), "entry_from": F.lit("01.02.2024")}).alias("p")).first()["p"]
    assert (params["G1_PARTS__NAMESS"], params["g1_case__ENTRY_DATE1D"], params["delo_table"], params["delo_id"]) == ("Иванов", "01.02.2024", "g1_case", "5") and "g1_case__JUDICIAL_UIDSS" not in params


def test_stored_index_gives_the_same(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"договор займа номер {i} и взыскание задолженности по нему " * (1 + i % 3)) for i in range(30)], "id int, text string")
    index = fulltext.store_index(rows, "id", "text", str(tmp_path / "index"))
    q = "задолженность по договорам 17"
    stored = [tuple(r) for r in fulltext.search(index, "id", q, 5).collect()]
    assert stored == [tuple(r) for r in fulltext.search(fulltext.postings(rows, "id", "text"), "id", q, 5).collect()] and stored[0][0] == 17
    assert [tuple(r) for r in fulltext.search(fulltext.load_index(spark, str(tmp_path / "index")), "id", q, 5).collect()] == stored


def test_people_and_empty_tables(spark):
    none = small_catalogue(spark).limit(0).withColumn("firstInstance", F.lit(None).cast("struct<court:string,caseNumber:string,judge:string>"))
    from caselight.operators import cases as reports

    facts = reports.facts(none)
    assert people.full_index(people.appearances_of(none)).count() == 0
    assert people.person_dossier(facts, "x")["summary"].first()["cases"] == 0
    assert professionals.cards(professionals.appearances(none)).count() == 0
    assert dashboard.totals(none).first()["catalog"] == 0 and dashboard.deep_judges(facts).count() == 0
    assert lookup.records(lookup.mentions(none)).count() == 0
    index = people.full_index(people.appearances_of(small_catalogue(spark)))
    assert [r.person for r in people.find_person(index, "Иванова И.И.").collect()] == ["иванова и.и."] and people.find_person(index, " ").count() == 0
    assert [r.person for r in people.find(index, family="судья").collect()] == ["иванова и.и."]


def test_names_are_judged_once(spark):
    cases = small_catalogue(spark)
    for rows, generates in ((people.appearances_of(cases), 2), (people.representatives(cases), 2)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == generates and plan.count("данные изъяты") <= 3  # a placeholder of the fixed list, in one place of the plan


def test_index_reads_the_appearances_three_times(spark):
    found = people.appearances_of(small_catalogue(spark))
    plan = people.full_index(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 2  # first numbers and roles; sums and courts are cut before


def test_fields_without_names_are_not_dealt(spark):
    from caselight.functions import names

    fields = [("judge", "", "Иванов"), ("participant", "истец", "ПАО Сбербанк"), ("participant", "адвокат", "Петров П.П."), ("event", "регистрация", "x"), ("event", "назначен судья", "Сидоров"), ("parties", "", "ООО Вектор / АО Луч"), ("parties", "", "ООО Вектор, Представитель: Орлов О.О.")]
    rows = spark.createDataFrame(fields, "kind string, about string, raw string")
    each = [F.col(c) for c in rows.columns]
    got = rows.select(names.may_hold_names(*each).alias("may"), names.names_of_field(*each).alias("n")).collect()
    assert [r.may for r in got] == [True, False, True, False, True, False, True]
    assert all(r.may or r.n.role is None or not r.n.names for r in got)
