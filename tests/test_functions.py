import datetime

import pytest
from pyspark.sql import functions as F

from caselight.functions import dates, names, text


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)) if given else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def nothing():
    return F.lit(None).cast("string")



@pytest.mark.parametrize(
    ("status", "label"),
    [
        ("Иск удовлетворен", "granted"),
        ("Отказано в удовлетворении", "denied"),
        ("Производство по делу прекращено", "terminated"),
        ("Заявление возвращено заявителю", "returned"),
        ("Исковое заявление возвращено", "returned"),
        ("Возвращено заявление", "returned"),
        ("Заявление оставлено без движения", "returned"),
        ("Иск удовлетворен частично", "granted_partial"),
        ("РЕШЕНИЕ ОТМЕНЕНО", "appealed_changed"),
        ("", "unknown"),
    ],
)
def test_outcome_by_status(spark, status, label):
    found = value(spark, names.outcome(F.col("s"), nothing(), nothing()), s=status)
    assert found["label"] == label
    assert found["source"] == ("none" if label == "unknown" else "status")


def test_outcome_by_events_and_act(spark):
    events = F.array(F.struct(F.lit("Решение").alias("name"), F.lit("Мировое соглашение").alias("result")))
    assert value(spark, names.outcome(nothing(), names.events_text(events), nothing()))["source"] == "events"
    act = "А" * 4000 + " РЕШИЛ: в удовлетворении исковых требований отказать"
    found = value(spark, names.outcome(F.lit(""), F.lit(""), F.col("a")), a=act)
    assert (found["label"], found["source"], found["confidence"]) == ("denied", "document", 0.85)
    early = "утвердить мировое соглашение " + "А" * 4000  # only the last part of an act counts
    assert value(spark, names.outcome(nothing(), nothing(), F.col("a")), a=early)["label"] == "unknown"


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('ООО "Ромашка"', ("ООО Ромашка", "ромашка", "ООО")),
        ("Общество с ограниченной ответственностью «Голиаф»", ("ООО Голиаф", "голиаф", "ООО")),
        ("ФГУП Почта", ("ФГУП Почта", "почта", "ФГУП")),
        ("ПАО Сбербанк", ("ПАО Сбербанк", "сбербанк", "ПАО")),
        ("Ромашка, ООО", ("Ромашка", "ромашка", None)),
        ("Ипатов Сергей", ("Ипатов Сергей", "ипатов сергей", None)),
        ("", None),
        ("A", None),
        ("ООО", None),
    ],
)
def test_entity(spark, raw, expected):
    found = value(spark, names.entity(F.col("r")), r=raw)
    assert (found and tuple(found)) == expected


def test_parties(spark):
    assert value(spark, names.parties(F.col("r")), r="Иванов И.И.; ООО Ромашка, ИП Петров / 12") == ["Иванов И.И.", "ООО Ромашка", "ИП Петров"]
    assert tuple(value(spark, names.split_parties(F.col("r")), r="Иванов; Петров")) == ("Иванов", "Петров")
    assert tuple(value(spark, names.split_parties(F.col("r")), r="Иванов — Петров")) == ("Иванов — Петров", None)


@pytest.mark.parametrize(
    ("raw", "kind"),
    [
        ("Иванов Иван Иванович", "identifiable"),
        ("Иванов И.И.", "identifiable"),
        ("И.И. Иванов", "identifiable"),
        ("ФИО1", "depersonalized"),
        ("<данные изъяты>", "depersonalized"),
        ("Л.С.В.", "depersonalized"),
        ("2-1/2024", "depersonalized"),
        ("ООО Ромашка", "org"),
        ("x", "empty"),
        ("", "empty"),
    ],
)
def test_name_kind(spark, raw, kind):
    assert value(spark, names.name_kind(F.col("r")), r=raw) == kind


def test_names_in_texts_and_roles(spark):
    found = value(spark, names.lawyers_in_text(F.col("t")), t="Адвокат: Петров Пётр Петрович, представитель — гражданка Сидорова Анна.\nзащитник")
    assert found == ["Петров Пётр Петрович", "Сидорова Анна"]
    assert value(spark, names.role_family(F.col("r")), r="ПРЕДСТАВИТЕЛЬ ИСТЦА") == "representative"
    assert value(spark, names.role_family(F.col("r")), r="ТРЕТЬЕ ЛИЦО") == "third"
    assert value(spark, names.representative_kind(F.col("r")), r="АДВОКАТ") == "advocate"
    assert value(spark, names.is_representative(F.col("r")), r="юрисконсульт")
    assert value(spark, names.party_kind(F.col("r")), r="ПАО ВТБ") == "bank"
    assert value(spark, names.season_bucket(F.lit("о взыскании алиментов"), nothing(), nothing())) == "divorce"
    assert value(spark, names.season_bucket(nothing(), nothing(), F.lit("Сбербанк"))) == "credit"


def test_dates(spark):
    for raw, expected in (("15.03.2024", datetime.date(2024, 3, 15)), ("c 1.3.2024 г.", datetime.date(2024, 3, 1)), ("01/03/2024", datetime.date(2024, 3, 1)), ("31.02.2024", None), ("23 декабря 2024", None), ("01.01.1889", None), ("", None)):
        assert value(spark, dates.record_date(F.col("r")), r=raw) == expected, raw
    assert value(spark, dates.date_key(F.col("r")), r="31.02.2024") == 20240231
    assert value(spark, dates.date_key(F.col("r")), r=" 2024-03-01 ") == 20240301
    assert value(spark, dates.date_key(F.col("r")), r="2024-03-01T10:00") is None  # a date alone
    assert value(spark, dates.date_key(F.col("r")), r="x 01.03.2024") is None
    day = lambda x: F.lit(x).cast("date")
    assert value(spark, dates.duration_days(day("2024-03-01"), day("2024-03-11"))) == 10
    assert value(spark, dates.duration_days(day("2024-03-11"), day("2024-03-01"))) is None
    windows = [tuple(map(str, r)) for r in dates.month_windows(spark, "2024-01-20", "2024-03-05").orderBy("window_start").collect()]
    assert windows == [("2024-01-20", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-05")]
    assert len(value(spark, dates.schedule_dates(day("2024-03-01"), 2, 3))) == 5
    assert len(value(spark, dates.schedule_dates(day("2024-03-01"), 2, 3, True))) == 6
    assert value(spark, dates.backoff(30, F.lit(3), 1.5, 90)) == 67.5
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    assert value(spark, dates.retry_after(F.lit("120"), now, 60)) == 60
    assert value(spark, dates.retry_after(F.lit("Fri, 01 Mar 2024 00:00:30 GMT"), now, 60)) == 30
    assert value(spark, dates.retry_after(F.lit("Thu, 29 Feb 2024 00:00:30 GMT"), now, 60)) is None


@pytest.mark.parametrize(("raw", "expected"), [("12 345,50", 12345.5), ("1.234.567,89", 1234567.89), ("12345.67", 12345.67), ("0", None), ("abc", None), ("", None), (f"12{chr(160)}345", 12345.0)])
def test_money(spark, raw, expected):
    assert value(spark, text.money(F.col("r")), r=raw) == expected


def test_amounts(spark):
    found = value(spark, text.amounts(F.col("r")), r="Истец просил о взыскании 150 000 руб. Суд решил взыскать 100 000,50 руб. и ещё взыскать 99 руб.")
    assert tuple(found) == (150000.0, 150000.0)  # a sum that is claimed counts as named for the award too
    found = value(spark, text.amounts(F.col("r")), r="Суд решил: взыскать с ответчика 100 000,50 руб. и ещё взыскать 99 руб.")
    assert tuple(found) == (None, 100000.5)
    assert tuple(value(spark, text.amounts(F.col("r")), r="взыскать 100 000 руб")) == (None, None)


def test_tokens(spark):
    a, b = value(spark, text.tokenize(F.col("r")), r="Взыскание задолженности, ЗАЁМ!"), value(spark, text.tokenize(F.col("r")), r="взыскания задолженность и по займу")
    assert a == ["взыскани", "задолженност", "заем"] and b == ["взыскан", "задолженност", "займ"]
    assert value(spark, text.tokenize(F.col("r")), r="  ! ") == []
    assert value(spark, text.stem(F.col("r")), r="договорами") == "договор"


def test_small_texts(spark):
    assert value(spark, text.clean(F.col("r")), r=f"a&nbsp;b{chr(160)} &amp;  c ") == "a b & c"
    assert value(spark, text.slug(F.col("r")), r="Ёлкин, Иван!") == "елкин-иван"
    assert value(spark, text.rounded(F.lit(-2.5))) == -2
    assert value(spark, text.percent(F.lit(1), F.lit(3))) == 33.3
    assert value(spark, text.percent(F.lit(1), F.lit(0))) == 0.0
    assert not value(spark, text.present(F.col("r")), r="")
