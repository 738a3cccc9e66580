"""A catalogue of cases made of the orders, the same for Spark and for SQL.

Each order is a case: its number, parties, status, people, events and acts follow from the keys, so that what the operators
must find in them is known beforehand. Expressions are written once, in words that both dialects take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

LETTERS = "АБВГДЕЖЗИК"
K, C = "o_orderkey", "o_custkey"


def person(x: str) -> str:
    """A surname with initials; a thousand different ones."""
    letter = lambda by: f"substr('{LETTERS}', CAST(floor(({x}) / {by}) AS INT) % 10 + 1, 1)"
    return f"({letter(1)} || 'ванов ' || {letter(10)} || '.' || {letter(100)} || '.')"


def day(plus: str = "0") -> str:
    return f"(CAST(o_orderdate AS DATE) + CAST({plus} AS INT))"


def written(d: str) -> str:
    """A date as court records write it."""
    return f"(lpad(CAST(day({d}) AS STRING), 2, '0') || '.' || lpad(CAST(month({d}) AS STRING), 2, '0') || '.' || CAST(year({d}) AS STRING))"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def by(x: str, values: list[str], otherwise: str | None = None) -> str:
    """The value at the place x."""
    return f"CASE {x} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + (f" ELSE {otherwise}" if otherwise is not None else "") + " END"


STATUS = ("Иск удовлетворен полностью", "Иск удовлетворен частично", "В иске отказано", "Утверждено мировое соглашение", "Производство по делу прекращено", "Заявление возвращено заявителю", "Решение отменено", "Решение оставлено без изменения", "")
OUTCOME = ("granted", "granted_partial", "denied", "settled", "terminated", "returned", "appealed_changed", "appealed_upheld", "unknown")
CATEGORY = ("Гражданские дела → иски о взыскании", "Уголовные дела", "Дела об административных правонарушениях", "", "Апелляция → прочее")

PLAINTIFF = by(f"{C} % 4", ["'ПАО Сбербанк'", f"'ООО Ромашка ' || {text(f'{C} % 50')}", person(C), f"'ФИО' || {text(f'{C} % 9')}"])
JUDGE = person(f"{C} % 40")
SECOND = person(f"{C} % 40 + 1")
REPRESENTATIVE, ADVOCATE, PRESIDENT = person(f"{C} + 3"), f"CASE WHEN {K} % 12 = 1 THEN 'ФИО2' ELSE {person(f'{K} % 37')} END", person(f"{K} % 23")
IN_TEXT = f"(substr('{LETTERS}', CAST({K} % 10 AS INT) + 1, 1) || 'етров Семен Ильич')"

#: Plain columns of a case.
COLUMNS = {
    "id": f"'c' || {text(K)}",
    "caseUid": f"CASE WHEN {K} % 3 = 0 THEN 'uid-' || {text(K)} END",
    "caseNumber": by(f"{K} % 5", [f"'11-' || {text(K)} || '/2024'", f"'2-' || {text(K)} || '/2024'", f"'2-' || {text(K)} || '/2023'", f"'5-' || {text(K)} || '/2024'", f"'2а-' || {text(K)} || '/2024'"]),
    "courtSubdomain": "replace(lower(n_name), ' ', '-') || CASE WHEN n_regionkey = 2 THEN '--mor' ELSE '' END",
    "courtName": "n_name || ' районный суд'",
    "courtRegion": f"CASE WHEN {K} % 13 = 0 THEN '' ELSE {text('n_regionkey + 11')} END",
    "category": by("CAST(substr(o_orderpriority, 1, 1) AS INT) - 1", [f"'{x}'" for x in CATEGORY]),
    "parties": f"CASE WHEN {K} % 10 = 7 THEN 'ООО Вектор / АО Луч' ELSE '' END",
    "plaintiff": PLAINTIFF,
    "defendant": f"CASE WHEN {K} % 6 = 0 THEN NULL ELSE {person(K)} END",
    "judge": f"CASE WHEN {K} % 17 = 0 THEN '' WHEN {K} % 19 = 0 THEN {JUDGE} || ', ' || {SECOND} ELSE {JUDGE} END",
    "status": by(f"{K} % 9", [f"'{x}'" for x in STATUS]),
    "entryDate": written(day()),
    "resultDate": f"CASE WHEN {K} % 4 <> 3 THEN {written(day(f'{K} % 200'))} END",
    "hearingDate": f"CASE {K} % 3 WHEN 0 THEN {written(day('10'))} WHEN 1 THEN {text(day('10'))} ELSE '' END",
    "hearingTime": "'10:00'",
    "caseUrl": f"CASE WHEN {K} % 6 <> 5 THEN '/case?k=' || {text(K)} ELSE '' END",
    "documentsCount": f"CAST({K} % 3 AS INT)",
    "hasActText": f"{K} % 4 = 1",
    "collectedAt": f"{text(day())} || 'T00:00:00.000Z'",
    "enrichedAt": f"CASE WHEN {K} % 5 <> 2 THEN {text(day('1'))} || 'T00:00:00.000Z' ELSE '' END",
}

#: Participants of a case, in order: condition, role, name.
PARTICIPANTS = (("TRUE", "ИСТЕЦ", PLAINTIFF), (f"{K} % 2 = 0", "ПРЕДСТАВИТЕЛЬ", REPRESENTATIVE), (f"{K} % 3 = 1", "АДВОКАТ", ADVOCATE), (f"{K} % 4 = 2", "ТРЕТЬЕ ЛИЦО", "'ФИО1'"))
PRESIDED = f"{K} % 7 = 0"
HAS_ACT, ACT_NAMES_ONE = f"{K} % 3 > 0", f"({K} % 3 > 0 AND {K} % 5 = 1)"
ACT = f"CASE WHEN {K} % 5 = 1 THEN 'В заседании адвокат ' || {IN_TEXT} || ', явился и поддержал требования. ' ELSE '' END"
LOWER_JUDGE = f"CASE WHEN {K} % 10 = 0 THEN {JUDGE} END"

#: What is known of a case beforehand: its outcome, its duration, and whether a representative can be told or is named at all.
LABEL = by(f"{K} % 9", [f"'{x}'" for x in OUTCOME])
DAYS = f"CAST(CASE WHEN {K} % 4 <> 3 THEN {K} % 200 WHEN {HAS_ACT} THEN 20 END AS INT)"
TOLD = f"({K} % 2 = 0 OR ({K} % 3 = 1 AND {K} % 12 <> 1) OR {ACT_NAMES_ONE})"
NAMED = f"({K} % 2 = 0 OR {K} % 3 = 1 OR {ACT_NAMES_ONE})"

FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

#: The catalogue in SQL: the plain columns, and those that are known beforehand.
CASES = "cases AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in COLUMNS.items()) + f", {LABEL} AS z_label, {DAYS} AS z_days, {K} AS z_k, {C} AS z_c, n_regionkey AS z_r, {TOLD} AS z_told, {NAMED} AS z_named FROM {FROM})"


def cases(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """The catalogue: plain columns, and participants, events, documents and firstInstance.

    dealt: the orders go to all cores first, in shares of which each core does several, by few and short columns, for queries whose work on each case takes long: a file
    of few row groups is read, and worked on, by few tasks.
    """
    read = lambda name: ship(spark).read.parquet(f"{sf}/{name}.parquet")
    orders = read("orders")
    if dealt:
        orders = orders.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "o_custkey")
    places = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    rows = orders.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    struct = lambda **parts: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")"
    people = ", ".join(struct(role=f"CASE WHEN {when} THEN '{role}' END", name=name) for when, role, name in PARTICIPANTS)
    event = struct(date=written(day("2")), time="'10:30'", name=f"CASE WHEN {PRESIDED} THEN 'Назначен судья' ELSE 'Регистрация' END", result=f"CASE WHEN {PRESIDED} THEN {PRESIDENT} ELSE '' END")
    act = struct(docId="'cont_doc1'", name="'РЕШЕНИЕ'", date=written(day("20")), text=ACT, hasText="CAST(NULL AS BOOLEAN)")
    nested = {
        "participants": f"filter(array({people}), x -> x.role IS NOT NULL)", "events": f"array({event})", "documents": f"filter(array({act}), x -> {HAS_ACT})",
        "firstInstance": struct(court="CAST(NULL AS STRING)", caseNumber="CAST(NULL AS STRING)", judge=LOWER_JUDGE),
    }
    return rows.select(*[F.expr(e).alias(c) for c, e in (COLUMNS | nested).items()])


def named_rows(parts: list[tuple[str, str, str]], columns: str) -> str:
    """SQL rows of the catalogue's orders, one for each (condition, pos, values) that holds: values are named as in columns."""
    return " UNION ALL ".join(f"SELECT {K} AS z_k, {at} AS pos, {values} FROM {FROM} WHERE {when}" for when, at, values in parts) if parts else columns
