"""The operators on cases, applied to a catalogue that is made of the orders (see `case_table`), each with SQL that derives the rows from the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import ENDINGS, STOP_WORDS
from ..operators import cases as reports
from ..operators import catalog, containment, dashboard, fulltext, lookup, maintained, merge, people, professionals, search, timeline
from ..operators.catalog import ListRequest
from ..operators.text_index import TextIndex
from ..session import folder
from ..sources import pages
from ..sources.store import Store
from ..streaming import collect, ingest
from . import case_table as ct
from .case_table import CASES, FROM, C, K
from .driver import query, t

_joined = lambda c: F.array_join(c, "; ")


# --- facts, lists, counts ---------------------------------------------------------------------------------------------


@query(f"""WITH {CASES} SELECT id, z_label AS outcome, z_days AS duration_days, "caseNumber" LIKE '2%' AS first_instance, "caseNumber" LIKE '11-%' AS appeal, CASE WHEN z_c % 4 = 0 THEN 'bank' ELSE 'other' END AS plaintiff_kind FROM cases""")
def case_facts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.facts(ct.cases(spark, sf)).select("id", "outcome", "duration_days", "first_instance", "appeal", "plaintiff_kind")


_REQUESTS = {
    "q": (ListRequest(q="СберБанк"), "z_c % 4 = 0"),
    "number": (ListRequest(case_number="11-1"), "contains(lower(\"caseNumber\"), '11-1')"),
    "uid": (ListRequest(uid="UID-12"), "contains(\"caseUid\", 'uid-12')"),
    "participant": (ListRequest(participant="сбер", participant_role="истец"), "z_c % 4 = 0"),
    "participant of any role": (ListRequest(participant="вектор"), "z_k % 10 = 7"),
    "representative": (ListRequest(participant="ванов", participant_role="representative"), "z_k % 2 = 0 OR (z_k % 3 = 1 AND z_k % 12 <> 1)"),
    "role judge": (ListRequest(participant_role="judge"), "judge <> ''"),
    "role third": (ListRequest(participant_role="третье"), "z_k % 4 = 2"),
    "court": (ListRequest(court="nation_13"), "\"courtSubdomain\" = 'nation_13'"),
    "region": (ListRequest(region="13"), "\"courtRegion\" = '13'"),
    "category": (ListRequest(category="Уголов"), "category LIKE 'Уголов%'"),
    "civil": (ListRequest(group="civil"), "category LIKE 'Гражд%'"),
    "appeal": (ListRequest(group="appeal"), "category LIKE 'Апелл%'"),
    "other": (ListRequest(group="other"), "category = ''"),
    "unknown group": (ListRequest(group="none such", court="nation_13"), "\"courtSubdomain\" = 'nation_13'"),
    "judge": (ListRequest(judge="аВанов"), "contains(lower(judge), 'аванов')"),
    "documents": (ListRequest(has_documents=True), "z_k % 3 > 0 OR z_k % 4 = 1"),
    "not enriched": (ListRequest(enriched=False), "z_k % 5 = 2"),
    "hearings": (ListRequest(hearing_from="1996-02-01", hearing_to="15.03.1997"), "z_k % 3 < 2 AND CAST(substr(\"collectedAt\", 1, 10) AS DATE) + 10 BETWEEN DATE '1996-02-01' AND DATE '1997-03-15'"),
}


@query(f"WITH {CASES} " + " UNION ALL ".join(f"SELECT '{name}' AS request, id FROM cases WHERE {where}" for name, (_, where) in _REQUESTS.items()))
def case_list_filters(spark: SparkSession, sf: str) -> DataFrame:
    rows, out = ct.cases(spark, sf), None
    for name, (request, _) in _REQUESTS.items():
        part = catalog.matching(rows, request).select(F.lit(name).alias("request"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {CASES}, m AS (SELECT * FROM cases WHERE z_c % 4 = 0 AND "courtRegion" = '12') SELECT id, "caseUid", "caseNumber", "courtSubdomain", "courtName", "courtRegion", category, plaintiff, defendant, judge, status, "hearingDate", "hearingTime", "documentsCount",
"hasActText", 1 AS "eventsCount", "enrichedAt", "collectedAt", (SELECT count(*) FROM m) AS total FROM m ORDER BY "collectedAt" DESC, id LIMIT 20 OFFSET 10""")
def case_list_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_page(ct.cases(spark, sf), ListRequest(q="сбербанк", region="12", limit=20, offset=10))


@query(f"""WITH {CASES}, p AS (SELECT * FROM cases WHERE "caseUrl" <> '' AND "enrichedAt" = '') SELECT 'all' AS region, count(*) AS pending FROM p UNION ALL SELECT '13', count(*) FROM p WHERE "courtRegion" = '13' UNION ALL SELECT '99', CAST(0 AS BIGINT)""")
def pending_by_region(spark: SparkSession, sf: str) -> DataFrame:
    rows = ct.cases(spark, sf)
    one = lambda name, region: catalog.pending_count(rows, region).select(F.lit(name).alias("region"), "pending")
    return one("all", None).unionByName(one("13", "13")).unionByName(one("99", "99"))


@query(f"""WITH {CASES}, i AS (SELECT id FROM cases WHERE z_k % 8 = 0 UNION SELECT "caseUid" FROM cases WHERE z_k % 9 = 0)
SELECT count(*) AS size, count(*) FILTER ("caseUrl" <> '') AS with_url, count(*) FILTER ("enrichedAt" <> '') AS enriched, count(*) FILTER (z_k % 3 > 0) AS with_documents, count(*) FILTER ("hasActText") AS with_act_text,
count(*) FILTER ("hasActText" OR (z_k % 3 > 0 AND z_k % 5 = 1)) AS with_full_text, count(*) FILTER ("caseUrl" <> '' AND "enrichedAt" = '') AS pending, count(*) FILTER (z_k % 8 = 0 OR z_k % 9 = 0) AS in_index FROM cases""")
def coverage_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = ct.cases(spark, sf)
    number = F.substring("id", 2, 20).cast("long")
    indexed = rows.where(number % 8 == 0).select("id").unionByName(rows.where(number % 9 == 0).select(F.col("caseUid").alias("id")))
    return reports.coverage(rows, indexed)


@query(f"""WITH {CASES} SELECT coalesce(nullif("courtRegion", ''), '—') AS place, count(*) AS total, count(*) FILTER ("enrichedAt" <> '') AS enriched, count(*) FILTER (z_k % 3 > 0) AS with_documents, count(*) FILTER ("hasActText") AS with_act_text FROM cases GROUP BY 1
ORDER BY total DESC, place LIMIT 30""")
def coverage_regions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.coverage_by(ct.cases(spark, sf), "courtRegion", 30)


@query(f"""WITH {CASES}, f AS (SELECT category, count(*) AS n FROM cases WHERE category <> '' GROUP BY 1), g AS (SELECT *, CASE WHEN category LIKE 'Гражд%' THEN 'civil' WHEN category LIKE 'Угол%' THEN 'criminal' WHEN category LIKE '%админ%' THEN 'admin' ELSE 'appeal' END AS "group" FROM f)
SELECT "group", category, n, CAST(sum(n) OVER (PARTITION BY "group") AS BIGINT) AS total FROM g""")
def case_category_groups(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.category_groups(catalog.facet(ct.cases(spark, sf), "category", blanks=False))


@query(f"""WITH {CASES}, f AS (SELECT "courtSubdomain" AS court, count(*) AS n, arg_max("courtRegion", struct_pack(a := "collectedAt", b := id)) AS region FROM cases GROUP BY 1), g AS (SELECT court, n, CASE WHEN region = '' THEN 'Без региона' ELSE region END AS region FROM f)
SELECT *, CAST(sum(n) OVER (PARTITION BY region) AS BIGINT) AS total FROM g""")
def case_courts_by_region(spark: SparkSession, sf: str) -> DataFrame:
    facets = catalog.facet(ct.cases(spark, sf).withColumnRenamed("courtSubdomain", "court"), "court", newest={"region": "courtRegion"}, by=F.struct("collectedAt", "id"))
    return catalog.courts_by_region(facets)


# --- a region's dashboard, judges, plaintiffs -------------------------------------------------------------------------

_SCOPE = f"""WITH {CASES}, s AS (SELECT * FROM cases WHERE "courtRegion" = '13' OR ("courtRegion" = '' AND "courtSubdomain" LIKE '%--mor')), e AS (SELECT * FROM s WHERE "enrichedAt" <> '')"""


def _scope(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.scope(ct.cases(spark, sf))


@query(_SCOPE + """ SELECT (SELECT count(*) FROM s) AS catalog, count(*) AS enriched, count(*) FILTER ("hasActText") AS with_act_text, count(*) FILTER (z_k % 3 > 0) AS with_documents, count(*) FILTER ("caseNumber" LIKE '2%') AS first_instance,
count(*) FILTER ("caseNumber" LIKE '11-%') AS appeal_like, (SELECT count(*) FROM s WHERE "caseUrl" <> '' AND "enrichedAt" = '') AS pending FROM e""")
def dashboard_totals(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.totals(_scope(spark, sf))


@query(_SCOPE + """ SELECT split_part("caseNumber", '-', 1) AS prefix, count(*) AS n FROM e GROUP BY 1""")
def dashboard_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.prefixes(_scope(spark, sf))


@query(_SCOPE + """ SELECT CASE WHEN category = '' THEN '—' ELSE trim(split_part(category, '→', 1)) END AS category, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, category LIMIT 15""")
def dashboard_categories(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.top_categories(_scope(spark, sf))


@query(_SCOPE + """ SELECT judge, count(*) AS n FROM e WHERE judge <> '' GROUP BY 1 ORDER BY n DESC, judge LIMIT 15""")
def dashboard_judges(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.top_judges(_scope(spark, sf))


@query(_SCOPE + """ , g AS (SELECT "courtSubdomain" AS court, min("courtName") AS name, count(*) AS total, count(*) FILTER ("enrichedAt" <> '') AS enriched, count(*) FILTER ("hasActText") AS with_act_text, count(*) FILTER ("caseNumber" LIKE '2%') AS first_instance,
count(*) FILTER ("caseNumber" LIKE '11-%') AS appeal_like, count(*) FILTER ("enrichedAt" <> '' AND z_told) AS identifiable FROM s GROUP BY 1) SELECT *, total / max(total) OVER () AS intensity FROM g""")
def dashboard_courts(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.courts(_scope(spark, sf))


@query(_SCOPE + """ SELECT id, "caseNumber", "courtSubdomain" AS court, status, "hasActText", "enrichedAt" FROM e ORDER BY "enrichedAt" DESC, id LIMIT 20""")
def dashboard_recent(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.recent(_scope(spark, sf))


_JUDGES = f"""WITH {CASES}, e AS (SELECT * FROM cases WHERE "enrichedAt" <> ''),
x AS (SELECT judge, TRUE AS one, z_days AS days, z_label AS r, z_c % 4 = 0 AS bank FROM e WHERE "caseNumber" LIKE '2%' AND judge <> ''
UNION ALL SELECT coalesce(CASE WHEN z_k % 10 = 0 THEN {ct.person("z_c % 40")} END, nullif(judge, '')), FALSE, NULL, z_label, FALSE FROM e WHERE "caseNumber" LIKE '11-%' AND z_label IN ('appealed_upheld', 'appealed_changed') AND (z_k % 10 = 0 OR judge <> '')),
g AS (SELECT judge, count(*) FILTER (one) AS cases, count(days) AS with_duration, median(days) AS median_days, CAST(quantile_disc(days, 0.75) AS DOUBLE) AS p75_days, count(*) FILTER (one AND r <> 'unknown') AS known, count(*) FILTER (one AND r IN ('granted', 'granted_partial')) AS favourable,
count(*) FILTER (one AND r = 'denied') AS denied, count(*) FILTER (bank) AS bank_cases, count(*) FILTER (bank AND r IN ('granted', 'granted_partial')) AS bank_favourable, count(*) FILTER (NOT one) AS reviewed, count(*) FILTER (NOT one AND r = 'appealed_changed') AS changed FROM x GROUP BY 1),
j AS (SELECT *, CASE WHEN known > 0 THEN favourable / known END AS favourable_rate, CASE WHEN bank_cases > 0 THEN bank_favourable / bank_cases END AS bank_rate, CASE WHEN reviewed > 0 THEN changed / reviewed END AS change_rate, cases / (SELECT max(cases) FROM g) AS intensity FROM g
WHERE cases >= 5 OR reviewed >= 3 ORDER BY cases DESC, judge LIMIT 40)"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.facts(ct.cases(spark, sf))


@query(_JUDGES + " SELECT * FROM j")
def judge_deep(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.deep_judges(_facts(spark, sf))


@query(_JUDGES + " , " + ", ".join(f"r{i} AS (SELECT '{n}' AS ranking, CAST(row_number() OVER (ORDER BY {v} {o}, judge) AS INTEGER) AS place, judge, CAST({v} AS DOUBLE) AS value FROM j WHERE {c} >= 3 AND {v} IS NOT NULL QUALIFY place <= {m})" for i, (n, v, c, o, m) in enumerate((("slow", "median_days", "with_duration", "DESC", 12), ("fast", "median_days", "with_duration", "ASC", 12), ("overturned", "change_rate", "reviewed", "DESC", 15), ("banks", "bank_rate", "bank_cases", "DESC", 15)))) + " SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3")
def judge_rankings(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.rankings(dashboard.deep_judges(_facts(spark, sf)))


@query(_JUDGES + """ , a AS (SELECT 'judges' AS part, CAST(row_number() OVER (ORDER BY cases DESC, judge) - 1 AS INTEGER) AS place, '{"judge":"' || judge || '","cases":' || cases || '}' AS payload FROM j QUALIFY place < 8),
p AS (SELECT split_part("caseNumber", '-', 1) AS prefix, count(*) AS n FROM e GROUP BY 1), b AS (SELECT 'prefixes' AS part, CAST(row_number() OVER (ORDER BY n DESC, prefix) - 1 AS INTEGER) AS place, '{"prefix":"' || prefix || '","n":' || n || '}' AS payload FROM p QUALIFY place < 6) SELECT * FROM a UNION ALL SELECT * FROM b""")
def insight_payload(spark: SparkSession, sf: str) -> DataFrame:
    prefixes = dashboard.prefixes(ct.cases(spark, sf)).orderBy(F.desc("n"), "prefix")
    return dashboard.insight({"judges": (dashboard.deep_judges(_facts(spark, sf)), ["judge", "cases"], 8), "prefixes": (prefixes, ["prefix", "n"], 6)})


@query(f"""WITH {CASES}, f AS (SELECT *, lower(plaintiff) AS k FROM cases WHERE "enrichedAt" <> '' AND "caseNumber" LIKE '2%'), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS i FROM f)
SELECT min(plaintiff) AS name, count(*) AS cases, count(*) FILTER (z_label <> 'unknown') AS known, count(*) FILTER (z_label IN ('granted', 'granted_partial')) AS wins, count(*) FILTER (z_label = 'denied') AS losses,
CASE WHEN count(*) FILTER (z_label IN ('granted', 'granted_partial', 'denied')) > 0 THEN count(*) FILTER (z_label IN ('granted', 'granted_partial')) / count(*) FILTER (z_label IN ('granted', 'granted_partial', 'denied')) END AS win_rate,
CASE WHEN k = 'пао сбербанк' THEN 'bank' ELSE 'other' END AS kind, string_agg("caseNumber", '; ' ORDER BY i) FILTER (i <= 4) AS samples FROM r GROUP BY k HAVING count(*) >= 4 ORDER BY cases DESC, k LIMIT 30""")
def serial_plaintiffs(spark: SparkSession, sf: str) -> DataFrame:
    return reports.serial_plaintiffs(_facts(spark, sf)).withColumn("samples", _joined("samples"))


# --- representatives, people, professionals ---------------------------------------------------------------------------


@query(f"WITH {CASES} SELECT id, z_told AS identifiable, z_named AND NOT z_told AS only_masked, NOT z_named AS \"none\" FROM cases")
def representative_signals(spark: SparkSession, sf: str) -> DataFrame:
    return ct.cases(spark, sf).select("id", names.signals(F.col("participants"), F.col("documents")).alias("s")).select("id", "s.*")


_REPS = ct.named_rows([(f"{K} % 2 = 0", "1", f"{ct.REPRESENTATIVE} AS name"), (f"{K} % 3 = 1 AND {K} % 12 <> 1", "2", f"{ct.ADVOCATE} AS name"), (ct.ACT_NAMES_ONE, "3", f"{ct.IN_TEXT} AS name")], "")


@query(f"""WITH {CASES}, x AS ({_REPS}), d AS (SELECT DISTINCT z_k, lower(name) AS person, min(name) OVER (PARTITION BY lower(name)) AS name FROM x), r AS (SELECT d.*, c.* EXCLUDE (z_k), row_number() OVER (PARTITION BY person ORDER BY id) AS i FROM d JOIN cases c ON d.z_k = c.z_k)
SELECT person, min(name) AS name, count(*) AS cases, count(*) FILTER (z_label <> 'unknown') AS with_outcome, count(*) FILTER (z_label IN ('granted', 'granted_partial')) AS wins, count(*) FILTER (z_label = 'denied') AS losses, count(*) FILTER (z_label NOT IN ('granted', 'granted_partial', 'denied')) AS neutrals,
CASE WHEN count(*) FILTER (z_label IN ('granted', 'granted_partial', 'denied')) > 0 THEN count(*) FILTER (z_label IN ('granted', 'granted_partial')) / count(*) FILTER (z_label IN ('granted', 'granted_partial', 'denied')) END AS win_rate, count(DISTINCT "courtSubdomain") AS courts,
string_agg("caseNumber", '; ' ORDER BY i) FILTER (i <= 5) AS samples FROM r GROUP BY person HAVING count(*) >= 2""")
def representative_winrates(spark: SparkSession, sf: str) -> DataFrame:
    return reports.representative_winrates(_facts(spark, sf)).withColumn("samples", _joined("samples"))


@query(f"""WITH {CASES}, x AS ({ct.named_rows([(f"{K} % 2 = 0", "1", f"'representative' AS kind, {ct.REPRESENTATIVE} AS name"), (f"{K} % 3 = 1 AND {K} % 12 <> 1", "2", f"'advocate' AS kind, {ct.ADVOCATE} AS name")], "")}),
g AS (SELECT "courtSubdomain" AS court, count(name) AS appearances, count(DISTINCT name) AS people, count(name) FILTER (kind = 'representative') AS representative_appearances, count(DISTINCT name) FILTER (kind = 'representative') AS representative_people,
count(name) FILTER (kind = 'advocate') AS advocate_appearances, count(DISTINCT name) FILTER (kind = 'advocate') AS advocate_people, CAST(0 AS BIGINT) AS jurist_appearances, CAST(0 AS BIGINT) AS jurist_people FROM cases LEFT JOIN x USING (z_k) GROUP BY 1) SELECT *, appearances / max(appearances) OVER () AS intensity FROM g""")
def representative_heat(spark: SparkSession, sf: str) -> DataFrame:
    return people.representative_heat(ct.cases(spark, sf, dealt=True))


_MENTIONS = ct.named_rows(
    [
        (f"{C} % 4 < 3", "0", f"'ИСТЕЦ' AS role, 'plaintiff' AS family, {ct.PLAINTIFF} AS name"), (f"{K} % 2 = 0", "1", f"'ПРЕДСТАВИТЕЛЬ', 'representative', {ct.REPRESENTATIVE}"), (f"{K} % 3 = 1 AND {K} % 12 <> 1", "2", f"'АДВОКАТ', 'representative', {ct.ADVOCATE}"),
        (f"{C} % 4 < 3", "5", f"'ИСТЕЦ', 'plaintiff', {ct.PLAINTIFF}"), (f"{K} % 6 <> 0", "6", f"'ОТВЕТЧИК', 'defendant', {ct.person(K)}"), (f"{K} % 17 <> 0", "7", f"'СУДЬЯ', 'judge', {ct.COLUMNS['judge']}"),
    ], "")
_FAMILIES = ("representative", "plaintiff", "defendant", "third", "judge", "other")
_HELD = ", ".join(f"CASE WHEN bool_or(family = '{f}') THEN '{f}' END" for f in _FAMILIES)


@query(f"""WITH {CASES}, x AS ({_MENTIONS}), m AS (SELECT lower(x.name) AS person, x.name AS said, x.role, x.family, x.pos, c.* FROM x JOIN cases c ON x.z_k = c.z_k), p AS (SELECT DISTINCT person, id, "caseNumber", "courtSubdomain", "hasActText", "enrichedAt" FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY id) AS i FROM p), q AS (SELECT person, "courtSubdomain", row_number() OVER (PARTITION BY person ORDER BY min(id)) AS i FROM p GROUP BY 1, 2),
a AS (SELECT person, arg_min(said, struct_pack(a := id, b := pos)) AS name, count(*) AS appearances, concat_ws('; ', {_HELD}) AS families, coalesce({_HELD}) AS primary_family, array_to_string(list_sort(list(DISTINCT role)), '; ') AS roles FROM m GROUP BY 1),
b AS (SELECT person, count(*) AS cases, count(DISTINCT "courtSubdomain") AS courts, count(*) FILTER ("hasActText") AS with_acts, count(*) FILTER ("enrichedAt" <> '') AS enriched_cases, string_agg("caseNumber", '; ' ORDER BY i) FILTER (i <= 5) AS numbers FROM n GROUP BY 1),
c AS (SELECT person, string_agg("courtSubdomain", '; ' ORDER BY i) FILTER (i <= 4) AS first_courts FROM q GROUP BY 1)
SELECT person, name, appearances, families, primary_family, roles, cases, courts, with_acts, enriched_cases, numbers, first_courts, 'p:' || trim(regexp_replace(person, '[^a-zа-я0-9]+', '-', 'g'), '-') AS person_id FROM a JOIN b USING (person) JOIN c USING (person)""")
def people_index(spark: SparkSession, sf: str) -> DataFrame:
    out = people.full_index(people.appearances_of(ct.cases(spark, sf, dealt=True)))
    return out.withColumns({c: _joined(c) for c in ("families", "roles", "numbers", "first_courts")})


_BANK = f"WITH {CASES}, m AS (SELECT *, coalesce(nullif(\"courtRegion\", ''), CASE WHEN \"courtSubdomain\" LIKE '%--mor' THEN '13' END) AS place FROM cases WHERE z_c % 4 = 0)"


@query(_BANK + """, s AS (SELECT count(*) AS cases, count(DISTINCT "courtSubdomain") AS courts, count(*) FILTER ("hasActText") AS with_acts, count(*) FILTER ("enrichedAt" <> '') AS enriched_cases, count(*) FILTER (z_label <> 'unknown') AS known,
count(*) FILTER (z_label IN ('granted', 'granted_partial')) AS wins, count(*) FILTER (z_label = 'denied') AS losses, count(*) FILTER (z_label NOT IN ('granted', 'granted_partial', 'denied', 'unknown')) AS neutrals, median(CASE WHEN z_k % 4 <> 3 THEN z_k % 200 END) AS median_days, count(DISTINCT place) AS regions FROM m),
w AS (SELECT *, CASE WHEN wins + losses > 0 THEN wins / (wins + losses) END AS win_rate FROM s)
SELECT *, CAST(least(99, least(90, 40 + cases * 2 + with_acts) + coalesce(floor(win_rate * 20 + 0.5), 0)) AS INTEGER) AS rating, CASE WHEN cases >= 20 AND coalesce(win_rate, 0) >= 0.55 THEN 'gold' WHEN cases >= 10 THEN 'silver' WHEN cases >= 4 THEN 'bronze' ELSE 'common' END AS tier FROM w""")
def dossier_summary(spark: SparkSession, sf: str) -> DataFrame:
    return people.person_dossier(_facts(spark, sf), "ПАО Сбербанк")["summary"]


@query(_BANK + """, y AS (SELECT 'outcomes' AS part, z_label AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'courts', "courtSubdomain", count(*) FROM m GROUP BY 2 UNION ALL SELECT 'categories', CASE WHEN category = '' THEN '—' ELSE trim(split_part(category, '→', 1)) END, count(*) FROM m GROUP BY 2
UNION ALL SELECT 'years', substr("collectedAt", 1, 4), count(*) FROM m GROUP BY 2 UNION ALL SELECT 'regions', place, count(*) FROM m WHERE place IS NOT NULL GROUP BY 2) SELECT * FROM y""")
def dossier_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts, out = people.person_dossier(_facts(spark, sf), "ПАО Сбербанк"), None
    for name, column in (("outcomes", "outcome"), ("courts", "court"), ("categories", "category"), ("years", "year"), ("regions", "region")):
        part = parts[name].select(F.lit(name).alias("part"), F.col(column).alias("value"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(_BANK + """ SELECT id, "caseNumber", 'ИСТЕЦ' AS role, z_label AS outcome, "enrichedAt" <> '' AS enriched FROM m ORDER BY coalesce(nullif("enrichedAt", ''), "collectedAt") DESC, id LIMIT 80""")
def dossier_cases(spark: SparkSession, sf: str) -> DataFrame:
    return people.person_dossier(_facts(spark, sf), "ПАО Сбербанк")["cases"].select("id", "caseNumber", "role", "outcome", "enriched")


@query(_BANK + " SELECT id FROM m ORDER BY id LIMIT 50")
def participant_cases(spark: SparkSession, sf: str) -> DataFrame:
    return people.cases_of(ct.cases(spark, sf), "сбербанк", "plaintiff").select("id")


_PROS = ct.named_rows(
    [
        (f"{K} % 17 <> 0", "0", f"'judge' AS role, {ct.JUDGE} AS name"), (f"{K} % 17 <> 0 AND {K} % 19 = 0", "1", f"'judge', {ct.SECOND}"), (f"{K} % 2 = 0", "10", f"'lawyer', {ct.REPRESENTATIVE}"),
        (f"{K} % 3 = 1 AND {K} % 12 <> 1", "11", f"'lawyer', {ct.ADVOCATE}"), (ct.PRESIDED, "20", f"'judge', {ct.PRESIDENT}"),
    ], "")
_CARDS = f"""WITH {CASES}, x AS ({_PROS}), f AS (SELECT lower(name) AS person, z_k, arg_min(name, pos) AS said, arg_min(role, pos) AS role FROM x GROUP BY 1, 2), m AS (SELECT f.person, f.said, f.role, c.* EXCLUDE ("courtRegion"), nullif("courtRegion", '') AS region FROM f JOIN cases c ON f.z_k = c.z_k),
b AS (SELECT person, arg_min(said, id) AS name, CASE WHEN bool_or(role = 'lawyer') THEN 'lawyer' ELSE 'judge' END AS primary_role, bool_or(role = 'judge') AS is_judge, count(*) AS cases, count(DISTINCT "courtSubdomain") AS courts, CAST(sum("documentsCount") AS BIGINT) AS documents, count(DISTINCT nullif(category, '')) AS categories,
count(*) FILTER ("enrichedAt" <> '') AS enriched_cases, count(DISTINCT region) AS regions, count(*) FILTER (category LIKE 'Гражд%') AS civil_cases, count(*) FILTER (category LIKE 'Угол%') AS criminal_cases, count(*) FILTER ("hasActText" OR "documentsCount" > 0) AS with_acts, max("collectedAt") AS last_active,
arg_min(region, id) FILTER (region IS NOT NULL) AS first_region FROM m GROUP BY 1), h AS (SELECT person, "courtSubdomain", count(*) AS n, min(id) AS seen, max("courtName") AS court, arg_max(struct_pack(r := region), id) AS last FROM m GROUP BY 1, 2),
k AS (SELECT person, arg_min(struct_pack(c := "courtSubdomain", n := court, r := last.r), struct_pack(a := -n, b := seen)) AS main FROM h GROUP BY 1), c1 AS (SELECT b.* EXCLUDE (first_region), main.n AS main_court, main.c AS main_court_code, coalesce(main.r, first_region) AS region,
CAST(least(99, greatest(55, floor(55 + (least(cases * 3, 28) + least(courts * 2, 12) + least(with_acts, 10) + least(enriched_cases, 12) + least(floor(documents / 2), 8) + least(categories, 6) + CASE WHEN regions > 1 THEN 4 WHEN regions = 1 THEN 1 ELSE 0 END + CASE WHEN primary_role = 'lawyer' THEN 6 ELSE 4 END) * 0.45 + 0.5))) AS INTEGER) AS rating
FROM b JOIN k USING (person)), cards AS (SELECT *, CASE WHEN rating >= 88 THEN 'gold' WHEN rating >= 78 THEN 'silver' WHEN rating >= 68 THEN 'bronze' ELSE 'common' END AS tier, trim(regexp_replace(person, '[^a-zа-я0-9]+', '-', 'g'), '-') AS card_id FROM c1)"""


@query(_CARDS + " SELECT * FROM cards")
def professional_cards(spark: SparkSession, sf: str) -> DataFrame:
    return professionals.cards(professionals.appearances(ct.cases(spark, sf)))


@query(_CARDS + """ SELECT 'courts' AS heat, person, "courtSubdomain" AS value, n AS cases FROM h QUALIFY row_number() OVER (PARTITION BY person ORDER BY n DESC, "courtSubdomain") <= 16
UNION ALL SELECT * FROM (SELECT 'categories', person, CASE WHEN category = '' THEN '—' ELSE trim(split_part(category, '→', 1)) END, count(*) FROM m GROUP BY 2, 3) UNION ALL SELECT * FROM (SELECT 'regions', person, CASE WHEN p = '13' THEN 'Мордовия' ELSE 'Рег. ' || p END, count(*)
FROM (SELECT person, coalesce(region, CASE WHEN "courtSubdomain" LIKE '%--mor' THEN '13' END) AS p FROM m) WHERE p IS NOT NULL GROUP BY 2, 3)""")
def professional_heats(spark: SparkSession, sf: str) -> DataFrame:
    found = professionals.appearances(ct.cases(spark, sf))
    part = lambda heat, rows, value: rows.select(F.lit(heat).alias("heat"), "person", F.col(value).alias("value"), "cases")
    return part("courts", professionals.court_heat(found), "courtSubdomain").unionByName(part("categories", professionals.category_heat(found), "category")).unionByName(part("regions", professionals.geo_heat(found, _labels(spark, sf)), "label"))


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    """The nations as a registry of courts."""
    mor = F.when(F.col("n_regionkey") == 2, F.lit("--mor")).otherwise(F.lit(""))
    code = F.concat(F.replace(F.lower("n_name"), F.lit(" "), F.lit("-")), mor)
    return t(spark, sf, "nation").select(code.alias("subdomain"), F.concat("n_name", F.lit(" районный суд")).alias("name"), (F.col("n_regionkey") + 11).cast("string").alias("region"), F.lit("ray").alias("type"), F.lit("").alias("vnkod"), F.lit(False).alias("captcha"), F.lit(True).alias("http"), F.col("n_nationkey").alias("seq"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return professionals.region_labels(_registry(spark, sf))


@query(_CARDS + """ SELECT person, rating, cases FROM cards WHERE primary_role = 'judge' OR is_judge ORDER BY rating DESC, cases DESC, person LIMIT 48""")
def card_list(spark: SparkSession, sf: str) -> DataFrame:
    found = professionals.appearances(ct.cases(spark, sf))
    return professionals.find_cards(professionals.cards(found), found, _labels(spark, sf), role="judge").select("person", "rating", "cases")


@query(_CARDS + """ SELECT person, rating FROM cards WHERE contains(lower(name), 'мордов') OR contains(lower(main_court), 'мордов') OR person IN (SELECT person FROM m WHERE region = '13') ORDER BY rating DESC, cases DESC, person LIMIT 120""")
def card_search(spark: SparkSession, sf: str) -> DataFrame:
    found = professionals.appearances(ct.cases(spark, sf))
    return professionals.find_cards(professionals.cards(found), found, _labels(spark, sf), q="Мордов", limit=500).select("person", "rating")


@query(_CARDS + """, g AS (SELECT region, count(*) FILTER (primary_role = 'lawyer') AS lawyers, count(*) FILTER (primary_role = 'judge' OR is_judge) AS judges FROM cards WHERE region IS NOT NULL GROUP BY 1)
SELECT region, CASE WHEN region = '13' THEN 'Мордовия' ELSE 'Рег. ' || region END AS label, lawyers, judges, lawyers + judges AS total, 'professionals' AS mode FROM g WHERE lawyers + judges > 0""")
def professionals_by_region(spark: SparkSession, sf: str) -> DataFrame:
    rows = ct.cases(spark, sf)
    cards = professionals.cards(professionals.appearances(rows))
    return professionals.regional(cards, catalog.facet(rows.withColumnRenamed("courtRegion", "region"), "region", blanks=False), _labels(spark, sf))


_PRACTICE = f"""WITH {CASES}, x AS ({ct.named_rows([(f"{K} % 17 <> 0", "0", f"{ct.JUDGE} AS name, TRUE AS own"), (f"{K} % 17 <> 0 AND {K} % 19 = 0", "1", f"{ct.SECOND}, TRUE"), (f"{K} % 10 = 0", "2", f"{ct.JUDGE}, FALSE")], "")}),
m AS (SELECT lower(x.name) AS person, own, c.*, "caseNumber" LIKE '2%' AS one FROM x JOIN cases c ON x.z_k = c.z_k WHERE own OR ("caseNumber" LIKE '11-%' AND z_label IN ('appealed_upheld', 'appealed_changed'))),
g AS (SELECT person, count(*) FILTER (own AND one) AS first_instance, count(*) FILTER (own AND "caseNumber" LIKE '11-%') AS appeal_like, count(z_days) FILTER (own AND one) AS with_duration, median(z_days) FILTER (own AND one) AS median_days, CAST(quantile_disc(z_days, 0.75) FILTER (own AND one) AS DOUBLE) AS p75_days,
count(*) FILTER (own AND one AND z_label <> 'unknown') AS known, count(*) FILTER (own AND one AND z_label IN ('granted', 'granted_partial')) AS favourable, count(*) FILTER (own AND one AND z_label = 'denied') AS denied, count(*) FILTER (own AND one AND z_c % 4 = 0) AS banks,
count(*) FILTER (own AND one AND z_c % 4 = 0 AND z_label IN ('granted', 'granted_partial')) AS bank_favourable, count(*) FILTER (NOT own) AS reviewed, count(*) FILTER (NOT own AND z_label = 'appealed_changed') AS changed FROM m GROUP BY 1)"""


@query(_PRACTICE + " SELECT *, CASE WHEN known > 0 THEN favourable / known END AS favourable_rate, CASE WHEN banks > 0 THEN bank_favourable / banks END AS bank_rate, CASE WHEN reviewed > 0 THEN changed / reviewed END AS change_rate FROM g")
def judge_practice(spark: SparkSession, sf: str) -> DataFrame:
    return professionals.practice(_facts(spark, sf))


@query(_CARDS + f""", y AS ({ct.named_rows([(f"{K} % 17 <> 0", "0", f"{ct.JUDGE} AS name"), (f"{K} % 17 <> 0 AND {K} % 19 = 0", "1", f"{ct.SECOND}")], "")}), z AS (SELECT lower(name) AS person, count(*) FILTER ("caseNumber" LIKE '2%') AS first_instance FROM y JOIN cases c ON y.z_k = c.z_k GROUP BY 1)
SELECT person, primary_role, CASE WHEN primary_role = 'judge' THEN coalesce(first_instance, 0) END AS first_instance FROM cards LEFT JOIN z USING (person)""")
def cards_with_practice(spark: SparkSession, sf: str) -> DataFrame:
    cards = professionals.cards(professionals.appearances(ct.cases(spark, sf)))
    return professionals.with_practice(cards, professionals.practice(_facts(spark, sf))).select("person", "primary_role", "first_instance")


# --- organisations, searches ------------------------------------------------------------------------------------------

_ORGS = f"""WITH {CASES}, x AS (SELECT z_k, plaintiff AS alias FROM cases WHERE z_c % 4 < 2 UNION ALL SELECT z_k, unnest(['ООО Вектор', 'АО Луч']) FROM cases WHERE z_k % 10 = 7), m AS (SELECT DISTINCT lower(regexp_replace(x.alias, '^(ПАО|ООО|АО) ', '')) AS key, x.alias, c.* EXCLUDE (z_k) FROM x JOIN cases c ON x.z_k = c.z_k),
r AS (SELECT key, min(alias) AS canonical, split_part(min(alias), ' ', 1) AS form, count(*) AS case_count, count(DISTINCT alias) AS alias_count FROM m GROUP BY 1)"""


@query(_ORGS + """, p AS (SELECT key, "courtRegion" AS region, min(id) AS f FROM m GROUP BY 1, 2), q AS (SELECT key, "courtSubdomain" AS court, min(id) AS f FROM m GROUP BY 1, 2), s AS (SELECT key, string_agg(region, '; ' ORDER BY f, region) AS regions FROM p GROUP BY 1), u AS (SELECT key, string_agg(court, '; ' ORDER BY f, court) AS courts FROM q GROUP BY 1)
SELECT * FROM r JOIN s USING (key) JOIN u USING (key)""")
def organisation_records(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.records(lookup.mentions(ct.cases(spark, sf))).withColumns({"regions": _joined("regions"), "courts": _joined("courts")})


@query(_ORGS + """, s AS (SELECT *, CASE WHEN key = 'ромашка 1' THEN 100 ELSE 0 END + CASE WHEN contains(lower(canonical), 'ромашка 1') THEN 50 ELSE 0 END + CASE WHEN contains(key, 'ромашка 1') OR contains('ромашка 1', key) THEN 30 ELSE 0 END + CASE WHEN contains(lower(canonical), 'ромашка 1') THEN 20 ELSE 0 END AS score FROM r),
n AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS i FROM m), v AS (SELECT key, string_agg(id, '; ' ORDER BY i) AS case_ids FROM n WHERE i <= 50 GROUP BY 1) SELECT key, score, case_count, canonical AS aliases, case_ids FROM s JOIN v USING (key) WHERE score > 0 ORDER BY score DESC, case_count DESC, key LIMIT 20""")
def organisation_resolve(spark: SparkSession, sf: str) -> DataFrame:
    out = lookup.resolve_records(lookup.mentions(ct.cases(spark, sf)), " Ромашка 1")
    return out.select("key", F.col("score").cast("int").alias("score"), "case_count", _joined("aliases").alias("aliases"), _joined("case_ids").alias("case_ids"))


@query(f"""WITH {CASES}, h AS (SELECT DISTINCT 'u' || z_k % 40 AS court FROM cases UNION ALL SELECT 'nation_2--mor') SELECT court, CASE WHEN court = 'nation_2--mor' THEN 'NATION_2 районный суд' ELSE court END AS name, '13' AS region, court <> 'nation_2--mor' AS captcha FROM h""")
def hearings_with_courts(spark: SparkSession, sf: str) -> DataFrame:
    rows = ct.cases(spark, sf).select(F.concat(F.lit("u"), (F.substring("id", 2, 20).cast("long") % 40).cast("string")).alias("court")).distinct()
    both = rows.unionByName(rows.limit(1).select(F.lit("nation_2--mor").alias("court")))
    return search.with_courts(both, _registry(spark, sf), F.lit(" "), F.lit("13")).select("court", "registry.name", "registry.region", "registry.captcha")


@query(f"""WITH {CASES}, m AS (SELECT * FROM cases WHERE z_c % 4 = 0 AND "courtRegion" = '13') SELECT id, (SELECT count(*) FROM m) AS total FROM m ORDER BY "collectedAt" DESC, id LIMIT 30""")
def collected_search(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue's side of a collected search; its texts are in collected_texts."""
    rows = ct.cases(spark, sf)
    page, _ = search.collected(_act_index(spark, sf), _act_chunks(rows), rows, ListRequest(q="сбербанк", region="13", limit=30), "chunk_id")
    return page.select("id", "total")


def _act_chunks(rows: DataFrame) -> DataFrame:
    """One chunk for each case with an act: what is said in court, and who the plaintiff is."""
    acts = rows.where(F.size("documents") > 0)
    said = F.concat_ws(" ", F.lit("заседание по делу рассмотрено открыто стороной"), "plaintiff", F.when(F.col("status") != "", F.col("status")))
    return acts.select(F.concat("id", F.lit("#0")).alias("chunk_id"), F.col("id").alias("case_uid"), F.col("courtName").alias("court"), F.col("caseNumber").alias("case_number"), said.alias("text"))


def _act_index(spark: SparkSession, sf: str) -> fulltext.Index:
    return fulltext.store_index(_act_chunks(ct.cases(spark, sf)), "chunk_id", "text", folder(spark, "act-index"))


@query("SELECT CAST(0 AS BIGINT) AS n")
def collected_texts_elsewhere(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a court that doesn't exist: the filter comes after the search, so nothing is left."""
    rows = ct.cases(spark, sf)
    _, texts = search.collected(_act_index(spark, sf), _act_chunks(rows), rows, ListRequest(q="мировое соглашение", court="no such court", limit=20), "chunk_id")
    return texts.agg(F.count("*").alias("n"))


# --- pages ------------------------------------------------------------------------------------------------------------

_UID = "md5(CAST(z_k AS VARCHAR))"


def _cell(*parts) -> F.Column:
    return F.concat(F.lit("<td>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</td>"))


def _numbered(rows: DataFrame) -> DataFrame:
    k = F.substring("id", 2, 20)
    return rows.withColumns({"k": k, "link": F.concat(F.lit('<a href="/m.php?case_id='), k, F.lit("&amp;case_uid="), F.md5(k.cast("binary")), F.lit('">'), F.col("caseNumber"), F.lit("</a>"))})


@query(f"""WITH {CASES} SELECT id, 'ok' AS parse_status, "caseNumber", {_UID} AS "caseUid", concat_ws(' — ', plaintiff, defendant) AS parties, category, judge, 'Зал 1' AS courtroom, "hearingTime" FROM cases""")
def hearing_pages(spark: SparkSession, sf: str) -> DataFrame:
    head = '<body><table id="tablcont"><tr><th>№ п/п</th><th>Номер дела</th><th>Время слушания</th><th>Место (Зал)</th><th>Информация по делу</th><th>Судья</th></tr><tr><td colspan="6">Дела</td></tr><tr>'
    info = F.concat(F.lit("КАТЕГОРИЯ: "), F.col("category"), F.lit("<br>ИСТЕЦ(ЗАЯВИТЕЛЬ): "), F.col("plaintiff"), F.coalesce(F.concat(F.lit("<br>ОТВЕТЧИК: "), F.col("defendant")), F.lit("")))
    html = F.concat(F.lit(head), _cell("1"), _cell(F.col("link")), _cell(F.col("hearingTime")), _cell("Зал 1"), _cell(info), _cell(F.col("judge")), F.lit("</tr></table></body>"))
    found = pages.hearings(pages.tables(_numbered(ct.cases(spark, sf, dealt=True)).select("id", html.alias("html"))))
    return pages.listed(found, "id", "parse_status").select("id", "parse_status", "x.caseNumber", "x.caseUid", "x.parties", "x.category", "x.judge", "x.courtroom", "x.hearingTime")


@query(f"""WITH {CASES} SELECT id, 27 AS total, "caseNumber", {_UID} AS "caseUid", coalesce(nullif(category, ''), 'Гражданские') AS category, plaintiff, defendant, "entryDate", "resultDate" FROM cases""")
def search_result_pages(spark: SparkSession, sf: str) -> DataFrame:
    head = 'Всего по запросу найдено — 27 <table id="tablcont"><tr><th>№ дела</th><th>Дата поступления</th><th>Категория / Стороны</th><th>Решение</th></tr><tr>'
    info = F.concat(F.lit("КАТЕГОРИЯ: "), F.col("category"), F.lit("<br>ИСТЕЦ: "), F.col("plaintiff"), F.coalesce(F.concat(F.lit("<br>ОТВЕТЧИК: "), F.col("defendant")), F.lit("")))
    html = F.concat(F.lit(head), _cell(F.col("link")), _cell(F.col("entryDate")), _cell(info), _cell(F.coalesce("resultDate", F.lit(""))), F.lit("</tr></table>"))
    found = pages.search_results(pages.tables(_numbered(ct.cases(spark, sf, dealt=True)).select("id", html.alias("html"))), F.lit("Гражданские"))
    return pages.listed(found, "id", "total").select("id", "total", "x.caseNumber", "x.caseUid", "x.category", "x.plaintiff", "x.defendant", "x.entryDate", "x.resultDate")


@query(f"""WITH {CASES} SELECT id, "caseNumber", {_UID} AS "caseUid", category, plaintiff, defendant, nullif(judge, '') AS judge, "entryDate", nullif(status, '') AS status, CASE WHEN defendant IS NULL THEN 1 ELSE 2 END AS people, '02.02.2024 09:30 Заседание' AS event, 'РЕШЕНИЕ' AS act FROM cases""")
def case_card_pages(spark: SparkSession, sf: str) -> DataFrame:
    row = lambda *cells: F.concat(F.lit("<tr>"), *[_cell(c) for c in cells], F.lit("</tr>"))
    one = F.concat(F.lit('<div id="cont1"><table><tr><th colspan=2>ДЕЛО</th></tr>'), row("Уникальный идентификатор дела", F.md5(F.col("k").cast("binary"))), row("Номер дела", F.col("caseNumber")), row("Категория дела", F.col("category")), row("Судья", F.col("judge")), row("Дата поступления", F.col("entryDate")), row("Результат рассмотрения", F.col("status")), F.lit("</table></div>"))
    two = F.concat(F.lit('<div id="cont2"><table><tr><th colspan=3>ДВИЖЕНИЕ ДЕЛА</th></tr>'), row("Наименование события", "Дата", "Время"), row("Заседание", "02.02.2024", "09:30"), F.lit("</table></div>"))
    three = F.concat(F.lit('<div id="cont3"><table><tr><th colspan=3>СТОРОНЫ</th></tr>'), row("Вид лица, участвующего в деле", "Фамилия / наименование", "ИНН"), row("ИСТЕЦ", F.col("plaintiff"), "77"), F.coalesce(row("ОТВЕТЧИК", F.col("defendant"), ""), F.lit("")), F.lit("</table></div>"))
    html = F.concat(one, two, three, F.lit('<div id="cont_doc1">РЕШЕНИЕ по делу, 5 марта 2023 г.</div>'))
    found = pages.case_cards(pages.tables(_numbered(ct.cases(spark, sf, dealt=True)).select("id", html.alias("html"))))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return found.select(
        "id", "caseNumber", "caseUid", "category", "plaintiff", "defendant", blank("judge").alias("judge"), "entryDate", blank("status").alias("status"), F.size("participants").alias("people"),
        F.concat_ws(" ", F.col("events")[0]["date"], F.col("events")[0]["time"], F.col("events")[0]["name"]).alias("event"), F.col("documents")[0]["name"].alias("act"),
    )


# --- merges, timelines, streams ---------------------------------------------------------------------------------------


@query(f"""WITH {CASES}, a AS (SELECT *, {ct.HAS_ACT.replace(K, "z_k")} AS act FROM cases WHERE z_k % 10 <> 0), b AS (SELECT *, CASE WHEN z_k % 2 = 0 THEN '2099-01-01' ELSE '' END AS en, CASE WHEN z_k % 4 = 0 THEN 'Не указано' ELSE 'Новая' END AS cat FROM cases WHERE z_k % 3 = 0),
j AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NULL AS no_a, b.id IS NULL AS no_b, coalesce(a.z_k, b.z_k) AS k, a.category AS ca, b.cat AS cb, a."enrichedAt" AS ea, b.en AS eb, a."documentsCount" AS da, a."hasActText" AS ha, a.act AS act FROM a FULL JOIN b ON a.id = b.id),
w AS (SELECT *, CASE WHEN no_a THEN TRUE WHEN no_b THEN FALSE WHEN eb <> '' AND (ea = '' OR eb >= ea) THEN TRUE WHEN ea <> '' AND eb = '' THEN FALSE ELSE TRUE END AS newer_b FROM j)
SELECT id, CASE WHEN no_a THEN cb WHEN no_b THEN ca WHEN newer_b THEN CASE WHEN cb = 'Новая' THEN cb WHEN ca <> '' THEN ca ELSE cb END ELSE CASE WHEN ca <> '' THEN ca WHEN cb = 'Новая' THEN cb ELSE cb END END AS category,
CASE WHEN no_a THEN nullif(eb, '') WHEN no_b THEN nullif(ea, '') ELSE coalesce(CASE WHEN newer_b THEN nullif(eb, '') ELSE nullif(ea, '') END, CASE WHEN newer_b THEN nullif(ea, '') ELSE nullif(eb, '') END) END AS "enrichedAt", CAST(CASE WHEN no_b THEN da ELSE 5 END AS INTEGER) AS "documentsCount", coalesce(ha, FALSE) AS "hasActText",
CAST(CASE WHEN NOT no_a AND act THEN 1 ELSE 0 END AS INTEGER) AS documents, CASE WHEN newer_b AND NOT no_a AND NOT no_b THEN 'a b' WHEN no_a THEN 'b' WHEN no_b THEN 'a' ELSE 'b a' END AS log FROM w""")
def catalogue_merge(spark: SparkSession, sf: str) -> DataFrame:
    k = F.substring("id", 2, 20).cast("long")
    log = lambda who: F.array(F.struct(F.lit(who).alias("at")))
    rows = ct.cases(spark, sf).drop("firstInstance")
    a = rows.where(k % 10 != 0).withColumn("changeLog", log("a"))
    b = rows.where(k % 3 == 0).withColumns({"enrichedAt": F.when(k % 2 == 0, "2099-01-01").otherwise(""), "category": F.when(k % 4 == 0, "Не указано").otherwise("Новая"), "documentsCount": F.lit(5), "hasActText": F.lit(False), "documents": F.slice("documents", 1, 0), "changeLog": log("b")})
    out = merge.merge_cases(a, b)
    return out.select("id", "category", F.nullif("enrichedAt", F.lit("")).alias("enrichedAt"), "documentsCount", "hasActText", F.size("documents").alias("documents"), F.array_join(F.transform("changeLog", lambda x: x["at"]), " ").alias("log"))


@query(f"""WITH {CASES}, o AS (SELECT * FROM cases WHERE z_k % 4 <> 0), n AS (SELECT *, z_k % 5 = 0 AS blank FROM cases WHERE z_k % 3 = 0)
SELECT coalesce(o.id, n.id) AS id, o.id IS NULL AS is_new, CASE WHEN n.id IS NULL THEN o.category WHEN n.blank THEN coalesce(nullif(o.category, ''), 'Не указано') ELSE 'Новая' END AS category, CASE WHEN o.id IS NULL THEN 'Заседание' ELSE o.status END AS status,
CASE WHEN n.id IS NULL THEN o.plaintiff ELSE 'Альфа' END AS plaintiff, CASE WHEN n.id IS NULL OR n.blank THEN o.judge ELSE 'Новый' END AS judge, CASE WHEN o.id IS NULL THEN 'now' ELSE o."collectedAt" END AS "collectedAt", CASE WHEN o.id IS NULL THEN 0 ELSE o."documentsCount" END AS "documentsCount"
FROM o FULL JOIN n ON o.id = n.id""")
def hearing_upserts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.substring("id", 2, 20).cast("long")
    rows = ct.cases(spark, sf).drop("firstInstance").withColumn("courtroom", F.lit(None).cast("string"))
    new = rows.where(k % 3 == 0).withColumns({"category": F.when(k % 5 == 0, "").otherwise("Новая"), "judge": F.when(k % 5 == 0, "").otherwise("Новый"), "parties": F.lit("Альфа; Бета"), "at": F.lit("now")})
    return merge.upsert_hearings(rows.where(k % 4 != 0), new).select("id", "is_new", "category", "status", "plaintiff", "judge", "collectedAt", "documentsCount")


@query(f"""WITH d AS (SELECT 'c' || {K} AS id, CAST(o_orderdate AS DATE) AS d, {K} AS k FROM {FROM}) SELECT id, d + INTERVAL 12 HOUR AS at, 'milestone' AS kind, 'entry' AS label FROM d UNION ALL SELECT id, d + CAST(k % 200 AS INT) + INTERVAL 12 HOUR, 'milestone', 'result' FROM d WHERE k % 4 <> 3
UNION ALL SELECT id, d + 10 + INTERVAL 12 HOUR, 'milestone', 'hearing' FROM d WHERE k % 3 = 0 UNION ALL SELECT id, d + 2 + INTERVAL 630 MINUTE, 'event', CASE WHEN k % 7 = 0 THEN 'Назначен судья' ELSE 'Регистрация' END FROM d UNION ALL SELECT id, d + 20 + INTERVAL 12 HOUR, 'document', 'РЕШЕНИЕ' FROM d WHERE k % 3 > 0""")
def case_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.of_cases(ct.cases(spark, sf))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of several late batches, upserted into a versioned store; then the store's newest version.

    The events come as four parts, dealt by id, so that each batch has rows older than those before. A batch is a part, in
    however many files it is, since each batch writes the store's buckets anew.
    """
    root = folder(spark, "stream-upsert")
    events = t(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), "event_type", "event_id")
    store = Store(spark, f"{root}/store", "user_id", ("event_type", "event_id"), "seq")
    for part in (3, 1, 2, 0):
        events.where(F.pmod("event_id", F.lit(4)) == part).write.mode("append").parquet(f"{root}/in")
        ingest.run_upserts(ingest.files(spark, f"{root}/in", events.schema, per_trigger=None), store, f"{root}/checkpoint").awaitTermination()
    return store.read().select("user_id", F.col("seq.ts").alias("ts"), "event_type", "event_id")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_windowed_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream, counted by day; a day comes out once the watermark, an hour behind the newest event, has passed it."""
    schema, root = t(spark, sf, "events").schema, folder(spark, "stream-windows")
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.windowed(stream, "ts", "1 day", "1 hour", ["event_type"], "value")
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT 'u' || user_id AS court, max(ts) AS last, count(*) FILTER (event_type = 'click') AS found, count(*) FILTER (event_type = 'purchase') AS parsed FROM events GROUP BY 1) SELECT * FROM s WHERE found > 0 OR parsed > 0 ORDER BY last DESC, court LIMIT 40""")
def collector_tasks(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda x: F.count_if(F.col("event_type") == x)
    tasks = t(spark, sf, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("court")).agg(F.max("ts").alias("last"), kind("click").alias("found"), kind("purchase").alias("parsed"))
    return dashboard.collector_tasks(tasks)


# --- full text in the other script ------------------------------------------------------------------------------------

_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхызт"[:26]


def _script(x: str) -> str:
    return x.translate(str.maketrans(_LATIN, _CYRILLIC))


def _cyrillic(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with their Latin letters as letters of the other script, for which stop words and endings apply."""
    return t(spark, sf, "documents").select("doc_id", F.translate(F.lower("text"), _LATIN, _CYRILLIC).alias("text"))


_STEM = rf"CASE WHEN regexp_matches(w, '[а-яё]$') THEN regexp_replace(w, '^(.{{4,}}?)(?:{'|'.join(dict.fromkeys(ENDINGS))})$', '\1') ELSE w END"


def _tokens_sql(documents: str = "documents") -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    words = rf"unnest(string_split(trim(regexp_replace(regexp_replace(translate(translate(lower(coalesce(text, '')), '{_LATIN}', '{_CYRILLIC}'), 'ё', 'е'), '[^a-zа-я0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '))"
    return f"""s0 AS (SELECT unnest([{stops}]) AS w), w0 AS (SELECT doc_id, {words} AS w FROM {documents}), w1 AS (SELECT doc_id, {_STEM} AS term FROM w0 WHERE length(w) >= 2 AND w NOT IN (SELECT w FROM s0)),
c AS (SELECT doc_id, term, count(*) AS tf FROM w1 WHERE term <> '' AND term NOT IN (SELECT w FROM s0) GROUP BY ALL), d AS (SELECT doc_id, CAST(sum(tf) AS INTEGER) AS size FROM c GROUP BY 1 HAVING sum(tf) >= 5), i AS (SELECT c.*, size FROM c JOIN d USING (doc_id))"""


_TOKENS = _tokens_sql()


@query(f"WITH {_TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM i GROUP BY term HAVING count(*) >= 20")
def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    index = fulltext.postings(_cyrillic(spark, sf), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where("df >= 20")


@query(f"""WITH {_TOKENS}, q AS (SELECT unnest(['{_script("secret")}', '{_script("license")}', '{_script("license")}']) AS w), qt AS (SELECT {_STEM} AS term, count(*) AS qtf FROM q GROUP BY 1), k AS (SELECT count(*) AS n, avg(size) AS a FROM d), df AS (SELECT term, count(*) AS df FROM i JOIN qt USING (term) GROUP BY 1),
r AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / a)) * qtf), 4) AS score FROM i JOIN qt USING (term) JOIN df USING (term), k GROUP BY doc_id) SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 10""")
def stored_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search of a stored index: built once, written, and read by the query's terms."""
    index = fulltext.store_index(_cyrillic(spark, sf), "doc_id", "text", folder(spark, "index"))
    return fulltext.search(index, "doc_id", _script("secret license license"), 10)


@query(f"""WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN coalesce(text, '') || ' license secret' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7), {_tokens_sql("changed")}, q AS (SELECT unnest(['{_script("secret")}', '{_script("license")}', '{_script("license")}']) AS w), qt AS (SELECT {_STEM} AS term, count(*) AS qtf FROM q GROUP BY 1), k AS (SELECT count(*) AS n, avg(size) AS a FROM d), df AS (SELECT term, count(*) AS df FROM i JOIN qt USING (term) GROUP BY 1),
r AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / a)) * qtf), 4) AS score FROM i JOIN qt USING (term) JOIN df USING (term), k GROUP BY doc_id) SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 20""")
def index_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A search of an index of all documents after some were replaced and some removed: segments, marks and block bounds instead of a new build."""
    docs, tenth = _cyrillic(spark, sf), F.pmod("doc_id", F.lit(10))
    index = TextIndex(spark, folder(spark, "text-index"), "doc_id")
    index.put(docs, "text")
    index.put(docs.where(tenth == 3).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(_script(" license secret")))), "text")
    index.remove(docs.where(tenth == 7))
    return index.search(_script("secret license license"), 20)


@query("SELECT o_orderkey, o_orderstatus AS status_before, 'X' AS status_after, o_totalprice FROM orders WHERE o_orderkey % 9 = 0")
def store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What differs between a store's first version and its last: one batch changes orders, a late one changes nothing any more."""
    orders = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(2).alias("seq"))
    store = Store(spark, folder(spark, "store-changes"), "o_orderkey", ("o_orderstatus", "o_totalprice"), "seq")
    first = store.upsert(orders)
    store.upsert(orders.where(F.pmod("o_orderkey", F.lit(9)) == 0).withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(None).cast("double"), "seq": F.lit(3)}))
    store.upsert(orders.withColumns({"o_orderstatus": F.lit("LATE"), "seq": F.lit(1)}))
    return store.changed(first.number).where(F.col("before.o_orderstatus") != F.col("after.o_orderstatus")).select("o_orderkey", F.col("before.o_orderstatus").alias("status_before"), F.col("after.o_orderstatus").alias("status_after"), F.col("after.o_totalprice").alias("o_totalprice"))


# --- many names at once -----------------------------------------------------------------------------------------------


@query(f"""WITH {CASES}, u AS (SELECT lower("caseUid") AS uid, "courtRegion", "collectedAt", id FROM cases WHERE "caseUid" IS NOT NULL), h AS (SELECT 'UID-' || c_custkey AS case_uid FROM customer)
SELECT case_uid, arg_max("courtRegion", struct_pack(a := "collectedAt", b := id)) AS region FROM h LEFT JOIN u ON contains(uid, lower(case_uid)) GROUP BY 1""")
def hit_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of text hits that name a case by a part of its uid."""
    hits = t(spark, sf, "customer").select(F.concat(F.lit("UID-"), F.col("c_custkey").cast("string")).alias("case_uid"))
    return search.with_region(hits, ct.cases(spark, sf))


_MET = " OR ".join([f"contains(lower({f}), lower(name))" for f in ("plaintiff", "coalesce(defendant, '')", "judge", "parties")] + [f"({when} AND contains(lower({who}), lower(name)))" for when, _, who in ct.PARTICIPANTS])
_JUDGES = ct.JUDGE


@query(f"""WITH n AS (SELECT DISTINCT {_JUDGES.replace(C, "c_custkey")} AS name FROM customer), f AS (SELECT {K}, {C}, {", ".join(f'{ct.COLUMNS[c]} AS {c}' for c in ("id", "plaintiff", "defendant", "judge", "parties"))} FROM {FROM}) SELECT name, id FROM n JOIN f ON {_MET}""")
def cases_of_many_names(spark: SparkSession, sf: str) -> DataFrame:
    names_ = t(spark, sf, "customer").select(F.expr(_JUDGES.replace(C, "c_custkey")).alias("name"))
    return containment.cases_of_names(ct.cases(spark, sf), names_)


@query(_ORGS + """, n AS (SELECT DISTINCT 'Ромашка ' || (c_custkey % 30) AS query FROM customer),
a AS (SELECT query, m.key, count(DISTINCT alias) AS hits FROM n JOIN m ON contains(lower(alias), lower(query)) GROUP BY ALL),
s AS (SELECT query, r.key, canonical, case_count, CAST(CASE WHEN lower(query) = r.key THEN 100 ELSE 0 END + CASE WHEN contains(lower(canonical), lower(query)) THEN 50 ELSE 0 END + CASE WHEN contains(r.key, lower(query)) OR contains(lower(query), r.key) THEN 30 ELSE 0 END + 20 * coalesce(a.hits, 0) AS INTEGER) AS score FROM n CROSS JOIN r LEFT JOIN a USING (query, key)),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, case_count DESC, key) AS INTEGER) AS place FROM s WHERE score > 0) SELECT * FROM p WHERE place <= 20""")
def records_of_many_names(spark: SparkSession, sf: str) -> DataFrame:
    asked = t(spark, sf, "customer").select(F.concat(F.lit("Ромашка "), (F.col("c_custkey") % 30).cast("string")).alias("query"))
    return containment.resolve_table(lookup.mentions(ct.cases(spark, sf)), asked)


# --- aggregates kept up by changes ------------------------------------------------------------------------------------

_KEPT = ("courtRegion", "caseUrl", "enrichedAt", "documentsCount", "hasActText", "plaintiff", "defendant", "judge", "participants")


def _store_in_batches(spark: SparkSession, sf: str, name: str) -> tuple[Store, list[DataFrame]]:
    """A store of all cases, and two batches to follow: enrichment of a part, other judges and regions for a part of them."""
    rows, k = ct.cases(spark, sf).select("id", *_KEPT, F.lit(1).cast("long").alias("seq")), F.substring("id", 2, 20).cast("long")
    store = Store(spark, folder(spark, name), "id", _KEPT, "seq")
    store.upsert(rows)
    return store, [rows.where(k % 4 == 0).withColumns({"enrichedAt": F.lit("2099-01-01"), "documentsCount": F.lit(4), "seq": F.lit(2).cast("long")}), rows.where(k % 8 == 0).withColumns({"judge": F.lit("Новый"), "courtRegion": F.lit("99"), "documentsCount": F.lit(None).cast("int"), "seq": F.lit(3).cast("long")})]


def _kept_up(spark: SparkSession, sf: str, name: str, shares, keys: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    store, batches = _store_in_batches(spark, sf, name)
    kept = maintained.Maintained(store, folder(spark, f"{name}-sums"), shares, keys, sums)
    kept.advance()
    for batch in batches:
        store.upsert(batch)
        kept.advance()
    return kept.read()


@query(f"""WITH {CASES}, n AS (SELECT CASE WHEN z_k % 8 = 0 THEN '99' ELSE "courtRegion" END AS region, "caseUrl" <> '' AND "enrichedAt" = '' AND z_k % 4 <> 0 AS open, z_k % 4 = 0 OR "documentsCount" > 0 AS docs, "hasActText" AS act FROM cases)
SELECT coalesce(region, '') AS region, count(*) AS cases, count(*) FILTER (open) AS pending, count(*) FILTER (docs) AS with_documents, count(*) FILTER (act) AS with_act_text FROM n GROUP BY 1""")
def maintained_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _kept_up(spark, sf, "counters", maintained.enrichment_shares, ("region",), ("cases", "pending", "with_documents", "with_act_text")).withColumn("region", F.coalesce("region", F.lit("")))


_PERSONS = " UNION ".join(
    [f"SELECT {K} AS z_k, 'ИСТЕЦ' AS role, {ct.PLAINTIFF} AS name FROM {FROM}", f"SELECT {K}, 'ОТВЕТЧИК', {ct.COLUMNS['defendant']} FROM {FROM}", f"SELECT {K}, 'СУДЬЯ', CASE WHEN {K} % 8 = 0 THEN 'Новый' ELSE {ct.COLUMNS['judge']} END FROM {FROM}"]
    + [f"SELECT {K}, '{role}', {name} FROM {FROM} WHERE {when}" for when, role, name in ct.PARTICIPANTS]
)


@query(f"WITH p AS ({_PERSONS}) SELECT lower(name) AS person, role, count(*) AS cases FROM p WHERE name <> '' GROUP BY ALL")
def maintained_people(spark: SparkSession, sf: str) -> DataFrame:
    return _kept_up(spark, sf, "people", maintained.people_shares, ("person", "role"), ("cases",))


# --- the collector ----------------------------------------------------------------------------------------------------


@query(f"""WITH {CASES} SELECT {_UID} AS id, "caseNumber", "courtSubdomain", coalesce(nullif(category, ''), 'Не указано') AS category, nullif(judge, '') AS judge, strftime(DATE '2024-01-01' + CAST(floor(z_k / 10000) AS INT), '%Y-%m-%d') AS "hearingDate", "hearingTime", CASE WHEN z_k % 50 = 0 THEN 'Отложено' ELSE 'Заседание' END AS status, z_k % 50 <> 0 AS waits FROM cases""")
def collected_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of schedules and, of every fiftieth case, its card, dropped into a folder, collected by a stream; the catalogue after that.

    A schedule has the cases of one court and 10,000 keys, whose place is its day: a line of the file for each, below the table's head.
    """
    root, k = folder(spark, "collected"), F.substring("id", 2, 20).cast("long")
    rows = _numbered(ct.cases(spark, sf, dealt=True)).withColumns({"place": k, "page": F.floor(k / 10_000)})
    info = F.concat(F.lit("КАТЕГОРИЯ: "), F.col("category"), F.lit("<br>ИСТЕЦ: "), F.col("plaintiff"))
    line = F.concat(F.lit("<tr>"), _cell("1"), _cell(F.col("link")), _cell(F.col("hearingTime")), _cell("Зал 1"), _cell(info), _cell(F.col("judge")), F.lit("</tr>"))
    head = '<table id="tablcont"><tr><th>№ п/п</th><th>Номер дела</th><th>Время слушания</th><th>Место (Зал)</th><th>Информация по делу</th><th>Судья</th></tr>'
    lines = rows.select(F.col("courtSubdomain").alias("court"), "page", "place", line.alias("value"))
    lines = lines.unionByName(lines.select("court", "page").distinct().withColumns({"place": F.lit(-1).cast("long"), "value": F.lit(head)}))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("page").cast("int")), "yyyy-MM-dd")
    _drop(lines.withColumn("day", day), f"{root}/in/schedule")
    pair = lambda a, b: F.concat(F.lit(f"<tr><td>{a}</td><td>"), b, F.lit("</td></tr>"))
    card = F.concat(F.lit('<div id="cont1"><table>'), pair("Уникальный идентификатор дела", F.md5(F.col("k").cast("binary"))), pair("Номер дела", F.col("caseNumber")), pair("Результат рассмотрения", F.lit("Отложено")), F.lit("</table></div>"))
    cards = rows.where(k % 50 == 0).select(F.col("courtSubdomain").alias("court"), day.alias("day"), "place", card.alias("value"))
    _drop(cards, f"{root}/in/cards", each=True)
    into = collect.store(spark, f"{root}/store")
    collect.run(spark, f"{root}/in", into, f"{root}/checkpoint").awaitTermination()
    waiting = collect.queue(into, None).select("id", F.lit(True).alias("waits"))
    found = collect.catalogue(into).join(waiting, "id", "left")
    return found.select("id", "caseNumber", "courtSubdomain", "category", F.nullif("judge", F.lit("")).alias("judge"), "hearingDate", "hearingTime", "status", F.coalesce("waits", F.lit(False)).alias("waits"))


def _drop(lines: DataFrame, where: str, each: bool = False) -> None:
    """Lines (court, day, place, value) in order of their places as one file for each court and day, or as one file each in the folder of its court and day.

    Making a file takes long, so many tasks share that, and each brings its files to their place as it ends.
    """
    spark = lines.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = lines.repartition(tasks, "court", "day", *(["place"] if each else [])).sortWithinPartitions("court", "day", "place").select("court", "day", "value")
    dealt.write.partitionBy("court", "day").option("maxRecordsPerFile", 1 if each else 0).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(where)
