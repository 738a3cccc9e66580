"""Instances of the operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, names, text
from ..functions.text import Rule
from ..operators import cases, catalog, fulltext, lookup, merge, people, schedule, timeline
from ..session import ship
from ..sources import pages as page_source

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf}/{name}.parquet")


def customers_with_nation(spark: SparkSession, sf: str) -> DataFrame:
    """nation has 25 rows by definition, so it is broadcast."""
    return t(spark, sf, "customer").join(F.broadcast(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))


def filtered_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = t(spark, sf, "orders").where((F.col("o_orderstatus") == "O") & catalog.between_dates(F.col("o_orderdate"), "1996-01-01", "1998-12-31"))
    return orders.join(customers_with_nation(spark, sf), F.col("o_custkey") == F.col("c_custkey"))


_FILTERED = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'"""


# --- lists, filters, facets -------------------------------------------------------------------------------------------


@query(f"""SELECT o_orderkey, c_name, n_name, o_totalprice, o_orderdate, o_orderpriority FROM {_FILTERED}
ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def catalog_list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = filtered_orders(spark, sf).select("o_orderkey", "c_name", "n_name", "o_totalprice", "o_orderdate", "o_orderpriority")
    return catalog.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")])


@query(f"SELECT o_orderkey, o_orderdate FROM {_FILTERED} ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 100")
def catalog_list_next_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.page(filtered_orders(spark, sf).select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 100, 500)


@query(f"SELECT n_name, count(*) AS n FROM {_FILTERED} GROUP BY n_name")
def facet_filtered_nations(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.facet(filtered_orders(spark, sf), "n_name")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE lower(concat_ws(' ', nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, ''))) LIKE '%brand#1%'")
def catalog_haystack_search(spark: SparkSession, sf: str) -> DataFrame:
    part = t(spark, sf, "part")
    return part.where(F.contains(catalog.haystack(F.col("p_name"), F.col("p_brand"), F.col("p_type")), F.lit("brand#1"))).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS
(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 45)""")
def participant_exists_filter(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))
    return t(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderpriority")


@query("""SELECT CASE WHEN regexp_matches(p_type, '(?i)steel|tin') THEN 'civil' WHEN regexp_matches(p_type, '(?i)copper') THEN 'criminal' ELSE 'other' END AS category_group, count(*) AS n FROM part GROUP BY 1""")
def category_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = (Rule("civil", "steel|tin"), Rule("criminal", "copper"))
    return catalog.facet(t(spark, sf, "part").select(text.label_of(F.col("p_type"), groups, "other").alias("category_group")), "category_group")


@query("SELECT n_name AS court, count(*) AS n, any_value(r_name) AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def facet_courts(spark: SparkSession, sf: str) -> DataFrame:
    nations = t(spark, sf, "nation").join(F.broadcast(t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 and 25 rows
    rows = t(spark, sf, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "court")
    return catalog.facet(rows, "court", newest={"region": "r_name"}, by=F.col("s_suppkey"))


@query("SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type")
def facet_categories(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.facet(t(spark, sf, "part").select(F.col("p_type").alias("category")), "category", blanks=False)


@query("SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> '' GROUP BY r_name")
def facet_regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = customers_with_nation(spark, sf).join(F.broadcast(t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalog.facet(rows.select(F.col("r_name").alias("region")), "region", blanks=False)


@query("SELECT o_custkey, count(*) AS n, arg_max(o_orderpriority, struct_pack(d := o_orderdate, k := o_orderkey)) AS newest_priority FROM orders GROUP BY o_custkey")
def facet_newest_label(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.facet(t(spark, sf, "orders"), "o_custkey", newest={"newest_priority": "o_orderpriority"}, by=F.struct("o_orderdate", "o_orderkey"))


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 20")
def pending_queue(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.pending(t(spark, sf, "documents").select("doc_id", "source"), t(spark, sf, "labels"), "doc_id", [F.col("doc_id")], 20)


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def anti_reindex(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


# --- merge and change capture -----------------------------------------------------------------------------------------


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = t(spark, sf, "customer")
    old = c.where("c_custkey % 10 <> 0").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat("c_name", F.lit("*"))).alias("c_name"), "c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return old, new


_SNAPSHOTS = """WITH o AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 10 <> 0),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name || '*' END AS c_name, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 = 0) """


@query(_SNAPSHOTS + """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(nullif(n.c_name, ''), o.c_name) AS c_name, coalesce(nullif(n.c_mktsegment, ''), o.c_mktsegment) AS c_mktsegment,
coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, o.c_custkey IS NULL AS is_new FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge.upsert(*snapshots(spark, sf), "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"])


@query(_SNAPSHOTS + """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, o.c_custkey IS NULL AS is_new FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert_blank_overwrites(spark: SparkSession, sf: str) -> DataFrame:
    return merge.upsert(*snapshots(spark, sf), "c_custkey", ["c_name"], blank_overwrites=True)


@query(_SNAPSHOTS + """, j AS (SELECT o.c_custkey AS k, o.c_name AS a, n.c_name AS b, o.c_mktsegment AS c, n.c_mktsegment AS d FROM o JOIN n ON o.c_custkey = n.c_custkey)
SELECT k AS c_custkey, 'c_name' AS field, a AS "from", b AS "to" FROM j WHERE a IS DISTINCT FROM b UNION ALL SELECT k, 'c_mktsegment', c, d FROM j WHERE c IS DISTINCT FROM d""")
def cdc_diff(spark: SparkSession, sf: str) -> DataFrame:
    return merge.changes(*snapshots(spark, sf), "c_custkey", ["c_name", "c_mktsegment"])


@query(_SNAPSHOTS + """, s AS (SELECT *, 0 AS side FROM o UNION ALL SELECT *, 1 FROM n)
SELECT c_custkey, arg_max(c_acctbal, struct_pack(a := c_acctbal, s := side)) AS c_acctbal, arg_max(c_name, struct_pack(a := c_acctbal, s := side)) AS c_name FROM s GROUP BY c_custkey""")
def conflict_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge.newer_wins(*snapshots(spark, sf), "c_custkey", ["c_acctbal"], ["c_acctbal", "c_name"])


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, string_agg(event_id || ':' || event_type, ',' ORDER BY k DESC) AS log, count(*) AS n FROM r WHERE k <= 30 GROUP BY user_id""")
def changelog_cap(spark: SparkSession, sf: str) -> DataFrame:
    log = merge.log_of(t(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.concat_ws(":", "event_id", "event_type"))
    return log.select("user_id", F.array_join("log", ",").alias("log"), F.size("log").cast("long").alias("n"))


@query("""WITH p AS (SELECT 0 AS part, * FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 1, * REPLACE (s_name || '!' AS s_name) FROM supplier WHERE s_suppkey % 2 = 0)
SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY part) AS k FROM p) WHERE k = 1""")
def page_dedup(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier").select("s_suppkey", "s_name")
    return merge.keep_first([s.where("s_suppkey % 3 <> 0"), s.where("s_suppkey % 2 = 0").withColumn("s_name", F.concat("s_name", F.lit("!")))], F.col("s_suppkey"), ["s_suppkey"])


# --- coverage and rates -----------------------------------------------------------------------------------------------


def covered(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(t(spark, sf, "labels"), "doc_id", "left")


_COVERED = "documents LEFT JOIN labels USING (doc_id)"


def _totals() -> list[Column]:
    return [F.count("*").alias("size"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean")]


@query(f"""WITH t AS (SELECT count(*) AS size, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 1 AND toxic = 0) AS clean FROM {_COVERED}),
u AS (SELECT 0 AS step, 'size' AS stage, size AS n, size FROM t UNION ALL SELECT 1, 'labelled', labelled, size FROM t UNION ALL SELECT 2, 'good', good, size FROM t UNION ALL SELECT 3, 'clean', clean, size FROM t)
SELECT CAST(step AS INTEGER) AS step, stage, n, CASE WHEN size > 0 THEN floor(n * 1000 / size + 0.5) / 10 ELSE 0.0 END AS pct FROM u""")
def coverage_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return cases.funnel(covered(spark, sf).agg(*_totals()), [("size", "size"), ("labelled", "labelled"), ("good", "good"), ("clean", "clean")])


@query(f"""SELECT coalesce(lang, '—') AS lang, count(*) AS size, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 1 AND toxic = 0) AS clean,
floor(count(quality) * 1000 / count(*) + 0.5) / 10 AS labelled_pct FROM {_COVERED} GROUP BY 1 ORDER BY size DESC, lang LIMIT 30""")
def coverage_by_group(spark: SparkSession, sf: str) -> DataFrame:
    out = covered(spark, sf).groupBy(F.coalesce("lang", F.lit("—")).alias("lang")).agg(*_totals())
    return out.withColumn("labelled_pct", text.percent(F.col("labelled"), F.col("size"))).orderBy(F.desc("size"), "lang").limit(30)


@query("""WITH a AS (SELECT count(*) AS size, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY) AS last_day, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS last_week FROM events),
b AS (SELECT *, floor(last_week / 7 * 10 + 0.5) / 10 AS per_day FROM a)
SELECT size, last_day, last_week, per_day, CASE WHEN per_day > 0 THEN CAST(ceil(greatest(500000 - size, 0) / per_day) AS BIGINT) END AS eta_days FROM b""")
def collection_rate(spark: SparkSession, sf: str) -> DataFrame:
    return cases.collection_rate(t(spark, sf, "events"), F.col("ts"), F.lit("2024-01-30").cast("timestamp_ntz"), 500_000)


# --- outcomes, judges, seasons ----------------------------------------------------------------------------------------

_DOC_RULES = (Rule("granted_partial", r"\bthe (?:to|that) "), Rule("granted", "license"), Rule("denied", "secret|token"), Rule("settled", r"[#%&*$]{3}"), Rule("terminated", "mente"))
_LABELS = ("granted", "granted_partial", "denied", "settled", "terminated", "returned", "unknown")
_DOC_CASE = r"""CASE WHEN regexp_matches(text, '(?i)\bthe (?:to|that) ') THEN 'granted_partial' WHEN regexp_matches(text, '(?i)license') THEN 'granted' WHEN regexp_matches(text, '(?i)secret|token') THEN 'denied'
WHEN regexp_matches(text, '(?i)[#%&*$]{3}') THEN 'settled' WHEN regexp_matches(text, '(?i)mente') THEN 'terminated' ELSE 'unknown' END"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", "lang", text.label_of(F.coalesce("text", F.lit("")), _DOC_RULES, "unknown").alias("outcome"))


@query(f"SELECT doc_id, lang, {_DOC_CASE} AS outcome FROM documents")
def outcome_classify(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf)


@query(f"""WITH c AS (SELECT {_DOC_CASE} AS outcome FROM documents), n AS (SELECT outcome, count(*) AS n FROM c GROUP BY 1), l AS (SELECT unnest([{", ".join(f"'{x}'" for x in _LABELS)}]) AS outcome)
SELECT outcome, coalesce(n, 0) AS n, (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c WHERE outcome <> 'unknown') AS known FROM l LEFT JOIN n USING (outcome)""")
def outcome_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = cases.label_counts(classified(spark, sf), "outcome", _LABELS)
    return out.select("outcome", "n", "total", "known")


@query("""WITH r AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'neutral' END AS r, o_orderpriority AS c, o_orderkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT o_custkey, count(*) AS cases, count(*) FILTER (r = 'win') AS wins, count(*) FILTER (r = 'loss') AS losses, count(*) FILTER (r = 'neutral') AS neutrals,
CASE WHEN count(*) FILTER (r IN ('win', 'loss')) > 0 THEN count(*) FILTER (r = 'win') / count(*) FILTER (r IN ('win', 'loss')) END AS win_rate, count(DISTINCT c) AS courts, string_agg(CAST(s AS VARCHAR), ',' ORDER BY i) FILTER (i <= 5) AS samples
FROM r GROUP BY o_custkey HAVING count(*) >= 2""")
def winrate_by_agent(spark: SparkSession, sf: str) -> DataFrame:
    result = F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").otherwise("neutral")
    out = cases.win_rates(t(spark, sf, "orders"), "o_custkey", result, F.col("o_orderpriority"), F.col("o_orderkey").cast("string"), F.struct("o_orderdate", "o_orderkey"))
    return out.withColumn("samples", F.array_join("samples", ","))


_LAG = "CASE WHEN datediff('day', o_orderdate, l_shipdate) BETWEEN 0 AND 4000 THEN datediff('day', o_orderdate, l_shipdate) END"


def shipped(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_extendedprice", "l_discount")
    rows = lines.join(t(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.withColumn("days", dates.duration_days(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")))


@query(f"""WITH s AS (SELECT l_suppkey AS judge, {_LAG} AS days, l_returnflag AS f, l_linenumber AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT judge, 1 AS one, days, CASE f WHEN 'A' THEN 'granted' WHEN 'R' THEN 'denied' ELSE 'unknown' END AS r FROM s WHERE l <> 1 UNION ALL SELECT judge, 0, NULL, CASE f WHEN 'R' THEN 'changed' ELSE 'upheld' END FROM s WHERE l = 1),
g AS (SELECT judge, count(*) FILTER (one = 1) AS cases, count(days) AS n_durations, median(days) AS median_days, CAST(quantile_disc(days, 0.75) AS DOUBLE) AS p75_days, count(*) FILTER (one = 1 AND r <> 'unknown') AS known, count(*) FILTER (one = 1 AND r = 'granted') AS granted,
count(*) FILTER (one = 1 AND r = 'denied') AS denied, count(*) FILTER (one = 0) AS appeals, count(*) FILTER (one = 0 AND r = 'changed') AS changed FROM b GROUP BY judge)
SELECT *, CASE WHEN known > 0 THEN granted / known END AS granted_rate, CASE WHEN known > 0 THEN denied / known END AS denied_rate, CASE WHEN appeals > 0 THEN changed / appeals END AS overturn_rate
FROM g WHERE cases >= 5 OR appeals >= 3 ORDER BY cases DESC, judge LIMIT 40""")
def judge_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = shipped(spark, sf).withColumn("judge", F.col("l_suppkey"))
    result = F.when(F.col("l_returnflag") == "A", "granted").when(F.col("l_returnflag") == "R", "denied").otherwise("unknown")
    appeal = F.when(F.col("l_returnflag") == "R", "changed").otherwise("upheld")
    return cases.judge_report(rows.where("l_linenumber <> 1").withColumn("result", result), rows.where("l_linenumber = 1").withColumn("result", appeal))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""SELECT CAST(m AS INTEGER) AS month, count(o_orderkey) AS total, {", ".join(f'''count(*) FILTER (o_orderpriority = '{p}') AS "{p}"''' for p in _PRIORITIES)}
FROM range(1, 13) r(m) LEFT JOIN orders ON month(o_orderdate) = m GROUP BY m""")
def seasonality_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return cases.months(t(spark, sf, "orders"), F.month("o_orderdate"), F.col("o_orderpriority"), _PRIORITIES)


@query(f"""WITH s AS (SELECT {_LAG} AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT count(d) AS n, median(d) AS median_days, CAST(quantile_disc(d, 0.25) AS DOUBLE) AS p25_days, CAST(quantile_disc(d, 0.75) AS DOUBLE) AS p75_days, round(avg(d), 6) AS mean_days FROM s""")
def lifecycle_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return cases.lifecycle(shipped(spark, sf), "days").withColumn("mean_days", F.round("mean_days", 6))


@query("""WITH s AS (SELECT l_extendedprice AS c, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice * (1 - l_discount) END AS a FROM lineitem)
SELECT count(c) AS n_claim, count(a) AS n_award, count(*) FILTER (c > 0 AND a IS NOT NULL) AS n_both, round(median(c), 4) AS median_claim, round(median(a), 4) AS median_award,
round(median(CASE WHEN c > 0 AND a IS NOT NULL THEN least(a / c, 5) END), 6) AS median_ratio, round(sum(c), 0) AS total_claim, round(sum(a), 0) AS total_award FROM s""")
def amount_conversion(spark: SparkSession, sf: str) -> DataFrame:
    award = F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = cases.amounts_report(t(spark, sf, "lineitem"), F.col("l_extendedprice"), award)
    places = {"median_claim": 4, "median_award": 4, "median_ratio": 6, "total_claim": 0, "total_award": 0}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


@query("""WITH c AS (SELECT o_custkey, count(*) AS cases FROM orders GROUP BY 1 HAVING count(*) >= 4 ORDER BY cases DESC, o_custkey LIMIT 30),
r AS (SELECT o_custkey, cases, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders JOIN c USING (o_custkey))
SELECT o_custkey, cases, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY i) AS samples FROM r WHERE i <= 4 GROUP BY 1, 2""")
def serial_parties(spark: SparkSession, sf: str) -> DataFrame:
    out = cases.frequent(t(spark, sf, "orders"), "o_custkey", F.col("o_orderdate"), F.col("o_orderkey"))
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query("""SELECT o_orderkey, o_orderdate, CAST(datediff('day', o_orderdate, DATE '2001-08-01') AS INTEGER) AS age_days FROM orders WHERE o_orderstatus = 'O' AND datediff('day', o_orderdate, DATE '2001-08-01') >= 60
ORDER BY age_days DESC, o_orderkey LIMIT 40""")
def stuck_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")
    return cases.stuck(rows, F.datediff(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date")), "o_orderkey")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS known, count(*) FILTER (o_orderstatus = 'F') AS granted, count(*) FILTER (o_orderstatus = 'O') AS denied,
CASE WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 THEN count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'P') END AS rate FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 36""")
def practice_shift(spark: SparkSession, sf: str) -> DataFrame:
    result = F.when(F.col("o_orderstatus") == "F", "granted").when(F.col("o_orderstatus") == "O", "denied").otherwise("unknown")
    return cases.practice(t(spark, sf, "orders"), F.col("o_orderdate"), result)


# --- heat maps and people ---------------------------------------------------------------------------------------------


def appearances(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers of a nation as people of two roles."""
    nation = F.broadcast(t(spark, sf, "nation"))
    c = t(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.regexp_replace("c_name", "^.*#0*", "person ").alias("name"), F.lit("plaintiff").alias("family"), F.col("n_nationkey").alias("case_id"), F.col("n_name").alias("court"))
    s = t(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.regexp_replace("s_name", "^.*#0*", "person ").alias("name"), F.lit("representative").alias("family"), F.col("n_nationkey").alias("case_id"), F.col("n_name").alias("court"))
    return c.unionByName(s)


_PEOPLE = """WITH a AS (SELECT regexp_replace(c_name, '^.*#0*', 'person ') AS name, 'plaintiff' AS family, n_nationkey AS case_id, n_name AS court FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT regexp_replace(s_name, '^.*#0*', 'person '), 'representative', n_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT lower(name) AS person, min(name) AS name, count(*) AS appearances, count(DISTINCT case_id) AS cases, count(DISTINCT court) AS courts,
concat_ws(',', CASE WHEN bool_or(family = 'representative') THEN 'representative' END, CASE WHEN bool_or(family = 'plaintiff') THEN 'plaintiff' END) AS families FROM a GROUP BY 1) """


@query(_PEOPLE + "SELECT *, split_part(families, ',', 1) AS primary_family FROM p")
def participant_index(spark: SparkSession, sf: str) -> DataFrame:
    return people.index(appearances(spark, sf)).withColumn("families", F.array_join("families", ","))


@query(_PEOPLE + """, f AS (SELECT unnest(string_split(families, ',')) AS family, appearances FROM p), l AS (SELECT unnest(['judge', 'representative', 'plaintiff', 'defendant', 'third', 'other']) AS family)
SELECT l.family, count(f.family) AS people, CAST(coalesce(sum(appearances), 0) AS BIGINT) AS appearances FROM l LEFT JOIN f USING (family) GROUP BY 1""")
def participant_facets(spark: SparkSession, sf: str) -> DataFrame:
    return people.facets(people.index(appearances(spark, sf)))


@query(_PEOPLE + "SELECT person, cases FROM p WHERE cases >= 2 AND person LIKE '%1%' AND families LIKE '%representative%' ORDER BY cases DESC, person LIMIT 100")
def people_list(spark: SparkSession, sf: str) -> DataFrame:
    found = people.find(people.index(appearances(spark, sf)), "1", "representative", 2).select("person", "cases")
    return catalog.page(found, [F.desc("cases"), F.col("person")], 0, 200)


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with the supplier and the nations of both sides."""
    nation = t(spark, sf, "nation").select("n_nationkey", "n_name")
    buyers = t(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("court"))
    sellers = t(spark, sf, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("n_name").alias("home"))
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    return lines.join(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))


_TRADES = """WITH x AS (SELECT s_name, a.n_name AS court, b.n_name AS home, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey) """


@query(_TRADES + ", h AS (SELECT court, count(*) AS appearances, count(DISTINCT s_name) AS people FROM x GROUP BY 1) SELECT *, appearances / max(appearances) OVER () AS intensity FROM h")
def court_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return people.heat(trades(spark, sf), "court", "s_name")


@query(_TRADES + """, top AS (SELECT s_name FROM x GROUP BY 1 ORDER BY count(*) DESC, s_name LIMIT 18), c AS (SELECT s_name, court, count(*) AS n FROM x GROUP BY 1, 2)
SELECT s_name, court, coalesce(n, 0) AS n FROM (SELECT s_name, n_name AS court FROM top, nation) g LEFT JOIN c USING (s_name, court)""")
def rep_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return people.matrix(trades(spark, sf), "s_name", "court", 18, t(spark, sf, "nation").withColumnRenamed("n_name", "court"))


@query(_TRADES + "SELECT l_returnflag, count(DISTINCT s_name) AS people, count(*) AS appearances FROM x GROUP BY GROUPING SETS ((l_returnflag), ())")
def rep_totals(spark: SparkSession, sf: str) -> DataFrame:
    return people.totals(trades(spark, sf), "l_returnflag", "s_name")


@query(_TRADES + ", c AS (SELECT s_name, court, count(*) AS n FROM x GROUP BY 1, 2) SELECT s_name, arg_min(court, struct_pack(a := -n, b := court)) AS court, max(n) AS n FROM c GROUP BY 1")
def main_court(spark: SparkSession, sf: str) -> DataFrame:
    return people.main_value(trades(spark, sf).withColumn("seq", F.lit(0)), "s_name", "court", "seq")


@query(_TRADES + """, g AS (SELECT s_name, count(*) AS cases, count(DISTINCT court) AS courts, count(*) FILTER (l_returnflag = 'A') AS acts, count(*) FILTER (l_returnflag <> 'N') AS enriched, count(DISTINCT home) AS regions FROM x GROUP BY 1),
r AS (SELECT s_name, cases, courts, CAST(least(99, greatest(55, floor(55 + (least(cases * 3, 28) + least(courts * 2, 12) + least(acts, 10) + least(enriched, 12) + least(floor(acts / 2), 8) + 1 + CASE WHEN regions > 1 THEN 4 ELSE 1 END + 6) * 0.45 + 0.5))) AS INTEGER) AS rating FROM g)
SELECT *, CASE WHEN rating >= 88 THEN 'gold' WHEN rating >= 78 THEN 'silver' WHEN rating >= 68 THEN 'bronze' ELSE 'common' END AS tier FROM r""")
def pro_cards_rating(spark: SparkSession, sf: str) -> DataFrame:
    acts = F.count_if(F.col("l_returnflag") == "A")
    g = trades(spark, sf).groupBy("s_name").agg(F.count("*").alias("cases"), F.count_distinct("court").alias("courts"), acts.alias("acts"), F.count_if(F.col("l_returnflag") != "N").alias("enriched"), F.count_distinct("home").alias("regions"))
    rating = people.professional_rating(F.col("cases"), F.col("courts"), F.col("acts"), F.col("enriched"), F.col("acts"), F.lit(1), F.col("regions"), F.lit(True))
    return g.select("s_name", "cases", "courts", rating.alias("rating")).withColumn("tier", people.professional_tier(F.col("rating")))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders), g AS (SELECT o_custkey, count(*) AS cases, count(*) FILTER (o_orderstatus = 'F') AS wins, count(*) FILTER (o_orderstatus = 'O') AS losses FROM x GROUP BY 1),
w AS (SELECT *, CASE WHEN wins + losses > 0 THEN wins / (wins + losses) END AS win_rate FROM g)
SELECT *, CAST(least(99, least(90, 40 + cases * 2 + wins) + coalesce(floor(win_rate * 20 + 0.5), 0)) AS INTEGER) AS rating,
CASE WHEN cases >= 20 AND coalesce(win_rate, 0) >= 0.55 THEN 'gold' WHEN cases >= 10 THEN 'silver' WHEN cases >= 4 THEN 'bronze' ELSE 'common' END AS tier FROM w""")
def person_dossier(spark: SparkSession, sf: str) -> DataFrame:
    g = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("cases"), F.count_if(F.col("o_orderstatus") == "F").alias("wins"), F.count_if(F.col("o_orderstatus") == "O").alias("losses"))
    g = g.withColumn("win_rate", F.when(F.col("wins") + F.col("losses") > 0, F.col("wins") / (F.col("wins") + F.col("losses"))))
    return g.withColumns({"rating": people.dossier_rating(F.col("cases"), F.col("win_rate"), F.col("wins")), "tier": people.dossier_tier(F.col("cases"), F.col("win_rate"))})


# --- names, entities, courts ------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT p_partkey, p_name, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS key FROM part)
SELECT key, arg_min(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), p_partkey) AS canonical, count(DISTINCT p_name) AS aliases, count(DISTINCT p_partkey) AS cases FROM k WHERE length(key) >= 2 GROUP BY 1""")
def entity_index(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.entities(t(spark, sf, "part").withColumn("seq", F.col("p_partkey")), "p_name", "seq", "p_partkey")


@query("""WITH k AS (SELECT lower(p_name) AS key, count(DISTINCT p_partkey) AS cases, arg_min(p_name, p_partkey) AS canonical FROM part GROUP BY 1)
SELECT key, cases, CASE WHEN key = 'red' THEN 100 ELSE 0 END + CASE WHEN lower(canonical) LIKE '%red%' THEN 50 ELSE 0 END + CASE WHEN key LIKE '%red%' OR 'red' LIKE '%' || key || '%' THEN 30 ELSE 0 END AS score FROM k WHERE lower(canonical) LIKE '%red%' OR 'red' LIKE '%' || key || '%'
ORDER BY score DESC, cases DESC, key LIMIT 20""")
def entity_resolve(spark: SparkSession, sf: str) -> DataFrame:
    index = lookup.entities(t(spark, sf, "part").withColumn("seq", F.col("p_partkey")), "p_name", "seq", "p_partkey")
    return lookup.resolve(index, "red").select("key", "cases", "score")


@query("""WITH s AS (SELECT n_name, n_nationkey, CASE WHEN lower(n_name) = 'united' THEN 500 ELSE 0 END + CASE WHEN regexp_matches(lower(n_name), '(^|[^a-z0-9])united([^a-z0-9]|$)') THEN 120 ELSE 0 END
+ CASE WHEN n_regionkey = 1 THEN 60 ELSE 0 END AS score FROM nation) SELECT n_name, score FROM s WHERE score > 0 ORDER BY score DESC, n_name LIMIT 10""")
def court_search(spark: SparkSession, sf: str) -> DataFrame:
    courts = t(spark, sf, "nation").withColumns({"code": F.col("n_nationkey").cast("string"), "region": F.col("n_regionkey").cast("string")})
    found = lookup.search_courts(courts, "United", name="n_name", code="code", region="region", kind=None, hints=(("united", "1"),), collation=None)
    return found.select("n_name", "score")


@query("""WITH n AS (SELECT trim(regexp_replace(c_name, '\\s+', ' ', 'g')) AS n, c_custkey FROM customer), k AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'depersonalized' WHEN c_custkey % 3 = 0 THEN 'identifiable' ELSE 'empty' END AS kind FROM n),
a AS (SELECT count(*) AS total, count(*) FILTER (kind <> 'empty') AS signals, count(*) FILTER (kind = 'identifiable') AS identifiable, count(*) FILTER (kind = 'depersonalized') AS masked FROM k)
SELECT *, CASE WHEN signals > 0 THEN identifiable / signals END AS identifiable_rate, CASE WHEN signals < 20 THEN 'insufficient' WHEN identifiable / signals >= 0.4 THEN 'go' WHEN identifiable / signals >= 0.2 THEN 'borderline' ELSE 'no-go' END AS verdict FROM a""")
def depersonalisation_report(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("ФИО"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 0, "Иванова Анна Петровна").otherwise(F.col("c_name"))
    rows = t(spark, sf, "customer").select(names.name_kind(raw).alias("kind"))
    return cases.depersonalization(rows, F.col("kind"))


# --- full text --------------------------------------------------------------------------------------------------------

_TOKENS = r"""tok AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2) AS w FROM documents),
p AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM tok WHERE len(w) >= 5), i AS (SELECT doc_id, term, size, count(*) AS tf FROM p GROUP BY ALL)"""


def latin_index(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with ASCII letters and digits only, for which the endings of the other script never apply."""
    return fulltext.postings(t(spark, sf, "documents"), "doc_id", "text", stop_words=["и"], word=r"[a-z0-9\-]+")


@query(f"WITH {_TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM i GROUP BY term HAVING count(*) >= 20")
def tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    return latin_index(spark, sf).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where("df >= 20")


@query(f"WITH {_TOKENS}, d AS (SELECT DISTINCT doc_id, size FROM i) SELECT count(*) AS n, round(avg(size), 6) AS avg_size FROM d")
def bm25_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.corpus(latin_index(spark, sf), "doc_id").withColumn("avg_size", F.round("avg_size", 6))


_BM25 = f"""WITH {_TOKENS}, q AS (SELECT unnest(['secret', 'token', 'the', 'the']) AS term), qt AS (SELECT term, count(*) AS qtf FROM q GROUP BY 1), d AS (SELECT DISTINCT doc_id, size FROM i),
s AS (SELECT count(*) AS n, avg(size) AS a FROM d), df AS (SELECT term, count(*) AS df FROM i JOIN qt USING (term) GROUP BY 1),
r AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / a)) * qtf), 4) AS score FROM i JOIN qt USING (term) JOIN df USING (term), s GROUP BY doc_id)"""


@query(_BM25 + " SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 10")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.search(latin_index(spark, sf), "doc_id", "secret token the the", 10, ["и"])


@query(_BM25 + """, b AS (SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 15), c AS (SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', nullif(lang, ''), nullif(source, ''))), 'en src1') ORDER BY doc_id DESC LIMIT 15)
SELECT doc_id, 'text' AS source, score FROM b UNION ALL SELECT doc_id, 'catalogue', NULL FROM c""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    best = fulltext.search(latin_index(spark, sf), "doc_id", "secret token the the", 15, ["и"]).select("doc_id", F.lit("text").alias("source"), "score")
    docs = t(spark, sf, "documents").select("doc_id", "lang", "source")
    found = docs.where(F.contains(catalog.haystack(F.col("lang"), F.col("source")), F.lit("en src1"))).orderBy(F.desc("doc_id")).limit(15)
    return best.unionByName(found.select("doc_id", F.lit("catalogue").alias("source"), F.lit(None).cast("double").alias("score")))


@query(None)
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.chunk(t(spark, sf, "documents"), "doc_id", "text")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def document_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.reassemble(t(spark, sf, "conversations"), "conv_id", "turn", "text")


# --- time, pages, plans -----------------------------------------------------------------------------------------------


@query("""SELECT user_id AS id, ts AS at, 'event' AS kind, event_type AS label FROM events UNION ALL SELECT o_custkey, o_orderdate, 'order', o_orderstatus FROM orders""")
def timeline_union(spark: SparkSession, sf: str) -> DataFrame:
    """The timelines of all users and customers."""
    events = t(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("label"))
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("label"))
    return timeline.union({"event": events, "order": orders}, "id", "at", "label")


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS links,
regexp_matches(html, '(?i)qrator|qaptcha|webknight|ddos-guard') AS antibot, NOT regexp_matches(html, '(?i)<table') AS no_table FROM pages""")
def html_extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return t(spark, sf, "pages").select(
        "page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, '<html lang="([^"]*)"', 1).alias("lang"), F.size(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).alias("links"),
        page_source.is_antibot(html).alias("antibot"), (~html.rlike("(?i)<table")).alias("no_table"),
    )


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CAST(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') AS INTEGER) AS page FROM pages")
def pagination_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return t(spark, sf, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, r"[?&]page=(\d+)", 1).try_cast("int").alias("page"))


@query("""WITH b AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1), m AS (SELECT *, CAST(unnest(generate_series(date_trunc('month', a), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM b)
SELECT o_custkey, greatest(m, a) AS window_start, least(last_day(m), b) AS window_end FROM m""")
def month_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The months between each customer's first order and the last."""
    bounds = t(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return dates.windows_of(bounds, "a", "b").select("o_custkey", "window_start", "window_end")


@query("""WITH m AS (SELECT unnest([DATE '2024-01-15', DATE '2024-02-01', DATE '2024-03-01']) AS window_start) SELECT n_name, r_name, window_start FROM nation, region, m""")
def search_plan_cross(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.search_plan(t(spark, sf, "nation").select("n_name"), t(spark, sf, "region").select("r_name"), "2024-01-15", "2024-03-10").select("n_name", "r_name", "window_start")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = t(spark, sf, "events").groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf: str) -> DataFrame:
    out = t(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""WITH c AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name) - 1 AS place FROM nation) SELECT n_name, CAST((place - 7 + 25) % 25 AS BIGINT) AS turn FROM c ORDER BY turn LIMIT 5""")
def ready_courts(spark: SparkSession, sf: str) -> DataFrame:
    courts = t(spark, sf, "nation").select("n_name", F.lit(None).cast("timestamp").alias("due"))
    return schedule.ready(courts, [F.col("n_name")], 7, F.lit("2024-01-01").cast("timestamp"), "due", 5).select("n_name", F.col("turn").cast("long").alias("turn"))


@query("SELECT o_orderpriority AS role, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, role LIMIT 30")
def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.facet(t(spark, sf, "orders").select(F.upper(F.trim("o_orderpriority")).alias("role")), "role").orderBy(F.desc("n"), "role").limit(30)


from . import case_queries  # noqa: E402, F401  registers its queries with the decorator above
