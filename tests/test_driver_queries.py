import duckdb
import pytest

from caselight.plans import driver

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_same_rows_as_sql(spark, db, name):
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in driver.oracle_sql():
        assert rows
        return
    got = db.execute(driver.oracle_sql()[name])
    named = [d[0] for d in got.description]
    assert sorted(named) == columns
    assert sorted(repr(tuple(r[named.index(c)] for c in columns)) for r in got.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "o_orderkey"
    assert set(driver.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
