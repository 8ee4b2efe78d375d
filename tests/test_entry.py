"""Every query against its SQL on the smallest tables, and what the entry module offers."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = sorted(__spark_entry__.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), duck.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted(map(str, df[columns].astype(object).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(NAMES) <= set(__spark_entry__.queries())
