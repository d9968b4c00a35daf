import duckdb
import pytest

from bomlens.llm import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    return repr(round(value, 9) if isinstance(value, float) else value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        duck.sql(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    df, found = registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())
