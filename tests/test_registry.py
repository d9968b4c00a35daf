import duckdb
import pytest

from bomlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    return connection


def plain(value):
    if hasattr(value, "asDict"):
        value = list(value)
    return repr(round(value, 9) if isinstance(value, float) else [plain(v) for v in value] if isinstance(value, list | tuple) else value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        found = duck.sql(sql)
        at = [found.columns.index(c) for c in columns]
        assert sorted(found.columns) == columns
        assert got == sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())
