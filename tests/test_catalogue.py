"""Every query against DuckDB on the smallest tables; the others run and keep their columns."""

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        at = sorted(columns)
        key = lambda r: tuple(map(repr, r))
        got = sorted((tuple(plain(r[c]) for c in at) for r in rows), key=key)
        assert got == sorted((tuple(plain(r[columns.index(c)]) for c in at) for r in want.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reuse_cap_holds(spark):
    used: dict[str, int] = {}
    for r in QUERIES["reuse_capped_units"](spark, SF).collect():
        for m in r.members.split(","):
            used[m] = used.get(m, 0) + 1
    assert max(used.values()) <= 2
