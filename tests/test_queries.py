"""Every registered query that has SQL agrees with it; the others run and keep their schema."""

import math

import duckdb
import pytest

from talkloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, bool) or v is None:
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def compare(spark, data, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = query(spark, data)
    columns = sorted(got.columns)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == expected


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, data, name):
    compare(spark, data, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name):
    rows = registry.QUERIES[name](spark, data)
    assert rows.columns and rows.limit(5).count() >= 0
