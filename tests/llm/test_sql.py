"""The operators' queries against their DuckDB SQL."""

import duckdb
import pytest

from vtable.llm.queries import QUERIES, SQL

TABLES = ("documents", "pages", "benchmark", "labels")


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = duck.sql(SQL[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    a = sorted(str([plain(r[c]) for c in names]) for r in got.collect())
    order = [want.columns.index(c) for c in names]
    assert a == sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())
