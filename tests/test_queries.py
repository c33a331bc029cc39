"""Every registered query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from vtable.plans.registry import ORACLE, QUERIES, flagship
from vtable.sources.workspace import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([plain(r[i]) for i in order]) for r in values)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_flagship(spark, sf_dir):
    assert flagship(spark, sf_dir).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown(spark, sf_dir):
    """Key filters reach the scan below version resolution, value filters stay above, columns are pruned."""
    from pyspark.sql import functions as F

    from vtable.operators import resolve
    from vtable.plans.kernel_queries import change_log

    snapshot = resolve.latest(change_log(spark, sf_dir), ["user_id"])
    assert "EqualTo(user_id,7)" in plan(snapshot.where(F.col("user_id") == 7))
    assert "GreaterThan(value" not in plan(snapshot.where(F.col("value") > 7))
    assert "props" not in plan(snapshot)
    assert "TakeOrderedAndProject" in plan(QUERIES["seek_limit_100"](spark, sf_dir))
    assert "WindowGroupLimit" in plan(QUERIES["latest_via_window"](spark, sf_dir))
    assert "CartesianProduct" not in plan(QUERIES["join_band"](spark, sf_dir)) and "NestedLoop" not in plan(QUERIES["join_band"](spark, sf_dir))
