"""What keeps relational queries bounded on large tables, and like their SQL on odd ones."""

import re

import duckdb

from vtable.plans.registry import ORACLE, QUERIES

from .test_queries import plan, rows


def like_its_sql(spark, folder, name, **tables):
    """The query's rows over tables, each (schema, rows), which are those of its SQL."""
    c = duckdb.connect()
    for t, (schema, values) in tables.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)), c.sql(ORACLE[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_no_sketch_for_each_distinct_value(spark, sf_dir):
    by_part = [line for line in plan(QUERIES["agg_approx"](spark, sf_dir)).splitlines() if re.search(r"Aggregate\(keys=\[[^\]]*l_partkey", line)]
    assert by_part and all("functions=[]" in line for line in by_part)


def test_approximate_aggregates_of_nulls(spark, tmp_path):
    lines = [(f, p, q) for f in ("A", "R", None) for p, q in ((1, 2.0), (1, 3.0), (2, None), (None, 50.0))] + [("N", None, None)] * 2
    like_its_sql(spark, tmp_path, "agg_approx", lineitem=("l_returnflag string, l_partkey bigint, l_quantity double", lines))


def test_lateral_limit_is_ordered(spark, sf_dir):
    """A customer's orders are numbered in the order of the subquery, and cut to the first ones before they are shuffled."""
    p = plan(QUERIES["lateral_topn"](spark, sf_dir))
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(o_custkey#\d+L, o_totalprice#\d+ DESC NULLS LAST, o_orderkey#\d+L ASC NULLS LAST", p)
    assert re.search(r"WindowGroupLimit .*row_number\(\), 2, Partial", p)


def test_lateral_limit_of_nulls_and_ties(spark, tmp_path):
    orders = [(k, c, t) for c in (1, 2, None) for k, t in ((None, 9.0), (7, 9.0), (5, 9.0), (6, None), (4, float("nan")), (4, float("nan")))]
    orders += [(1, 3, None), (None, 3, None), (2, 3, -0.0), (8, 4, 0.0), (9, 4, -0.0), (3, 4, 0.0)]
    like_its_sql(spark, tmp_path, "lateral_topn", customer=("c_custkey bigint", [(c,) for c in (1, 2, 2, 3, 4, 5, None)]), orders=("o_orderkey bigint, o_custkey bigint, o_totalprice double", orders + [(k, 6, None) for k in (1, 2, 3)]))


def test_salted_join_broadcasts_nothing(spark, sf_dir):
    p = plan(QUERIES["join_salted"](spark, sf_dir))
    assert "ShuffledHashJoin" in p and "Broadcast" not in p


def test_salted_join_of_hot_and_null_keys(spark, tmp_path):
    lines = [(i, 1, 1) for i in range(200)] + [(i, 2, 1) for i in range(3)] + [(1, None, 1), (None, 2, None), (5, 9, 1)]
    parts = [(1, "a"), (1, "b"), (2, None), (3, "c"), (None, "d")]
    like_its_sql(spark, tmp_path, "join_salted", lineitem=("l_orderkey bigint, l_partkey bigint, l_linenumber int", lines), part=("p_partkey bigint, p_brand string", parts))
