"""The SQL surface over snapshots: joins, aggregates, windows, sets, subqueries and functions.

Where Spark SQL and DuckDB spell a query alike, one text serves both; where they don't, each has its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect
from ..sources.workspace import TABLES, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for name in TABLES:
        if name in text:
            read(spark, sf_dir, name).createOrReplaceTempView(name)


def sql(name: str, text: str, spark: str | None = None) -> None:
    """text for DuckDB, and for Spark unless that has its own."""

    def run(session: SparkSession, sf_dir: str, q: str = spark or text) -> DataFrame:
        _views(session, sf_dir, q)
        return session.sql(q)

    QUERIES[name], ORACLE[name] = run, text


def query(text: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


# joins ----------------------------------------------------------------------------------------------------------------------------

sql("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
sql("join_index_nested_loop", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey BETWEEN 5 AND 9")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
sql("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON s_suppkey = c_custkey")
sql("join_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)")
sql("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql("join_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
sql("join_cross_small", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
sql(
    "join_star4",
    """SELECT r_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment""",
)
sql("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
# Spark's text selects what it sorts by and names the place of nulls: with a projection between LIMIT and ORDER BY, Spark numbers a customer's orders in no order.
sql(
    "lateral_topn",
    "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
    "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 2) t",
)


@query("SELECT c_custkey, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY c_custkey")
def lateral_left(spark, sf_dir):
    """A correlated subquery as a lateral join of the DataFrame interface."""
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    own = orders.where((F.col("o_custkey") == F.col("c_custkey").outer()) & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_totalprice")
    return customer.lateralJoin(own, how="left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def band_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at <= high: intervals are spread over buckets of width, so the join is an equi-join with a residual predicate."""
    buckets = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    joined = left.withColumn("_b", F.floor(F.col(at) / width)).join(buckets, "_b")
    return joined.where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_b")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 5 AND s_acctbal + 5")
def join_band(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 5).alias("low"), (F.col("s_acctbal") + 5).alias("high"))
    return band_join(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), supplier, "p_retailprice", "low", "high", 10.0).select("p_partkey", "s_suppkey")


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int) -> DataFrame:
    """An inner join for hot keys of big: its rows of a key go to salts tasks, and small's rows to each of those. It always shuffles: Spark would
    judge small by its size before it is repeated, and hold salts times that whole in each executor."""
    spread = big.withColumn("_s", F.pmod(F.xxhash64(*[c for c in big.columns if c != on]), F.lit(salts)))
    repeated = small.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(repeated.hint("shuffle_hash"), [on, "_s"]).drop("_s")


@query("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def join_salted(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber")
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    return salted_join(lines, parts, "k", 4).groupBy("p_brand").agg(F.count("*").alias("n"))


# aggregates -----------------------------------------------------------------------------------------------------------------------

sql(
    "agg_basic",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_discount), 6) AS discount, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY l_returnflag")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 250000) AS big, count(*) AS n FROM orders GROUP BY o_orderpriority")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus)::BIGINT AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(grouping(l_linestatus) AS bigint) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql(
    "agg_string",
    "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
sql("agg_stats", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS v, round(corr(c_acctbal, c_custkey), 6) AS r FROM customer GROUP BY c_mktsegment")
sql("agg_maxby", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS best, min_by(o_orderkey, o_totalprice) AS worst FROM orders GROUP BY o_custkey")
sql("agg_percentile", "SELECT l_shipmode, round(quantile_cont(q, 0.5), 4) AS median FROM (SELECT l_returnflag AS l_shipmode, l_quantity AS q FROM lineitem) GROUP BY l_shipmode", "SELECT l_shipmode, round(percentile(q, 0.5), 4) AS median FROM (SELECT l_returnflag AS l_shipmode, l_quantity AS q FROM lineitem) GROUP BY l_shipmode")
sql("agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near, true AS sketched, true AS middle FROM lineitem GROUP BY l_returnflag")
def agg_approx(spark, sf_dir):
    """By group: the exact count, and whether the approximate ones and the median are as near as their parameters promise. Sketches take no
    account of repeats, so they see each distinct value once: beside a count of distinct values Spark would keep a sketch for each of those."""
    lines = read(spark, sf_dir, "lineitem")
    values = lines.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag")
    counts = values.agg(F.count("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("b"))
    medians = lines.groupBy(F.col("l_returnflag").alias("f")).agg(F.percentile_approx("l_quantity", 0.5, 10_000).alias("m"), F.percentile("l_quantity", 0.5).alias("e"))
    found = counts.join(medians, F.col("l_returnflag").eqNullSafe(F.col("f")))
    return found.select("l_returnflag", "parts", (F.abs(F.col("a") - F.col("parts")) <= 0.08 * F.col("parts")).alias("near"), (F.abs(F.col("b") - F.col("parts")) <= 0.08 * F.col("parts")).alias("sketched"), (F.col("m").eqNullSafe(F.col("e")) | (F.abs(F.col("m") - F.col("e")) <= 1)).alias("middle"))


# windows, order, sets -------------------------------------------------------------------------------------------------------------

sql("win_rank", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderstatus)")
sql("win_distribution", "SELECT s_suppkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)")
sql("win_lag_lead", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS later, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
sql("win_nth", "SELECT event_id, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events")
sql("win_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS s FROM events")
sql("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n FROM orders")
sql("win_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)::BIGINT AS q FROM customer", "SELECT c_custkey, cast(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS bigint) AS q FROM customer")
sql("win_topn_per_group", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) rn FROM lineitem) WHERE rn <= 3")
sql("sort_nulls", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS b FROM customer ORDER BY b DESC NULLS LAST, c_custkey")
sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
sql("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
sql("distinct_vals", "SELECT DISTINCT p_brand, p_type FROM part")
sql("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
sql("intersect_all", "SELECT l_linenumber AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
sql("except_distinct", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
sql("except_all", "SELECT l_linenumber AS k FROM lineitem EXCEPT ALL SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'A'")

# subqueries -----------------------------------------------------------------------------------------------------------------------

sql("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
sql("subq_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("subq_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)")
sql("subq_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1)")
sql("cte", "WITH t AS (SELECT o_custkey, sum(o_totalprice) s FROM orders GROUP BY o_custkey), m AS (SELECT max(s) m FROM t) SELECT o_custkey FROM t, m WHERE s > m * 0.8")
sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, (n + 1) * f FROM t WHERE n < 10) SELECT n, f FROM t")
sql("values_rows", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.0")
def prepared_parameters(spark, sf_dir):
    _views(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :who AND o_totalprice > :least", args={"who": 7, "least": 1000.0})


# functions ------------------------------------------------------------------------------------------------------------------------

sql(
    "fn_string",
    """SELECT p_partkey, length(p_name)::BIGINT AS len, lower(p_brand) AS lo, upper(p_name) AS up, trim(concat(' ', p_name, ' ')) AS tr, substr(p_name, 2, 3) AS su, replace(p_name, 'e', 'E') AS re,
instr(p_name, 'r')::BIGINT AS ins, p_name || '-' || p_brand AS cc, p_name LIKE '%red%' AS li, reverse(p_brand) AS rv, lpad(p_brand, 12, '*') AS lp, split_part(p_name, ' ', 2) AS sp FROM part""",
    """SELECT p_partkey, cast(length(p_name) AS bigint) AS len, lower(p_brand) AS lo, upper(p_name) AS up, trim(concat(' ', p_name, ' ')) AS tr, substr(p_name, 2, 3) AS su, replace(p_name, 'e', 'E') AS re,
cast(instr(p_name, 'r') AS bigint) AS ins, p_name || '-' || p_brand AS cc, p_name LIKE '%red%' AS li, reverse(p_brand) AS rv, lpad(p_brand, 12, '*') AS lp, split_part(p_name, ' ', 2) AS sp FROM part""",
)
sql(
    "fn_date",
    """SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d, date_trunc('month', o_orderdate)::TIMESTAMP AS mo,
date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS df, (o_orderdate::DATE + 10)::DATE AS pl, strftime(o_orderdate, '%Y/%m/%d') AS fm FROM orders""",
    """SELECT o_orderkey, cast(year(o_orderdate) AS bigint) AS y, cast(month(o_orderdate) AS bigint) AS m, cast(day(o_orderdate) AS bigint) AS d, cast(date_trunc('month', o_orderdate) AS timestamp_ntz) AS mo,
cast(datediff(cast(o_orderdate AS date), DATE '1995-01-01') AS bigint) AS df, date_add(cast(o_orderdate AS date), 10) AS pl, date_format(o_orderdate, 'yyyy/MM/dd') AS fm FROM orders""",
)
sql("fn_math", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, round(sqrt(abs(c_acctbal)), 6) AS q, round(power(c_nationkey, 2), 2) AS p, c_custkey % 7 AS m, sign(c_acctbal)::BIGINT AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, round(exp(c_nationkey / 10.0), 4) AS e FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(sqrt(abs(c_acctbal)), 6) AS q, round(power(c_nationkey, 2), 2) AS p, c_custkey % 7 AS m, cast(sign(c_acctbal) AS bigint) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, round(exp(c_nationkey / 10.0D), 4) AS e FROM customer")
sql("fn_cond", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS k, coalesce(nullif(c_mktsegment, 'BUILDING'), '?') AS n, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l FROM customer")
sql("fn_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events", "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k FROM events")
sql(
    "fn_json_struct",
    """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{"u":' || user_id || ',"t":"' || event_type || '"}' AS packed FROM events""",
    "SELECT event_id, from_json(props, 'k BIGINT').k AS k, to_json(named_struct('u', user_id, 't', event_type)) AS packed FROM events",
)
sql(
    "fn_map",
    "SELECT o_custkey, count(DISTINCT o_orderpriority)::BIGINT AS kinds, max(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey END) AS urgent, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderkey % 2 = 0)::BIGINT AS even FROM orders GROUP BY o_custkey",
    """SELECT o_custkey, cast(cardinality(m) AS bigint) AS kinds, element_at(m, array_max(filter(map_keys(m), k -> k LIKE '1%'))) AS urgent,
cast(cardinality(map_filter(e, (k, v) -> v > 0)) AS bigint) AS even
FROM (SELECT o_custkey, map_from_entries(collect_list(struct(p, top))) AS m, map_from_arrays(collect_list(p), collect_list(even)) AS e
  FROM (SELECT o_custkey, o_orderpriority AS p, max(o_orderkey) AS top, count_if(o_orderkey % 2 = 0) AS even FROM orders GROUP BY o_custkey, o_orderpriority) GROUP BY o_custkey)""",
)
sql(
    "fn_array",
    "SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm, round(list_max(embedding), 5)::DOUBLE AS top FROM embeddings",
    "SELECT vec_id, cast(size(embedding) AS bigint) AS n, round(aggregate(embedding, 0D, (a, x) -> a + cast(x AS double) * cast(x AS double)), 4) AS norm, cast(round(array_max(embedding), 5) AS double) AS top FROM embeddings",
)
sql("fn_binary_hex", "SELECT c_custkey, hex(c_name) AS h, md5(c_name) AS m, sha256(c_name) AS s, unhex(hex(c_name))::BLOB = c_name::BLOB AS back FROM customer", "SELECT c_custkey, hex(c_name) AS h, md5(c_name) AS m, sha2(c_name, 256) AS s, unhex(hex(c_name)) = cast(c_name AS binary) AS back FROM customer")
sql("fn_cast", "SELECT o_orderkey, o_totalprice::VARCHAR IS NOT NULL AS v, TRY_CAST(o_orderpriority AS BIGINT) AS n, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS d, trunc(o_totalprice)::BIGINT AS t FROM orders", "SELECT o_orderkey, cast(o_totalprice AS string) IS NOT NULL AS v, try_cast(o_orderpriority AS bigint) AS n, try_cast(substr(o_orderpriority, 1, 1) AS bigint) AS d, cast(o_totalprice AS bigint) AS t FROM orders")


@query("SELECT p_partkey, p_name GLOB '*r[aeiou]*' AS g, lower(p_name) LIKE lower('%RED%') AS l, p_size // 4 AS q, coalesce(nullif(p_size, 7), -1) AS i, instr(p_name, 't')::BIGINT AS t FROM part")
def fn_dialect(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", dialect.glob(F.col("p_name"), "*r[aeiou]*").alias("g"), dialect.like_nocase(F.col("p_name"), "%RED%").alias("l"), dialect.truncating_divide(F.col("p_size"), F.lit(4)).alias("q"), dialect.ifnull(F.nullif("p_size", F.lit(7)), F.lit(-1)).alias("i"), dialect.instr(F.col("p_name"), F.lit("t")).alias("t"))


@query("SELECT c_mktsegment, coalesce(sum(CASE WHEN c_acctbal < -5000 THEN c_acctbal END), 0.0) AS t FROM customer GROUP BY c_mktsegment")
def fn_total(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    return customer.groupBy("c_mktsegment").agg(dialect.total(F.when(F.col("c_acctbal") < -5000, F.col("c_acctbal"))).alias("t"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(hex(c_name), '(..)', '\\1 ', 'g'), '00 ', '00FF ', 'g') || '00' AS escaped FROM customer")
def fn_key_escape(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", dialect.escape_key(F.col("c_name")))


# functions of the user ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, round(o_totalprice * 1.25 + 3, 4) AS taxed FROM orders")
def udf_scalar(spark, sf_dir):
    @F.pandas_udf("double")
    def taxed(x: pd.Series) -> pd.Series:
        return x * 1.25 + 3

    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(taxed("o_totalprice"), 4).alias("taxed"))


@query("SELECT o_orderstatus, round(sum(o_totalprice * o_totalprice) / sum(o_totalprice), 2) AS weighted FROM orders GROUP BY o_orderstatus")
def pandas_udaf(spark, sf_dir):
    """A user's aggregate in two steps: sums where the rows are, so no group is gathered in one task."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sq=b.p * b.p).groupby("o_orderstatus", as_index=False)[["sq", "p"]].sum()

    rows = read(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").alias("p"))
    parts = rows.mapInPandas(part, "o_orderstatus string, sq double, p double")
    return parts.groupBy("o_orderstatus").agg(F.round(F.sum("sq") / F.sum("p"), 2).alias("weighted"))


@query("SELECT o_custkey, round(sum(o_totalprice * o_totalprice) / sum(o_totalprice), 2) AS weighted FROM orders GROUP BY o_custkey")
def pandas_grouped_agg(spark, sf_dir):
    """A user's aggregate that sees a group whole: for groups that are known to be small, as a customer's orders are."""

    @F.pandas_udf("double")
    def weighted(p: pd.Series) -> float:
        return float((p * p).sum() / p.sum())

    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(weighted("o_totalprice"), 2).alias("weighted"))


@query("SELECT p_partkey, generate_subscripts(w, 1)::INTEGER AS position, unnest(w) AS word FROM (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS w FROM part)")
def udtf_words(spark, sf_dir):
    """A user's table function, joined laterally."""
    _views(spark, sf_dir, "part")
    dialect.register(spark)
    return spark.sql("SELECT p_partkey, position, word FROM part, LATERAL words(p_name)")
