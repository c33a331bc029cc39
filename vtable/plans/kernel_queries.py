"""Version resolution and access paths over the test tables. events is read as a change log: key user_id, version event_id, errors delete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import access, resolve
from ..sources.workspace import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a function under its name with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


KEY = ["user_id"]
_LOG = "(SELECT user_id, event_type, value, event_id _v, event_type = 'error' _d FROM events)"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("_v"), (F.col("event_type") == "error").alias("_d"))


def _snapshot(as_of: str = "") -> str:
    return f"SELECT user_id, event_type, value, _v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _v DESC) rn FROM {_LOG} {as_of}) WHERE rn = 1 AND NOT _d"


@query(_snapshot())
def snapshot_latest(spark, sf_dir):
    return resolve.latest(change_log(spark, sf_dir), KEY).drop("_d")


@query(_snapshot("WHERE _v <= 1000"))
def snapshot_as_of_1k(spark, sf_dir):
    return resolve.latest(change_log(spark, sf_dir), KEY, as_of=1000).drop("_d")


@query(_snapshot())
def latest_via_window(spark, sf_dir):
    return resolve.latest_by_window(change_log(spark, sf_dir), KEY).drop("_d")


_POINTS = [100, 500, 900]


@query(" UNION ALL ".join(f"SELECT {v} AS at, count(*) AS live FROM ({_snapshot(f'WHERE _v <= {v}')})" for v in _POINTS))
def snapshot_as_of_all(spark, sf_dir):
    log, out = change_log(spark, sf_dir), None
    for v in _POINTS:
        one = resolve.latest(log, KEY, as_of=v).agg(F.lit(v).alias("at"), F.count("*").alias("live"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT count(*) FILTER (WHERE _d) AS tombstones, count(*) FILTER (WHERE NOT _d) AS live FROM (SELECT max_by(_d, _v) _d FROM {_LOG} GROUP BY user_id)")
def tombstone_filter(spark, sf_dir):
    return resolve.newest(change_log(spark, sf_dir), KEY).agg(F.count_if("_d").alias("tombstones"), F.count_if(~F.col("_d")).alias("live"))


@query("SELECT user_id, max(event_id) AS version FROM events GROUP BY user_id")
def latest_version_per_key(spark, sf_dir):
    return resolve.latest_version(change_log(spark, sf_dir), KEY)


def _buffer(orders: DataFrame) -> DataFrame:
    """Rows of orders that a transaction has changed (every tenth) or deleted (every twentieth)."""
    some = orders.where("o_orderkey % 10 = 0")
    return some.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("_d", F.col("o_orderkey") % 20 == 0)


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 20 <> 0")
def txn_overlay_read(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return resolve.overlay(orders, _buffer(orders), ["o_orderkey"])


_GC = f"SELECT user_id, event_type, value, _v FROM (SELECT *, max(CASE WHEN _v <= 600 THEN _v END) OVER (PARTITION BY user_id) top FROM {_LOG}) WHERE _v > 600 OR (_v = top AND NOT _d)"


@query(_GC)
def compaction_gc(spark, sf_dir):
    return resolve.collect_garbage(change_log(spark, sf_dir), KEY, 600).drop("_d")


@query(_snapshot("WHERE _v <= 800"))
def gc_preserves_snapshots(spark, sf_dir):
    return resolve.latest(resolve.collect_garbage(change_log(spark, sf_dir), KEY, 600), KEY, as_of=800).drop("_d")


@query(
    f"""WITH a AS ({_snapshot("WHERE _v <= 400")}), b AS ({_snapshot("WHERE _v <= 900")})
SELECT user_id, CASE WHEN a._v IS NULL THEN 'insert' WHEN b._v IS NULL THEN 'delete' ELSE 'update' END AS change, a.value AS old_value, b.value AS new_value
FROM a FULL JOIN b USING (user_id) WHERE a._v IS DISTINCT FROM b._v"""
)
def snapshot_diff(spark, sf_dir):
    return resolve.diff(change_log(spark, sf_dir), KEY, 400, 900).select("user_id", "change", F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"))


@query(f"SELECT user_id, event_type, value, _v, _d FROM {_LOG} WHERE _v > 200 AND _v <= 700")
def change_feed_range(spark, sf_dir):
    return resolve.changes(change_log(spark, sf_dir), 200, 700)


@query("SELECT user_id, event_id AS _v FROM events WHERE event_id > 500 AND event_id <= 800 AND user_id IN (SELECT user_id FROM events WHERE event_id <= 10)")
def conflicting_keys(spark, sf_dir):
    log = change_log(spark, sf_dir)
    mine = log.where("_v <= 10")
    hit = resolve.conflicting_keys(mine, log.where("_v <= 800"), KEY, 500)
    return resolve.changes(log, 500, 800).join(hit, KEY, "left_semi").select("user_id", "_v")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


_COLUMNS = "o_orderkey, o_custkey, o_totalprice, o_orderpriority"
ORDER = ["o_orderkey"]


@query(f"SELECT {_COLUMNS} FROM orders WHERE o_orderkey = 77")
def point_get(spark, sf_dir):
    return access.point(_orders(spark, sf_dir), ORDER, 77)


@query(f"SELECT {_COLUMNS} FROM orders WHERE o_orderkey = -5")
def point_get_missing(spark, sf_dir):
    return access.point(_orders(spark, sf_dir), ORDER, -5)


@query(f"SELECT {_COLUMNS} FROM orders WHERE o_orderkey IN (3, 50, 999, 123456789)")
def multi_get(spark, sf_dir):
    return access.multi(_orders(spark, sf_dir), ORDER, [3, 50, 999, 123456789])


@query(f"SELECT {_COLUMNS} FROM orders WHERE o_orderkey % 7 = 0")
def multi_get_joined(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    return access.multi(orders, ORDER, orders.where("o_orderkey % 7 = 0").select("o_orderkey"))


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def full_scan_project(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")


@query(f"SELECT count(*) AS n FROM ({_snapshot()})")
def count_keys(spark, sf_dir):
    return resolve.latest(change_log(spark, sf_dir), KEY).agg(F.count("*").alias("n"))


def _range(name: str, sql: str, **bounds) -> None:
    QUERIES[name] = lambda spark, sf_dir: access.key_range(_orders(spark, sf_dir), "o_orderkey", **bounds)
    ORACLE[name] = f"SELECT {_COLUMNS} FROM orders WHERE {sql}"


_range("range_closed", "o_orderkey >= 100 AND o_orderkey <= 200", low=100, high=200)
_range("range_open", "o_orderkey > 100 AND o_orderkey < 200", low=100, high=200, low_open=True, high_open=True)
_range("range_half_open", "o_orderkey >= 100 AND o_orderkey < 200", low=100, high=200, high_open=True)
_range("range_lower_only", "o_orderkey >= 1000", low=1000)
_range("range_upper_only", "o_orderkey < 300", high=300, high_open=True)


@query(f"SELECT {_COLUMNS} FROM orders ORDER BY o_orderkey")
def pk_ordered_scan(spark, sf_dir):
    return _orders(spark, sf_dir).orderBy("o_orderkey")


@query(f"SELECT {_COLUMNS} FROM orders WHERE o_orderkey >= 321 ORDER BY o_orderkey LIMIT 100")
def seek_limit_100(spark, sf_dir):
    return access.seek(_orders(spark, sf_dir), ORDER, 321, 100)


@query("SELECT c_name, c_custkey FROM customer WHERE c_name LIKE 'Customer#00000001%' ORDER BY c_name LIMIT 20")
def prefix_scan(spark, sf_dir):
    return access.prefix(read(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", "Customer#00000001")


@query(f"SELECT {_COLUMNS} FROM orders WHERE o_custkey = 42")
def index_eq(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    index = access.index_entries(orders, ["o_custkey"], ORDER)
    return access.by_index(orders, ORDER, index, F.col("o_custkey") == 42)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_partkey = 10 AND l_suppkey < 50")
def index_prefix2(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = read(spark, sf_dir, "lineitem").select(*key, "l_quantity")
    index = access.index_entries(lines, ["l_partkey", "l_suppkey"], key)
    return access.by_index(lines, key, index, (F.col("l_partkey") == 10) & (F.col("l_suppkey") < 50))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 12)")
def index_lookup_then_fetch(spark, sf_dir):
    index = access.index_entries(_orders(spark, sf_dir), ["o_custkey"], ORDER).withColumnRenamed("o_orderkey", "l_orderkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return access.by_index(lines, ["l_orderkey"], index, F.col("o_custkey").between(10, 12))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey >= 20 ORDER BY o_custkey, o_orderkey")
def index_range_ordered(spark, sf_dir):
    index = access.index_entries(_orders(spark, sf_dir), ["o_custkey"], ORDER)
    return access.key_range(index, "o_custkey", 20).orderBy("o_custkey", "o_orderkey")


@query(
    f"SELECT {_COLUMNS} FROM orders WHERE o_orderpriority LIKE '%URGENT' AND o_totalprice IS NOT NULL AND (o_custkey IN (1, 2, 3, 5, 8) OR abs(o_totalprice - 50000) < 2000)"
)
def residual_like_in_null_or(spark, sf_dir):
    return _orders(spark, sf_dir).where(F.col("o_orderpriority").like("%URGENT") & F.col("o_totalprice").isNotNull() & (F.col("o_custkey").isin(1, 2, 3, 5, 8) | (F.abs(F.col("o_totalprice") - 50000) < 2000)))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return resolve.duplicate_values(_orders(spark, sf_dir), ["o_custkey"])


@query(
    f"""WITH s AS (SELECT e.user_id, e.event_id, max(l._v) v FROM (SELECT * FROM events WHERE event_type = 'purchase') e
  JOIN {_LOG} l ON l.user_id = e.user_id AND l._v < e.event_id AND l.event_type = 'view' GROUP BY ALL)
SELECT user_id, event_id, v AS seen FROM s"""
)
def join_temporal(spark, sf_dir):
    log = change_log(spark, sf_dir)
    bought = log.where("event_type = 'purchase'").select("user_id", F.col("_v").alias("event_id"))
    views = log.where("event_type = 'view'").select("user_id", "_v")
    return as_of_join(bought, views, ["user_id"], "event_id", "_v", strict=True).select("user_id", "event_id", F.col("_v").alias("seen")).where("seen IS NOT NULL")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, strict: bool = False, width: float | None = None) -> DataFrame:
    """left with the newest row of right at or before (strict: before) its time, nulls where there is none.

    Union and a running last value: one shuffle on the keys, no pairs are made. With width (in the unit of the time, seconds for timestamps)
    a key's rows are dealt out by stretches of time, so a hot key is many tasks' work: the last row of right of each key and stretch, a
    map-side combined aggregate, is carried on over the stretches, of which a key has few, and stands before each stretch's own rows.
    """
    rest = [c for c in right.columns if c not in by]
    none = [F.lit(None).cast(right.schema[c].dataType).alias(f"r_{c}") for c in rest]
    a = left.select(*by, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_l"), *none)
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), *[F.col(c).alias(f"r_{c}") for c in rest])
    rows, keys = a.unionByName(b), list(by)
    mine = F.struct(*[F.col(f"r_{c}").alias(c) for c in rest])
    own = F.when(F.col("_l").isNull(), mine)
    if width is not None:
        instant = F.col("_t").cast("timestamp") if dict(rows.dtypes)["_t"].startswith("timestamp") else F.col("_t")
        rows, keys = rows.withColumn("_stretch", F.floor(instant.cast("double") / width)), [*by, "_stretch"]
        ends = rows.groupBy(*keys).agg(F.max_by(own, F.when(F.col("_l").isNull(), F.col("_t"))).alias("_end"))
        earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
        rows = rows.join(carried, keys)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(own, ignorenulls=True).over(w)
    if width is not None:
        found = F.coalesce(found, F.col("_carried"))
    return rows.withColumn("_r", found).where("_l IS NOT NULL").select("_l.*", "_r.*")


@query(
    """SELECT a.event_id, a.user_id, b.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) event_id FROM events WHERE event_type = 'error' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts"""
)
def join_asof(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    errors = events.where("event_type = 'error'").groupBy("user_id", F.col("ts").alias("error_ts")).agg(F.max("event_id").alias("error_id"))
    return as_of_join(bought, errors, ["user_id"], "ts", "error_ts").select("event_id", "user_id", "error_id")


@query(ORACLE["join_asof"])
def join_asof_hot(spark, sf_dir):
    """The same with each user's rows dealt out by days."""
    events = read(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    errors = events.where("event_type = 'error'").groupBy("user_id", F.col("ts").alias("error_ts")).agg(F.max("event_id").alias("error_id"))
    return as_of_join(bought, errors, ["user_id"], "ts", "error_ts", width=86_400.0).select("event_id", "user_id", "error_id")
