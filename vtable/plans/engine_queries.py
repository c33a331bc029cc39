"""What tables hold after writes, read back from storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect
from ..kv import KV
from ..operators import resolve
from ..sources import files
from ..sources.options import Options
from ..sources.schema import TableSchema
from ..sources.workspace import new_folder, read
from ..table import ConflictError, Table
from .sql import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]


def _orders(spark: SparkSession, sf_dir: str, indexes=(), **options) -> Table:
    rows = read(spark, sf_dir, "orders").select(*COLUMNS)
    table = Table.create(spark, new_folder(spark), TableSchema.of("orders", rows.schema, ["o_orderkey"], tuple(indexes)), options=Options(sync="OFF", **options))
    table.insert(rows)
    return table


_ALL = ", ".join(COLUMNS)


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders UNION ALL SELECT -o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey > 0")
def bulk_upsert_result(spark, sf_dir):
    t = _orders(spark, sf_dir)
    rows = read(spark, sf_dir, "orders").select(*COLUMNS)
    t.upsert(rows.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(rows.where("o_orderkey % 5 = 0 AND o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey"))))
    return t.read()


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 50 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders")
def update_where_result(spark, sf_dir):
    t = _orders(spark, sf_dir)
    t.update("o_custkey < 50", {"o_totalprice": F.round(F.col("o_totalprice") * 2, 2)})
    return t.read()


@query(f"SELECT {_ALL} FROM orders WHERE NOT o_orderpriority = '1-URGENT'")
def delete_where_result(spark, sf_dir):
    t = _orders(spark, sf_dir)
    t.delete("o_orderpriority = '1-URGENT'")
    return t.read()


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def pk_change_update(spark, sf_dir):
    t = _orders(spark, sf_dir)
    t.update("o_orderkey % 4 = 0", {"o_orderkey": -F.col("o_orderkey") - 1})
    return t.read()


@query(f"SELECT {_ALL} FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey >= 0")
def time_travel_after_writes(spark, sf_dir):
    t = _orders(spark, sf_dir)
    kept = t.delete("o_orderkey % 2 = 0")
    t.update("true", {"o_totalprice": F.lit(0.0)})
    return t.read(kept)


@query("SELECT 'orders' AS kind, 0 AS missing, 0 AS extra")
def index_base_antijoin_empty(spark, sf_dir):
    t = _orders(spark, sf_dir, [(("o_custkey",), False)])
    t.update("o_custkey % 2 = 0", {"o_custkey": F.col("o_custkey") + 1})
    t.delete("o_custkey % 5 = 0")
    found = {r.check.rsplit("_", 1)[-1]: r.problems for r in t.check().collect() if "idx" in r.check}
    return spark.createDataFrame([("orders", found["missing"], found["extra"])], "kind string, missing int, extra int")


@query(f"SELECT {_ALL} FROM (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_totalprice, o_orderpriority FROM orders) WHERE o_custkey = 43")
def index_lookup_stored(spark, sf_dir):
    t = _orders(spark, sf_dir, [(("o_custkey",), False)])
    t.update("o_custkey % 2 = 0", {"o_custkey": F.col("o_custkey") + 1})
    return t.lookup(t.schema.indexes[0].name, 43)


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders")
def savepoint_rollback_state(spark, sf_dir):
    t = _orders(spark, sf_dir)
    x = t.begin()
    x.update("o_orderkey % 10 = 0", {"o_totalprice": F.lit(1.0)})
    x.savepoint("a")
    x.delete("o_orderkey % 2 = 0")
    x.rollback_to("a")
    x.commit()
    return t.read()


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 1 THEN 5.0 ELSE o_totalprice END AS o_totalprice, o_orderpriority, 1 AS conflicts FROM orders")
def first_committer_wins(spark, sf_dir):
    t = _orders(spark, sf_dir)
    a, b = t.begin(), t.begin()
    a.update("o_orderkey = 1", {"o_totalprice": F.lit(5.0)})
    b.update("o_orderkey <= 3", {"o_totalprice": F.lit(6.0)})
    a.commit()
    lost = 0
    try:
        b.commit()
    except ConflictError:
        lost = 1
    return t.read().withColumn("conflicts", F.lit(lost))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 6 = 0 THEN 'seen' END AS note FROM orders")
def schema_evolution_null_fill(spark, sf_dir):
    t = _orders(spark, sf_dir)
    t.add_column("note", "TEXT")
    t.update("o_orderkey % 6 = 0", {"note": F.lit("seen")})
    return t.read()


@query("SELECT 'files' AS check, 0 AS problems UNION ALL SELECT 'row_counts', 0 UNION ALL SELECT 'key_versions', 0")
def integrity_summary(spark, sf_dir):
    return _orders(spark, sf_dir).check()


@query("SELECT 'idx_orders_o_custkey' AS kind, 0 AS level, count(*) AS rows FROM orders UNION ALL SELECT 'rows', 0, count(*) FROM orders")
def table_stats(spark, sf_dir):
    return _orders(spark, sf_dir, [(("o_custkey",), False)]).stats().select("kind", "level", "rows")


@query("SELECT 0 AS level, count(*)::BIGINT AS rows FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, count(*) FROM orders")
def udtf_table_files(spark, sf_dir):
    """The files of a table by a table function: rows of a compacted level, and of one commit above it."""
    t = _orders(spark, sf_dir)
    t.compact(everything=True)
    t.update("o_orderkey % 2 = 0", {"o_totalprice": F.lit(0.0)})
    dialect.register(spark)
    return spark.sql(f"SELECT level, sum(rows) AS rows FROM table_files('{t.path}') GROUP BY level")


@query(f"SELECT o_orderkey, o_custkey, o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 9 <> 0")
def compacted_read(spark, sf_dir):
    t = _orders(spark, sf_dir)
    t.update("o_orderkey % 2 = 0", {"o_totalprice": F.col("o_totalprice") + 1})
    t.delete("o_orderkey % 9 = 0")
    t.compact(everything=True)
    return t.read()


@query(f"SELECT {_ALL} FROM orders")
def backup_restore(spark, sf_dir):
    t, path = _orders(spark, sf_dir), new_folder(spark)
    t.backup(path)
    t.delete("true")
    return Table.open(spark, path).read()


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events")
def wal_replay(spark, sf_dir):
    """A log that is opened anew: every committed change row is there once."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    path = new_folder(spark)
    t = Table.create(spark, path, TableSchema.of("events", events.schema, ["event_id"]), options=Options(sync="OFF"))
    for k in range(3):
        t.insert(events.where(f"event_id % 3 = {k}"))
    return Table(spark, path).changes().agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT p_name AS k, p_brand AS v FROM part WHERE p_name >= 'c' AND p_name < 'd' AND p_partkey = (SELECT max(p_partkey) FROM part q WHERE q.p_name = part.p_name)")
def kv_range(spark, sf_dir):
    kv = KV(spark, new_folder(spark), Options(sync="OFF"))
    part = read(spark, sf_dir, "part").groupBy("p_name").agg(F.max_by("p_brand", "p_partkey").alias("p_brand"))
    kv.put_frame(part.select(F.col("p_name").cast("binary").alias("key"), F.col("p_brand").cast("binary").alias("value")))
    return kv.table.range(b"c", b"d", high_open=True).select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0 GROUP BY n_name")
def sql_session(spark, sf_dir):
    s = Session(spark)
    s.sql(f"CREATE VIRTUAL TABLE cust USING vtable('{new_folder(spark)}', 'off', 'c_custkey INT PRIMARY KEY, c_nationkey INT, c_acctbal REAL', '')")
    s.table("cust").insert(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
    s.sql("BEGIN")
    s.sql("DELETE FROM cust WHERE c_custkey % 3 = 0")
    s.sql("COMMIT")
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return s.sql("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM cust JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def replayed_change_log(spark, sf_dir):
    """events committed in four pieces, in order, as upserts and deletes."""
    events = read(spark, sf_dir, "events")
    log = events.select("user_id", "event_type", "value", "event_id", (F.col("event_type") == "error").alias("_d"))
    struct = log.select("user_id", "event_type", "value")
    t = Table.create(spark, new_folder(spark), TableSchema.of("events", struct.schema, ["user_id"]), options=Options(sync="OFF"))
    top = events.agg(F.max("event_id")).first()[0]
    for k in range(4):
        piece = log.where(F.col("event_id").between(k * top // 4 + (k > 0), (k + 1) * top // 4))
        t.write(resolve.newest(piece, ["user_id"], "event_id").drop("event_id"))
    return t.read()


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 = {i}" for i, k in enumerate(("csv", "tsv", "json", "orc", "parquet"))))
def file_formats(spark, sf_dir):
    """Each fifth of a table written in a format and read back."""
    customer, folder, out = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), new_folder(spark), None
    for i, kind in enumerate(("csv", "tsv", "json", "orc", "parquet")):
        files.save(customer.where(f"c_custkey % 5 = {i}"), f"{folder}/x.{kind}")
        one = files.load(spark, f"{folder}/x.{kind}", customer.schema).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 1")
def change_feed_stored(spark, sf_dir):
    """The rows of one commit out of three, by the change feed's data source."""
    from ..streaming.source import register

    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    t = Table.create(spark, new_folder(spark), TableSchema.of("orders", rows.schema, ["o_orderkey"]), options=Options(sync="OFF"))
    at = [t.insert(rows.where(f"o_orderkey % 3 = {k}")) for k in range(3)]
    register(spark)
    return spark.read.format("vtable_changes").option("after", at[0]).option("until", at[1]).load(t.path).drop("_v", "_d")


# access paths over a stored table: a compacted level below two commits ---------------------------------------------------------------

_LAYERED = f"(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 50 <> 7)"


def _layered(spark: SparkSession, sf_dir: str, indexes=()) -> Table:
    t = _orders(spark, sf_dir, indexes)
    t.compact(everything=True)
    t.update("o_orderkey % 10 = 0", {"o_totalprice": F.col("o_totalprice") + 1})
    t.delete("o_orderkey % 50 = 7")
    return t


def stored(name: str, sql: str, indexes=()):
    """Registers a read of the layered table."""

    def add(f):
        QUERIES[name], ORACLE[name] = (lambda spark, sf_dir: f(_layered(spark, sf_dir, indexes))), sql.replace("{t}", _LAYERED)
        return f

    return add


_BY_CUSTOMER = [(("o_custkey", "o_orderpriority"), False)]


@stored("stored_get", f"SELECT {_ALL} FROM {{t}} WHERE o_orderkey = 70")
def _(t):
    return t.frame([t.get(70)] if t.get(70) and t.get(57) is None else [])


stored("stored_where_key", f"SELECT {_ALL} FROM {{t}} WHERE o_orderkey = 80")(lambda t: t.where(o_orderkey=80))
stored("stored_range", f"SELECT {_ALL} FROM {{t}} WHERE o_orderkey >= 100 AND o_orderkey < 9000")(lambda t: t.range(100, 9000, high_open=True))
stored("stored_seek_100", f"SELECT {_ALL} FROM {{t}} WHERE o_orderkey >= 321 ORDER BY o_orderkey LIMIT 100")(lambda t: t.seek(321, 100))
stored("stored_multi_get", f"SELECT {_ALL} FROM {{t}} WHERE o_orderkey IN (3, 50, 57, 999, 123456789)")(lambda t: t.multi_get([3, 50, 57, 999, 123456789]))
stored("stored_multi_get_joined", f"SELECT {_ALL} FROM {{t}} WHERE o_orderkey % 3 = 0")(lambda t: t.multi_get(t.read().where("o_orderkey % 3 = 0").select("o_orderkey")))
stored("stored_full_scan", f"SELECT {_ALL} FROM {{t}}")(lambda t: t.read())
stored("stored_lookup", f"SELECT {_ALL} FROM {{t}} WHERE o_custkey = 42", _BY_CUSTOMER)(lambda t: t.lookup(t.schema.indexes[0].name, 42))
stored("stored_lookup_prefix2", f"SELECT {_ALL} FROM {{t}} WHERE o_custkey = 42 AND o_orderpriority = '5-LOW'", _BY_CUSTOMER)(lambda t: t.where(o_custkey=42, o_orderpriority="5-LOW"))
stored("stored_lookup_range", f"SELECT {_ALL} FROM {{t}} WHERE o_custkey BETWEEN 10 AND 400", _BY_CUSTOMER)(lambda t: t.lookup_range(t.schema.indexes[0].name, 10, 400))
@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9800")
def stored_index_join(spark, sf_dir):
    """An index nested loop: the few customers' orders by the index, files without them skipped."""
    t = _orders(spark, sf_dir, _BY_CUSTOMER)
    few = read(spark, sf_dir, "customer").where("c_acctbal > 9800").select("c_custkey", "c_name")
    found = t.lookup_many(t.schema.indexes[0].name, few.select("c_custkey"))
    return few.join(found, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


stored("stored_changes", f"SELECT o_orderkey, o_orderkey % 50 = 7 AS _d FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 50 = 7")(lambda t: t.changes(t.version - 2, t.version).select("o_orderkey", "_d"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN 'delete' ELSE 'update' END AS change, o_totalprice AS old_price, CASE WHEN o_orderkey % 50 <> 7 THEN o_totalprice + 1 END AS new_price FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 50 = 7")
def diff_across_compaction(spark, sf_dir):
    """Two snapshots with a compaction between them that has merged the old one's rows."""
    t = _layered(spark, sf_dir)
    old = t.version - 2
    t.compact(everything=True)
    return t.diff(old, t.version).select("o_orderkey", "change", F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"))


@query(f"SELECT {_ALL} FROM orders WHERE o_custkey = 42")
def lookup_before_index(spark, sf_dir):
    """An index made later, asked at a version before it."""
    t = _orders(spark, sf_dir)
    then = t.version
    t.update("o_custkey = 42", {"o_custkey": F.lit(-1).cast("long")})
    return t.lookup(t.add_index(["o_custkey"]), 42, as_of=then)


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 4.0 WHEN o_orderkey < 20 AND o_orderkey >= 0 THEN 100.0 + o_orderkey ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders
WHERE o_orderkey % 6 <> 1"""
)
def txn_many_statements(spark, sf_dir):
    """Fifty statements under nested savepoints, some undone."""
    t = _orders(spark, sf_dir)
    with t.transaction() as x:
        for k in range(20):
            x.update(f"o_orderkey = {k}", {"o_totalprice": F.lit(100.0 + k)})
        x.savepoint("a")
        for k in range(10):
            x.put([{"o_orderkey": -100 - k, "o_custkey": k}])
            x.savepoint("b")
            x.delete_keys([k])
        x.rollback_to("b")
        x.rollback_to("a")
        x.delete("o_orderkey % 6 = 1")
        for k in range(8):
            x.savepoint(f"c{k}")
            x.update("o_orderkey % 4 = 0", {"o_totalprice": F.lit(float(k))})
        x.rollback_to("c5")
        x.release("c0")
    return t.read()


@query("SELECT o_orderkey, o_totalprice::VARCHAR IS NOT NULL AS priced, floor(o_totalprice)::BIGINT AS whole FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, true, 1 FROM orders WHERE o_orderkey % 2 <> 0")
def schema_drop_and_alter(spark, sf_dir):
    """A column of another type, one dropped, an index dropped and made anew."""
    t = _orders(spark, sf_dir, [(("o_custkey",), False)])
    t.update("o_orderkey % 2 <> 0", {"o_totalprice": F.lit(1.0)})
    t.alter_type("o_totalprice", "INT")
    t.drop_index(t.schema.indexes[0].name)
    t.drop_column("o_orderpriority")
    name = t.add_index(["o_custkey"])
    t.update("o_orderkey = 3", {"o_custkey": F.lit(5).cast("long")})
    rows = t.read().join(t.index(name), ["o_orderkey", "o_custkey"])
    return rows.select("o_orderkey", F.col("o_totalprice").isNotNull().alias("priced"), F.col("o_totalprice").alias("whole")) if "o_orderpriority" not in rows.columns else rows
