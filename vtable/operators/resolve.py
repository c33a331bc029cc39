"""Version resolution over change rows, as DataFrame to DataFrame functions.

A change log has, besides its key and value columns, a version column (higher is newer; unique for a key) and a deleted flag (a tombstone).
Everything here is declarative: key filters put on a result pass below the aggregate to the Parquet scan, value filters don't.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERSION, DELETED = "_v", "_d"


def _as_of(log: DataFrame, as_of: int | None, version: str) -> DataFrame:
    return log if as_of is None else log.where(F.col(version) <= as_of)


def newest(log: DataFrame, key: Sequence[str], version: str = VERSION, as_of: int | None = None) -> DataFrame:
    """The newest row of each key no newer than as_of, tombstones included.

    A map-side combined max_by: a key with very many versions sends one row from each task.
    """
    rest = [c for c in log.columns if c not in key]
    picked = F.max_by(F.struct(*rest), F.col(version)).alias("_row")
    return _as_of(log, as_of, version).groupBy(*key).agg(picked).select(*key, "_row.*").select(*log.columns)


def latest(log: DataFrame, key: Sequence[str], version: str = VERSION, deleted: str = DELETED, as_of: int | None = None) -> DataFrame:
    """The snapshot: newest rows without tombstones."""
    return newest(log, key, version, as_of).where(~F.coalesce(F.col(deleted), F.lit(False)))


def latest_by_window(log: DataFrame, key: Sequence[str], version: str = VERSION, deleted: str = DELETED, as_of: int | None = None) -> DataFrame:
    """As latest, by row_number: Catalyst limits each key to one row before and after the shuffle. For rows too wide to aggregate."""
    order = Window.partitionBy(*key).orderBy(F.desc(version))
    rows = _as_of(log, as_of, version).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False)))


def latest_version(log: DataFrame, key: Sequence[str], version: str = VERSION) -> DataFrame:
    """Key and the version of its newest row, tombstone or not."""
    return log.groupBy(*key).agg(F.max(version).alias("version"))


def overlay(base: DataFrame, buffer: DataFrame, key: Sequence[str], deleted: str = DELETED, small: bool = False) -> DataFrame:
    """base with a buffer over it (one row for a key), a transaction's or that of newer commits: the buffer's row always wins, its tombstones
    remove. small: the buffer is known to be small enough to be broadcast, so base isn't shuffled."""
    live = buffer.where(~F.coalesce(F.col(deleted), F.lit(False))).select(*base.columns)
    keys = F.broadcast(buffer.select(*key)) if small else buffer.select(*key)
    return base.join(keys, list(key), "left_anti").select(*base.columns).unionByName(live)


def changes(log: DataFrame, after: int | None, until: int | None, version: str = VERSION) -> DataFrame:
    """All change rows with after < version <= until, tombstones included, unresolved."""
    rows = log if after is None else log.where(F.col(version) > after)
    return _as_of(rows, until, version)


def diff(log: DataFrame, key: Sequence[str], old: int, new: int, version: str = VERSION, deleted: str = DELETED, before: DataFrame | None = None) -> DataFrame:
    """What changed for a key between two snapshots: key, change (insert, update, delete), old and new value structs.

    An update is a live key with a newer version. One pass: both snapshots are aggregates of the same scan, so nothing is joined. Where log
    no longer has the rows of the old snapshot, before has them.
    """
    rest = [c for c in log.columns if c not in (*key, deleted)]
    row = F.struct(*rest, deleted)
    both = log.withColumn("_is_old", F.lit(before is None)).withColumn("_is_new", F.lit(True))
    if before is not None:
        both = both.unionByName(before.withColumn("_is_old", F.lit(True)).withColumn("_is_new", F.lit(False)))

    def at(v: int, side: str) -> Column:
        there = F.col(side) & (F.col(version) <= v)
        return F.max_by(F.when(there, row), F.when(there, F.col(version)))

    both = both.where(F.col(version) <= new).groupBy(*key).agg(at(old, "_is_old").alias("_o"), at(new, "_is_new").alias("_n"))

    def live(s: str) -> Column:
        return F.when(F.col(s).isNotNull() & ~F.coalesce(F.col(f"{s}.{deleted}"), F.lit(False)), F.col(s).dropFields(deleted))

    both = both.select(*key, live("_o").alias("old"), live("_n").alias("new"))
    kind = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "insert").when(F.col("new").isNull() & F.col("old").isNotNull(), "delete")
    kind = kind.when(F.col(f"old.{version}") < F.col(f"new.{version}"), "update")
    return both.withColumn("change", kind).where("change is not null").select(*key, "change", "old", "new")


def collect_garbage(log: DataFrame, key: Sequence[str], threshold: int, whole: bool = True, version: str = VERSION, deleted: str = DELETED) -> DataFrame:
    """Rows that snapshots from threshold on need: all newer than threshold, and of the others the newest of each key.

    That one goes too if it is a tombstone and log is whole, that is, no row of its key is anywhere else.
    """
    old = F.col(version) <= threshold
    kept = newest(log.where(old), key, version)
    if whole:
        kept = kept.where(~F.coalesce(F.col(deleted), F.lit(False)))
    return kept.unionByName(log.where(~old))


def conflicting_keys(buffer: DataFrame, log: DataFrame, key: Sequence[str], read_version: int, version: str = VERSION) -> DataFrame:
    """Keys of buffer that someone has written since read_version."""
    return buffer.select(*key).distinct().join(changes(log, read_version, None, version).select(*key), list(key), "left_semi")


def duplicate_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of columns that more than one row has, with how many do; values with a null are never duplicates."""
    return rows.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
