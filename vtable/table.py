"""Keyed, versioned tables on Parquet: snapshot reads, atomic writes, indexes, compaction and administration."""

from __future__ import annotations

import logging
import threading
import uuid
from bisect import bisect_left
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import access, resolve
from .operators.compaction import MEGABYTE, overlapping, pick
from .operators.resolve import DELETED, VERSION
from .sources.log import Commit, CorruptTable, DataFile, Log, SlotTaken, State, Store
from .sources.options import Options
from .sources.schema import Index, SchemaError, TableSchema, parse_ddl

log = logging.getLogger("vtable.table")

#: Commits whose versions are written into a read's plan as a literal map; more are joined.
LITERAL_COMMITS = 500
#: Commits whose versions are broadcast at most where they are joined.
BROADCAST_COMMITS = 100_000
#: Rows, and bytes of their files, of newer commits that are broadcast at most over an older level.
OVERLAY_ROWS, OVERLAY_BYTES = 1_000_000, 32_000_000
#: Tries to commit under the next free number.
TRIES = 50
#: A pin that is older is taken for one of a process that has died.
PIN_HOURS = 24


class ConflictError(RuntimeError):
    """Someone else has committed a write to one of the keys since the transaction began."""


class UniqueViolation(ValueError):
    """Two live rows would have one value of a unique index."""


class Expired(ValueError):
    """A snapshot that compaction has given up."""


def bound_of(kind: T.DataType, value: Any) -> Any:
    """value as a bound of files' columns of a type, or None where the log has none for it."""
    return value if isinstance(kind, T.IntegralType) and isinstance(value, int) or isinstance(kind, T.StringType) and isinstance(value, str) else None


def apart(files: Sequence[DataFile], as_of: int | None) -> tuple[list[DataFile], list[DataFile]]:
    """Files whose rows are live as they are, and files that must be resolved.

    The files of one folder of level 0 come from one write, which has a key once, and so do those that compaction calls single. Files are
    taken in the order of their least keys; where such a folder's files overlap no others, they need no resolving. Files with nulls overlap
    each other; files without bounds overlap all."""
    known = sorted((f for f in files if f.low is not None), key=lambda f: f.low)
    bare = [f for f in files if f.low is None and f.rows == f.nulls]
    open_ = [f for f in files if f.low is None and f.rows != f.nulls]
    groups: list[list[DataFile]] = []
    top: Any = None
    for f in known:
        if groups and f.low <= top:
            groups[-1].append(f)
            top = max(top, f.high)
        else:
            groups.append([f])
            top = f.high
    if open_:
        groups = [[*known, *bare, *open_]]
    elif len({f.folder for f in files if f.nulls}) > 1:
        with_nulls = [g for g in groups if any(f.nulls for f in g)]
        groups = [g for g in groups if g not in with_nulls] + [[*(f for g in with_nulls for f in g), *bare]]
    elif bare:
        groups.append(bare)
    plain: list[DataFile] = []
    mixed: list[DataFile] = []
    for g in groups:
        once = len({f.folder for f in g}) == 1 and all((not f.level or f.single) and (as_of is None or f.high_v <= as_of) for f in g)
        (plain if once else mixed).extend(g)
    return plain, mixed


def beneath(files: Sequence[DataFile], as_of: int | None) -> tuple[list[DataFile], list[DataFile]]:
    """Of files that must be resolved: those of the largest folder, and the others, if the folder has each key once, is older than all others, and
    the others are few enough to be broadcast and far fewer. Else two empty lists. The log knows the rows and bytes of each file."""
    by: dict[str, list[DataFile]] = {}
    for f in files:
        by.setdefault(f.folder, []).append(f)
    base = max(by.values(), key=lambda g: sum(f.rows for f in g))
    rest = [f for f in files if f.folder != base[0].folder]
    top, rows = max(f.high_v for f in base), sum(f.rows for f in rest)
    once = all(not f.level or f.single for f in base) and (as_of is None or top <= as_of)
    small = rows <= OVERLAY_ROWS and sum(f.bytes for f in rest) <= OVERLAY_BYTES and 2 * rows <= sum(f.rows for f in base)
    return (base, rest) if once and small and all(f.low_v > top for f in rest) else ([], [])


class Scoped(logging.LoggerAdapter):
    """A table's messages, which begin with its path."""

    def process(self, msg, kwargs):
        return f"{self.extra['scope']}: {msg}", kwargs


class Metrics:
    """Counters of what this process has done."""

    NAMES = ("reads", "point_reads", "commits", "conflicts", "rows_written", "compactions", "files_written", "files_removed", "retries")

    def __init__(self):
        self._lock, self.counts = threading.Lock(), dict.fromkeys(self.NAMES, 0)

    def add(self, name: str, n: int = 1) -> None:
        with self._lock:
            self.counts[name] += n


class Table:
    """A table in a folder.

    `_log/<number>.json` are commits and the only truth; a commit's rows are in `data/<random>/` and its index entries in `idx/<n>/<random>/`,
    written before the commit is created under the next free number. So a lost race moves no data, and files of no commit are not seen. Rows
    of level 0 get their version from the commit of their folder; compacted files store it in `_v`.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.store = Store(spark, self.path)
        self.log = Log(self.store)
        self.metrics, self.say = Metrics(), Scoped(log, {"scope": self.path})
        if not self.log.head().version:
            raise CorruptTable(f"{path} holds no table")

    # opening ------------------------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: TableSchema | str = "", name: str = "data", options: Options | None = None) -> Table:
        """A new table; schema as a declaration or a TableSchema."""
        schema = parse_ddl(name, schema) if isinstance(schema, str) else schema
        options = options or Options()
        if Log(Store(spark, path)).versions():
            raise SchemaError(f"{path} already holds a table")
        try:
            Log(Store(spark, path)).append(Commit(1, "create", schema=schema.to_json()), options.sync == "FULL")
        except SlotTaken:
            raise SchemaError(f"{path} already holds a table") from None
        return cls(spark, path, options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: TableSchema | str | None = None, name: str = "data", options: Options | None = None) -> Table:
        """The table in path, made if there is none. A declared schema adds its further columns to an existing table."""
        if not Log(Store(spark, path)).versions():
            return cls.create(spark, path, schema or "", name, options)
        table = cls(spark, path, options)
        if schema:
            declared = parse_ddl(name, schema) if isinstance(schema, str) else schema
            merged = table.schema.merge(declared)
            if merged != table.schema:
                table._commit("schema", schema=merged)
        return table

    def close(self) -> None:
        """Nothing is buffered: what is committed is durable."""

    @property
    def schema(self) -> TableSchema:
        return TableSchema.from_json(self.log.head().schema)

    @property
    def version(self) -> int:
        return self.log.head().version

    # reading ------------------------------------------------------------------------------------------------------------------

    def _state(self, as_of: int | None) -> State:
        head = self.log.head()
        if as_of is None or as_of >= head.horizon:
            return head
        if as_of < head.floor:
            raise Expired(f"version {as_of} is older than {head.floor}, the oldest that is kept")
        return self.log.at(as_of)

    def _scan(self, files: Sequence[DataFile], struct: T.StructType, versions: dict[str, int]) -> DataFrame:
        """Change rows of files: struct, _d and _v. One scan for all files; columns that a file lacks are null."""
        full = T.StructType([*struct.fields, T.StructField(DELETED, T.BooleanType()), T.StructField(VERSION, T.LongType())])
        if not files:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(*[f"{self.path}/{f.path}" for f in files])
        fresh = {f.folder: versions[f.folder] for f in files if not f.level}
        if not fresh:
            return rows
        if len(fresh) == 1 and not any(f.level for f in files):
            return rows.withColumn(VERSION, F.lit(next(iter(fresh.values()))).cast("long"))
        folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
        if len(fresh) <= LITERAL_COMMITS:
            by_folder = F.create_map(*[x for k, v in fresh.items() for x in (F.lit(k), F.lit(v).cast("long"))])
            return rows.withColumn(VERSION, F.coalesce(F.col(VERSION), F.try_element_at(by_folder, folder)))
        known = self.spark.createDataFrame(list(fresh.items()), "_folder string, _n long")
        known = F.broadcast(known) if len(fresh) <= BROADCAST_COMMITS else known
        return rows.withColumn("_folder", folder).join(known, "_folder", "left").withColumn(VERSION, F.coalesce(VERSION, "_n")).drop("_folder", "_n")

    def _folders(self, state: State) -> dict[str, int]:
        """Folder to version of the files of level 0, from their own entries."""
        return {f.folder: f.low_v for f in state.files.values() if not f.level}

    def _files_of(self, state: State, low: Any = None, high: Any = None, after: int | None = None, until: int | None = None, index: int = 0) -> list[DataFile]:
        """Files that may hold keys within the bounds and versions after < v <= until."""
        return [f for f in state.files.values() if f.index == index and f.may_hold(low, high) and (after is None or f.high_v > after) and (until is None or f.low_v <= until)]

    def _rows(self, state: State, low: Any = None, high: Any = None, after: int | None = None, until: int | None = None) -> DataFrame:
        """Change rows of the files that may hold keys and versions within the bounds."""
        return self._scan(self._files_of(state, low, high, after, until), self.schema.stored, self._folders(state))

    def _resolved(self, files: list[DataFile], state: State, struct: T.StructType, key: Sequence[str], as_of: int | None) -> DataFrame:
        """Live rows of files: those of files that alone hold their range of keys, each key once, are a plain scan; the others are resolved.
        So filters on any column reach Parquet where there is nothing to resolve, and only overlapping commits are shuffled."""
        plain, mixed = apart(files, as_of)
        folders = self._folders(state)
        out = None
        if plain or not mixed:
            out = self._scan(plain, struct, folders).where(~F.coalesce(F.col(DELETED), F.lit(False)))
        if mixed:
            base, delta = beneath(mixed, as_of)
            if base:
                newer = resolve.newest(self._scan(delta, struct, folders), key, as_of=as_of)
                old = self._scan(base, struct, folders).where(~F.coalesce(F.col(DELETED), F.lit(False)))
                late = resolve.overlay(old, newer, key, small=True)
            else:
                late = resolve.latest(self._scan(mixed, struct, folders), key, as_of=as_of)
            out = late if out is None else out.unionByName(late)
        return out

    def _whole(self, rows: DataFrame) -> DataFrame:
        """With the columns that are always null, in schema order."""
        return rows.select(*[F.col(c.name) if c.type != "void" else F.lit(None).alias(c.name) for c in self.schema.columns])

    def read(self, as_of: int | None = None, low: Any = None, high: Any = None) -> DataFrame:
        """The live rows at a version, now if none is given. low and high bound the first key column and skip files outside; files of later
        versions are skipped too."""
        self.metrics.add("reads")
        state = self._state(as_of)
        return self._whole(self._resolved(self._files_of(state, low, high, until=as_of), state, self.schema.stored, self.schema.key, as_of))

    as_of = read

    def observed(self, rows: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
        """rows, and an observation that has, once an action has run over them, their number and the least and greatest key: metrics of the
        executors' work, without a further job."""
        first = self.schema.key[0]
        seen = Observation(f"{self.schema.name}-{name}-{uuid.uuid4().hex}")
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(first).alias("low"), F.max(first).alias("high")), seen

    def changes(self, after: int | None = None, until: int | None = None) -> DataFrame:
        """Change rows, with _v and _d, of the versions after < _v <= until; only files with such versions are read. Versions that compaction
        has merged are gone."""
        rows = self._rows(self.log.head(), after=after, until=until)
        return resolve.changes(rows, after, until).select(*[c.name for c in self.schema.columns if c.type != "void"], VERSION, F.coalesce(DELETED, F.lit(False)).alias(DELETED))

    def diff(self, old: int, new: int) -> DataFrame:
        """What changed between two versions, see resolve.diff. Where a compaction lies behind old, its snapshot comes from the files of then."""
        before, after = self._state(old), self._state(new)
        if old >= after.horizon:
            return resolve.diff(self._rows(after, until=new), self.schema.key, old, new)
        return resolve.diff(self._rows(after, until=new), self.schema.key, old, new, before=self._rows(before, until=old))

    def get(self, *key: Any, as_of: int | None = None) -> dict | None:
        """The row with a primary key."""
        self.metrics.add("point_reads")
        first = self._bound(key[0])
        found = access.point(self.read(as_of, first, first), self.schema.key, *key).take(1)
        return found[0].asDict(True) if found else None

    def _bound(self, value: Any) -> Any:
        """value as a bound for file pruning, or None where the log has none for its type."""
        return bound_of(self.schema.struct[self.schema.key[0]].dataType, value)

    def multi_get(self, keys: Sequence[Any] | DataFrame, as_of: int | None = None) -> DataFrame:
        """Rows of many keys, a list or a DataFrame. Up to LITERAL_KEYS values of the first key column bound the files and are pushed to
        Parquet; more are joined."""
        first = self.schema.key[0]
        if isinstance(keys, DataFrame):
            values = access.few_values(keys, first)
        else:
            values = list({k[0] if isinstance(k, tuple) else k for k in keys}) if len(keys) <= access.LITERAL_KEYS else None
        if values is None:
            return access.multi(self.read(as_of), self.schema.key, keys)
        values = [v for v in values if v is not None]
        rows = self._among(values, as_of)
        return rows if len(self.schema.key) == 1 else access.multi(rows, self.schema.key, keys)

    def _among(self, values: Sequence[Any], as_of: int | None) -> DataFrame:
        """Live rows whose first key column is one of values; files that can hold none of them are skipped."""
        schema, state = self.schema, self._state(as_of)
        first = schema.key[0]
        kind = schema.struct[first].dataType
        bounds = sorted(values) if all(bound_of(kind, v) is not None for v in values) else None
        files = self._files_of(state, until=as_of)
        if bounds is not None:
            files = [f for f in files if f.low is None or (k := bisect_left(bounds, f.low)) < len(bounds) and bounds[k] <= f.high]
        rows = self._whole(self._resolved(files, state, schema.stored, schema.key, as_of))
        return rows.where(access.is_one_of(first, kind, values)) if values else rows.limit(0)

    def range(self, low: Any = None, high: Any = None, low_open: bool = False, high_open: bool = False, as_of: int | None = None) -> DataFrame:
        return access.key_range(self.read(as_of, self._bound(low), self._bound(high)), self.schema.key[0], low, high, low_open, high_open)

    def seek(self, start: Any, limit: int) -> DataFrame:
        return access.seek(self.read(low=self._bound(start)), self.schema.key, start, limit)

    def prefix(self, start: str, limit: int | None = access.PREFIX_LIMIT) -> DataFrame:
        """Rows whose first key column begins with start; for text keys files outside are skipped."""
        text = isinstance(self.schema.struct[self.schema.key[0]].dataType, T.StringType) and bool(start)
        return access.prefix(self.read(low=start if text else None, high=start + chr(0x10FFFF) if text else None), self.schema.key[0], start, limit)

    def ordered(self) -> DataFrame:
        return self.read().orderBy(*self.schema.key)

    def count(self) -> int:
        return self.read().count()

    # indexes ------------------------------------------------------------------------------------------------------------------

    def _entry_struct(self, index: Index) -> T.StructType:
        struct = self.schema.struct
        return T.StructType([struct[c] for c in dict.fromkeys([*index.columns, *self.schema.key])])

    def _index_bound(self, index: Index, value: Any) -> Any:
        return bound_of(self.schema.struct[index.columns[0]].dataType, value)

    def index(self, name: str, as_of: int | None = None, low: Any = None, high: Any = None) -> DataFrame:
        """Live entries of an index: its columns and the key. low and high bound its first column and skip files outside."""
        index, state = self.schema.index(name), self._state(as_of)
        entry = self._entry_struct(index)
        if as_of is not None and as_of < self.log.head().born.get(str(index.id), 0):
            return access.index_entries(self.read(as_of), index.columns, self.schema.key)
        low, high = self._index_bound(index, low), self._index_bound(index, high)
        files = self._files_of(state, low, high, until=as_of, index=index.id)
        return self._resolved(files, state, entry, entry.names, as_of).select(*entry.names)

    def _fetch(self, entries: DataFrame, as_of: int | None) -> DataFrame:
        """The rows that entries name: a few are looked up by their keys, which skips files; many are joined."""
        values = access.few_values(entries, self.schema.key[0])
        rows = self.read(as_of) if values is None else self._among(values, as_of)
        return rows if values is not None and len(self.schema.key) == 1 else access.by_index(rows, self.schema.key, entries, F.lit(True))

    def lookup(self, name: str, *values: Any, as_of: int | None = None) -> DataFrame:
        """Rows whose first indexed columns have the values. A version before the index was made is looked through itself."""
        index = self.schema.index(name)
        entries = self.index(name, as_of, values[0], values[0])
        return self._fetch(entries.where(access.key_equals(entries, index.columns[: len(values)], values)), as_of)

    def lookup_many(self, name: str, values: DataFrame, as_of: int | None = None) -> DataFrame:
        """Rows whose first indexed column is among the values of a one-column DataFrame: the inner side of an index nested loop. A few values
        bound the index's files, and what they name the table's; many are joined."""
        first = self.schema.index(name).columns[0]
        wanted = values.select(F.col(values.columns[0]).alias(first)).distinct()
        few = access.few_values(wanted, first)
        if few is None:
            return self._fetch(self.index(name, as_of).join(wanted, first, "left_semi"), as_of)
        few = [v for v in few if v is not None]
        entries = self.index(name, as_of, min(few, default=None), max(few, default=None))
        return self._fetch(entries.where(access.is_one_of(first, self.schema.struct[first].dataType, few)), as_of)

    def lookup_range(self, name: str, low: Any = None, high: Any = None, as_of: int | None = None) -> DataFrame:
        """Rows whose first indexed column lies between low and high, in its order."""
        first = self.schema.index(name).columns[0]
        entries = access.key_range(self.index(name, as_of, low, high), first, low, high)
        return self._fetch(entries, as_of).orderBy(first, *self.schema.key)

    def where(self, **values: Any) -> DataFrame:
        """Rows with the columns' values, by the access path that fits: whole key, else the first index with the longest left prefix, else a scan."""
        schema = self.schema
        if set(schema.key) <= set(values):
            first = self._bound(values[schema.key[0]])
            rows = self.read(low=first, high=first)
        else:
            rows = self.read()
            for index in schema.indexes:
                lead = [c for k, c in enumerate(index.columns) if set(index.columns[: k + 1]) <= set(values)]
                if lead:
                    rows = self.lookup(index.name, *[values[c] for c in lead])
                    break
        return rows.where(access.key_equals(rows, list(values), list(values.values())))

    # writing ------------------------------------------------------------------------------------------------------------------

    def _shape(self, df: DataFrame) -> DataFrame:
        """df's columns cast to the schema, missing ones null, with _d."""
        schema, have = self.schema, set(df.columns)
        if unknown := have - {c.name for c in schema.columns} - {DELETED}:
            raise SchemaError(f"{schema.name}: no column {', '.join(sorted(unknown))}")
        if missing := set(schema.key) - have:
            raise SchemaError(f"{schema.name}: key column {', '.join(sorted(missing))} is missing")
        columns = []
        for c in schema.columns:
            if c.type == "void":
                continue
            value = F.col(c.name).cast(c.field.dataType) if c.name in have else F.lit(None).cast(c.field.dataType)
            if self.options.coerce_nulls and c.name not in schema.key:
                zero = {"bigint": 0, "double": 0.0, "string": "", "binary": b""}.get(c.type)
                value = value if zero is None else F.coalesce(value, F.lit(zero).cast(c.field.dataType))
            columns.append(value.alias(c.name))
        gone = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in have else F.lit(False)
        return df.select(*columns, gone.alias(DELETED))

    def _save(self, rows: DataFrame, where: str, order: Sequence[str], level: int = 0) -> None:
        out = rows.sortWithinPartitions(*order).write
        for c in order[:1]:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.option("compression", "zstd" if level else "lz4_raw").parquet(f"{self.path}/{where}")

    def _files(self, where: str, first: str, struct: T.StructType, version: int = 0, level: int = 0, index: int = 0, single: bool = False) -> list[DataFile]:
        """What the log says about the Parquet files in a folder: one aggregate over the key column, a row for each file."""
        sizes = {p: n for p, n in self.store.sizes(where).items() if p.endswith(".parquet")}
        if not sizes:
            return []
        kind = struct[first].dataType
        bounded = isinstance(kind, T.IntegralType | T.StringType)
        rows = self.spark.read.schema(T.StructType([struct[first], T.StructField(VERSION, T.LongType())])).parquet(f"{self.path}/{where}")
        name = F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file")
        stats = rows.groupBy(name).agg(F.count("*").alias("n"), F.min(first).alias("low"), F.max(first).alias("high"), F.min(VERSION).alias("low_v"), F.max(VERSION).alias("high_v"), F.count_if(F.col(first).isNull()).alias("nulls")).collect()
        return [
            DataFile(f"{where}/{s.file}", s.n, sizes[f"{where}/{s.file}"], level, index, s.low if bounded else None, s.high if bounded else None, s.low_v or version, s.high_v or version, single, s.nulls)
            for s in stats
        ]

    def _old_rows(self, changes: DataFrame, as_of: int) -> DataFrame:
        return self.read(as_of).join(changes.select(*self.schema.key).distinct(), list(self.schema.key), "left_semi")

    def _index_changes(self, index: Index, changes: DataFrame, old: DataFrame) -> DataFrame:
        """Entries that a write adds, and tombstones of those that it takes away."""
        entry = self._entry_struct(index).names
        new = changes.where(~F.col(DELETED)).select(*entry)
        gone = old.select(*entry).exceptAll(new)
        fresh = new.exceptAll(old.select(*entry))
        return fresh.withColumn(DELETED, F.lit(False)).unionByName(gone.withColumn(DELETED, F.lit(True)))

    def _check_unique(self, changes: DataFrame, state_version: int) -> None:
        """Raises if the live rows after the write would share a unique value: among the new rows, or of one with a row that stays."""
        key = list(self.schema.key)
        for index in self.schema.indexes:
            if not index.unique:
                continue
            new = changes.where(~F.col(DELETED)).dropna(subset=list(index.columns))
            twice = resolve.duplicate_values(new, index.columns).take(1)
            if not twice:
                stay = self.index(index.name, state_version).join(changes.select(*key).distinct(), key, "left_anti")
                twice = new.select(*index.columns).join(stay.select(*index.columns), list(index.columns), "left_semi").take(1)
            if twice:
                raise UniqueViolation(f"{self.schema.name}.{index.name}: {twice[0].asDict()}")

    def write(self, changes: DataFrame, read_version: int | None = None, op: str = "write", batch: str | None = None) -> int | None:
        """Commits change rows (a schema's columns and _d, one row for a key) read at read_version; returns the new version.

        Data first, then the commit under the next number. If others have taken it, their keys are compared with ours: ConflictError on a common
        one, else uniqueness is checked again and the next number tried. None if batch was committed before.
        """
        base = self.log.head().version if read_version is None else read_version
        if batch and self.log.head().has_batch(batch):
            return None
        if self.options.stall_limit and sum(not f.level for f in self.log.head().files.values()) >= self.options.stall_limit:
            self.compact()
        schema, uid = self.schema, uuid.uuid4().hex
        key = list(schema.key)
        nulls = F.lit(False)
        for k in key:
            nulls |= F.col(k).isNull()
        shaped = self._shape(changes)
        self._save(shaped, f"data/{uid}", key)
        rows = self.spark.read.schema(shaped.schema).parquet(f"{self.path}/data/{uid}")
        try:
            found = rows.groupBy(*key).agg(F.count("*").alias("_n")).agg(F.sum("_n"), F.count_if(nulls), F.max("_n")).first()
            if found[1]:
                raise SchemaError(f"{schema.name}: null in the key")
            if (found[2] or 0) > 1:
                raise SchemaError(f"{schema.name}: a write has two rows for one key")
            if any(i.unique for i in schema.indexes):
                self._check_unique(rows, base)
            old = self._old_rows(rows, base) if schema.indexes else None
            for index in schema.indexes:
                self._save(self._index_changes(index, rows, old), f"idx/{index.id}/{uid}", list(index.columns))
            version = self._publish(rows, uid, base, op, batch)
        except Exception:
            self.store.delete(f"data/{uid}")
            for index in schema.indexes:
                self.store.delete(f"idx/{index.id}/{uid}")
            raise
        self.metrics.add("commits")
        self.metrics.add("rows_written", found[0] or 0)
        self.say.debug("version %s: %s of %d rows", version, op, found[0] or 0)
        return version

    def _publish(self, rows: DataFrame, uid: str, base: int, op: str, batch: str | None) -> int | None:
        schema, seen = self.schema, base
        key = list(schema.key)
        added = self._files(f"data/{uid}", key[0], schema.struct)
        for index in schema.indexes:
            added += self._files(f"idx/{index.id}/{uid}", index.columns[0], schema.struct, index=index.id)
        if self.options.sync == "FULL":
            self.store.sync([f.path for f in added])
        for _ in range(TRIES):
            head = self.log.head()
            if batch and head.has_batch(batch):
                return None
            if head.version > seen:
                self._check_conflict(rows, added, base)
                if any(i.unique for i in schema.indexes):
                    self._check_unique(rows, head.version)
                seen = head.version
            version = head.version + 1
            placed = [replace(f, low_v=version, high_v=version) for f in added]
            try:
                self.log.append(Commit(version, op, base, placed, batch=batch), self.options.sync == "FULL")
                self.metrics.add("files_written", len(placed))
                return version
            except SlotTaken:
                self.metrics.add("retries")
        raise ConflictError(f"{schema.name}: no free commit number in {TRIES} tries")

    def _check_conflict(self, rows: DataFrame, added: list[DataFile], base: int) -> None:
        """First committer wins: raises if a commit after base has one of our keys. Files whose bounds don't meet ours are not read."""
        own = [f for f in added if not f.index]
        theirs = [f for c in self.log.since(base) if c.op != "compact" for f in c.add if not f.index and any(f.may_hold(o.low, o.high) for o in own)]
        key = list(self.schema.key)
        if theirs and rows.select(*key).join(self._scan(theirs, self.schema.stored, {f.folder: f.low_v for f in theirs}).select(*key), key, "left_semi").take(1):
            self.metrics.add("conflicts")
            self.say.info("conflict with a commit since version %d", base)
            raise ConflictError(f"{self.schema.name}: a key was written since version {base}")

    def _commit(self, op: str, schema: TableSchema | None = None, only_if: Callable[[State], bool] | None = None, **more: Any) -> int:
        for _ in range(TRIES):
            head = self.log.head()
            if only_if and not only_if(head):
                raise ConflictError(f"{self.path}: someone else has done this")
            version = head.version + 1
            try:
                self.log.append(Commit(version, op, version - 1, schema=schema.to_json() if schema else None, **more), self.options.sync == "FULL")
                return version
            except SlotTaken:
                self.metrics.add("retries")
        raise ConflictError(f"{self.path}: no free commit number in {TRIES} tries")

    def frame(self, rows: Sequence[dict] | Sequence[tuple], columns: Sequence[str] | None = None) -> DataFrame:
        """Rows from Python as a DataFrame of the schema's types."""
        names = list(columns or (rows[0].keys() if rows and isinstance(rows[0], dict) else self.schema.struct.names))
        if unknown := set(names) - set(self.schema.struct.names):
            raise SchemaError(f"{self.schema.name}: no column {', '.join(sorted(unknown))}")
        struct = T.StructType([self.schema.struct[n] for n in names])
        values = [tuple(r.get(n) for n in names) if isinstance(r, dict) else tuple(r) for r in rows]
        return self.spark.createDataFrame(values, struct)

    def insert(self, rows: DataFrame | Sequence, mode: str = "upsert", batch: str | None = None) -> int | None:
        """mode upsert replaces rows with the same key, error raises UniqueViolation on one, ignore leaves it as it is."""
        df, base = rows if isinstance(rows, DataFrame) else self.frame(rows), self.version
        if mode not in ("upsert", "error", "ignore"):
            raise ValueError(f"no mode {mode}")
        if mode != "upsert":
            key = list(self.schema.key)
            shaped = self._shape(df)
            there = self.read(base).select(*key)
            if mode == "error" and shaped.select(*key).join(there, key, "left_semi").take(1):
                raise UniqueViolation(f"{self.schema.name}: the key of a row is there")
            df = shaped.join(there, key, "left_anti") if mode == "ignore" else shaped
        return self.write(df, base, "insert", batch)

    def upsert(self, rows: DataFrame | Sequence, batch: str | None = None) -> int | None:
        return self.insert(rows, batch=batch)

    put = upsert

    def updated(self, rows: DataFrame, values: dict[str, Any]) -> DataFrame:
        """Change rows that set columns of rows (live rows) to expressions; a changed key is a delete and an insert."""
        for c in values:
            if c not in self.schema.struct.names:
                raise SchemaError(f"{self.schema.name}: no column {c}")
        key = list(self.schema.key)
        as_column = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
        new = rows.select(*[(as_column.get(n, F.col(n))).cast(self.schema.struct[n].dataType).alias(n) for n in self.schema.struct.names]).withColumn(DELETED, F.lit(False))
        if set(values) & set(key):
            gone = rows.withColumn(DELETED, F.lit(True)).join(new.select(*key), key, "left_anti")
            new = new.unionByName(gone)
        return new

    def update(self, condition: Column | str, values: dict[str, Any]) -> int | None:
        base = self.version
        rows = self.read(base).where(condition)
        return self.write(self.updated(rows, values), base, "update")

    def delete(self, condition: Column | str) -> int | None:
        base = self.version
        return self.write(self.read(base).where(condition).withColumn(DELETED, F.lit(True)), base, "delete")

    def delete_keys(self, keys: Sequence[Any]) -> int | None:
        key = self.schema.key
        rows = self.frame([k if isinstance(k, tuple) else (k,) for k in keys], key)
        return self.write(rows.withColumn(DELETED, F.lit(True)), None, "delete")

    def put_indexed(self, row: dict) -> int | None:
        """A row and its index entries in one commit, as every write does."""
        return self.upsert([row])

    # transactions -------------------------------------------------------------------------------------------------------------

    def begin(self):
        from .txn import Transaction

        return Transaction(self)

    @contextmanager
    def transaction(self):
        """Commits at the end, rolls back on an exception."""
        txn = self.begin()
        try:
            yield txn
        except BaseException:
            txn.rollback()
            raise
        txn.commit()

    # schema and administration ------------------------------------------------------------------------------------------------

    def add_column(self, name: str, kind: str) -> int:
        return self._commit("schema", schema=self.schema.add_column(name, kind))

    def drop_column(self, name: str) -> int:
        """The column is no longer read; compaction leaves its values out."""
        return self._commit("schema", schema=self.schema.drop_column(name))

    def alter_type(self, name: str, kind: str) -> int:
        """Rewrites the rows with the column cast to another type, versions and all; fails if someone else commits meanwhile. Versions before
        the last compaction can't be read any more."""
        head, old, uid = self.log.head(), self.schema, uuid.uuid4().hex
        new = old.alter_type(name, kind)
        files = [f for f in head.files.values() if not f.index]
        added: list[DataFile] = []
        if files:
            level = max([1, *(f.level for f in files)])
            rows = self._scan(files, old.stored, self._folders(head)).withColumn(name, F.col(name).cast(new.struct[name].dataType))
            parts = max(1, -(-sum(f.bytes for f in files) // (self.options.file_mb * MEGABYTE)))
            self._save(rows.repartitionByRange(parts, *old.key), f"data/{uid}", [*old.key, VERSION], level)
            plain, _ = apart(files, None)
            added = self._files(f"data/{uid}", old.key[0], new.struct, level=level, single=len(plain) == len(files))
        return self._commit("schema", schema=new, add=added, remove=[f.path for f in files], floor=head.horizon, only_if=lambda state: state.version == head.version)

    def drop_index(self, name: str) -> int:
        index = self.schema.index(name)
        head = self.log.head()
        return self._commit("schema", schema=self.schema.drop_index(name), remove=[f.path for f in head.files.values() if f.index == index.id], only_if=lambda state: state.version == head.version)

    def rename(self, name: str) -> int:
        return self._commit("schema", schema=replace(self.schema, name=name))

    def add_index(self, columns: Sequence[str], unique: bool = False) -> str:
        """A new index, filled from the snapshot."""
        for _ in range(TRIES):
            base = self.log.head().version
            schema = self.schema.add_index(tuple(columns), unique)
            index, uid = schema.indexes[-1], uuid.uuid4().hex
            rows = access.index_entries(self.read(base), index.columns, schema.key)
            if unique and (twice := resolve.duplicate_values(rows, index.columns).take(1)):
                raise UniqueViolation(f"{schema.name}.{index.name}: {twice[0].asDict()}")
            self._save(rows.withColumn(DELETED, F.lit(False)), f"idx/{index.id}/{uid}", list(index.columns))
            files = self._files(f"idx/{index.id}/{uid}", index.columns[0], schema.struct, base + 1, index=index.id)
            try:
                self.log.append(Commit(base + 1, "index", base, files, schema=schema.to_json(), index=index.id), self.options.sync == "FULL")
                return index.name
            except SlotTaken:
                self.store.delete(f"idx/{index.id}/{uid}")
        raise ConflictError(f"{self.path}: no free commit number in {TRIES} tries")

    def pin(self, version: int) -> str:
        """Keeps a version readable, for other processes' compactions and vacuums too, until unpin() or PIN_HOURS."""
        token = f"{version:020d}-{uuid.uuid4().hex}"
        self.store.put(f"_pins/{token}", "")
        return token

    def unpin(self, token: str) -> None:
        self.store.delete(f"_pins/{token}")

    def pins(self) -> list[int]:
        return [int(n.partition("-")[0]) for n, ms in self.store.ages("_pins").items() if n[:1].isdigit() and ms < PIN_HOURS * 3_600_000]

    @contextmanager
    def pinned(self):
        """Keeps the snapshot of now readable while the block runs."""
        version = self.version
        token = self.pin(version)
        try:
            yield version
        finally:
            self.unpin(token)

    def threshold(self) -> int:
        """The oldest version that a reader may still ask for."""
        return min([self.version - self.options.retain, *self.pins()])

    def compact(self, everything: bool = False) -> int | None:
        """Rewrites the files that the picker chooses, or all, into the next level without rows that no kept snapshot needs.

        Rows go to range partitions of the key, so the new files don't overlap. Tombstones go only if no file outside holds their keys.
        """
        head, schema, limit, uid = self.log.head(), self.schema, self.threshold(), uuid.uuid4().hex
        added, removed = [], []
        for index in (None, *schema.indexes):
            number = index.id if index else 0
            files = [f for f in head.files.values() if f.index == number]
            chosen, level = (files, max([1, *(f.level for f in files)])) if everything else pick(files, self.options)
            if not chosen:
                continue
            struct = self._entry_struct(index) if index else schema.stored
            key = struct.names if index else list(schema.key)
            order = list(index.columns) if index else key
            whole = not overlapping(chosen, [f for f in files if f not in chosen])
            kept = resolve.collect_garbage(self._scan(chosen, struct, self._folders(head)), key, limit, whole)
            where = f"idx/{number}/{uid}" if index else f"data/{uid}"
            parts = max(1, -(-sum(f.bytes for f in chosen) // (self.options.file_mb * MEGABYTE)))
            self._save(kept.repartitionByRange(parts, *order), where, [*order, VERSION], level)
            single = whole and limit >= max(f.high_v for f in chosen)
            added += self._files(where, order[0], schema.struct, level=level, index=number, single=single)
            removed += [f.path for f in chosen]
        if not removed:
            return None
        version = self._commit("compact", add=added, remove=removed, horizon=limit, only_if=lambda state: state.files.keys() >= set(removed))
        self.metrics.add("compactions")
        self.metrics.add("files_removed", len(removed))
        self.say.info("compacted %d files into %d at level %d", len(removed), len(added), level)
        return version

    def flush(self) -> int | None:
        """Merges level 0 into level 1 if there is any; commits themselves are durable at once."""
        rows = [f for f in self.log.head().files.values() if not f.index]
        return self.compact(everything=all(not f.level for f in rows)) if any(not f.level for f in rows) else None

    def vacuum(self) -> list[str]:
        """Deletes data that no readable version needs: files that neither the newest state nor a pinned one names, abandoned transactions'
        rows, and commits that only older versions need. Snapshots before the horizon, or the oldest pin, are given up by a commit first. Writers
        must not be at work."""
        pins = self.pins()
        floor = min([self.log.head().horizon, *pins])
        if floor > self.log.head().floor:
            self.log.write_state(self._commit("vacuum", floor=floor), self.options.sync == "FULL")
        states = [self.log.head(), *(self.log.at(v) for v in set(pins))]
        live = {f.path.rsplit("/", 1)[0] for s in states for f in s.files.values()}
        there = {p.rsplit("/", 1)[0] for p in [*self.store.sizes("data"), *self.store.sizes("idx")]}
        gone = sorted(there - live)
        kept = set(self.store.ages("_pins"))
        for folder in [*gone, *(f"_txn/{n}" for n in self.store.names("_txn") if n not in kept)]:
            self.store.delete(folder)
        pruned = self.log.prune(floor)
        self.say.info("vacuumed %d folders and %d commits below version %d", len(gone), pruned, floor)
        return gone

    def backup(self, path: str) -> int:
        """Copies the newest version's files and the log up to it, that last and in order. A missing file fails the backup."""
        other = Store(self.spark, path)
        if other.names(Log.FOLDER):
            raise SchemaError(f"{path} already holds a table")
        with self.pinned() as version:
            state = self.log.at(version)
            with ThreadPoolExecutor(8) as pool:
                list(pool.map(lambda f: self.store.copy(f, other), state.files))
                names = [n for n in self.store.names(Log.FOLDER) if int(n.partition(".")[0]) <= version and n.endswith((".json", ".state"))]
                list(pool.map(lambda n: self.store.copy(f"{Log.FOLDER}/{n}", other), [n for n in names if not n.startswith(f"{version:020d}")]))
            for n in names:
                if n.startswith(f"{version:020d}"):
                    self.store.copy(f"{Log.FOLDER}/{n}", other)
        return version

    def check(self) -> DataFrame:
        """check, problems: files that are missing or other than the log says, doubled (key, version), index and rows at odds."""
        state, schema = self.log.head(), self.schema
        key = list(schema.key)
        sizes = self.store.sizes("data") | self.store.sizes("idx")
        bad = [f for f in state.files.values() if sizes.get(f.path) != f.bytes]
        found = [("files", len(bad))]
        if not bad:
            rows = self._rows(state)
            found.append(("row_counts", abs(rows.count() - sum(f.rows for f in state.files.values() if not f.index))))
            found.append(("key_versions", rows.groupBy(*key, VERSION).count().where("count > 1").count()))
            live = self.read()
            for index in schema.indexes:
                want, have = access.index_entries(live, index.columns, key), self.index(index.name)
                found.append((f"{index.name}_missing", want.exceptAll(have).count()))
                found.append((f"{index.name}_extra", have.exceptAll(want).count()))
        return self.spark.createDataFrame(found, "check string, problems long")

    def stats(self) -> DataFrame:
        """Files, rows and bytes by kind and level."""
        by: dict[tuple, list[int]] = {}
        for f in self.log.head().files.values():
            e = by.setdefault((next((i.name for i in self.schema.indexes if i.id == f.index), "rows"), f.level), [0, 0, 0])
            for k, n in enumerate((1, f.rows, f.bytes)):
                e[k] += n
        return self.spark.createDataFrame([(*k, *v) for k, v in sorted(by.items())], "kind string, level int, files long, rows long, bytes long")

    def follow(self, each: Callable[[DataFrame, int], None], after: int = 0) -> int:
        """Calls each(changes, version) for every version after the given one; returns the last."""
        for c in self.log.since(after):
            if c.op not in ("create", "schema", "compact", "index", "vacuum"):
                each(self.changes(c.version - 1, c.version), c.version)
            after = c.version
        return after
