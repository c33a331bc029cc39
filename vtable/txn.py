"""Optimistic transactions: a snapshot, a buffer that reads see, savepoints, first committer wins."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import access, resolve
from .operators.resolve import DELETED
from .table import ConflictError, Table


class Transaction:
    """Each statement's change rows are written to the table's folder, under the transaction's own name, and the transaction is the list of
    their folders; the last one wins for a key. A savepoint is a length of the list. So a plan is as large after many statements as after one."""

    def __init__(self, table: Table):
        self.table, self.read_version = table, table.version
        self._ops: list[int] = []
        self._made = 0
        self._saves: list[tuple[str, int]] = []
        self._pin = table.pin(self.read_version)
        self.open = True

    def _need_open(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction has ended")

    def buffer(self) -> DataFrame | None:
        """One change row for each written key."""
        if not self._ops:
            return None
        struct = self.table.schema.stored
        struct = T.StructType([*struct.fields, T.StructField(DELETED, T.BooleanType())])
        base = f"{self.table.path}/_txn/{self._pin}"
        rows = self.table.spark.read.schema(struct).parquet(*[f"{base}/{k}" for k in self._ops])
        number = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1).cast("int")
        return resolve.newest(rows.withColumn("_s", number), self.table.schema.key, "_s").drop("_s")

    def read(self) -> DataFrame:
        """The snapshot with this transaction's writes over it."""
        self._need_open()
        base, buffer = self.table.read(self.read_version), self.buffer()
        return base if buffer is None else resolve.overlay(base, buffer, self.table.schema.key)

    def get(self, *key: Any) -> dict | None:
        found = access.point(self.read(), self.table.schema.key, *key).take(1)
        return found[0].asDict(True) if found else None

    def lookup(self, index: str, *values: Any) -> DataFrame:
        """Rows by indexed values: the index at the snapshot finds committed rows, the buffer is looked through itself."""
        self._need_open()
        rows, buffer = self.table.lookup(index, *values, as_of=self.read_version), self.buffer()
        if buffer is None:
            return rows
        out = resolve.overlay(rows, buffer, self.table.schema.key)
        return out.where(access.key_equals(out, self.table.schema.index(index).columns[: len(values)], values))

    def _add(self, changes: DataFrame) -> None:
        self._need_open()
        self.table._shape(changes).write.parquet(f"{self.table.path}/_txn/{self._pin}/{self._made}")
        self._ops.append(self._made)
        self._made += 1

    def put(self, rows: DataFrame | Sequence) -> None:
        self._add(rows if isinstance(rows, DataFrame) else self.table.frame(rows))

    insert = put

    def update(self, condition: Column | str, values: dict[str, Any]) -> None:
        self._add(self.table.updated(self.read().where(condition), values))

    def delete(self, condition: Column | str) -> None:
        self._add(self.read().where(condition).withColumn(DELETED, F.lit(True)))

    def delete_keys(self, keys: Sequence[Any]) -> None:
        rows = self.table.frame([k if isinstance(k, tuple) else (k,) for k in keys], self.table.schema.key)
        self._add(rows.withColumn(DELETED, F.lit(True)))

    def savepoint(self, name: str) -> None:
        self._need_open()
        self._saves.append((name, len(self._ops)))

    def _find(self, name: str) -> int:
        for k in range(len(self._saves) - 1, -1, -1):
            if self._saves[k][0] == name:
                return k
        raise KeyError(f"no savepoint {name}")

    def release(self, name: str) -> None:
        """Forgets the savepoint and those within; the writes stay."""
        del self._saves[self._find(name) :]

    def rollback_to(self, name: str) -> None:
        """Undoes the writes since the savepoint, which stays; those within go."""
        k = self._find(name)
        del self._ops[self._saves[k][1] :]
        del self._saves[k + 1 :]

    def rollback(self) -> None:
        if self.open:
            self.table.store.delete(f"_txn/{self._pin}")
            self.table.unpin(self._pin)
        self.open, self._ops = False, []

    def commit(self) -> int:
        """The new version, or the read version if nothing was written."""
        self._need_open()
        buffer = self.buffer()
        try:
            return self.read_version if buffer is None else self.table.write(buffer, self.read_version, "txn")
        finally:
            self.rollback()


def commit_all(transactions: Sequence[Transaction]) -> list[int | ConflictError]:
    """Commits one after another, each checked against those before it: its version, or the conflict."""
    out: list[int | ConflictError] = []
    for t in transactions:
        try:
            out.append(t.commit())
        except ConflictError as e:
            out.append(e)
    return out
