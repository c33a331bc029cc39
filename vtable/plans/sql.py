"""SQL over mounted tables: queries go to Spark, writes and transactions to the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import DELETED
from ..sources.options import Options, parse_string
from ..sources.schema import split_top
from ..table import Table, UniqueViolation
from ..txn import Transaction

_NAME = r"([A-Za-z_]\w*)"


class SqlError(ValueError):
    """A statement that can't be read."""


class Session:
    """Mounted tables and at most one transaction, which takes in every table that it touches.

    A statement sees all tables at one moment: within a transaction, each at its snapshot with the transaction's own writes.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}
        self._txns: dict[str, Transaction] = {}
        self._in_txn, self._saves = False, []

    # tables -------------------------------------------------------------------------------------------------------------------

    def mount(self, name: str, path: str, sync: str = "", schema: str = "", options: str = "") -> Table:
        given = parse_string(options) | ({"sync": sync} if sync else {})
        self.tables[name.lower()] = table = Table.open(self.spark, path, schema or None, name, Options().with_(given))
        return table

    def unmount(self, name: str) -> None:
        """The data stays."""
        self.table(name)
        del self.tables[name.lower()]
        self.spark.catalog.dropTempView(name)

    def table(self, name: str) -> Table:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise SqlError(f"no table {name}") from None

    def begin(self) -> None:
        if self._in_txn:
            raise SqlError("a transaction is open")
        self._in_txn, self._saves = True, []
        self._txns = {n: t.begin() for n, t in self.tables.items()}

    def _end(self) -> dict[str, Transaction]:
        if not self._in_txn:
            raise SqlError("no transaction is open")
        txns, self._txns, self._in_txn, self._saves = self._txns, {}, False, []
        return txns

    def commit(self) -> None:
        """Each table commits by itself: a transaction over several tables is atomic for each of them only."""
        txns = self._end()
        try:
            for t in txns.values():
                t.commit()
        finally:
            for t in txns.values():
                t.rollback()

    def rollback(self) -> None:
        for t in self._end().values():
            t.rollback()

    def _each(self, what: str, name: str) -> None:
        if not self._in_txn:
            raise SqlError("no transaction is open")
        if what != "savepoint" and name not in self._saves:
            raise SqlError(f"no savepoint {name}")
        for t in self._txns.values():
            getattr(t, what)(name)
        if what == "savepoint":
            self._saves.append(name)
        else:
            last = len(self._saves) - 1 - self._saves[::-1].index(name)
            del self._saves[last + (what == "rollback_to") :]

    def _rows(self, name: str) -> DataFrame:
        return self._txns[name.lower()].read() if name.lower() in self._txns else self.table(name).read()

    def _views(self, text: str) -> None:
        """Views of the tables whose names the statement has."""
        words = {w.lower() for w in re.findall(r"\w+", text)}
        for name in self.tables:
            if name in words:
                self._rows(name).createOrReplaceTempView(name)

    # statements ---------------------------------------------------------------------------------------------------------------

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame | None:
        """A query's rows; None for other statements. args are the query's parameters."""
        text = text.strip().rstrip(";").strip()
        for pattern, do in self._STATEMENTS:
            if m := re.fullmatch(pattern, text, re.I | re.S):
                return do(self, *m.groups())
        self._views(text)
        return self.spark.sql(text, args=args)

    def _create(self, name: str, given: str) -> None:
        self.mount(name, *[re.sub(r"^(['\"])(.*)\1$", r"\2", p, flags=re.S) for p in split_quoted(given)])

    def _write(self, name: str, changes: DataFrame, op: str) -> None:
        if name.lower() in self._txns:
            self._txns[name.lower()]._add(changes)
        else:
            self.table(name).write(changes, op=op)

    def _insert(self, mode: str | None, name: str, columns: str | None, source: str) -> None:
        table = self.table(name)
        self._views(source)
        rows = self.spark.sql(f"SELECT * FROM ({source})" if re.match(r"\s*values", source, re.I) else source)
        names = [c.strip() for c in columns.split(",")] if columns else [f.name for f in table.schema.columns][: len(rows.columns)]
        if len(names) != len(rows.columns):
            raise SqlError(f"{name}: {len(rows.columns)} values for {len(names)} columns")
        rows, key = rows.toDF(*names), list(table.schema.key)
        mode = (mode or "").lower()
        if mode in ("ignore", "abort", "fail"):
            there = self._rows(name).select(*key)
            shaped = table._shape(rows)
            if mode == "ignore":
                rows = shaped.join(there, key, "left_anti")
            elif shaped.join(there, key, "left_semi").take(1):
                raise UniqueViolation(f"{name}: the key of a row is there")
        # of rows of one statement with one key the last counts, as if they came one by one
        if re.match(r"\s*values", source, re.I):
            last = rows.withColumn("_s", F.monotonically_increasing_id())
            rows = last.groupBy(*key).agg(F.max_by(F.struct(*[c for c in last.columns if c not in (*key, "_s")], F.lit(0).alias("_one")), "_s").alias("_r")).select(*key, "_r.*").drop("_one")
        self._write(name, rows, "insert")

    def _update(self, name: str, sets: str, where: str | None) -> None:
        table = self.table(name)
        values = {}
        for part in split_quoted(sets):
            column, _, expr = part.partition("=")
            values[column.strip()] = F.expr(expr.strip())
        rows = self._rows(name)
        self._write(name, table.updated(rows.where(where) if where else rows, values), "update")

    def _delete(self, name: str, where: str | None) -> None:
        rows = self._rows(name)
        self._write(name, (rows.where(where) if where else rows).withColumn(DELETED, F.lit(True)), "delete")

    def _rename(self, name: str, new: str) -> None:
        table = self.table(name)
        table.rename(new)
        del self.tables[name.lower()]
        self.spark.catalog.dropTempView(name)
        self.tables[new.lower()] = table

    def _index(self, unique: str | None, name: str, columns: str) -> None:
        self.table(name).add_index([c.strip() for c in columns.split(",")], bool(unique))

    def _add_column(self, name: str, column: str, kind: str) -> None:
        self.table(name).add_column(column, kind)

    def _drop_column(self, name: str, column: str) -> None:
        self.table(name).drop_column(column)

    def _alter_type(self, name: str, column: str, kind: str) -> None:
        self.table(name).alter_type(column, kind)

    def _drop_index(self, index: str, name: str) -> None:
        self.table(name).drop_index(index)

    def _show(self, name: str, what: str) -> DataFrame:
        return getattr(self.table(name), what.lower())()

    _STATEMENTS = [
        (rf"create\s+(?:virtual\s+)?table\s+(?:if\s+not\s+exists\s+)?{_NAME}\s+using\s+vtable\s*\((.*)\)", _create),
        (rf"drop\s+table\s+{_NAME}", unmount),
        (rf"(?:insert(?:\s+or\s+(ignore|abort|fail|replace))?|replace)\s+into\s+{_NAME}\s*(?:\(([^()]*)\))?\s*((?:values|select|with)\b.*)", _insert),
        (rf"update\s+{_NAME}\s+set\s+(.*?)(?:\s+where\s+(.*))?", _update),
        (rf"delete\s+from\s+{_NAME}(?:\s+where\s+(.*))?", _delete),
        (r"begin(?:\s+transaction)?", begin),
        (r"commit|end", commit),
        (r"rollback", rollback),
        (rf"savepoint\s+{_NAME}", lambda s, n: s._each("savepoint", n)),
        (rf"release(?:\s+savepoint)?\s+{_NAME}", lambda s, n: s._each("release", n)),
        (rf"rollback\s+to(?:\s+savepoint)?\s+{_NAME}", lambda s, n: s._each("rollback_to", n)),
        (rf"alter\s+table\s+{_NAME}\s+add\s+(?:column\s+)?(\w+)\s+(.+)", _add_column),
        (rf"alter\s+table\s+{_NAME}\s+rename\s+to\s+{_NAME}", _rename),
        (rf"alter\s+table\s+{_NAME}\s+drop\s+(?:column\s+)?(\w+)", _drop_column),
        (rf"alter\s+table\s+{_NAME}\s+alter\s+(?:column\s+)?(\w+)\s+type\s+(.+)", _alter_type),
        (rf"drop\s+index\s+(\w+)\s+on\s+{_NAME}", _drop_index),
        (rf"create\s+(unique\s+)?index\s+(?:\w+\s+)?on\s+{_NAME}\s*\(([^()]*)\)", _index),
        (rf"backup\s+{_NAME}\s+to\s+'([^']*)'", lambda s, n, p: s.table(n).backup(p) and None),
        (rf"compact\s+{_NAME}", lambda s, n: s.table(n).compact(True) and None),
        (rf"table\s+{_NAME}\s+(check|stats)", _show),
    ]


def split_quoted(text: str) -> list[str]:
    """Parts between commas outside quotes and parentheses."""
    parts, last, quote, depth = [], "", "", 0
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        else:
            depth += (ch == "(") - (ch == ")")
        if ch == "," and not quote and not depth:
            parts.append(last.strip())
            last = ""
        else:
            last += ch
    return [*parts, last.strip()]
