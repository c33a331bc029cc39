"""Table schemas: columns, primary key, indexes; a DDL parser and JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


class SchemaError(ValueError):
    """A declaration, a column or a row doesn't fit a table."""


#: Declared type names and the types that they stand for; any other name is taken as Spark's, if it is one.
TYPE_NAMES = {"INT": "bigint", "INTEGER": "bigint", "REAL": "double", "FLOAT": "double", "TEXT": "string", "BLOB": "binary", "NULL": "void"}
RESERVED = ("_v", "_d")
#: What an empty declaration means.
DEFAULT_DDL = "key BLOB PRIMARY KEY, value BLOB"


def spark_type(name: str) -> T.DataType:
    name = name.strip()
    if re.match(r"(var)?char\b", name, re.I):
        return T.StringType()
    try:
        return T.DataType.fromDDL(TYPE_NAMES.get(name.upper(), name.lower()))
    except Exception:
        return T.BinaryType()  # as for any unknown name in the declarations that this follows


@dataclass(frozen=True)
class Column:
    id: int
    name: str
    type: str

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, T.NullType() if self.type == "void" else T.DataType.fromDDL(self.type))


@dataclass(frozen=True)
class Index:
    id: int
    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...]
    indexes: tuple[Index, ...] = field(default=())
    #: Names of dropped columns, and the highest number of a dropped index: neither is given again.
    past_columns: tuple[str, ...] = ()
    past_index: int = 0

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len({n.lower() for n in names}) != len(names):
            raise SchemaError(f"{self.name}: two columns have one name")
        if any(n.lower() in RESERVED for n in names):
            raise SchemaError(f"{self.name}: {', '.join(RESERVED)} are reserved")
        if not self.key:
            raise SchemaError(f"{self.name}: a primary key is needed")
        for used in (self.key, *(i.columns for i in self.indexes)):
            if missing := [c for c in used if c not in names]:
                raise SchemaError(f"{self.name}: no column {', '.join(missing)}")

    @property
    def struct(self) -> T.StructType:
        return T.StructType([c.field for c in self.columns])

    @property
    def stored(self) -> T.StructType:
        """Columns that files hold: Parquet has no type for columns that are always null."""
        return T.StructType([c.field for c in self.columns if c.type != "void"])

    def index(self, name: str) -> Index:
        for i in self.indexes:
            if i.name == name:
                return i
        raise SchemaError(f"{self.name}: no index {name}")

    def drop_column(self, name: str) -> TableSchema:
        """Without a column that is in no key or index. Its name can't be given again: files still hold its values."""
        self._loose(name)
        return replace(self, columns=tuple(c for c in self.columns if c.name != name), past_columns=(*self.past_columns, name))

    def alter_type(self, name: str, kind: str) -> TableSchema:
        """With another type of a column that is in no key or index."""
        self._loose(name)
        return replace(self, columns=tuple(replace(c, type=spark_type(kind).simpleString()) if c.name == name else c for c in self.columns))

    def _loose(self, name: str) -> None:
        if name not in [c.name for c in self.columns]:
            raise SchemaError(f"{self.name}: no column {name}")
        if name in self.key or any(name in i.columns for i in self.indexes):
            raise SchemaError(f"{self.name}: {name} is in the key or an index")

    def drop_index(self, name: str) -> TableSchema:
        gone = self.index(name)
        return replace(self, indexes=tuple(i for i in self.indexes if i.name != name), past_index=max(self.past_index, gone.id))

    def add_column(self, name: str, kind: str) -> TableSchema:
        if name.lower() in [c.lower() for c in self.past_columns]:
            raise SchemaError(f"{self.name}: {name} was dropped; its name can't be given again")
        new = Column(max(c.id for c in self.columns) + 1, name, spark_type(kind).simpleString())
        return replace(self, columns=(*self.columns, new))

    def add_index(self, columns: tuple[str, ...], unique: bool = False, name: str | None = None) -> TableSchema:
        number = max((i.id for i in self.indexes), default=0)
        number = max(number, self.past_index) + 1
        name = name or f"{'uidx' if unique else 'idx'}_{self.name}_{'_'.join(columns)}"
        return replace(self, indexes=(*self.indexes, Index(number, name, tuple(columns), unique)))

    def merge(self, declared: TableSchema) -> TableSchema:
        """With the columns that only declared has behind the others; nothing else of it counts."""
        out, have = self, {c.name for c in self.columns}
        for c in declared.columns:
            if c.name not in have:
                out = out.add_column(c.name, c.type)
        return out

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "columns": [[c.id, c.name, c.type] for c in self.columns], "key": self.key, "indexes": [[i.id, i.name, i.columns, i.unique] for i in self.indexes], "past_columns": self.past_columns, "past_index": self.past_index})

    @classmethod
    def from_json(cls, text: str) -> TableSchema:
        d = json.loads(text)
        return cls(d["name"], tuple(Column(*c) for c in d["columns"]), tuple(d["key"]), tuple(Index(i, n, tuple(c), u) for i, n, c, u in d["indexes"]), tuple(d.get("past_columns", ())), d.get("past_index", 0))

    @classmethod
    def of(cls, name: str, struct: T.StructType, key: list[str] | tuple[str, ...], indexes: tuple[tuple[tuple[str, ...], bool], ...] = ()) -> TableSchema:
        out = cls(name, tuple(Column(k + 1, f.name, f.dataType.simpleString()) for k, f in enumerate(struct.fields)), tuple(key))
        for columns, unique in indexes:
            out = out.add_index(tuple(columns), unique)
        return out


def split_top(text: str) -> list[str]:
    """Parts between commas that no parentheses or angle brackets enclose."""
    parts, depth, last = [], 0, ""
    for ch in text:
        depth += (ch in "(<") - (ch in ")>")
        if depth < 0:
            raise SchemaError(f"unbalanced: {text}")
        if ch == "," and not depth:
            parts.append(last)
            last = ""
        else:
            last += ch
    if depth:
        raise SchemaError(f"unbalanced: {text}")
    return [p.strip() for p in [*parts, last] if p.strip()]


_LIST = r"\s*\(([^()]*)\)\s*$"


def parse_ddl(name: str, ddl: str) -> TableSchema:
    """A schema from `col TYPE [PRIMARY KEY | PK | UNIQUE], PRIMARY KEY (a, b), INDEX (a, b), UNIQUE INDEX (a)`.

    Keywords are case-insensitive and declarations may come in any order. Nothing at all stands for DEFAULT_DDL.
    """
    columns, key, lists = [], [], []
    for part in split_top(ddl) or split_top(DEFAULT_DDL):
        if m := re.match(r"primary\s+key" + _LIST, part, re.I):
            key += split_top(m[1])
        elif m := re.match(r"(unique\s+)?index(?:\s+(\w+))?" + _LIST, part, re.I):
            lists.append((tuple(split_top(m[3])), bool(m[1]), m[2]))
        elif m := re.match(r"unique" + _LIST, part, re.I):
            lists.append((tuple(split_top(m[1])), True, None))
        elif m := re.match(r"(\w+)\s+([\w<>:,\s()]+?)((?:\s+(?:primary\s+key|pk|unique|not\s+null))*)$", part, re.I):
            columns.append((m[1], m[2]))
            if re.search(r"primary\s+key|\bpk\b", m[3], re.I):
                key.append(m[1])
            elif re.search("unique", m[3], re.I):
                lists.append(((m[1],), True, None))
        else:
            raise SchemaError(f"{name}: can't read {part!r}")
    out = TableSchema(name, tuple(Column(k + 1, c, spark_type(t).simpleString()) for k, (c, t) in enumerate(columns)), tuple(key))
    for cols, unique, own in lists:
        out = out.add_index(cols, unique, own)
    return replace(out)
