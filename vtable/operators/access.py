"""Access paths over a resolved snapshot or an index: what is asked for is put as a filter, and Catalyst takes it to the scan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of a multi-get that are sent as a literal list; more are joined.
LITERAL_KEYS = 1000
#: Rows that a prefix scan gives if nothing else is said.
PREFIX_LIMIT = 20


def key_equals(df: DataFrame, key: Sequence[str], values: Sequence[Any]) -> Column:
    """A predicate; each value is cast to its column's type, so that text literals find binary keys."""
    cond = F.lit(True)
    for name, value in zip(key, values, strict=True):
        cond &= F.col(name) == F.lit(value).cast(df.schema[name].dataType)
    return cond


def point(df: DataFrame, key: Sequence[str], *values: Any) -> DataFrame:
    return df.where(key_equals(df, key, values))


def multi(df: DataFrame, key: Sequence[str], keys: Sequence[Any] | DataFrame) -> DataFrame:
    """The rows of many keys: a short list of one-column keys is a pushed-down IN, anything else a semi join."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(*key).distinct(), list(key), "left_semi")
    if len(key) == 1 and len(keys) <= LITERAL_KEYS:
        kind = df.schema[key[0]].dataType
        return df.where(is_one_of(key[0], kind, keys)) if keys else df.limit(0)
    wanted = df.sparkSession.createDataFrame([k if isinstance(k, tuple) else (k,) for k in keys], df.select(*key).schema)
    return df.join(wanted.distinct(), list(key), "left_semi")


def is_one_of(column: str, kind: T.DataType, values: Sequence[Any]) -> Column:
    """column IN (values), as one expression: a thousand single literals take longer to send to the JVM than to look up."""
    if not values:
        return F.lit(False)
    if isinstance(kind, T.IntegralType) and all(isinstance(v, int) for v in values):
        return F.expr(f"`{column}` IN ({', '.join(f'cast({v}L as {kind.simpleString()})' if not -(2**31) <= v < 2**31 else str(v) for v in values)})")
    if isinstance(kind, T.StringType) and all(isinstance(v, str) for v in values):
        quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
        return F.expr(f"`{column}` IN ({', '.join(quoted)})")
    return F.col(column).isin([F.lit(v).cast(kind) for v in values])


def few_values(df: DataFrame, column: str, most: int = LITERAL_KEYS) -> list[Any] | None:
    """The distinct values of a column, or None if there are more than most."""
    found = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    return found if len(found) <= most else None


def key_range(df: DataFrame, column: str, low: Any = None, high: Any = None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Rows with column between low and high, where given; either end may be open."""
    kind = df.schema[column].dataType
    if low is not None:
        bound = F.lit(low).cast(kind)
        df = df.where(F.col(column) > bound if low_open else F.col(column) >= bound)
    if high is not None:
        bound = F.lit(high).cast(kind)
        df = df.where(F.col(column) < bound if high_open else F.col(column) <= bound)
    return df


def seek(df: DataFrame, key: Sequence[str], start: Any, limit: int) -> DataFrame:
    """The first limit rows from start on, in key order: one top-k, no full sort."""
    return key_range(df, key[0], start).orderBy(*key).limit(limit)


def prefix(df: DataFrame, column: str, start: str, limit: int | None = PREFIX_LIMIT) -> DataFrame:
    """Rows whose text or binary column begins with start, in its order."""
    found = df.where(F.col(column).startswith(F.lit(start).cast(df.schema[column].dataType))).orderBy(column)
    return found if limit is None else found.limit(limit)


def by_index(df: DataFrame, key: Sequence[str], index: DataFrame, found: Column) -> DataFrame:
    """Rows of df that the entries of index, which holds indexed columns and key, name where found holds.

    Few entries are found as a rule: adaptive execution then broadcasts them once it has seen their size.
    """
    return df.join(index.where(found).select(*key).distinct(), list(key), "left_semi")


def index_entries(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """What an index on columns holds for the rows of df."""
    return df.select(*dict.fromkeys([*columns, *key]))
