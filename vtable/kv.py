"""A key-value store of byte strings on a table: open, put, get, delete, iterate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.resolve import DELETED
from .sources.options import Options
from .table import Table


def as_bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


class KV:
    """Keys in the order of their unsigned bytes. An empty value is a delete, so it is never read back."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.table = Table.open(spark, path, options=options)

    def close(self) -> None:
        self.table.close()

    def put(self, key: bytes | str, value: bytes | str) -> None:
        self.put_many([(key, value)])

    def put_many(self, pairs: Sequence[tuple[bytes | str, bytes | str]]) -> int | None:
        """All pairs in one commit; of pairs with one key the last counts."""
        last = {as_bytes(k): as_bytes(v) for k, v in pairs}
        return self.put_frame(self.table.frame(list(last.items()))) if last else None

    def put_frame(self, pairs: DataFrame) -> int | None:
        """Columns key and value, one row for a key."""
        return self.table.write(pairs.withColumn(DELETED, F.coalesce(F.length("value") == 0, F.lit(True))))

    def get(self, key: bytes | str, version: int | None = None) -> bytes | None:
        found = self.table.get(as_bytes(key), as_of=version)
        return bytes(found["value"]) if found else None

    def delete(self, key: bytes | str) -> None:
        self.table.delete_keys([as_bytes(key)])

    def scan(self, start: bytes | str = b"", limit: int | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Pairs from start on in key order, a partition at a time on the driver."""
        rows = self.table.range(as_bytes(start)).orderBy("key")
        for r in (rows if limit is None else rows.limit(limit)).toLocalIterator():
            yield bytes(r.key), bytes(r.value)

    def prefix(self, start: bytes | str, limit: int | None = 20) -> list[tuple[bytes, bytes]]:
        return [(bytes(r.key), bytes(r.value)) for r in self.table.prefix(as_bytes(start), limit).collect()]

    def iterator(self) -> Cursor:
        return Cursor(self)

    def count(self) -> int:
        return self.table.count()


class Cursor:
    """seek, valid, next, key, value over the snapshot of when it was made."""

    def __init__(self, kv: KV):
        self._rows, self._at, self._version = kv.table.read(kv.table.version), None, kv.table.version
        self._it: Iterator = iter(())

    def seek(self, start: bytes | str = b"") -> None:
        self._it = self._rows.where(F.col("key") >= F.lit(as_bytes(start))).orderBy("key").toLocalIterator(prefetchPartitions=True)
        self.next()

    def next(self) -> None:
        self._at = next(self._it, None)

    def valid(self) -> bool:
        return self._at is not None

    def key(self) -> bytes:
        return bytes(self._at.key)

    def value(self) -> bytes:
        return bytes(self._at.value)
