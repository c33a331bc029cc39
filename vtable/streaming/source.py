"""A table's change feed as a Spark data source, for batches and streams: spark.readStream.format("vtable_changes").load(path)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.schema import TableSchema


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _commits(path: str, after: int, until: int | None = None) -> list[dict]:
    fs, base = _filesystem(path)
    found = fs.get_file_info(pafs.FileSelector(f"{base}/_log", allow_not_found=True))
    numbers = sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))
    out = []
    for n in numbers:
        if n > after and (until is None or n <= until):
            with fs.open_input_stream(f"{base}/_log/{n:020d}.json") as s:
                out.append(json.loads(s.read()))
    return out


def _schema(path: str) -> str:
    """The newest schema: that of the newest commit that has one, else of the newest written state."""
    if found := [c["schema"] for c in _commits(path, 0) if c["schema"]]:
        return found[-1]
    fs, base = _filesystem(path)
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/_log")) if f.base_name.endswith(".state"))
    with fs.open_input_stream(names[-1]) as s:
        return json.loads(s.read())["schema"]


def live_files(path: str) -> list[dict]:
    """The files of the newest state, as the log has them."""
    fs, base = _filesystem(path)
    states = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/_log")) if f.base_name.endswith(".state"))
    files, last = {}, 0
    if states:
        with fs.open_input_stream(states[-1]) as s:
            state = json.loads(s.read())
        files, last = {f["path"]: f for f in state["files"]}, state["version"]
    for c in _commits(path, last):
        for gone in c["remove"]:
            files.pop(gone, None)
        files |= {f["path"]: f for f in c["add"]}
    return list(files.values())


class FilePart(InputPartition):
    def __init__(self, path: str, version: int):
        super().__init__(None)
        self.path, self.version = path, version


class _Reader:
    """Partitions are data files of level 0, one for each task; rows come as Arrow batches."""

    def __init__(self, schema: StructType, path: str):
        self.schema, self.path = schema, path

    def parts(self, after: int, until: int) -> list[FilePart]:
        return [FilePart(f["path"], c["version"]) for c in _commits(self.path, after, until) if c["op"] not in ("compact", "index", "vacuum") for f in c["add"] if not f["index"]]

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, base = _filesystem(self.path)
        want = to_arrow_schema(self.schema)
        with fs.open_input_file(f"{base}/{part.path}") as f:
            for b in pq.ParquetFile(f).iter_batches(10_000):
                columns = []
                for field in want:
                    if field.name == "_v":
                        columns.append(pa.array([part.version] * b.num_rows, pa.int64()))
                    elif field.name in b.schema.names:
                        columns.append(b.column(b.schema.names.index(field.name)).cast(field.type))
                    else:
                        columns.append(pa.nulls(b.num_rows, field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, f.type) for f in want]))


class BatchReader(_Reader, DataSourceReader):
    def __init__(self, schema: StructType, path: str, after: int, until: int | None):
        super().__init__(schema, path)
        self.after, self.until = after, until

    def partitions(self) -> list[FilePart]:
        until = self.until if self.until is not None else max([c["version"] for c in _commits(self.path, self.after)], default=self.after)
        return self.parts(self.after, until)


class StreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str, after: int):
        super().__init__(schema, path)
        self.after = after

    def initialOffset(self) -> dict:
        return {"version": self.after}

    def latestOffset(self) -> dict:
        return {"version": max([c["version"] for c in _commits(self.path, self.after)], default=self.after)}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        return self.parts(start["version"], end["version"])

    def commit(self, end: dict) -> None:
        self.after = max(self.after, end["version"])


class ChangeFeed(DataSource):
    """Options: after and until, versions. Changes that compaction and vacuum have removed can't be read again."""

    @classmethod
    def name(cls) -> str:
        return "vtable_changes"

    def schema(self) -> str:
        text = _schema(self.options["path"])
        columns = [(c.name, c.type) for c in TableSchema.from_json(text).columns if c.type != "void"]
        return ", ".join(f"`{n}` {t}" for n, t in [*columns, ("_d", "boolean"), ("_v", "bigint")])

    def reader(self, schema: StructType) -> DataSourceReader:
        until = self.options.get("until")
        return BatchReader(schema, self.options["path"], int(self.options.get("after", 0)), int(until) if until else None)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(schema, self.options["path"], int(self.options.get("after", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeFeed)
