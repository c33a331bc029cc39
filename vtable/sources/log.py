"""The commit log of a table: numbered JSON files that name the data files of each version."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import SparkSession


#: Commits between written states.
EVERY = 50


class CorruptTable(RuntimeError):
    """A commit can't be read, or files that it names are missing."""


class SlotTaken(Exception):
    """Someone else has committed under the number."""


@dataclass(frozen=True)
class DataFile:
    """A Parquet file below the table's folder. index 0 holds rows, others entries of that index. single: one live row for each key."""

    path: str
    rows: int
    bytes: int
    level: int = 0
    index: int = 0
    low: Any = None
    high: Any = None
    low_v: int = 0
    high_v: int = 0
    single: bool = False
    #: Rows whose first key column, which low and high are of, is null; only entries of an index have such.
    nulls: int = 0

    @property
    def folder(self) -> str:
        return self.path.split("/")[-2]

    def may_hold(self, low: Any, high: Any) -> bool:
        return self.low is None or not ((low is not None and self.high < low) or (high is not None and self.low > high))


@dataclass
class Commit:
    version: int = 0
    op: str = "write"
    read_version: int = 0
    add: list[DataFile] = field(default_factory=list)
    remove: list[str] = field(default_factory=list)
    schema: str | None = None
    horizon: int | None = None
    batch: str | None = None
    #: The index that this commit has made; the version below which files have been deleted.
    index: int | None = None
    floor: int | None = None

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Commit:
        d = json.loads(text)
        return cls(**d | {"add": [DataFile(**f) for f in d["add"]]})


@dataclass
class State:
    """What the log says up to a version."""

    version: int = 0
    schema: str | None = None
    files: dict[str, DataFile] = field(default_factory=dict)
    horizon: int = 0
    #: The highest number of a micro-batch by stream.
    batches: dict[str, int] = field(default_factory=dict)
    #: Indexes made after the table, with their versions.
    born: dict[str, int] = field(default_factory=dict)
    floor: int = 0

    def dump(self) -> str:
        return json.dumps(asdict(self) | {"files": [asdict(f) for f in self.files.values()]})

    @classmethod
    def load(cls, text: str) -> State:
        d = json.loads(text)
        return cls(**d | {"files": {f["path"]: DataFile(**f) for f in d["files"]}})

    def apply(self, c: Commit) -> None:
        self.version = c.version
        self.schema = c.schema or self.schema
        for path in c.remove:
            self.files.pop(path, None)
        self.files |= {f.path: f for f in c.add}
        self.horizon = max(self.horizon, c.horizon or 0)
        self.floor = max(self.floor, c.floor or 0)
        if c.index:
            self.born[str(c.index)] = c.version
        if c.batch:
            name, number = batch_number(c.batch)
            self.batches[name] = max(number, self.batches.get(name, -1))

    def has_batch(self, batch: str) -> bool:
        name, number = batch_number(batch)
        return self.batches.get(name, -1) >= number


def batch_number(batch: str) -> tuple[str, int]:
    """Stream and number of `stream:number`; any other text is a stream of its own with the number 0."""
    name, _, number = batch.rpartition(":")
    return (name, int(number)) if name and number.isdigit() else (batch, 0)


#: Stores in which a rename is atomic and fails if the target is there, besides the local disk.
ATOMIC_RENAME = ("hdfs", "viewfs", "webhdfs", "abfs", "abfss", "ofs")


class Store:
    """Files of a table's folder through Hadoop's file systems. Commits need a store that can create a file whole or not at all: the local disk,
    or one of ATOMIC_RENAME."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self._conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def local_path(self, name: str) -> str:
        return self.path(name).toUri().getPath()

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def sizes(self, folder: str) -> dict[str, int]:
        """Name to bytes of the files below folder."""
        out: dict[str, int] = {}
        if not self.fs.exists(self.path(folder)):
            return out
        base = self.path("").toUri().getPath().rstrip("/") + "/"
        it = self.fs.listFiles(self.path(folder), True)
        while it.hasNext():
            s = it.next()
            out[s.getPath().toUri().getPath().removeprefix(base)] = s.getLen()
        return out

    def read(self, name: str) -> str:
        if self.local:
            with open(self.local_path(name)) as f:
                return f.read()
        stream = self.fs.open(self.path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, sync: bool) -> None:
        """Creates a file whole or not at all; SlotTaken if it is there."""
        if self.local:
            target = self.local_path(name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            temp = f"{target}.{uuid.uuid4().hex}.tmp"
            with open(temp, "w") as f:
                f.write(text)
                if sync:
                    f.flush()
                    os.fsync(f.fileno())
            try:
                os.link(temp, target)
            except FileExistsError:
                raise SlotTaken(name) from None
            finally:
                os.unlink(temp)
            return
        self._put(name, text, sync)

    def _put(self, name: str, text: str, sync: bool) -> None:
        """The file is written under another name and renamed, which fails if the target is there; a reader never sees half of it."""
        scheme = self.fs.getUri().getScheme()
        if scheme not in (*ATOMIC_RENAME, "file"):
            raise CorruptTable(f"{scheme}: this store can't create a file whole or not at all")
        jvm = self.spark.sparkContext._jvm
        temp = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(temp, False)
        try:
            stream.write(bytearray(text.encode()))
            if sync:
                stream.hsync()
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, self.path(name), options)
        except Exception as e:
            self.fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise SlotTaken(name) from e
            raise

    def sync(self, names: list[str]) -> None:
        """Forces files to the disk, where that is this machine's; other stores have written them when they are closed."""
        if self.local:
            for name in names:
                with open(self.local_path(name), "rb") as f:
                    os.fsync(f.fileno())

    def put(self, name: str, text: str) -> None:
        """A small file under a name that nobody else uses."""
        if not self.fs.exists(self.path(name).getParent()):
            self.fs.mkdirs(self.path(name).getParent())
        self.create(name, text, False)

    def ages(self, folder: str) -> dict[str, int]:
        """Name to milliseconds since its last change of the files in folder."""
        if not self.fs.exists(self.path(folder)):
            return {}
        return {s.getPath().getName(): int(time.time() * 1000) - s.getModificationTime() for s in self.fs.listStatus(self.path(folder))}

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def copy(self, name: str, other: Store) -> None:
        if not self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(name), other.fs, other.path(name), False, self._conf):
            raise CorruptTable(f"{name} can't be copied")


class Log:
    """Commits below _log; a version is a file's number, so a transaction's rows share one."""

    FOLDER = "_log"

    def __init__(self, store: Store):
        self.store, self._state = store, State()

    @staticmethod
    def name(version: int) -> str:
        return f"{Log.FOLDER}/{version:020d}.json"

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.store.names(self.FOLDER) if n.endswith(".json")]

    def commit_at(self, version: int) -> Commit:
        try:
            c = Commit.load(self.store.read(self.name(version)))
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptTable(f"commit {version} can't be read: {e}") from e
        if c.version != version:
            raise CorruptTable(f"commit {version} says that it is {c.version}")
        return c

    def _checkpoint(self, most: int) -> State:
        """The newest written state of a version up to most; an empty one if there is none."""
        found = [int(n.removesuffix(".state")) for n in self.store.names(self.FOLDER) if n.endswith(".state")]
        if not (kept := [v for v in found if v <= most]):
            return State()
        try:
            return State.load(self.store.read(f"{self.FOLDER}/{max(kept):020d}.state"))
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptTable(f"the state at {max(kept)} can't be read: {e}") from e

    def head(self) -> State:
        """The newest state; only commits that are new since the last call, or since the last written state, are read."""
        if not self._state.version:
            self._state = self._checkpoint(1 << 62)
        for v in self.versions():
            if v > self._state.version:
                if v != self._state.version + 1:
                    raise CorruptTable(f"commit {self._state.version + 1} is missing")
                self._state.apply(self.commit_at(v))
        return self._state

    def at(self, version: int) -> State:
        state = self._checkpoint(version)
        for v in self.versions():
            if state.version < v <= version:
                state.apply(self.commit_at(v))
        return state

    def write_state(self, version: int, sync: bool) -> None:
        try:
            self.store.create(f"{self.FOLDER}/{version:020d}.state", self.at(version).dump(), sync)
        except SlotTaken:
            pass

    def prune(self, floor: int) -> int:
        """Deletes the commits and states that no version from floor on needs; how many."""
        states = [int(n.removesuffix(".state")) for n in self.store.names(self.FOLDER) if n.endswith(".state")]
        if not (low := max([v for v in states if v <= floor], default=0)):
            return 0
        gone = [self.name(v) for v in self.versions() if v < low] + [f"{self.FOLDER}/{v:020d}.state" for v in states if v < low]
        for name in gone:
            self.store.delete(name)
        return len(gone)

    def since(self, version: int) -> list[Commit]:
        return [self.commit_at(v) for v in self.versions() if v > version]

    def append(self, commit: Commit, sync: bool) -> None:
        """Creates the commit; at every EVERY-th version the state is written too, for those who open the table later."""
        self.store.create(self.name(commit.version), commit.dump(), sync)
        if commit.version % EVERY == 0:
            self.write_state(commit.version, sync)
