"""Two shells: python -m vtable.cli kv PATH, and python -m vtable.cli sql PATH [--sql STATEMENT]."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from .kv import KV
from .plans.sql import Session
from .sources.options import Options, parse_file

KV_HELP = "open PATH, close, put KEY VALUE, get KEY, del KEY, scan PREFIX [LIMIT], count, stats, help, exit"


def _table(df) -> Iterator[str]:
    """The names of the columns, then every row; the driver holds a partition at a time."""
    yield "|".join(df.columns)
    for r in df.toLocalIterator():
        yield "|".join("" if v is None else str(v) for v in r)


class KvShell:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.kv = spark, KV(spark, path) if path else None

    def lines(self, line: str) -> list[str] | None:
        return self.run(line)

    def run(self, line: str) -> list[str] | None:
        """Lines to print; None ends the shell."""
        word, *rest = line.split(maxsplit=2) or [""]
        if word in ("exit", "quit"):
            return None
        if word == "help":
            return [KV_HELP]
        if word == "open" and rest:
            self.kv = KV(self.spark, rest[0])
            return ["OK"]
        if not word:
            return []
        if self.kv is None:
            return ["no database is open"]
        match word, rest:
            case "close", []:
                self.kv.close()
                self.kv = None
                return ["OK"]
            case "put", [key, value]:
                self.kv.put(key, value)
                return ["OK"]
            case "get", [key]:
                found = self.kv.get(key)
                return ["(nil)" if found is None else found.decode(errors="replace")]
            case "del", [key]:
                self.kv.delete(key)
                return ["OK"]
            case "scan", [start, *limit]:
                found = self.kv.prefix(start, int(limit[0]) if limit else 20)
                return [f"{k.decode(errors='replace')} = {v.decode(errors='replace')}" for k, v in found]
            case "count", []:
                return [str(self.kv.count())]
            case "stats", []:
                return list(_table(self.kv.table.stats()))
        return [f"can't read {line!r}; {KV_HELP}"]


class SqlShell:
    """The table in a path is mounted as `data`."""

    def __init__(self, spark: SparkSession, path: str, options: dict[str, str] | None = None):
        self.session = Session(spark)
        self.session.mount("data", path, options=";".join(f"{k}={v}" for k, v in (options or {}).items()))

    def run(self, statement: str) -> list[str] | None:
        out = self.lines(statement)
        return None if out is None else list(out)

    def lines(self, statement: str) -> Iterable[str] | None:
        """What run gives, a result's rows as they come."""
        text = statement.strip().rstrip(";")
        if text in (".exit", ".quit"):
            return None
        if text == ".stats":
            table = self.session.table("data")
            return [*_table(table.stats()), *(f"{k}={v}" for k, v in table.metrics.counts.items())]
        if not text:
            return []
        out = self.session.sql(text)
        return ["OK"] if out is None else _table(out)


def statements(lines: Iterable[str]) -> Iterable[str]:
    """Lines gathered up to a semicolon; a line that begins with a dot is a statement."""
    held = ""
    for line in lines:
        if not held and line.startswith("."):
            yield line.strip()
            continue
        held += line if line.endswith("\n") else line + "\n"
        if line.rstrip().endswith(";"):
            yield held
            held = ""
    if held.strip():
        yield held


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vtable")
    p.add_argument("shell", choices=("kv", "sql"))
    p.add_argument("path", nargs="?")
    p.add_argument("--config")
    p.add_argument("--compact-at", dest="l0_limit")
    p.add_argument("--mem", help="the driver's memory, such as 4g")
    p.add_argument("--cache", help="share of the memory for cached data, 0 to 1")
    p.add_argument("--compaction-threads", help="tasks that run at a time, compactions' among them, on a local session")
    p.add_argument("--sql")
    given = p.parse_args(args)
    builder = SparkSession.builder.appName("vtable")
    if given.mem:
        builder = builder.config("spark.driver.memory", given.mem)
    if given.cache:
        builder = builder.config("spark.memory.storageFraction", given.cache)
    if given.compaction_threads:
        builder = builder.master(f"local[{int(given.compaction_threads)}]")
    spark = builder.getOrCreate()
    options = (parse_file(given.config) if given.config else {}) | ({"l0_limit": given.l0_limit} if given.l0_limit else {})
    if given.shell == "kv":
        shell, lines = KvShell(spark, given.path), (x.strip() for x in sys.stdin)
    else:
        shell, lines = SqlShell(spark, given.path or "data", options), statements([given.sql] if given.sql else sys.stdin)
    for line in lines:
        try:
            out = shell.lines(line)
            if out is None:
                break
            if isinstance(out, list):
                out = ["\n".join(out)]
            for x in out:
                print(x)
        except Exception as e:
            print(f"error: {e}")
        sys.stdout.flush()
    return 0


if __name__ == "__main__":
    sys.exit(main())
