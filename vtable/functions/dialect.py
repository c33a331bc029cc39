"""Functions of the host dialect that Spark spells otherwise, as expressions over built-ins, and key coding for ordered byte strings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def ifnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def instr(text: Column, part: Column) -> Column:
    """Where part begins in text, from 1 on; 0 if it isn't there."""
    return F.call_function("instr", text, part).cast("long")


def glob(text: Column, pattern: str) -> Column:
    """Case-sensitive match of the whole text; * stands for any run, ? for one character, [..] for a set."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + ch if not ch.isalnum() else ch
        i += 1
    return text.rlike(f"(?s)^{out}$")


def like_nocase(text: Column, pattern: str) -> Column:
    """LIKE that doesn't tell A-Z from a-z."""
    return F.lower(text).like(pattern.lower())


def truncating_divide(a: Column, b: Column) -> Column:
    """Integer division towards zero, null for a zero divisor."""
    return F.when(b != 0, F.call_function("try_divide", a - F.call_function("try_mod", a, b), b).cast("long"))


def total(x: Column) -> Column:
    """A sum that is 0.0 for no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def escape_key(x: Column) -> Column:
    """Bytes in a form whose order stays the same when more bytes follow: 00 as 00FF, ended by 00. As upper-case hexadecimal."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.hex(x), "(..)", "$1 "), "00 ", "00FF "), F.lit("00")).alias("escaped")


@udtf(returnType="path string, level int, index int, rows long, bytes long, low_v long, high_v long")
class TableFiles:
    """table_files(path): the files of a table's newest state, read from its log by one task."""

    def eval(self, path: str) -> Iterator[tuple]:
        from ..streaming.source import live_files

        for f in live_files(path):
            yield f["path"], f["level"], f["index"], f["rows"], f["bytes"], f["low_v"], f["high_v"]


@udtf(returnType="position int, word string")
class Words:
    """words(text): the runs of anything but white space, with their positions from 1 on."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from enumerate((text or "").split(), 1)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    spark.udtf.register("table_files", TableFiles)
    spark.udtf.register("words", Words)
