"""Operators that keep a state of their own for each key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Totals(StatefulProcessor):
    """Count and sum of all that a key has had; idle milliseconds after its last row a key's state is let go."""

    def __init__(self, key: str, idle: int | None):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n long, total double", self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, total = self.held.get() if self.held.exists() else (0, 0.0)
        for f in rows:
            n, total = n + int(f["n"].sum()), total + float(f["total"].sum())
        self.held.update((n, total))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals(events: DataFrame, key: str, value: str, idle: str | None = None) -> DataFrame:
    """key, n, total after each micro-batch, for the keys that it touched: counts and sums of all that a key has had so far.

    A task's rows of a key are added up before they are sent to its state, so a hot key sends few rows from each task. With idle, a
    duration, keys that get nothing for so long lose their state. A batch DataFrame gives its totals. The state is kept by the session's state
    store, which must be the one on RocksDB: a session with the default one is switched to it.
    """
    slim = events.select(key, F.lit(1).cast("long").alias("n"), F.col(value).cast("double").alias("total"))
    if not events.isStreaming:
        return slim.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    kind = events.schema[key].dataType.simpleString()
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    conf = events.sparkSession.conf
    if "RocksDB" not in conf.get(_STORE):
        conf.set(_STORE, _ROCKS)

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.groupby(key, as_index=False, dropna=False)[["n", "total"]].sum()

    sums = slim.mapInPandas(part, slim.schema)
    return sums.groupBy(key).transformWithStateInPandas(Totals(key, wait), f"{key} {kind}, n long, total double", "Update", "None" if wait is None else "ProcessingTime")
