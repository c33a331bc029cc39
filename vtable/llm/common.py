"""What the operators of this package share: the shared folder, checked broadcasts, hashing and graph labels."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has been counted and holds at most so many rows, and at most so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Text bytes that one step of the numpy code works on; a longer single text is still taken whole.
SLICE_BYTES = 500_000
#: Rows and bytes of an Arrow batch at most, so that an executor's Python workers hold little of long texts at a time.
BATCH_ROWS, BATCH_BYTES = 300, 2 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir, with its scheme. Where that is unset a local session gets a
    temporary one; a cluster must set it, since its machines would not see each other's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vtable-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to BATCH_ROWS and BATCH_BYTES; the operators that send texts to Python call this."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(limit)) <= BATCH_ROWS:
        spark.conf.set(limit, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables in the shared folder that cut lineage; they outlive lost executors. drop() deletes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/vtable-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checked(small: DataFrame, rows: int, width: int = 32) -> DataFrame:
    """small with a broadcast hint if its counted rows, of about width bytes each, are within the limits, else as it is, to be joined by a shuffle."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS and rows * width <= BROADCAST_BYTES else small


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """Slices of a column of strings as UTF-8 bytes, about max_bytes each, with the row that each begins at."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield lo, binary_list(column.slice(lo, hi - lo))
        lo = hi


def binary_list(column: pa.Array) -> list[bytes | None]:
    """Strings as UTF-8 bytes, nulls as None."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def hash_words(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    flat = np.empty(len(words), object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=False)


def shingle_sets(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, one after another, and how many each text has.

    Words are the runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words is one shingle; without words it has none.
    """
    split = [t.lower().split() if t else [] for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    w = hash_words([x for s in split for x in s])
    h = w.copy()
    for j in range(1, words):
        m = max(0, len(w) - j)
        h[:m] = mix(h[:m] + np.uint64(j)) + w[j:]
    sets, sizes, at = [], np.zeros(len(split), np.int64), 0
    for i, n in enumerate(counts.tolist()):
        if n >= words:
            own = np.sort(h[at : at + n - words + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            short = w[at : at + 1].copy()
            for x in w[at + 1 : at + n]:
                short = mix(short + np.uint64(77)) + x
            own = mix(short + np.uint64(n))
        else:
            own = w[:0]
        at += n
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else w[:0]), sizes


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys out of sorted batches, one key at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def components(scratch: Scratch, edges: DataFrame, name: str = "labels") -> DataFrame:
    """node, comp: the smallest node that each node of edges (a, b) is connected with.

    Each round every node takes the least of itself and its neighbours and the graph is contracted by that map, so stars vanish at
    once and the rest at least halves; the maps are then applied one after another. Nothing is gathered in one task: the least
    neighbour is a map-side combined aggregate, and hot nodes meet in joins that adaptive execution splits.
    """
    e = scratch.write(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), f"{name}-e0")
    maps, k = [], 0
    while not e.isEmpty():
        both = e.unionByName(e.selectExpr("b a", "a b"))
        least = scratch.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"{name}-m{k}")
        maps.append(least)
        up = least.selectExpr("a x", "m")
        e2 = e.join(up, e.a == up.x).selectExpr("m a", "b").join(up, F.col("b") == up.x).selectExpr("a", "m b")
        nxt = scratch.write(e2.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), f"{name}-e{k + 1}")
        scratch.drop(f"{name}-e{k}")
        e, k = nxt, k + 1
    if not maps:
        return scratch.write(edges.selectExpr("a node", "a comp").limit(0), name)
    labels = maps[0].selectExpr("a node", "m comp")
    for m in maps[1:]:
        labels = labels.join(m, labels.comp == m.a, "left").select("node", F.coalesce("m", "comp").alias("comp"))
    out = scratch.write(labels, name)
    scratch.drop(f"{name}-e{k}", *[f"{name}-m{i}" for i in range(k)])
    return out
