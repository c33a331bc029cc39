"""Exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, checked, free_name

#: Characters that the second step hashes.
PREFIX = 256
#: Bytes of a row of groups: the digest in hexadecimal and three numbers.
GROUP_BYTES = 120


def _steps(text: Column, prefix: int) -> tuple[Column, Column, Column]:
    """Length, hash of the first characters and digest of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.octet_length(text), F.xxhash64(F.substring(text, 1, prefix)), F.sha2(text, 256)


def _equal_texts(scratch: Scratch, docs: DataFrame, text: str, doc_id: str, prefix: int) -> tuple[DataFrame, int, DataFrame, int]:
    """starts (len, pre: those that more than one row has) and groups (len, sha, keep_id, group_size: the same of whole texts), each with its count.

    A step's groups are counts, combined before the shuffle, so copies of one text don't meet in a task. While starts can be broadcast only
    texts whose length and prefix have a fellow are hashed in full; beyond that all are, so that the join moves digests and no texts.
    """
    length, pre, sha = _steps(F.col(text), prefix)
    rows = scratch.write(docs.select(length.alias("len"), pre.alias("pre")), "rows")
    lengths = scratch.write(rows.groupBy("len").count().where("count > 1").select("len"), "lengths")
    starts = rows.join(checked(lengths, lengths.count()), "len").groupBy("len", "pre").count().where("count > 1").select("len", "pre")
    starts = scratch.write(starts, "starts")
    n = starts.count()
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), length.alias("len"), pre.alias("pre"), (F.col(text) if n <= BROADCAST_ROWS else sha).alias("x"))
    left = own.join(checked(starts, n), ["len", "pre"], "left_semi").select("doc_id", "len", (_steps(F.col("x"), prefix)[2] if n <= BROADCAST_ROWS else F.col("x")).alias("sha"))
    groups = left.groupBy("len", "sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = scratch.write(groups, "groups")
    return starts, n, groups, groups.count()


def _with_groups(docs: DataFrame, found: tuple[DataFrame, int, DataFrame, int], text: str, prefix: int, digest: bool) -> DataFrame:
    """Every row of docs with __len, __sha (null where there can be no fellow, unless digest is asked for), keep_id and group_size of its
    group, null where it is alone. Nothing but groups too many to broadcast makes docs move."""
    starts, n, groups, m = found
    length, pre, sha = _steps(F.col(text), prefix)
    rows = docs.withColumn("__len", length)
    if not digest and n <= BROADCAST_ROWS:
        rows = rows.withColumn("__pre", pre).join(F.broadcast(starts.toDF("__l", "__p").withColumn("__seen", F.lit(True))), (F.col("__len") == F.col("__l")) & (F.col("__pre") == F.col("__p")), "left")
        rows = rows.withColumn("__sha", F.when(F.col("__seen"), sha)).drop("__pre", "__l", "__p", "__seen")
    else:
        rows = rows.withColumn("__sha", sha)
    groups = groups.toDF("__l", "__s", "__keep", "__size")
    small = m <= min(BROADCAST_ROWS, BROADCAST_BYTES // GROUP_BYTES)
    return rows.join(F.broadcast(groups) if small else groups, (F.col("__len") == F.col("__l")) & (F.col("__sha") == F.col("__s")), "left").drop("__l", "__s")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix: int = PREFIX, digest: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept of each row of docs: of rows with the same text that with the largest doc_id stays.

    Texts are equal when they are identical; null counts as empty. Three steps, each over what the one before couldn't tell apart: rows with the
    same length, with the same hash of their first characters, with the same SHA-256 of the full text. Only rows that survive two steps
    have their full text hashed.

    Every row has its row, repeated ones too. Rows of one doc_id with different texts are in different groups. Rows that share the largest
    doc_id of their group are all marked kept (deduplicated() breaks such ties). A null doc_id stays only if no row of its text has another:
    then keep_id is null and all of them are marked. Other columns are not read. An empty table gives an empty result.

    With digest each row has the SHA-256 of its own text in a column of that name; then all texts are hashed in full.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = _equal_texts(scratch, docs, "text", "doc_id", prefix)
    rows = _with_groups(docs, found, "text", prefix, bool(digest))
    keep = F.when(F.col("__size").isNull(), F.col("doc_id")).otherwise(F.col("__keep"))
    out = rows.select("doc_id", keep.alias("keep_id"), F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"), *([F.col("__sha").alias(digest)] if digest else []))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix: int = PREFIX) -> DataFrame:
    """One row of docs for each text, with all its columns: that with the largest doc_id, as exact_dedup() has it.

    Where several rows of a text have that doc_id (or all have none) one of them stays: that with the least digest of all its columns.
    """
    scratch = Scratch(docs.sparkSession)
    found = _equal_texts(scratch, docs, text, doc_id, prefix)
    rows = _with_groups(docs, found, text, prefix, False).where(F.col("__size").isNull() | F.col(doc_id).cast("long").eqNullSafe(F.col("__keep")))
    tied = rows.where("__size is not null").groupBy("__len", "__sha").count().where("count > 1").select(F.col("__len").alias("__l"), F.col("__sha").alias("__s"))
    tied = scratch.write(tied, "tied")
    n = tied.count()
    if not n:
        return rows.select(*docs.columns)
    same = (F.col("__len") == F.col("__l")) & (F.col("__sha") == F.col("__s"))
    small = checked(tied, n, GROUP_BYTES)
    row = free_name(docs, "row")
    one = rows.join(small, same, "left_semi").groupBy("__len", "__sha").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))).alias(row))
    return rows.join(small, same, "left_anti").select(*docs.columns).unionByName(one.select(f"{row}.*"))
