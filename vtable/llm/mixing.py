"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Hexadecimal digits of the MD5 that make the uniform number of a row: 52 bits, which a double holds.
DIGITS = 13


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from the MD5 of the parts, nulls as empty, joined by a colon."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_steps(rate: float) -> tuple[int, list[float]]:
    """first, and P(count <= k) for k = first, first + 1, ... until it is 1 as nearly as 52 bits tell; below first it is 0 as nearly."""
    first = max(0, math.floor(rate - 12 * math.sqrt(rate) - 60))
    steps, total, k = [], 0.0, first
    while rate > 0 and (k < rate or total < 1 - 2.0**-53) and k < rate + 40 * math.sqrt(rate) + 60:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        steps.append(total)
        k += 1
    return first, steps


def rates(docs: DataFrame, weights: dict[str, float], total: int | None, source: str) -> dict[str, float]:
    """Mean repetitions of a document by source: what makes the sources' expected rows stand as their weights, total rows in all."""
    counts = {r[0]: r[1] for r in docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("s")).count().where(F.col("s").isin(*weights)).collect()}
    there = sum(w for s, w in weights.items() if counts.get(s))
    total = sum(counts.values()) if total is None else total
    return {s: total * w / there / counts[s] for s, w in weights.items() if counts.get(s) and w > 0}


def mix_sources(docs: DataFrame, weights: dict[str, float], total: int | None = None, seed: int = 0, source: str = "source", doc_id: str = "doc_id", text: str = "text", partitions: int | None = None, default: float = 0.0) -> DataFrame:
    """All columns of docs, with rate (mean repetitions), copy (0, 1, ...) and shuffle_key, in global random order.

    Each document is repeated as often as a Poisson count with its source's rate says, which inverting the distribution at a number hashed
    from seed, doc_id, source and the text's MD5 gives: the same in any run and partitioning. Sources that aren't in weights have the rate default,
    beside the total; those without a positive weight have rate 0. A null source is the source "". total is the expected number of rows; by default that of the weighted sources' documents.

    The rates come from counts of the sources in weights, at most one number for each; each row's count is found in its source's few
    steps, and copies are made where the row is. The one shuffle deals rows by their random key, so a source with most of the rows is
    spread evenly; within a partition the key orders them. Rows with the same key, which only repeated rows have, are split over tasks
    where they make a partition too large (REBALANCE).

    Rows with the same doc_id, source and text are replicated alike: all or none of them, in the same numbers. A null doc_id, source or text
    counts as empty for the hash, so rows that have no doc_id are drawn by their texts. Where
    docs has columns named rate, copy or shuffle_key, the new ones have an underscore behind their name. No weights without a
    default, or an empty table, give an empty result.
    """
    rate, copy, key = (free_name(docs, n) for n in ("rate", "copy", "shuffle_key"))
    found = rates(docs, weights, total, source)
    own = F.coalesce(F.col(source), F.lit(""))
    identity = [F.lit(seed), F.col(doc_id), F.col(source), F.col("__m")]
    u = uniform(*identity)
    if found:
        mean = F.coalesce(F.create_map(*[x for s, r in found.items() for x in (F.lit(s), F.lit(r))])[own], F.lit(0.0))
        steps = {s: poisson_steps(r) for s, r in found.items()}
        first = F.create_map(*[x for s, (k, _) in steps.items() for x in (F.lit(s), F.lit(k))])[own]
        cuts = F.create_map(*[x for s, (_, c) in steps.items() for x in (F.lit(s), F.array(*map(F.lit, c)))])[own]
        count = F.coalesce(first + F.size(F.filter(cuts, lambda c: c <= F.col("__u"))), F.lit(0))
    else:
        mean, count = F.lit(0.0), F.lit(0)
    if default > 0:
        start, cuts = poisson_steps(default)
        known = own.isin(*weights)
        mean = F.when(known, mean).otherwise(F.lit(float(default)))
        count = F.when(known, count).otherwise(F.lit(start) + F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("__u"))))
    rows = docs.withColumn("__m", F.md5(F.coalesce(F.col(text), F.lit("")))).withColumn("__u", u).withColumn("__n", count).withColumn(rate, mean)
    # as an outer one the generator lets no filter on the counts go below it, where they would be worked out again
    rows = rows.withColumn(copy, F.explode_outer(F.when(F.col("__n") > 0, F.sequence(F.lit(0), F.col("__n") - 1)))).where(F.col(copy).isNotNull())
    rows = rows.withColumn(key, uniform(*identity, F.col(copy))).drop("__m", "__u", "__n")
    dealt = rows.hint("rebalance", partitions, F.col(key)) if partitions else rows.hint("rebalance", F.col(key))
    return dealt.sortWithinPartitions(key)
