"""Benchmark decontamination by spaced seeds, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checked, free_name

#: Positions with 1 are hashed, those with 0 may hold any word. In any WINDOW words of which PERCENT in a hundred are equal, one of them fits.
MASKS = ("1101011", "11100111")
#: A leak is so many aligned words (or the whole item, if it has fewer) of which so many in a hundred are equal.
WINDOW, PERCENT = 12, 80
#: Words are runs of letters and digits, lower-cased.
SEPARATORS = r"[^\p{L}\p{N}]+"


def words(text) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda x: x != "")


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda x: F.xxhash64(x))


def masked_hash(hs: Column, i: Column, number: int, mask: str) -> Column:
    """The hash of the words (by their own hashes) that a mask leaves at position i; null where the mask doesn't fit."""
    left = [F.get(hs, i + j) for j, bit in enumerate(mask) if bit == "1"]
    return F.when((i >= 0) & (i + len(mask) <= F.size(hs)), F.xxhash64(F.lit(number), *left))


def by_mask(hs: Column, i: Column, masks: Sequence[str], number: Column | None = None) -> Column:
    """The hashes of all masks at a position, or that of one by its number."""
    if number is None:
        return F.array(*[masked_hash(hs, i, k, m) for k, m in enumerate(masks)])
    return F.coalesce(*[F.when(number == k, masked_hash(hs, i, k, m)) for k, m in enumerate(masks)])


def item_seeds(tests: DataFrame, masks: Sequence[str], window: int, percent: int) -> tuple[DataFrame, list[str]]:
    """item_id, n (words), q (position), k (mask), h (hash), before (the same mask's hash a word earlier); and all masks.

    Items shorter than window are cut into one part more than the words in which they may differ, so that a whole part is equal: those
    parts are their seeds, under masks of ones of the parts' lengths.
    """
    tests = tests.withColumn("n", F.size("item"))
    short = tests.where(f"n > 0 AND n < {window}").withColumn("parts", F.least("n", F.expr(f"cast(n - ceil(n * {percent} / 100) + 1 as int)")))
    short = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).selectExpr("item_id", "item", "n", "cast(part * n div parts as int) q", "cast((part + 1) * n div parts - part * n div parts as int) len")
    lengths = sorted(r[0] for r in short.select("len").distinct().collect())
    every = [*masks, *("1" * m for m in lengths)]
    seeds = tests.where(f"n >= {window}").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    seeds = seeds.select("item_id", "item", "n", "q", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("k"))
    if lengths:
        number = F.coalesce(*[F.when(F.col("len") == m, F.lit(len(masks) + i)) for i, m in enumerate(lengths)])
        seeds = seeds.unionByName(short.select("item_id", "item", "n", "q", number.alias("k")))
    seeds = seeds.withColumn("hs", word_hashes("item"))
    hs, q, k = F.col("hs"), F.col("q"), F.col("k")
    # parts of short items are no run of seeds: the one before isn't looked up, so it can't stand for this one
    before = F.when(k < len(masks), by_mask(hs, q - 1, masks, k))
    return seeds.select("item_id", "n", "q", "k", by_mask(hs, q, every, k).alias("h"), before.alias("before")).where("h is not null"), every


def alignments(docs: DataFrame, tests: DataFrame, keys: Sequence[str], window: int, percent: int, masks: Sequence[str]) -> DataFrame:
    """keys, item_id, words: a row for each verified alignment. docs has keys and text; tests has item_id and item (words)."""
    scratch = Scratch(docs.sparkSession)
    tests = scratch.write(tests, "items")
    seeds, every = item_seeds(tests, masks, window, percent)
    seeds = scratch.write(seeds, "seeds")
    ws, hs, i = F.col("ws"), F.col("hs"), F.col("i")
    places = docs.select(*keys, words(F.col("text")).alias("ws")).withColumn("hs", word_hashes("ws"))
    # as an outer one the generator lets no filter on the words go below it, where they would be split again
    places = places.select(*keys, "ws", "hs", F.explode_outer(F.when(F.size("ws") > 0, F.sequence(F.lit(0), F.size("ws") - 1))).alias("i"))
    own = places.select(*keys, "ws", "hs", "i", F.explode(by_mask(hs, i, every)).alias("h")).where("h is not null")
    hits = own.join(checked(seeds, seeds.count()), "h")
    # an alignment's run of seeds is verified once, at its first
    hits = hits.where(~F.coalesce(by_mask(hs, i - 1, masks, F.col("k")) == F.col("before"), F.lit(False)))
    off = i - F.col("q")
    start = F.greatest(off, F.lit(0))
    aligned = F.slice(ws, start + 1, F.least(off + F.col("n"), F.size(ws)) - start)
    found = hits.select(*keys, "item_id", (start - off).alias("skip"), aligned.alias("aligned"))
    size = tests.agg(F.count("*"), F.sum(F.length(F.concat_ws(" ", "item")))).first()
    found = found.join(checked(tests, size[0], (size[1] or 0) // max(1, size[0]) + 32), "item_id")
    n = F.size("item")
    w = F.least(n, F.lit(window))
    need = F.ceil(w * percent / F.lit(100))
    equal = F.transform("item", lambda x, q: F.coalesce((F.get("aligned", q - F.col("skip")) == x).cast("int"), F.lit(0)))
    found = found.select(*keys, "item_id", n.alias("n"), w.alias("w"), need.alias("need"), equal.alias("eq"))
    total = F.aggregate("eq", F.lit(0), lambda a, x: a + x)
    leak = F.exists(F.sequence(F.lit(0), F.col("n") - F.col("w")), lambda s: F.aggregate(F.slice("eq", s + 1, F.col("w")), F.lit(0), lambda a, x: a + x) >= F.col("need"))
    return found.withColumn("words", total).where((F.col("words") >= F.col("need")) & leak).select(*keys, "item_id", "words")


def _items(tests: DataFrame, item_text: str, item_id: str) -> DataFrame:
    return tests.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("item")).where("item_id is not null")


def leaks(docs: DataFrame, tests: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, percent: int = PERCENT, masks: Sequence[str] = MASKS) -> DataFrame:
    """doc_id, item_id, words: the benchmark items that a document holds, and the most equal words of an alignment.

    Seeds: at each word position of documents and items, the words that a mask leaves are hashed, so that a substituted word under a 0
    does no harm. Documents' and items' hashes are joined; a common hash gives an alignment (document, item, distance). It is verified
    word by word: a leak has a stretch of window words, or the whole item if that is shorter, of which percent in a hundred or more are
    equal. Items shorter than window are found by whole parts of them (see item_seeds), so with MASKS no alignment of any item is missed.

    A document's words are split once and hashed where they are; a hit takes along only the words that stand opposite the item, so the work is
    linear in the text's length, however repetitive it is, and nothing of the text is shuffled. Items' seeds and words are broadcast only after
    being counted; beyond the limit the joins shuffle hashes and hits. What is found of a document and item is combined before the shuffle.

    Nulls, empty texts and texts without words match nothing. A null doc_id or item_id matches nothing. Rows with the same doc_id are one
    document: it holds what any of them holds. Repeated items are one if their item_id is. Other columns are not read. Empty tables give an
    empty result.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    found = alignments(slim, _items(tests, item_text, item_id), ["doc_id"], window, percent, masks)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").cast("long").alias("words"))


def decontaminate(docs: DataFrame, tests: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, percent: int = PERCENT, masks: Sequence[str] = MASKS) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, as leaks() has it; all columns and all other rows stay.

    Rows are told apart by their text (two 64-bit hashes), not by an id: of rows with one doc_id only those with the leaking text go, and
    rows without a doc_id are judged as any other. Null and empty texts stay.
    """
    a, b = free_name(docs, "__a"), free_name(docs, "__b")
    keyed = docs.withColumn(a, F.xxhash64(text)).withColumn(b, F.xxhash64(F.lit("leak"), text))
    slim = keyed.select(F.col(a).alias("t1"), F.col(b).alias("t2"), F.col(text).alias("text"))
    bad = alignments(slim, _items(tests, item_text, item_id), ["t1", "t2"], window, percent, masks).select("t1", "t2").distinct()
    bad = Scratch(docs.sparkSession).write(bad, "bad").toDF(f"{a}_bad", f"{b}_bad")
    return keyed.join(checked(bad, bad.count()), (F.col(a) == F.col(f"{a}_bad")) & (F.col(b) == F.col(f"{b}_bad")), "left_anti").drop(a, b)
