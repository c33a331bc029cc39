"""N-gram Jaccard join by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .common import Scratch, binary_list, bounded_batches, checked, components, mix, runs, shingle_sets, text_slices

#: Members of a signature's group, and tokens in all, that one task holds at most; larger groups are dealt out in so large blocks.
BLOCK, BLOCK_TOKENS = 512, 2_000_000
#: Sets whose token union is a column of the matrix.
GROUP = 16
#: Bits of a signature: fewer would make sets meet by chance, more would only be shuffled.
SIGNATURE_BITS = 48
#: 64-bit words of a set's parity sketch.
SKETCH = 32
#: Documents in the sample that finds signatures shared by very many documents, and how often they are there. It steers only the route
#: that a signature's rows take, never the result.
SAMPLE, OFTEN = 20_000, 20


class Threshold:
    """Jaccard similarity of num / den at least, and what follows from it for two sets of a <= b tokens.

    They differ in at most far(a) tokens. So if the tokens are dealt by their hash into more than far(a) parts, the two sets have
    the same tokens in at least one part: a signature is the hash of one part. The number of parts depends on a size class, and a
    set is in its own class and in those that smaller sets similar to it can be in.
    """

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be over 0 and at most 1")
        self.num, self.den = num, den
        self.starts = [1]
        if num < den:
            self.starts = [-(-num // (den - num))]
            while self.starts[-1] < 2**40:
                self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * 3 // 2))
        self.start = np.array(self.starts, np.int64)
        self.most = self.far(self.start[1:] - 1) if num < den else np.zeros(0, np.int64)
        self.parts = self.most + 1 + np.maximum(1, self.most // 50)

    def far(self, a):
        return (self.den - self.num) * a // self.num

    def least(self, n):
        """Tokens of a set of n that any similar set must hold."""
        return -(-self.num * n // self.den)

    def similar(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)


def signatures(flat: np.ndarray, sizes: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of the sets in flat, and for each the number of its set.

    Any two different similar sets share one. Parts without tokens have no signature; a set with so many of them that the parts of a pair
    that are equal may all be empty has its smallest tokens as further signatures, as many as make two such sets share one.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    low = np.searchsorted(t.start, t.least(sizes), "right") - 1
    own = np.searchsorted(t.start, sizes, "right") - 1
    sums, sets = [], []
    poor = np.zeros(len(sizes), bool)
    spread = mix(flat + np.uint64(0x5851F42D4C957F2D))
    high = flat >> np.uint64(32)
    for back in range(int((own - low).max(initial=0)) + 1):
        c = own - back
        uses = (c >= low) & (c >= 0) & (c < len(t.parts))
        if not uses.any():
            continue
        k = np.where(uses, t.parts[np.clip(c, 0, len(t.parts) - 1)], 0)
        here = uses[owner]
        o, kk = owner[here], k[owner[here]].astype(np.uint64)
        part = (high[here] * kk) >> np.uint64(32)
        first = np.ones(len(o), bool)
        first[1:] = (o[1:] != o[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(first)
        if len(at):
            total = np.add.reduceat(spread[here], at)
            place = mix((c[o[at]].astype(np.uint64) << np.uint64(40)) + part[at])
            sums.append(mix(total ^ place))
            sets.append(o[at])
        full = np.bincount(o[at], minlength=len(sizes))
        most = t.most[np.clip(c, 0, len(t.parts) - 1)]
        poor |= uses & (k - full >= k - np.minimum(t.far(sizes), most))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for i in np.flatnonzero(poor & (own >= 0)):
        p = int(sizes[i] - t.least(sizes[i]) + 1)
        sums.append(mix(flat[starts[i] : starts[i] + p] ^ np.uint64(0x9E3779B97F4A7C15)))
        sets.append(np.full(p, i))
    if not sums:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums, sets = np.concatenate(sums) >> np.uint64(64 - SIGNATURE_BITS), np.concatenate(sets)
    order = np.argsort(sets, kind="stable")
    return sums[order], sets[order]


def sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of bits for each set: whether an odd number of its tokens fall on the bit. Two sketches differ in no more bits than the sets
    in tokens, so a pair that is too far apart by its sketches is so by its sets."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = mix(flat ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - (SKETCH * 64 - 1).bit_length())
    odd = np.bincount(owner * (SKETCH * 64) + place.astype(np.int64), minlength=len(sizes) * SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sizes), SKETCH * 64), axis=1)


SETS = "doc_id long, n long, k1 long, k2 long, place long, sketch binary, sigs array<long>"


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set."""
    ends = np.cumsum(sizes)
    keys = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(flat ^ salt), dtype=np.uint64)))
        keys.append(mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return keys


def set_rows(words: int, num: int, den: int):
    """For mapInArrow: doc_id, text and place to the set's size, its two hashes, its sketch and its signatures.

    Of equal sets that are near each other only the first that has a doc_id has a sketch and signatures; they would be the same.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Threshold(num, den)
        for b in batches:
            for lo, texts in text_slices(b.column(1)):
                flat, sizes = shingle_sets(texts, words)
                keys = set_keys(flat, sizes)
                named = np.flatnonzero(b.column(0).slice(lo, len(texts)).is_valid().to_numpy(zero_copy_only=False))
                _, first = np.unique(np.stack(keys, 1)[named], axis=0, return_index=True)
                twin = np.ones(len(sizes), bool)
                twin[named[first]] = False
                kept = np.where(twin, 0, sizes)
                own = flat[np.repeat(~twin, sizes)]
                sums, sets = signatures(own, kept, t)
                drawn = sketches(own, kept[kept > 0])
                offsets = np.concatenate(([0], np.cumsum(np.bincount(sets, minlength=len(sizes))))).astype(np.int32)
                ends = np.concatenate(([0], np.cumsum(np.where(kept > 0, SKETCH * 8, 0)))).astype(np.int32)
                sketch = pa.Array.from_buffers(pa.binary(), len(sizes), [pa.array(kept > 0).buffers()[1], pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(drawn))])
                keys = [pa.array(k, mask=sizes == 0) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(texts)).cast(pa.int64()), pa.array(sizes), *keys, b.column(2).slice(lo, len(texts)), sketch, pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.view(np.int64)))],
                    names=["doc_id", "n", "k1", "k2", "place", "sketch", "sigs"],
                )

    return rows


CANDIDATES = "pivot long, block int, part int, query boolean, node long"


def candidate_rows(num: int, den: int):
    """For mapInArrow over rows sorted by group: pivot, block, part, query, node, n, sketch. Gives the rows without n and sketch, but for
    those that have no partner in their group that could be similar by sizes and sketches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["pivot", "block", "part"]):
            if table.num_rows < 2:
                continue
            cross = table.column("block")[0].as_py() != table.column("part")[0].as_py()
            table = table.sort_by("n")
            n, query = table.column("n").to_numpy(), np.array(table.column("query").to_pylist(), bool)
            bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(n), -1)
            stays, ends = np.zeros(len(n), bool), np.searchsorted(n, n * den // num, "right")
            for i in range(len(n) - 1):
                js = np.arange(i + 1, ends[i])
                if cross:
                    js = js[query[js] != query[i]]
                if len(js):
                    both = n[js] + n[i]
                    far = both - 2 * -(-num * both // (num + den))
                    near = np.bitwise_count(bits[js] ^ bits[i]).sum(1) <= far
                    if near.any():
                        stays[i] = True
                        stays[js[near]] = True
            if stays.any():
                yield from table.select(["pivot", "block", "part", "query", "node"]).filter(pa.array(stays)).combine_chunks().to_batches()

    return rows


def link_block(sets: list[np.ndarray], query: np.ndarray, cross: bool, elsewhere: list[list[int]], t: Threshold) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Every link among the sets of a block, by position: one end, the other ends, and whether each joins two components of those before it.

    With cross only queries and others are compared with each other. Sets that have a number of elsewhere in common are not compared.

    A token-group matrix: sets in the order of their least tokens, which similar sets mostly share, are cut into groups of GROUP; for each
    token the matrix has the groups whose union holds it. A set similar to a query holds t.least(n) of its n tokens, and so does its group:
    the query's overlap with every group is read off the matrix, and only groups with enough are opened and compared set by set.
    """
    order = np.array(sorted(range(len(sets)), key=lambda i: sets[i][:2].tolist()), np.int64)
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    ends = np.cumsum(sizes)
    tokens, cols = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    group = np.arange(len(order)) // GROUP
    n_groups = int(group[-1]) + 1
    cells = np.unique(cols * n_groups + np.repeat(group, sizes))
    held = cells % n_groups
    ptr = np.searchsorted(cells, np.arange(len(tokens) + 1) * n_groups)
    asks = query[order]
    met = shared_bits([elsewhere[i] for i in order])
    comp = np.arange(len(order))
    inside = np.zeros(len(tokens), bool)
    for i in range(len(order)):
        own = cols[ends[i] - sizes[i] : ends[i]]
        lo, n = ptr[own], ptr[own + 1] - ptr[own]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        bound = np.bincount(held[at], minlength=n_groups)
        inside[own] = True
        for g in np.flatnonzero(bound[: group[i] + 1] >= t.least(sizes[i])):
            first, last = g * GROUP, min((g + 1) * GROUP, i)
            if first >= last:
                continue
            from_ = ends[first] - sizes[first]
            both = np.add.reduceat(inside[cols[from_ : ends[last - 1]]].astype(np.int64), ends[first:last] - sizes[first:last] - from_)
            similar = t.den * both >= t.num * (sizes[first:last] + sizes[i] - both)
            if cross:
                similar &= asks[first:last] != asks[i]
            if met.shape[1]:
                similar &= ~(met[first:last] & met[i]).any(axis=1)
            js = np.flatnonzero(similar) + first
            if len(js):
                joins = np.zeros(len(js), bool)
                for k in np.flatnonzero(comp[js] != comp[i]).tolist():
                    if comp[js[k]] != comp[i]:
                        joins[k] = True
                        comp[comp == comp[i]] = comp[js[k]]
                yield int(order[i]), order[js], joins
        inside[own] = False


def shared_bits(lists: list[list[int]]) -> np.ndarray:
    """A row of bytes for each list, a bit for each number that several lists have."""
    flat = np.array([x for own in lists for x in own], np.int64)
    owner = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    out = np.zeros((len(lists), -(-int((n > 1).sum()) // 8)), np.uint8)
    many = n[at] > 1
    np.bitwise_or.at(out, (owner[many], place[at[many]] // 8), (1 << (place[at[many]] % 8)).astype(np.uint8))
    return out


#: Links in a batch that link_rows gives.
LINK_ROWS = 100_000
LINKS = "a long, b long, links long, joins boolean"


def link_rows(words: int, num: int, den: int, pairs: bool):
    """For mapInArrow over rows sorted by group: pivot, block, part, query, earlier, node, copies, k1, k2, text. Gives, for each group, of
    each node with links how many rows it is linked with there (a, links), the links that join components of the group (a, b), and all
    others too if pairs are asked for.

    Where block and part differ, sets of the one are compared with those of the other. Rows whose text is not that of the set (another text
    of the same doc_id) are passed over.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Threshold(num, den)
        for table in runs(batches, ["pivot", "block", "part"]):
            node, copies, k1, k2 = (table.column(c).to_numpy() for c in ("node", "copies", "k1", "k2"))
            query, earlier = (table.column(c).to_pylist() for c in ("query", "earlier"))
            texts = [x for c in table.column("text").chunks for x in binary_list(c)]
            flat, sizes = shingle_sets(texts, words)
            ends = np.cumsum(sizes)
            own = set_keys(flat, sizes)
            # rows that repeat a doc_id and its text count once
            once = list({int(node[k]): k for k in np.flatnonzero((own[0] == k1) & (own[1] == k2) & (sizes > 0)).tolist()}.values())
            node, copies = node[once], copies[once]
            cross = table.column("block")[0].as_py() != table.column("part")[0].as_py()
            asks = np.array([query[k] for k in once], bool)
            if len(once) < 2 or (cross and (asks.all() or not asks.any())):
                continue
            linked, held, n = np.zeros(len(once), np.int64), [], 0
            for i, js, joins in link_block([flat[ends[k] - sizes[k] : ends[k]] for k in once], asks, cross, [earlier[k] for k in once], t):
                linked[i] += copies[js].sum()
                linked[js] += copies[i]
                some = np.ones(len(js), bool) if pairs else joins
                held.append((np.full(int(some.sum()), i), js[some], joins[some]))
                n += len(held[-1][0])
                if n >= LINK_ROWS:
                    yield link_batch(node, held)
                    held, n = [], 0
            if n:
                yield link_batch(node, held)
            if len(at := np.flatnonzero(linked)):
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), none, pa.array(linked[at]), pa.nulls(len(at), pa.bool_())], names=["a", "b", "links", "joins"])

    return rows


def link_batch(node: np.ndarray, links: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    i, j, joins = (np.concatenate(x) for x in zip(*links, strict=True))
    a, b = node[i], node[j]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64()), pa.array(joins)], names=["a", "b", "links", "joins"])


def head_rows(signature: np.ndarray, pivot: np.ndarray):
    """For mapInArrow: row and sigs to row and the pivots of those of its signatures that are in signature (sorted), each once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(signature, flat), len(signature) - 1)
            hit = signature[at] == flat
            pairs = np.unique(np.stack([b.column(0).to_numpy(zero_copy_only=False)[owner[hit]], pivot[at[hit]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["row", "pivot"])

    return rows


def shared_signatures(scratch: Scratch, sets: DataFrame, rows: int) -> DataFrame:
    """row, pivot: the sets that share a signature with others, and one of those that stands for them; pivots themselves are among the rows.

    Signatures that a bounded sample of the sets shows to be shared by very many sets have their least row in the sample as the pivot. They
    are counted; within the limit of broadcasts each set looks its pivots up where it is, so a set's many frequent signatures become a few
    rows before anything is shuffled. The rest meet by a shuffle on the signature, and the least row is the pivot.
    """
    every = sets.select("row", F.explode("sigs").alias("sig"))
    share = min(1.0, SAMPLE / max(rows, 1))
    sample = every.where(F.pmod(F.xxhash64("row"), F.lit(1_000_003)) <= int(share * 1_000_003))
    heads = scratch.write(sample.groupBy("sig").agg(F.min("row").alias("pivot"), F.count("*").alias("n")).where(f"n >= {OFTEN}").select("sig", "pivot"), "heads")
    few = heads.count()
    if not few:
        hot = sets.select("row", F.col("row").alias("pivot")).limit(0)
    elif few <= common.BROADCAST_ROWS:
        table = heads.toArrow().sort_by("sig")
        hot = sets.select("row", "sigs").mapInArrow(head_rows(table["sig"].to_numpy(), table["pivot"].to_numpy()), "row long, pivot long")
    else:
        hot = every.join(heads, "sig").select("row", "pivot")
    by_sig = Window.partitionBy("sig")
    rest = every.join(checked(heads.select("sig"), few), "sig", "left_anti").select("row", F.min("row").over(by_sig).alias("pivot"), F.max("row").over(by_sig).alias("last"))
    return hot.unionByName(rest.where("pivot < last").select("row", "pivot")).distinct()


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id", pairs: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(result, links): doc_id, n_shingles, component_id, n_links of each row of docs; with pairs also every link (a, b), a <= b, between
    different texts, once.

    Two rows are linked when the Jaccard similarity of their sets of distinct word shingles is num / den or more; component_id is the
    smallest doc_id that links lead to, n_links the number of rows linked with. Tokens are 64-bit hashes of shingles. In links a text is
    named by the smallest doc_id that has it; n similar texts have n (n - 1) / 2, so they are counted where they are found and
    only made rows when asked for.

    Token-group matrix: equal sets count once. Sets that share a signature (see Threshold) meet around one of them, so any two similar
    sets meet. Of those that meet, sets that their sketches show to be far from all others leave before any text is moved (see sketches). The
    rest are partitioned into groups of similar sets with a token union each; a query opens only the groups whose
    union holds enough of its tokens (see link_block). Where over BLOCK sets, or BLOCK_TOKENS tokens, meet, they are dealt out in
    blocks, and each block's sets are queries to the later blocks. Two sets that meet around several sets are compared at the least of them.
    Components need only the links that join two components of a block; those are told apart where they are found.

    Nulls, empty texts and texts of white space have an empty set: n_shingles 0, linked with nothing, component_id their own doc_id. Rows,
    not ids, are what is linked: rows of one doc_id with different texts are linked only if the texts are similar, and repeated rows are copies of
    each other. Rows without a doc_id are returned with their n_shingles, but are linked with nothing. Other columns are not read. An
    empty table gives an empty result.
    """
    out, links = _joined(docs, words, num, den, text, doc_id, pairs)
    return out.drop("place", "stands"), links


def _joined(docs: DataFrame, words: int, num: int, den: int, text: str, doc_id: str, pairs: bool) -> tuple[DataFrame, DataFrame | None]:
    """What jaccard_components() returns, with place (hash of the text) and stands (whether the row is the first of its component)."""
    scratch = Scratch(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("place"))
    made = scratch.write(docs.mapInArrow(set_rows(words, num, den), SETS).withColumn("row", F.monotonically_increasing_id()), "made")
    sets = scratch.write(made.drop("sigs", "sketch"), "sets")
    near = scratch.write(shared_signatures(scratch, made.where("sketch is not null").select("row", "sigs"), sets.count()), "near")
    keyed = made.where("k1 is not null and doc_id is not null")
    # the text of a set is fetched by the doc_id and the hash of one row that has it
    kinds = keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "place")).alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"), F.max("sketch").alias("sketch"))
    kinds = scratch.write(kinds.select("k1", "k2", "rep.doc_id", "rep.place", "n", "copies", "sketch").withColumn("node", F.monotonically_increasing_id()), "kinds")
    scratch.drop("made")
    # rows with equal sets are one member
    members = near.join(sets.select("row", "k1", "k2"), "row").select("pivot", "k1", "k2").distinct().join(kinds.select("k1", "k2", "node", "n", "sketch"), ["k1", "k2"])
    members = scratch.write(members.drop("k1", "k2"), "members")
    large = members.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks")).where("blocks > 1")
    large = scratch.write(large, "large")
    placed = members.join(checked(large, large.count()), "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.selectExpr("pivot", "greatest(own, other) block", "least(own, other) part", "own < other query", "node", "n", "sketch")
    keys = ["pivot", "block", "part"]
    placed = scratch.write(placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(candidate_rows(num, den), CANDIDATES), "placed")
    pivots = placed.groupBy("node").agg(F.collect_set("pivot").alias("pivots"))
    wanted = placed.join(pivots, "node").selectExpr(*keys, "query", "filter(pivots, p -> p < pivot) earlier", "node")
    wanted = wanted.join(kinds.select("node", "doc_id", "place", "copies", "k1", "k2"), "node")
    texts = docs.join(checked(wanted, placed.count(), 150), ["doc_id", "place"]).drop("doc_id", "place")
    texts = texts.select(*keys, "query", "earlier", "node", "copies", "k1", "k2", "text")
    found = scratch.write(texts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(link_rows(words, num, den, pairs), LINKS), "links")
    labels = components(scratch, found.where("joins").select("a", "b"))
    rep = F.struct("doc_id", "place").alias("rep")
    labels = labels.join(kinds.select("node", rep), "node")
    labels = scratch.write(labels.join(labels.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("node", "least"), "least")
    linked = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    named = kinds.join(labels, "node", "left").join(linked, "node", "left").where("copies > 1 or least is not null")
    named = named.select("k1", "k2", F.coalesce("least", rep).alias("first"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    slim = sets.select("doc_id", "place", F.col("n").alias("n_shingles"), "k1", "k2").join(named, ["k1", "k2"], "left")
    known = F.col("doc_id").isNotNull() & F.col("first").isNotNull()
    stands = ~known | ((F.col("doc_id") == F.col("first.doc_id")) & F.col("place").eqNullSafe(F.col("first.place")))
    out = slim.select("doc_id", "place", "n_shingles", F.when(known, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(known, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"), stands.alias("stands"))
    links = None
    if pairs:
        ids = kinds.select("node", "doc_id")
        links = found.where("b is not null").join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = scratch.write(links, "pairs")
    out = scratch.write(out, "out")
    scratch.drop("sets", "kinds", "near", "heads", "members", "large", "placed", "links", "labels", "least")
    return out, links


def near_deduplicated(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, with all columns, without the rows that jaccard_components() links to one that stays: of each component the row with the
    smallest doc_id stays, of those the one with the least hash of its text. Rows with one doc_id and text are one document and stay
    together; rows without a doc_id, or without words, all stay.
    """
    found, _ = _joined(docs, words, num, den, text, doc_id, False)
    gone = found.where("not stands").select(F.col("doc_id").alias("__d"), F.col("place").alias("__p")).distinct()
    return docs.join(checked(gone, gone.count()), (docs[doc_id].cast("long") == F.col("__d")) & (F.xxhash64(docs[text]) == F.col("__p")), "left_anti")
