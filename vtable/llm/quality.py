"""Quality classifier: a weak-label model over overlapping heuristics trains a hashed linear scorer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, hash_words, mix, text_slices

#: Votes: 0 bad, 1 good, 2 none. A pattern is the votes of all labellers as digits to the base 3, the first labeller's lowest.
BAD, GOOD, NONE = 0, 1, 2
#: Each looks at one share of a text, votes bad on one side of a gap and good on the other, and not within: (name, bad, good, weight). They
#: overlap: most kinds of bad text are seen by two or more, as the label model needs. weight is the number of words (or characters, lines) that
#: stand in the middle of the gap beside the text's own, so a short text gets votes only for what is plain even there.
RULES = (
    ("symbols", 0.03, 0.005, 20),
    ("capitals", 0.3, 0.12, 20),
    ("repeats", 0.25, 0.5, 3),
    ("columns", 0.2, 0.02, 0.5),
    ("marks", 0.7, 0.4, 3),
    ("doubled", 0.2, 0.05, 2),
    ("starts", 0.6, 0.7, 4),
    ("sentences", 0.3, 0.7, 1),
    ("stutter", 0.12, 0.03, 2),
    ("commonest", 0.3, 0.15, 3),
)
LABELLERS = tuple(r[0] for r in RULES)
#: P(bad vote) and P(good vote) of a labeller that votes, on bad and on good documents, to begin with; and how much that weighs.
PRIOR, FIRM = np.array([[0.5, 0.5], [0.02, 0.98]]), 0.1
#: So many buckets hold the scorer's weights. In its sums over documents derivatives and labels are whole multiples of 1 / ONE at the finest, so
#: that no sum depends on the order of its parts.
BITS, ONE = 16, 2.0**40
#: The threshold is looked for in so many cells of scores at a time.
CELLS = 2**16
#: Labels are counted as whole multiples of 1 / GOOD_ONE for the threshold; where a sample is asked for, texts draw a number below DRAWS.
GOOD_ONE, DRAWS = 2**30, 1_000_003
#: The scorer is trained until no derivative of its mean loss is over TOLERANCE, in ROUNDS steps at most.
TOLERANCE, ROUNDS, DECAY = 1e-5, 500, 1e-4

_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_PUNCTUATION = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_SYMBOLS = [ord(c) for c in "#$%&*+<=>@[]^_`{}~\\"]
_ENDS = (b".", b"!", b"?", b":", b'"', b"'")


def shares(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numerators and denominators of the shares that RULES look at: a row for each text, a column for each rule."""
    n = len(texts)
    chars, facts = np.zeros((n, 256), np.int64), np.zeros((n, 8))
    for i, t in enumerate(texts):
        if not t:
            continue
        b = np.frombuffer(t, np.uint8)
        chars[i] = np.bincount(b, minlength=256)
        first = b[(b > 32) & np.concatenate(([True], b[:-1] <= 32))]
        lines, words = t.splitlines(), t.split()
        often = Counter(words)
        ended = sum(x.rstrip().endswith(_ENDS) for x in lines)
        small = ((first >= 128) | (first >= 97) & (first < 123)).sum()
        twice = (_PUNCTUATION[b[1:]] & (b[1:] == b[:-1])).sum()
        facts[i] = len(words), len(often), ended, len(lines), small / max(1, len(first)) * len(words), twice, sum(map(eq, words, islice(words, 1, None))), max(often.values(), default=0)
    words, distinct, ended, lines, small, twice, again, most = facts.T
    size, letters = chars.sum(1), chars[:, _UPPER].sum(1) + chars[:, _LOWER].sum(1)
    # long texts repeat words by themselves
    fresh = distinct * np.maximum(1, np.log10(np.maximum(10, words)) / 2)
    bars = chars[:, ord("|")] + chars[:, 9]
    over = [chars[:, _SYMBOLS].sum(1), chars[:, _UPPER].sum(1), fresh, bars, chars[:, _PUNCTUATION].sum(1), twice, small, ended, again, most]
    under = [size, letters, words, words, words, words, words, lines, words, words]
    return np.stack(over, 1).astype(float), np.stack(under, 1).astype(float)


def votes(texts: list[bytes | None]) -> np.ndarray:
    """A row for each text, a column for each of LABELLERS. Texts without words get no vote."""
    over, under = shares(texts)
    out = np.full(over.shape, NONE)
    for k, (_, bad, good, weight) in enumerate(RULES):
        x = (over[:, k] + weight * (bad + good) / 2) / (under[:, k] + weight)
        worse, better = (x > bad, x < good) if bad > good else (x < bad, x > good)
        out[:, k] = np.where(under[:, 2] == 0, NONE, np.where(worse, BAD, np.where(better, GOOD, NONE)))
    return out


@dataclass(frozen=True)
class LabelModel:
    """P(vote | quality) by labeller, quality and vote, and P(good)."""

    table: np.ndarray
    good: float

    def posterior(self, votes_: np.ndarray) -> np.ndarray:
        logs = np.tile(np.log([1 - self.good, self.good]), (len(votes_), 1))
        for k in range(len(self.table)):
            logs += np.log(self.table[k][:, votes_[:, k]]).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))


def digits(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**k % 3 for k in range(len(LABELLERS))], 1)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns, which say all that the model needs of the documents.

    Labellers that vote do so independently given the quality; abstaining says nothing. What is estimated is how accurate each is on bad and
    on good documents. It begins with PRIOR, which also counts as FIRM documents a document, since labellers are known to be better than chance.
    """
    v, n = digits(patterns), counts.astype(float)
    begin = np.append(PRIOR, np.ones((2, 1)), 1)
    model = LabelModel(np.tile(begin, (len(LABELLERS), 1, 1)), 0.8)
    for _ in range(rounds):
        p = model.posterior(v)
        w = np.stack([n * (1 - p), n * p])
        new = np.stack([np.stack([[w[y][v[:, k] == x].sum() for x in (BAD, GOOD)] for y in (0, 1)]) for k in range(len(LABELLERS))])
        new += PRIOR * (1 + FIRM * new.sum(2, keepdims=True))
        table = np.append(new / new.sum(2, keepdims=True), np.ones((len(LABELLERS), 2, 1)), 2)
        good = float(np.clip((w[1].sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        done = np.abs(table - model.table).max() < 1e-7 and abs(good - model.good) < 1e-7
        model = LabelModel(table, good)
        if done:
            break
    return model


def counted(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, counts, and how many of them each text (row) has of each kind (column): hashed byte trigrams and words of the whole text, and the
    words that are there so often, by powers of two of their count, without and with the power of two of the number of words."""
    buckets, counts, kinds = [], [], np.zeros((len(texts), 4), np.int32)
    mask = np.uint64(2**BITS - 1)
    for i, t in enumerate(texts):
        t = t or b""
        b = np.frombuffer(t, np.uint8).astype(np.uint64)
        three = mix(b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)) & mask if len(b) > 2 else b[:0]
        words = mix(hash_words(t.split()) + np.uint64(1)) & mask
        for k, x in enumerate((three, words)):
            u, c = np.unique(x, return_counts=True)
            buckets.append(u.astype(np.int32))
            counts.append(c)
            kinds[i, k] = len(u)
        if len(words):
            often, many = np.log2(c).astype(np.int64), int(np.log2(len(words)))
            part = np.bincount(often, weights=c).astype(np.int64)
            at = np.flatnonzero(part)
            for code in (at, at + 64 * (many + 1)):
                buckets.append((mix(code.astype(np.uint64) + np.uint64(1 << 50)) & mask).astype(np.int32))
                counts.append(part[at])
            kinds[i, 2:] = len(at)
    return np.concatenate(buckets) if buckets else np.zeros(0, np.int32), np.concatenate(counts) if counts else np.zeros(0, np.int64), kinds


def scales(count: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """What the counts of each text and kind are multiplied by: one by their norm for trigrams and words, one by the number of words for the rest."""
    sizes, out = kinds.ravel(), np.zeros(kinds.size)
    if len(count):
        there, c = sizes > 0, count.astype(float)
        starts = (np.cumsum(sizes) - sizes)[there]
        by_norm = np.tile([True, True, False, False], len(kinds))[there]
        out[there] = 1 / np.where(by_norm, np.sqrt(np.add.reduceat(c * c, starts)), np.add.reduceat(c, starts))
    return out


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, values and how many of each text: hashed words and byte trigrams of the whole text, each kind's counts by their norm, and how
    much of the text is words that are there so often, by powers of two of their count and of the number of words."""
    bucket, count, kinds = counted(texts)
    return bucket, count * np.repeat(scales(count, kinds), kinds.ravel()), kinds.sum(1)


def packed(texts: list[bytes | None]) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """features() of a slice in few bytes: how many of each text and kind, their scales, the steps from bucket to bucket, the counts."""
    bucket, count, kinds = counted(texts)
    steps = np.diff(bucket, prepend=0).astype(np.uint16)
    count_ = count.astype(np.uint16 if count.max(initial=0) < 2**16 else np.uint32)
    codec = pa.Codec("zstd")
    return kinds.ravel(), scales(count, kinds).tobytes(), codec.compress(steps.tobytes(), asbytes=True), bytes([count_.itemsize]) + codec.compress(count_.tobytes(), asbytes=True)


@dataclass(frozen=True)
class Slice:
    """The features of a slice of texts."""

    bucket: np.ndarray
    count: np.ndarray
    sizes: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, kinds: np.ndarray, scale: bytes, steps: bytes, counts: bytes) -> Slice:
        n, width, codec = int(kinds.sum()), counts[0], pa.Codec("zstd")
        bucket = np.cumsum(np.frombuffer(codec.decompress(steps, 2 * n), np.uint16), dtype=np.uint16).astype(np.int64)
        count = np.frombuffer(codec.decompress(counts[1:], width * n), np.uint16 if width == 2 else np.uint32).astype(float)
        return cls(bucket, count, kinds, np.frombuffer(scale))

    def margins(self, w: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.sizes))
        if len(self.bucket):
            there = self.sizes > 0
            sums[there] = np.add.reduceat(w.take(self.bucket) * self.count, (np.cumsum(self.sizes) - self.sizes)[there])
        a, b, c, d = (sums * self.scale).reshape(-1, 4).T
        return a + b + c + d + w[-1]

    def derivatives(self, error: np.ndarray, one: float) -> np.ndarray:
        """By bucket, the sum of each text's error times its value, as whole multiples of 1 / one."""
        x = np.rint(np.repeat(np.repeat(error * one, 4) * self.scale, self.sizes) * self.count)
        return np.bincount(self.bucket, weights=x, minlength=2**BITS).astype(np.int64)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_scorer(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights at which loss, which gives a value and its derivatives, is least, the last one constant. By limited-memory quasi-Newton steps
    until no derivative is over tolerance."""
    w, past = np.zeros(2**BITS + 1), []
    f, g = loss(w)
    for _ in range(rounds):
        if np.abs(g).max() <= tolerance:
            break
        q, used = g.copy(), []
        for s, y, r in reversed(past):
            used.append(r * (s @ q))
            q -= used[-1] * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, r), a in zip(past, reversed(used), strict=True):
            q += s * (a - r * (y @ q))
        step, slope = (1.0 if past else 1 / max(1e-9, np.abs(g).max())), -(g @ q)
        while True:
            f2, g2 = loss(w - step * q)
            if f2 <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = -step * q, g2 - g
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
        w, f, g = w + s, f2, g2
        if step < 1e-10:
            break
    return w


def _slices(docs: DataFrame, text: str, doc_id: str, drawn: bool) -> DataFrame:
    """A row for a slice of texts: doc_id, draw (a number below DRAWS by a hash of the text, if drawn, else 0) and vote pattern of each, features."""
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit("quality")), F.lit(DRAWS)) if drawn else F.lit(0)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), draw.cast("int").alias("draw"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in text_slices(b.column(1)):
                n = pa.array([0, len(texts)], pa.int32())
                pattern = (votes(texts) * 3 ** np.arange(len(LABELLERS))).sum(1).astype(np.int32)
                kinds, *binary = packed(texts)
                lists = [pa.ListArray.from_arrays(n, x) for x in (b.column(0).slice(lo, len(texts)), b.column(2).slice(lo, len(texts)), pa.array(pattern))]
                lists.append(pa.ListArray.from_arrays(pa.array([0, len(kinds)], pa.int32()), pa.array(kinds)))
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in binary)], names=["doc_id", "draw", "pattern", "kinds", "scale", "steps", "counts"])

    return slim.mapInArrow(pack, "doc_id array<long>, draw array<int>, pattern array<int>, kinds array<int>, scale binary, steps binary, counts binary")


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, Slice]]:
    """draw and pattern of each text, and the features, of each row of _slices."""
    column = {n: b.column(b.schema.get_field_index(n)) for n in ("draw", "pattern", "kinds", "scale", "steps", "counts")}
    for i in range(b.num_rows):
        draw, pattern, kinds = (column[n][i].values.to_numpy() for n in ("draw", "pattern", "kinds"))
        yield draw, pattern, Slice.of(kinds, *(column[n][i].as_py() for n in ("scale", "steps", "counts")))


def _loss(slices: DataFrame, labels: Broadcast, n: int, least: int, decay: float = DECAY) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The mean logistic loss of the drawn of n documents, with probabilities as labels, and decay / 2 times the squared weights; and its derivatives.

    Each task adds its documents up as whole numbers, small enough that those of n documents fit into 64 bits, so the sums are the same however
    the documents are dealt to tasks. What the driver gets is a number for each weight.
    """
    one = min(ONE, 2.0 ** (60 - n.bit_length()))
    rows, context = slices.select("draw", "pattern", "kinds", "scale", "steps", "counts"), slices.sparkSession.sparkContext

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(w)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, w = np.zeros(2**BITS + 3, np.int64), sent.value
            for b in batches:
                for draw, pattern, part in _unpacked(b):
                    z, label, taken = part.margins(w), labels.value[pattern], draw < least
                    error = np.where(taken, probability(z) - label, 0.0)
                    total[: 2**BITS] += part.derivatives(error, one)
                    more = np.rint(error * one).sum(), np.rint(np.where(taken, np.logaddexp(0, z) - label * z, 0.0) * (one / 256)).sum(), taken.sum()
                    total[2**BITS :] += np.array(more).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "x"])

        got = rows.mapInArrow(add, "at int, x long").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        sent.destroy()
        total = np.zeros(2**BITS + 3)
        total[got.column("at").to_numpy()] = got.column("x").to_numpy()
        many = max(1.0, total[-1])
        return total[-2] / (one / 256) / many + decay / 2 * (w @ w), total[:-2] / one / many + decay * w

    return loss


def best_threshold(rows: DataFrame) -> float:
    """Halfway between the two neighbouring scores of rows (score, good) that tell good from bad best: where the share of the good at or over it
    less the share of the bad (each row is good / GOOD_ONE of the one and the rest of the other; null counts as neither) is largest; the lowest such.

    Scores are counted by cells. Where a cell begins the difference is known; within it, it is at most what it would be had all the cell's
    good rows the higher scores. Cells that may hold a better one are divided, until there is none.
    """
    edges = (np.arange(CELLS) / CELLS).view(np.int64)
    rows = rows.where("good IS NOT NULL")
    while True:
        sent = rows.sparkSession.sparkContext.broadcast(edges)

        def cells(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                # doubles that are not negative have the order of their bits
                key = b.column(0).to_numpy().view(np.int64)
                cell = np.searchsorted(sent.value, key, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(key), b.column(1)], names=["cell", "key", "good"])

        by = rows.select("score", "good").mapInArrow(cells, "cell int, key long, good long").groupBy("cell")
        got = by.agg(F.sum("good").alias("good"), F.sum(F.lit(GOOD_ONE) - F.col("good")).alias("bad"), F.min("key").alias("lo"), F.max("key").alias("hi")).toArrow()
        sent.destroy()
        if not got.num_rows:
            return 0.5
        got = got.sort_by([("cell", "descending")])
        good, bad = (np.array(got.column(c).to_pylist(), object) for c in ("good", "bad"))
        lo, hi = (got.column(c).to_numpy() for c in ("lo", "hi"))
        over, under = np.cumsum(good), np.cumsum(bad)
        goods, bads = max(1, over[-1]), max(1, under[-1])
        gap, most = over * bads - under * goods, over * bads - (under - bad) * goods
        best = gap.max()
        again = (lo < hi) & (most >= best).astype(bool)
        if not again.any():
            break
        step = (hi[again] - lo[again]) // max(2, CELLS // int(again.sum())) + 1
        parts = [np.arange(a, b + 1, s) for a, b, s in zip(lo[again], hi[again], step, strict=True)]
        # cells that are done with stay apart: together they might have to be divided again
        edges = np.unique(np.concatenate([np.zeros(1, np.int64), lo, *parts, hi[again] + 1]))
    at = np.flatnonzero(gap == best)[-1]
    s = np.append(lo[at], hi[at + 1 : at + 2]).view(float)
    return float(s.sum() / 2)


@dataclass(frozen=True)
class Scorer:
    """The label model, the weights of the linear scorer, and the score from which on documents are kept."""

    labels: LabelModel
    weights: np.ndarray
    least: float


def _learn(slices: DataFrame, sample: int | None) -> tuple[LabelModel, np.ndarray, np.ndarray, int]:
    """The label model, its posteriors by pattern, the scorer's weights, and the number that those texts' draws are below that train it."""
    counts = slices.select(F.explode("pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).toArrow()
    pattern, many = (counts.column(c).to_numpy().astype(np.int64) for c in ("pattern", "n"))
    order, n = np.argsort(pattern), int(many.sum())
    model = fit_labels(pattern[order], many[order])
    labels = model.posterior(digits(np.arange(3 ** len(LABELLERS))))
    least = DRAWS if sample is None else int(np.ceil(min(1.0, sample / max(1, n)) * DRAWS))
    if not n:
        return model, labels, np.zeros(2**BITS + 1), least
    sent = slices.sparkSession.sparkContext.broadcast(labels)
    weights = fit_scorer(_loss(slices, sent, n, least))
    sent.destroy()
    return model, labels, weights, least


def _scored(slices: DataFrame, labels: np.ndarray, weights: np.ndarray, least: int) -> DataFrame:
    """doc_id, score, good of each document: the label as a multiple of 1 / GOOD_ONE, null if the document does not train the scorer."""
    sent = slices.sparkSession.sparkContext.broadcast((labels, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, weights = sent.value
        for b in batches:
            for i, (draw, pattern, part) in enumerate(_unpacked(b)):
                good = pa.array(np.rint(labels[pattern] * GOOD_ONE).astype(np.int64), mask=draw >= least)
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(probability(part.margins(weights))), good], names=["doc_id", "score", "good"])

    return slices.mapInArrow(score, "doc_id long, score double, good long")


def _learned(docs: DataFrame, text: str, doc_id: str, sample: int | None, least: float | None) -> tuple[Scorer, DataFrame]:
    """The scorer, with least as its threshold if that is given, and each document's doc_id and score, in the shared folder."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    slices = scratch.write(_slices(docs, text, doc_id, sample is not None), "slices")
    model, labels, weights, below = _learn(slices, sample)
    scores = scratch.write(_scored(slices, labels, weights, below), "scores")
    scratch.drop("slices")
    return Scorer(model, weights, best_threshold(scores) if least is None else least), scores


def learn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int | None = None) -> Scorer:
    """Every document counts in the weak-label model, the scorer's weights and the threshold.

    Texts are read once: votes and features are written to the shared folder and deleted when the scorer is learned. The label model needs a number
    for each vote pattern (3 ** labellers at most). The scorer is trained on all documents, the model's posteriors as labels: each step's loss
    and derivatives are summed where the features are, and the driver gets a number for each weight. The threshold is the score that tells good
    from bad best among all documents, by the same posteriors; it is exact. With sample, scorer and threshold are learned from about so many
    documents, drawn by a hash of the text.
    """
    return _learned(docs, text, doc_id, sample, None)[0]


def quality_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int | None = None, least: float | None = None) -> DataFrame:
    """doc_id, score, kept of each row of docs: the probability of good quality by the linear scorer that learn() trains on docs, and whether it is
    least or more; without least, the threshold that learn() finds.

    Every whole text is scored. Null and empty texts are scored as texts without features. Equal texts have equal scores. Repeated rows and
    null doc_ids are each scored; other columns are not read. An empty table gives an empty result.
    """
    scorer, scores = _learned(docs, text, doc_id, sample, least)
    return scores.select("doc_id", "score", (F.col("score") >= scorer.least).alias("kept"))
