"""Token counts under a unigram vocabulary, by dynamic programming shared in a trie."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix, text_slices

#: Stands before each pre-token.
SPACE = "▁"
#: A character that is no piece scores so much less than the worst piece and counts as its UTF-8 bytes.
PENALTY = 10.0
#: Pre-tokens whose counts a task holds at most; beyond that it begins anew.
HELD = 500_000
#: Text bytes whose distinct pre-tokens go through the trie together; a batch has no more.
SLICE_BYTES = 2_000_000


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a SentencePiece model file, without control, unknown, unused and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))}


def _step(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """Hash of a piece with one more character before it."""
    return mix(h + cp + np.uint64(1 << 40))


@dataclass(frozen=True)
class Vocabulary:
    """For each length: sorted hashes of all ends of pieces of that length, and their scores, -inf for those that are no piece."""

    tables: list[tuple[np.ndarray, np.ndarray]]
    worst: float

    @classmethod
    def of(cls, pieces: dict[str, float]) -> Vocabulary:
        ends: list[dict[int, float]] = []
        for piece, score in pieces.items():
            cps = np.array([ord(c) for c in reversed(piece)], np.uint64)
            h = np.zeros(1, np.uint64)
            for n in range(len(cps)):
                h = _step(h, cps[n : n + 1])
                if len(ends) <= n:
                    ends.append({})
                ends[n][int(h[0])] = max(ends[n].get(int(h[0]), -np.inf), score if n + 1 == len(cps) else -np.inf)
        tables = [(np.array(sorted(e), np.uint64), np.array([e[k] for k in sorted(e)])) for e in ends]
        return cls(tables, min(pieces.values()))


def count_words(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each of the distinct words: pieces of the segmentation with the best total score, of those the one with the fewest pieces.

    The words, with SPACE before them, are a trie: a level for each character, a node for each distinct prefix. In sorted order the words of
    a node stand together, so a level is made by comparing neighbours. A node's best score is computed once for all words below it, from its
    ancestors' and the pieces that end in it; a word's result is that of its last node.
    """
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    texts = [np.frombuffer((SPACE + words[i].decode("utf-8", "replace")).encode("utf-32-le"), np.uint32) for i in order]
    lengths = np.array([len(t) for t in texts], np.int64)
    cp = np.concatenate(texts).astype(np.uint64) if texts else np.zeros(0, np.uint64)
    start = np.cumsum(lengths) - lengths
    result = np.zeros(len(words), np.int64)
    live = np.arange(len(words))  # words that reach the level, in order
    node = np.zeros(len(words), np.int64)  # of each live word, at the level above
    levels = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))]  # scores, tokens, parents; the last ones only
    most = len(vocabulary.tables)
    depth = 0
    while len(live):
        c = cp[start[live] + depth]
        new = np.ones(len(live), bool)
        new[1:] = (node[1:] != node[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        parent, at = node[first], start[live[first]] + depth
        node = np.cumsum(new) - 1
        best, tokens = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
        own, up, h = np.arange(len(first)), parent, np.zeros(len(first), np.uint64)
        for n in range(1, min(depth + 1, most) + 1):
            keys, scores = vocabulary.tables[n - 1]
            h = _step(h, cp[at[own] - n + 1])
            k = np.searchsorted(keys, h)
            k[k == len(keys)] = 0
            known = keys[k] == h
            above, counts, parents = levels[-n]
            if n == 1:
                gain, size = np.where(known, scores[k], -np.inf), np.ones(len(own), np.int64)
                odd = np.isneginf(gain)
                gain[odd] = vocabulary.worst - PENALTY
                x = cp[at[odd]]
                size[odd] = 1 + (x >= 0x80).astype(np.int64) + (x >= 0x800) + (x >= 0x10000)
                best, tokens = above[up] + gain, counts[up] + size
            else:
                s, t = above[up] + np.where(known, scores[k], -np.inf), counts[up] + 1
                better = (s > best[own]) | ((s == best[own]) & (t < tokens[own]))
                best[own[better]], tokens[own[better]] = s[better], t[better]
            own, h = own[known], h[known]
            if not len(own):
                break
            up = parents[up[known]]
        levels = [*levels[1 - most :], (best, tokens, parent)] if most > 1 else [(best, tokens, parent)]
        depth += 1
        done = lengths[live] == depth
        result[order[live[done]]] = tokens[node[done]]
        live, node = live[~done], node[~done]
    return result


def token_counts(docs: DataFrame, pieces: dict[str, float], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row. Pre-tokens are runs of anything but ASCII white space.

    pieces, of which a vocabulary has some ten thousand, is sent to all tasks. Nothing is shuffled: a task takes its texts in slices, whole
    texts each; those of a slice's distinct pre-tokens that the task hasn't met go through the trie, and their terminal counts are held.

    Nulls and texts without words count 0; a single long text is a slice of its own. Segmentations that tie have the fewest pieces. Repeated rows
    and null doc_ids are each returned; other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.of(pieces))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            for lo, texts in text_slices(b.column(1), SLICE_BYTES):
                split = [t.split() if t else [] for t in texts]
                counts = np.array([len(s) for s in split], np.int64)
                flat = np.empty(int(counts.sum()), object)
                flat[:] = [w for s in split for w in s]
                code, distinct = pd.factorize(flat)
                if new := [w for w in distinct if w not in held]:
                    if len(held) + len(new) > HELD:
                        held, new = {}, list(distinct)
                    held.update(zip(new, count_words(new, sent.value).tolist(), strict=True))
                each = np.array([held[w] for w in distinct], np.int64)[code] if len(flat) else np.zeros(0, np.int64)
                sums = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=each, minlength=len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(counts), pa.array(sums)], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, "doc_id long, n_pretokens long, n_tokens long")
