"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, mix, text_slices

#: Lengths of the n-grams; together they have 2 ** BITS buckets.
LENGTHS, BITS = (1, 2, 3), 16
#: About so many labelled documents are learned from, drawn by a hash of doc_id and text; all of them where there are fewer.
SAMPLE = 20_000
#: Languages that a model has room for; more are an error.
MOST_LANGS = 500
#: Added to each bucket's count.
SMOOTH = 0.5
UNKNOWN = "und"


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and whether it is a letter or a mark, which words go on over."""
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return alpha, alpha | np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the number of n-grams of each text, the number of letters of each text.

    Texts are lower-cased; each run of characters that are neither letters nor marks counts as one space, as does either end.
    """
    parts = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
    cp = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    alpha, wordly = letters()
    n_letters = np.bincount(owner[alpha[cp]], minlength=len(parts))
    is_letter = wordly[cp]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    cp, owner = np.where(is_letter, cp, 32)[keep].astype(np.uint64), owner[keep]
    found, owners, h = [], [], np.zeros(len(cp), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        m = max(0, len(cp) - n + 1)
        h = mix(h[:m] + cp[n - 1 :] + np.uint64(n << 40))
        if n in LENGTHS:
            inside = owner[:m] == owner[n - 1 :]
            found.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[:m][inside])
    o = np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return np.concatenate(found)[order], np.bincount(o, minlength=len(parts)), n_letters


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order, log P(bucket | language) by language and bucket, log P(language), and the mean log P of an n-gram of a
    language's own texts that is left out of its counts."""

    langs: list[str]
    table: np.ndarray
    prior: np.ndarray
    usual: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language, its posterior probability, and its fit: 1 where the text's n-grams are as likely as those of the language's
        own texts, 0 where they are no likelier than any bucket drawn at random, in between by the mean of the logarithms."""
        bucket, counts, n_letters = grams(texts)
        some = counts > 0
        starts = (np.cumsum(counts) - counts)[some]
        logs = np.tile(self.prior, (len(texts), 1))
        for k in range(len(self.langs)):
            if len(starts):
                logs[some, k] += np.add.reduceat(self.table[k][bucket], starts)
        best = logs.argmax(1)
        score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        ok = n_letters > 0
        chance = -BITS * np.log(2)
        mean = (logs[np.arange(len(texts)), best] - self.prior[best]) / np.maximum(counts, 1)
        fit = (mean - chance) / np.maximum(self.usual[best] - chance, 1e-9)
        return [self.langs[b] if x else UNKNOWN for b, x in zip(best.tolist(), ok.tolist(), strict=True)], np.where(ok, score, 0.0), np.where(ok, fit, 0.0)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    for lo, texts in text_slices(column, 120_000):
        yield lo, [None if t is None else t.decode() for t in texts]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang and text to bucket counts, summed up within the task; bucket -1 counts documents."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for lo, texts in _texts(b.column(1)):
            bucket, counts, _ = grams(texts)
            ends = np.cumsum(counts)
            for i, lang in enumerate(langs[lo : lo + len(texts)]):
                t = total.setdefault(lang, np.zeros(2**BITS + 1, np.int64))
                t[:-1] += np.bincount(bucket[ends[i] - counts[i] : ends[i]], minlength=2**BITS)
                t[-1] += 1
    for lang, t in total.items():
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == 2**BITS, -1, at)), pa.array(t[at])], names=["lang", "bucket", "n"])


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Counts n-grams of the labelled rows that have a language, or of a hashed sample of about sample of them. The driver gets 2 ** BITS sums
    at most for each of MOST_LANGS languages; more languages are an error.

    Rows are drawn by doc_id and text, so those without a doc_id are drawn by their text; only rows that repeat both are drawn together.
    """
    bounded_batches(labelled.sparkSession)
    labelled = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id")).where("lang is not null and text is not null")
    share = min(1.0, sample / max(1, labelled.count()))
    drawn = labelled.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit("langid")), F.lit(1_000_003)) < share * 1_000_003)
    if len(drawn.select("lang").distinct().limit(MOST_LANGS + 1).collect()) > MOST_LANGS:
        raise ValueError(f"there are more than {MOST_LANGS} languages")
    sums = drawn.select("lang", "text").mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return fit({lang: dict(zip(own["bucket"].tolist(), own["n"].tolist(), strict=True)) for lang, own in sums.groupby("lang")})


def fit(sums: dict[str, dict[int, int]]) -> Model:
    """A model from the counts of n-grams by language and bucket; bucket -1 counts documents."""
    langs = sorted(sums)
    table, docs, usual = np.full((len(langs), 2**BITS), SMOOTH), np.ones(len(langs)), np.zeros(len(langs))
    for k, name in enumerate(langs):
        docs[k] = sums[name].get(-1, 0)
        own = {b: n for b, n in sums[name].items() if b >= 0}
        n = np.array(list(own.values()), np.int64)
        table[k, list(own)] += n
        usual[k] = (n * (np.log(n - 1 + SMOOTH) - np.log(max(1, n.sum() - 1 + SMOOTH * 2**BITS)))).sum() / max(1, n.sum())
    table = np.log(table) - np.log(table.sum(1, keepdims=True)) if langs else table
    return Model(langs, table, np.log(docs / docs.sum()) if langs else docs, usual)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns keep of each row with lang_pred, score, fit: the likeliest of the model's languages, its posterior probability among them,
    and how much the text is like that language's own (see Model.predict), which a text in a language that wasn't learned is not.

    The whole text counts. Null texts and texts without a letter are UNKNOWN with score and fit 0, and so is everything if the model has learned no
    language. The first language in alphabetical order wins ties. Repeated rows are each returned, null doc_ids too. Where keep has columns
    of the new ones' names, those have an underscore behind theirs. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    new = [free_name(kept, n) for n in ("lang_pred", "score", "fit")]
    schema = T.StructType([*kept.schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType()), T.StructField(new[2], T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in _texts(b.column(0)):
                names, scores, fits = sent.value.predict(texts) if sent.value.langs else ([UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)))
                own = [c.slice(lo, len(texts)) for c in b.columns[1:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores), pa.array(fits)], names=schema.names)

    own = free_name(kept, "text_of")
    return docs.select(F.col(text).alias(own), *[F.col(f"`{c}`") for c in keep]).mapInArrow(rows, schema)


def held_out(doc_id) -> F.Column:
    """One row in five, by the CRC-32 of doc_id as text; a null counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: what identify() says, learned from the rows of docs that have a lang and aren't held out."""
    model = learn(docs.where(~held_out(F.col("doc_id"))), sample=sample)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")
