"""A training corpus from documents, stage by stage; each stage is written and read again.

Stages judge rows by their texts: rows that share a doc_id, or have none, are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vtable.llm.common import Scratch, free_name, read
from vtable.llm.decontaminate import decontaminate
from vtable.llm.exact import deduplicated
from vtable.llm.jaccard import near_deduplicated
from vtable.llm.langid import UNKNOWN, identify, learn
from vtable.llm.mixing import mix_sources
from vtable.llm.queries import OTHERS, WEIGHTS

#: Documents whose likeliest language has less than this posterior probability are rejected.
LEAST_SCORE = 0.5
#: So are those less like the texts of that language than halfway between them and n-grams at random.
LEAST_FIT = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones have: those without letters, or too unlike any of them, go. Each row is judged by its text."""
    pred, score, fit = (free_name(docs, n) for n in ("lang_pred", "score", "fit"))
    found = identify(docs, learn(docs), keep=docs.columns)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= LEAST_SCORE) & (F.col(fit) >= LEAST_FIT)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, with the largest doc_id; null counts as empty."""
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id stays."""
    return near_deduplicated(docs, words=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a passage of benchmark go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, shuffled; those of sources without a weight at the rate OTHERS."""
    return mix_sources(docs, WEIGHTS, seed=1, default=OTHERS)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near), ("decontamination", benchmark), ("mixing", mixture)]
#: Hashed n-gram models have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
