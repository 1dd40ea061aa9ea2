"""A corpus pipeline: five filters and encoders, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wirelens.llm import bpe, decontam, langid, neardup, toxicity
from wirelens.llm.common import Scratch, table

#: Copies from 0.8 on, not op1's 0.85: more trees and a lower sketch bar (0.85 expected, deviation 0.03) for the same recall.
NEAR = neardup.Forest(percent=80, trees=16, agree=0.70)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without toxic texts; null and empty ones are judged as unmarked. Equal texts go or stay together."""
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.tolerable(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` in a language that the labelled ones have; texts that are null or have no letter go."""
    return langid.accepted(docs, langid.train(langid.learnable(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one document of each group; rows of a repeated id are judged each by its own text, null ids stay."""
    return neardup.without_near_duplicates(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark item; null texts and null ids stay."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of digests for every row of ``docs``; null and empty texts have no ids."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.decode(bpe.encode(docs, path, pattern), path, pattern))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Trained models and token merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is kept in the shared folder until the next one is."""
    scratch, before = Scratch(spark), []
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
