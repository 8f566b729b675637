"""Cleaning and packing a corpus: stages of operators, each on all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from webloom.llm import near_copies as copies
from webloom.llm import packing, substring_dedup, toxicity
from webloom.llm.common import read, stored


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, machine)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates.

    Near duplicates have 5-word shingles with a Jaccard similarity of 0.8 or more.  Links of SimHash fingerprints
    come first and are checked exactly; an exact search finds those that the fingerprints do not link.  Of several
    rows with that id one stays, and of a group without any id one row.
    """
    return copies.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that an earlier document has too."""
    return substring_dedup.without_repeats(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack: one row per piece of a document with its place in a sequence."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_copies),
    ("substring_dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: Classifier, fingerprints, subword tokens and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stored before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
