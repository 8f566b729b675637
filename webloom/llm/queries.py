"""Registered queries of this folder; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from webloom.llm import (
    block_search,
    byte_bpe,
    collocations,
    fill_middle,
    lattice_lm,
    main_text,
    packing,
    sharding,
    simhash,
    spherical,
    substring_dedup,
    syncmers,
    toxicity,
)
from webloom.llm.common import read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(read(spark, sf_dir, "documents"))


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(read(spark, sf_dir, "documents"))


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return lattice_lm.scores(read(spark, sf_dir, "documents"), pieces)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed(read(spark, sf_dir, "documents"), tokenizer)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read(spark, sf_dir, "documents"))


def op12_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.searched(read(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_histogram_shards": op2_histogram_shards,
    "op3_syncmers": op3_syncmers,
    "op4_toxicity": op4_toxicity,
    "op5_lattice_lm": op5_lattice_lm,
    "op6_simhash": op6_simhash,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op9_spherical_caps": op9_spherical_caps,
    "op8_byte_bpe": op8_byte_bpe,
    "op10_main_text": op10_main_text,
    "op11_fill_middle": op11_fill_middle,
    "op12_block_search": op12_block_search,
    "op13_collocations": op13_collocations,
}
#: SQL for DuckDB, where it can express the query.
ORACLES: dict[str, str] = {
    "op11_fill_middle": fill_middle.SQL,
    "op12_block_search": block_search.SQL,
    "op13_collocations": collocations.SQL,
}
