"""A corpus pipeline: each stage applies one text operator to all rows that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.

Edge cases: null texts count as empty and fail the quality rules, so none reaches the second stage; rows that repeat
an id or a text pass the first two stages alike, and of equal texts exactly one row is left by the third; very long
texts pass whole; other columns are carried along by all stages but the last, whatever their names; an empty table
gives an empty result at every stage, and so does a run that leaves no document at one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import exact_dedup, packing, quality_rules, simhash, toxicity
from sparkloom.llm.common import ship, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep; empty and null texts go."""
    ship(spark)
    return quality_rules.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones among them, scores below its threshold; where
    none is labelled, the share of seed words decides."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the largest doc_id) of each group of equal texts; of rows that repeat it, one."""
    ship(spark)
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id) of each group of near duplicates, linked as the operator links them: at three
    or fewer of 64 bits over three-word shingles; of rows that repeat it, one."""
    ship(spark)
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids; every document that is left is in some."""
    return packing.packing_stage(spark, docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Weak supervision, boosted trees and fingerprints are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
