"""A pipeline that turns ``documents`` into packed training sequences: bad text
and near-duplicates go, then repeated passages, then contaminated documents, and
what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from learnlens.llm import common, decontaminate, fmindex, packing, quality, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    common.ship(spark)
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), "quality")
    return quality.accepted(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash near-duplicates."""
    common.ship(spark)
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 13 words that an earlier document holds;
    n_chars follows the text."""
    common.ship(spark)
    return common.with_length(fmindex.without_repeats(docs))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    common.ship(spark)
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts cut into sequences of 2048 ids: one row per piece, with its ids, its
    sequence and its place there."""
    common.ship(spark)
    return packing.pieces(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", keep_uncontaminated),
    ("packing", pack),
]

#: Trained models and tokenizers are beyond SQL; tests/llm holds the run
#: against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
