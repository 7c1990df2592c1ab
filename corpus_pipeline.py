"""A corpus pipeline of five operators; each stage's result is written as Parquet and read again by the next.

Texts of any length are handled whole, an empty table gives empty results, and extra columns of any name are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm import mixing, ngram_join, packing, substring_dedup, toxicity
from evidora.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go; all others stay as they are, null and empty texts and
    repeated rows too."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, name).filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; so do all without a word, rows equal in id and text once."""
    return ngram_join.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that repeat another document's text are cut out; documents stay, even empty, and null texts stay null."""
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets; documents without a word stay once."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of sequences; null and empty texts are an end token each."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substring_dedup", cut_repeats), ("mixing", mix_sources), ("packing", pack)]
#: SQL can't express training, shingle joins or tokenizing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
