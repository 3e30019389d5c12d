"""The corpus pipeline: documents through the operators, each stage written and read again.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns
of documents. Line dedup and near dedup compare shingles of five words at a similarity of 0.8.
A document whose lines all repeat earlier ones stays with what is left of its text, the mix
then never takes it, as it has no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import common, line_dedup, mixing, near_dedup, packing, toxicity


def keep_untoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject."""
    return toxicity.keep_clean(docs, common.documents(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go."""
    return line_dedup.remove_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs, mixing.mix(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", keep_untoxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: Learned scores, minhashes and token ids are beyond SQL. Tests compare line dedup and near dedup with brute force,
#: packing with the tokenizers file, the mix with its targets, and toxicity with its labels (test_llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
