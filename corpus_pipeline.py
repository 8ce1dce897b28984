"""A training corpus from ``documents``: quality rules, near-duplicates, personal
data, mixing, packing. Each stage's result is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import mixing, packing, pii, quality, simhash
from palimpsest.storage import read_table, stash


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows beyond a threshold of their language and source, and those without a word."""
    return quality.filter_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates; rows without a letter or digit stay."""
    return simhash.drop_near_duplicates(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the spans of personal data in their texts replaced by their kind; null texts stay null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the target weights use it: those of scarce languages more than once,
    some of plentiful ones not at all. Rows without text go."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of related documents with their words, as they are after the stages before."""
    return packing.pack(docs, texts=True)


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_copies),
    ("personal data", remove_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Personal data, the flow and the walk have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of ``documents``. No documents give no windows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
