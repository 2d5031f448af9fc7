"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that its stage keeps, with
the columns of ``docs``, or, for the last, the packed pieces. Between stages documents are written as Parquet in the shared
folder and read again, so a stage that is lost runs again from its own input. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, near_copies, packing, pii, quality_rules
from tidemark.llm.common import drop_tables, keep_only, materialize, read, tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned ones reject."""
    return quality_rules.filter_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 5-word shingles, a similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch of each document that the mix takes."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packing_stage),
]

#: Fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``. A stage's own tables, and its input, go once its output is written."""
    docs, done = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with tables() as written:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_tables(spark, done + written[:-1])
        done = written[-1:]
    with tables() as written:
        return keep_only(STAGES[-1][1](spark, docs, sf_dir), done + written)
