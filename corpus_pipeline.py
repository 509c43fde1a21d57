"""A corpus pipeline of five stages: language, near-duplicates, personal data, mixture, packing.

Each stage works on all that its predecessor kept; its output is written as Parquet in the shared
folder and reread as the next stage's documents. All but the last return the columns of documents,
and any others that documents have, whatever their names.

Defined results: null, empty and letterless texts go at the first stage; repeated rows and equal
texts leave one document at the second; null ids, sources and languages are carried; very long texts
are worked on whole; an empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwright.llm import langid, mixing, omh, packing, pii
from spanwright.llm.common import Scratch, forget, staged, table
from spanwright.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a told language: no text, no letter, or no language at score 0.5."""
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of copies and near copies."""
    return omh.near_deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in the texts; n_chars follows the new text."""
    return pii.replaced(docs, pii.session_key(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", language), ("near-dedup", near_duplicates), ("PII", personal_data), ("mixing", mixture), ("packing", packed)]

#: Learned models, minimum hashes and token ids are beyond SQL; a test compares run() with a slow chain of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that packing makes of the documents of sf_dir. What a stage wrote goes when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with Scratch(spark) as scratch:
            docs = scratch.keep(staged(stage(spark, docs, sf_dir), f"pipeline-{i}"))
        if before:
            forget(spark, before)
        before = docs.staged_at
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
