"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which
``run`` writes as Parquet to the shared checkpoint folder and reads again as
the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import drop_leaks
from tidemark.llm.packing import pack_documents
from tidemark.llm.secrets import redact_secrets
from tidemark.llm.simhash import keep_one_per_class, simhash_dedup
from tidemark.llm.support import operator_conf, scratch
from tidemark.llm.toxicity import drop_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, _table(spark, sf_dir, "labels"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    return keep_one_per_class(docs, simhash_dedup(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also edited, go."""
    return drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the texts; every document stays."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 1024 tokens."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: A trained classifier, XXH64, alignments and token merges are out of SQL's reach; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; returns the last one's rows."""
    docs = _table(spark, sf_dir, "documents")
    with scratch(spark, "pipeline") as s, operator_conf(spark):
        for i, (name, stage) in enumerate(STAGES):
            before, docs = docs, s.table(stage(spark, docs, sf_dir), name, keep=i + 1 == len(STAGES))
            s.drop(before)
    return docs
