"""The corpus pipeline: toxicity and quality filters, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``docs``. Classifiers learn from the labelled
documents among their own input.

Nulls, empty texts, repeated rows and extra columns are handled as the operators' docstrings say:
empty texts get the classifiers' base rate and are kept unless that rejects them, rows without a
doc_id are kept by near-dedup, and of repeated rows near-dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm import minhash_dedup, packing, quality, toxicity
from pixelframe.llm.runtime import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)("text") < toxicity.THRESHOLD)


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(spark, model)("text") >= quality.SELECT_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", select_quality),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Trained models and weighted sampling can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
        work.keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
