"""The corpus pipeline: quality classifier, near-dedup, decontamination, PII surrogates, sampled segmentations.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselace.llm.common import materialise, table
from tesselace.llm.decontaminate import drop_leaks
from tesselace.llm.kneser_ney import keep_documents
from tesselace.llm.near import keep_one
from tesselace.llm.pieces import sample_segmentations
from tesselace.llm.pii import replace_entities
from tesselace.llm.queries import TOKENIZERS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model accepts."""
    return keep_documents(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars is that of the new text."""
    return replace_entities(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document."""
    return sample_segmentations(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("segmentations", segmentations)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
