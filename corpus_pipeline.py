"""A corpus pipeline of five operators; each stage reads what its predecessor kept, written as Parquet.

All stages but the last return the columns of ``documents``. Counted as part of ``tapeflow.llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.llm import language_id, ngram_join, packing, pii, quality_rules
from tapeflow.llm.common import Scratch, held_out, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language, or with one that hardly leads, go. Labels teach as in the query."""
    model = language_id.train(docs, ~held_out("doc_id", 3, 1))
    judged = language_id.predict(docs, model, "_lang_pred", "_score")
    return judged.where((F.col("_lang_pred") != language_id.UNKNOWN) & (F.col("_score") >= language_id.LEAST_SCORE)).select(docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return ngram_join.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; every document stays."""
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("ngram_join", duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Language models and chosen paths are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
