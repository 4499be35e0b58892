"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import line_dedup, minhash, packing, quality_rules, substring
from storyloom.llm.common import load, materialize, text_or_empty

#: Packing has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def _with_text(docs: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """kept: every column of docs with its text replaced in `name`; n_chars follows the new text."""
    out = kept.withColumn("text", F.col(name)).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    return quality_rules.kept_documents(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that occur in five documents or more outside their largest doc_id."""
    return _with_text(docs, line_dedup.with_kept_text(docs), line_dedup.KEPT)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by a similarity of 0.8 on shingles of five words."""
    return minhash.kept_documents(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without words in 35-word windows that occur more than once in the corpus."""
    return _with_text(docs, substring.with_kept_text(docs), substring.KEPT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("line_dedup", lines_stage),
    ("minhash_near_dedup", near_stage),
    ("substring_dedup", passages_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; each stage's result is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
