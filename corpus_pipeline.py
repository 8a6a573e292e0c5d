"""The training-corpus pipeline: each stage is one operator, written as Parquet and read again.

Every stage takes the documents its predecessor kept and applies its operator to all of them: the
quality classifier learns from the labels (bounded statistics only) and its rejects go; lines that
repeat go; one document of each group of near copies stays; documents that hold benchmark passages
go; what is left is packed into sequences. A document that lost all its lines is an empty text, and
empty texts are near copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import materialise, small_side, table
from lectern.llm.decontamination import drop_contaminated
from lectern.llm.line_dedup import dedup_lines
from lectern.llm.packing import pack, tokenizer_path
from lectern.llm.quality import document_statistics, fit, keep_good
from lectern.llm.simhash_dedup import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = table(spark, sf_dir, "labels")
    ids = materialise(labels.select("doc_id").distinct(), "labelled-ids")
    labelled = docs.join(small_side(ids), "doc_id", "left_semi")
    return keep_good(docs, fit(document_statistics(labelled), labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts that share 0.8 of their five-word shingles."""
    return drop_near_duplicates(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in sequences."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The stages' hashes, models and packing can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
