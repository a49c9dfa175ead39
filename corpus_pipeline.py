"""The corpus pipeline: documents through five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again as the next stage's documents.

Defined cases, in every stage: a null text is an empty one (the quality rules reject it); a null doc_id keeps its row and
stands for itself; rows that repeat are judged alike, each by its own text, and near-dedup keeps one row of each group, the smallest
doc_id's (ids before null, then the least text hash, then the least other columns); ties of a threshold reach it; texts of any length are
read whole; empty tables pass through as empty tables; without labels or benchmark items nothing is rejected for their sake; columns
beyond those of documents are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelink.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from orelink.llm.common import dropped, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _whole_texts(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most ``rows``, on both sides of the pipe; the session keeps a smaller setting of its own."""
    spark.conf.set(BATCH, min(rows, int(spark.conf.get(BATCH))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows of one doc_id stand or fall by their own texts."""
    _whole_texts(spark)
    judged = quality_rules.judge_texts(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten or more documents have; n_chars follows."""
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id; groups without any id keep one too."""
    _whole_texts(spark)
    return simhash.representatives(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item covers, each judged by its own text."""
    _whole_texts(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left."""
    _whole_texts(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level bpe", encoding),
]

ORACLE_SQL = None  # hashed n-grams, fingerprints, tiling and merges are not SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            dropped(before)  # the rows written since do not need it
    return docs
