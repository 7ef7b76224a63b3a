"""Corpus pipeline: five stages from raw documents to packed token windows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last keep the columns of ``documents``; where a stage shortens a text,
``n_chars`` follows. Part of the training-data operators (``glmframe.llm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glmframe.llm.common import checkpointed, read_table
from glmframe.llm.line_dedup import line_dedup
from glmframe.llm.near_dedup import near_duplicates
from glmframe.llm.packing import pack_words
from glmframe.llm.quality_knn import fit_quality, score_quality
from glmframe.llm.substring_dedup import substring_dedup
from glmframe.session import make_importable, scratch_path


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from an operator's ``row`` and shortened ``text``."""
    columns = []
    for name in docs.columns:
        column = F.col("text") if name == "text" else F.col(f"row.`{name}`")
        if name == "n_chars":
            column = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(column)
        columns.append(column.cast(docs.schema[name].dataType).alias(name))
    return found.select(*columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours accept."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("predicted = 1").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated runs, short ones of five words or more among them."""
    return _columns(line_dedup(docs), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies (five-word shingles, 0.8).

    Of rows that repeat one doc_id with the same text, one stays; rows of one
    doc_id with other texts, and rows without a doc_id, aren't told apart and
    all stay.
    """
    gone = near_duplicates(docs, width=5, percent=80).where("id <> component_id").select("id").distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")
    counts = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).count()
    often = checkpointed(counts.where("count > 1").select("id"))
    if often.isEmpty():
        return kept
    again = kept.join(often, kept["doc_id"] == often["id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(often, kept["doc_id"] == often["id"], "left_anti").unionByName(again)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier in the corpus."""
    return _columns(substring_dedup(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of at most 2048 tokens, with their ids and a checksum of these."""
    return pack_words(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]

#: Nearest neighbours, near copies and packing can't be put as SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written under ``spark.checkpoint.dir`` and read again."""
    make_importable(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
