"""The corpus pipeline: quality rules, quality classifier, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import op2_packing, op4_quality_rules, op6_near_duplicates, op7_quality_classifier, op10_substring_dedup
from webloom.llm.common import read_table
from webloom.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep. A null, empty or blank text fails; every row is judged by itself, repeated rows alike.
    All columns stay as they are, whatever their names; no rows give no rows."""
    rows = docs.select(F.struct("*").alias("own"), "text")
    return op4_quality_rules.rate(rows, keep=["own"]).where("kept").select("own.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.5 or more; ties, nulls and repeated rows get the score of their text (null as empty).

    The model learns from labelled documents of the whole corpus, held-out ones excepted: those that the rules
    reject are its best examples of label 0. All columns stay as they are; no rows give no rows.
    """
    labels = read_table(spark, sf_dir, "labels").where(~op7_quality_classifier.held_out(F.col("doc_id")))
    model = op7_quality_classifier.fit(read_table(spark, sf_dir, "documents"), labels)
    scored = op7_quality_classifier.classify(docs.select(F.struct("*").alias("own"), "text"), model, keep=["own"])
    return scored.where("score >= 0.5").select("own.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest doc_id, a null one last. Rows that share a
    doc_id stay if their texts are in different groups; rows without words all stay. No rows give no rows."""
    return op6_near_duplicates.kept_rows(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages that an earlier document has; n_chars counts what is left, emptied documents go.

    Rows that share a doc_id, and all without one, count as one document and cut nothing from each other. Null and
    empty texts stay; no rows give no rows.
    """
    left = op10_substring_dedup.cut_repeats(docs.select("doc_id", "text", F.struct(*docs.columns).alias("own")))
    kept = left.where(~F.coalesce((F.col("removed_words") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return kept.select(*[(F.col("own")[c] if new.get(c) is None else new[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences. A null text is empty and gives one piece, its end; repeated rows are
    packed each for itself and may swap places; other columns are left out. No rows give no rows."""
    pieces = op2_packing.pieces_of(docs.select("doc_id", "text"), keep=["doc_id"])
    return op2_packing.pack(pieces, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can express neither the classifier nor MinHash banding nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
