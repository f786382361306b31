"""The corpus pipeline: stages that each take documents and return documents.

Every stage works on all that its predecessor kept. The classifier's rejects go;
repeated lines go, and documents made of nothing else; of each group of similar
documents the one with the smallest id stays; documents that contain a benchmark
passage go; the rest is encoded in pieces, and ``text`` is what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, jaccard_join, line_dedup, pieces, quality, tables


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, tables.read(spark, sf_dir, "labels"))
    return quality.good_documents(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, tables.read(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece_ids, text``"""
    vocabulary = pieces.load_vocabulary()
    return pieces.decode(pieces.encode(docs, vocabulary=vocabulary), vocabulary=vocabulary)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

#: The first stage is learned and the last one samples, so SQL cannot express them; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.store(stage(spark, docs, sf_dir), name)
    return docs
