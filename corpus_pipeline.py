"""Corpus pipeline: quality, language, near-duplicates, benchmark passages, mixture.

Each stage takes the documents its predecessor kept, acts on them and hands them on; what it returns
is written as Parquet in the shared folder and read again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, language, mixture, near_dup, quality, queries
from barloom.llm.words import free_name
from barloom.session import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labels, takes for good."""
    score = free_name(docs, "quality_score")
    scored = quality.score(docs, queries.quality_model(spark, docs, sf_dir), into=score)
    return scored.filter(F.col(score) >= 0.5).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the wanted languages, by all evidence."""
    return language.keep_languages(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of test items; documents that are mostly such passages go."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, one row for each epoch that takes some of their tokens."""
    return mixture.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("mixture", mixed),
]

# Compression sizes, trigram models and the forest are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
