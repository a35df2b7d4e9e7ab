"""The corpus pipeline: language, exact copies, near copies, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it again as the next stage's docs.  All stages but the last return the columns of ``documents``.
Language identification and packing are learned or tokenized in Python, so no SQL states the result.

Null and empty texts have no language and go in the first stage.  Repeated rows go in the second; of equal texts the
largest doc_id stays, of near copies the smallest, of equal ones one.  Very long texts pass whole, but the mixture may cut
them.  Columns of any name stay as far as the mixture.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veduta.llm.common import shared_folder
from veduta.llm.exact import exact_dedup
from veduta.llm.language import language_filter
from veduta.llm.mixing import mixed_documents
from veduta.llm.near import near_dedup
from veduta.llm.packing import packed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z and a-z being alike."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: rows repeated, cut or left out as the mix takes their words."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences."""
    return packed(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
