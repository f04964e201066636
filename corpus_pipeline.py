"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Defined results: only the columns of documents are read, so others may have any name;
null texts count as empty ones, null ids come after all others and null sources are a
source of their own; of rows that repeat one stays; empty tables give an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common, decontam, linededup, mil, mixing, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    model = mil.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mil.score(docs.select(*COLUMNS), model).where(F.col("score") >= mil.THRESHOLD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that a document with a smaller id holds; ``n_chars`` follows the text.

    Every document stays, with an empty text if all its lines were repeats.
    """
    found = linededup.dedup(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    return simhash.representatives(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: each document that the mix takes with its text, how often the whole goes in (``epochs``) and the first words of a last, cut pass (``rest``)."""
    return mixing.mixed_texts(docs.select(*COLUMNS))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The classifier and SimHash have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None
