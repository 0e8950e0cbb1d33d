"""A corpus pipeline over documents: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.base import read, scratch, staged
from keyloom.llm.decontamination import drop_leaks
from keyloom.llm.packing import pack
from keyloom.llm.pii import redact
from keyloom.llm.quality import filter_quality
from keyloom.llm.similar import drop_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts among them; null lang or source is the empty name."""
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more on five-word shingles, the document of least id stays.

    Null ids come after all others; of equal ids the first by a hash of the text stays; texts without words are one group.
    """
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; null texts leak none, and documents without id are judged as one."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets, and n_chars the new length; a null text stays null with its n_chars."""
    from pyspark.sql import functions as F

    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; an empty text is its end token alone."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: SQL can't express the tokenizer and the fitted stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage staged for itself goes once its rows are written
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
