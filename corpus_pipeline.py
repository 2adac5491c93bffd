"""From raw documents to packed training windows: quality rules, near duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it back for the next one. All stages but the last return the columns of ``documents``; the last returns the packed
pieces. Null texts count as empty and fall to the first stage; every stage works on whole texts of any length and all its
rows. Of repeated rows the near-duplicate stage keeps one, also where they share an id with others; other columns
go along under their names; an empty table gives empty stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.llm import packing, quality_rules, sanitize, simhash
from shelfsift.llm.queries import tokenizer_path
from shelfsift.llm.support import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy for training text, however long they are."""
    return quality_rules.ledger(docs).where(quality_rules.kept("corpus-1")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return simhash.keep_one(docs, shingle=3, limit=2)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with sanitised texts and their new lengths."""
    cleaned = sanitize.sanitize(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cleaned


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), end_id=2, temperature=0.7, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

# Packing and fingerprints cannot be written in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
