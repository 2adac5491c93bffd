"""Shared-folder tables, small sides and other helpers of the operators in this package."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side table goes to every executor only up to this many rows; it is counted first.
SMALL_ROWS = 200_000
# The blanks that separate words, as a character class of both Java and Python patterns.
BLANKS = r"\x20\x09-\x0D"

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-process local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folders.setdefault(context.applicationId, tempfile.mkdtemp(prefix="shelfsift-llm-"))


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tables/{label}-{uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows: cuts lineage, computes once."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Mark a side table for broadcast if it has at most ``limit`` rows; else leave the join to shuffle."""
    return F.broadcast(df) if len(df.limit(limit + 1).select(F.lit(1)).toArrow()) <= limit else df


def column(df: DataFrame, name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def inputs(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names: others cannot clash with it."""
    return df.select(*(column(df, given).alias(own) for own, given in names.items()))


def hex_lower(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")
