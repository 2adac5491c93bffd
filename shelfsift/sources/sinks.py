"""Sinks for result tables and extracted scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "orc")


def write_table(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result (metrics, matrix, report) as a folder of files."""
    if file_format not in FORMATS:
        raise ValueError(f"unknown format {file_format}; one of {', '.join(FORMATS)}")
    writer = df.write.mode(mode).format(file_format)
    if file_format == "csv":  # as read_listings reads it: quotes are doubled and blanks stay; an empty text is read as a missing one
        writer = writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    writer.save(path)


def write_scripts(scripts: DataFrame, path: str, per_page: bool = False, mode: str = "overwrite") -> None:
    """Write ``page_id, script`` rows, so that each page's script can be told from the others.

    ``per_page`` gives every page a folder with its text, for a handful of pages; the default is a Parquet table of
    both columns, which suits any number.
    """
    if per_page:
        scripts.select("page_id", F.col("script").alias("value")).write.mode(mode).partitionBy("page_id").text(path)
    else:
        scripts.select("page_id", "script").write.mode(mode).parquet(path)
