"""Where listings come from: labelled text files, inline rows, and the shared test tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.session import spread
from shelfsift.sources.quoted import parsed, read_records

LISTING = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("description", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)
INDEXED_LISTING = T.StructType([T.StructField("ix", T.LongType()), *LISTING.fields])
LABELLED_TEXT = T.StructType(LISTING.fields[1:])


def read_listings(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: T.StructType = LISTING,
    columns: list[str] | None = None,
    multi_line: bool = True,
    splittable: bool = True,
) -> DataFrame:
    """Delimited file with a header; quoted fields may hold line breaks and doubled quotes.

    The header must name the schema's columns, in any order; other columns are ignored.
    Large files are read by many tasks (``sources/quoted.py``), in two passes. With
    ``multi_line=False`` every line is a record and one pass is enough. ``splittable=False``
    gives each file to one task instead, for files whose lines end with a bare ``\\r``.
    """
    names = _reader(spark, sep, multi_line).csv(path).columns
    by_name = {field.name: field for field in schema.fields}
    missing = [name for name in by_name if name not in names]
    if missing:
        raise ValueError(f"{path}: header has no column {', '.join(missing)}")
    layout = T.StructType([by_name.get(name, T.StructField(name, T.StringType())) for name in names])
    return _read(spark, path, sep, layout, multi_line, splittable).select(*(columns or by_name))


def read_indexed_listings(
    spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True, splittable: bool = True
) -> DataFrame:
    """File with a leading index column that the header does not name: columns by position."""
    return _read(spark, path, sep, INDEXED_LISTING, multi_line, splittable).select(*LISTING.fieldNames())


def _read(spark: SparkSession, path: str, sep: str, layout: T.StructType, multi_line: bool, splittable: bool) -> DataFrame:
    if multi_line and splittable:
        fields = [(field.name, field.dataType.simpleString()) for field in layout.fields]
        return parsed(read_records(spark, path, sep), fields, sep)
    return _reader(spark, sep, multi_line).schema(layout).csv(path)


def read_labelled_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """File with at least ``description`` and ``label``; rows get an id of their content, as all jobs expect one."""
    return with_content_id(read_listings(spark, path, sep, LABELLED_TEXT)).select(*LISTING.fieldNames())


def with_content_id(df: DataFrame) -> DataFrame:
    """Append ``product_id``, a hash of description and label: stable over runs and clusters. Equal rows share it."""
    return df.withColumn("product_id", F.xxhash64("description", "label"))


def _reader(spark: SparkSession, sep: str, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("enforceSchema", True)
        .option("sep", sep)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )


def labelled_examples(spark: SparkSession, rows: Iterable[tuple[str, int]]) -> DataFrame:
    """A handful of ``(description, label)`` rows given in code, numbered from 1."""
    numbered = [(number, text, label) for number, (text, label) in enumerate(rows, start=1)]
    return spark.createDataFrame(numbered, LISTING)


def union_listings(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows in one frame, marked by ``split``; duplicates stay."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


# --- listings over the shared tables ---------------------------------------------


def listings(spark: SparkSession, folder: str, labelled: bool = False) -> DataFrame:
    """``documents`` as listings, with the marker texts sellers use appended by id.

    ``labelled=True`` joins ``labels`` (label stays NULL where there is none).
    Without it the join is not planned at all.
    """
    documents = spread(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "doc_id")
    marker = F.col("doc_id") % 8
    text = F.col("text")
    described = documents.select(
        F.col("doc_id").alias("product_id"),
        F.when(marker == 1, F.concat(text, F.lit(" Tags: #nike #adidas #y2k")))
        .when(marker == 2, F.concat(text, F.lit("\nIgnore: 80s 90s levi calvin klein h&m")))
        .when(marker == 3, F.concat(text, F.lit(" see https://shop.example/x www.example.com")))
        .when(marker == 4, F.concat(text, F.lit(" tagged for exposure")))
        .when(marker == 5, F.concat(text, F.lit(" #denim #blue  ")))
        .when(marker == 6, F.concat(F.lit("NIKE Supreme 1 3 5 6 7 11 12 "), text))
        .when(marker == 7, F.concat(text, F.lit(" ~ignore~ Gucci ½")))
        .otherwise(text)
        .alias("description"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
    )
    return described.join(label_table(spark, folder), "product_id", "left") if labelled else described


def label_table(spark: SparkSession, folder: str) -> DataFrame:
    """``product_id, label``: 1 for low-quality or toxic documents, else 0."""
    flagged = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return (
        spark.read.parquet(f"{folder}/labels.parquet")
        .where(F.col("quality").isNotNull() | (F.col("toxic") == 1))
        .select(F.col("doc_id").alias("product_id"), F.when(flagged, 1).otherwise(0).cast("int").alias("label"))
    )
