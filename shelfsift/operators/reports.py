"""Per-row prediction reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsift.fixed_values import HEAD_ROWS
from shelfsift.functions.text import label_name, preview
from shelfsift.operators.sampling import head_subset
from shelfsift.session import cut_lineage


def prediction_report(
    truth: DataFrame,
    predictions: DataFrame,
    rows: int = HEAD_ROWS,
    use_all: bool = False,
    key: str = "product_id",
) -> DataFrame:
    """``row_number, key, actual, predicted, description``: truth and prediction met on the key.

    A key that has several predictions fails loudly: it would not be known which one belongs to a row.
    """
    subset = head_subset(truth.select(key, "description", "label"), rows, use_all, key)
    repeated = F.raise_error(F.concat(F.lit(f"several predictions for {key} "), F.col(key).cast("string")))
    single = predictions.groupBy(key).agg(F.first("prediction").alias("prediction"), F.count("*").alias("_n"))
    single = single.select(key, F.when(F.col("_n") > 1, repeated.cast("int")).otherwise(F.col("prediction")).alias("prediction"))
    return report_lines(subset.join(single, key), key, use_all)


def report_lines(met: DataFrame, key: str = "product_id", whole: bool = True) -> DataFrame:
    """The report of rows that hold truth and prediction already; ``whole`` for more than a head of the table."""
    numbered = number_rows(met, key) if whole else met.withColumn(
        "row_number", F.row_number().over(Window.orderBy(key)).cast("bigint")
    )
    return numbered.select(
        "row_number",
        key,
        label_name(F.col("label")).alias("actual"),
        label_name(F.col("prediction")).alias("predicted"),
        preview(F.col("description")).alias("description"),
    )


def number_rows(df: DataFrame, key: str, buckets: int | None = None, output: str = "row_number") -> DataFrame:
    """Number all rows from 1 in key order, without ordering them in one task.

    The rows are stored once, range-partitioned by the key (of any type that can be ordered, repeated or not) and sorted;
    a row's number is its place in its partition and the number of rows in the partitions before.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df).repartitionByRange(buckets, key).sortWithinPartitions(key)
    # the id holds the partition in its upper bits and the place in it in the lower 33
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    # one offset row per partition, so the copied side never has more than ``buckets`` rows
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(output, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_at", "_part", "_before")
    )
