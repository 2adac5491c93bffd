"""The row-local text and feature columns on a stream of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfsift.functions.features import with_listing_features
from shelfsift.functions.text import clean_text


def listing_feature_stream(listings: DataFrame) -> DataFrame:
    """Cleaned text and the 14 features; stateless, so the same plan serves batch and stream."""
    return with_listing_features(listings).withColumn("clean_text", clean_text(F.col("description")))


def write_feature_stream(listings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, append it to a parquet folder, and stop."""
    return (
        listing_feature_stream(listings)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
