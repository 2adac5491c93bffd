"""A balanced few-shot sample that is kept up to date while labelled listings arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfsift.fixed_values import FEW_SHOT_EXAMPLES, SEED
from shelfsift.operators.sampling import merge_states, sample_state

STATE = "product_id bigint, description string, label int, _order string, batch bigint"


def write_sample_stream(
    listings: DataFrame, folder: str, checkpoint: str, examples: int = FEW_SHOT_EXAMPLES, seed: int = SEED
) -> StreamingQuery:
    """Merge what has arrived (product_id, description, label) into the sample in ``folder``, and stop.

    Each micro-batch writes the state behind it under its own number, from the state before it: a batch that is run again
    after a failure writes the same rows to the same place, so no listing counts twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col("product_id").cast("bigint"), "description", F.col("label").cast("int"))
        states = [sample_state(rows, examples, seed), _latest(spark, folder, number)]
        merged = merge_states([s.select("product_id", "description", "label") for s in states], examples, seed)
        merged.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return listings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state; ``examples_of`` makes the examples of it."""
    return _latest(spark, folder, None)


def _latest(spark: SparkSession, folder: str, before: int | None) -> DataFrame:
    """The newest state, or the newest before a batch: a handful of rows for every batch so far."""
    # an empty frame comes along, so that a folder without batches is a state without rows
    try:
        states = spark.read.schema(STATE).parquet(folder)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], STATE).drop("batch")
    states = states if before is None else states.where(F.col("batch") < before)
    newest = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == F.lit(newest)).drop("batch")
