"""Prompt texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.fixed_values import (
    BUILT_IN_EXAMPLES,
    EXAMPLE_DESCRIPTION,
    EXAMPLE_LABEL,
    EXAMPLE_SEPARATOR,
    PROMPT_BEFORE_EXAMPLES,
    PROMPT_BEFORE_TEXT,
    PROMPT_END_LONG,
    PROMPT_END_SHORT,
    SYSTEM_PROMPT,
)


def built_in_examples(spark: SparkSession) -> DataFrame:
    """The four examples used when no training data is given, as ``place, description, label``."""
    rows = [(place, text, label) for place, (text, label) in enumerate(BUILT_IN_EXAMPLES, start=1)]
    return spark.createDataFrame(rows, "place bigint, description string, label string")


def choose_examples(spark: SparkSession, given: DataFrame | None = None, from_training: DataFrame | None = None) -> DataFrame:
    """Examples given by the caller, else those picked from training data, else the built-in ones."""
    if given is not None:
        return given
    return from_training if from_training is not None else built_in_examples(spark)


def few_shot_block(examples: DataFrame) -> DataFrame:
    """The examples as one text, in order of ``place`` (one row, column ``block``)."""
    lines = F.concat(
        F.lit(EXAMPLE_DESCRIPTION), F.col("description"), F.lit(EXAMPLE_LABEL), F.col("label")
    )
    ordered = F.array_sort(F.collect_list(F.struct("place", lines.alias("line"))))
    return examples.agg(F.concat_ws(EXAMPLE_SEPARATOR, ordered["line"]).alias("block"))


def block_text(examples: DataFrame) -> str:
    """The few-shot block as a value: as many rows as there are examples, never more."""
    return few_shot_block(examples).first()["block"]


def user_prompt(text: Column, block: str, long_form: bool = True) -> Column:
    """The request for one listing; the long form spells out the answer's JSON fields."""
    end = PROMPT_END_LONG if long_form else PROMPT_END_SHORT
    return F.concat(
        F.lit(PROMPT_BEFORE_EXAMPLES + block + PROMPT_BEFORE_TEXT), F.coalesce(text, F.lit("")), F.lit(end)
    )


def messages(user: Column, system: str = SYSTEM_PROMPT) -> Column:
    """System and user message as an array of ``role, content``."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
