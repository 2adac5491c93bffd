"""Splits, head subsets, and balanced few-shot selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsift.fixed_values import FEW_SHOT_EXAMPLES, HEAD_ROWS, SEED
from shelfsift.functions.text import label_name


def rows_in(df: DataFrame, ids: DataFrame, key: str = "product_id") -> DataFrame:
    """Rows whose key occurs in ``ids``. The key table grows with the data, so it is not forced to broadcast."""
    return df.join(ids.select(key), key, "left_semi")


def rows_not_in(df: DataFrame, ids: DataFrame, key: str = "product_id") -> DataFrame:
    """The complement: a training set without the test rows."""
    return df.join(ids.select(key), key, "left_anti")


def head_subset(df: DataFrame, rows: int = HEAD_ROWS, use_all: bool = False, key: str = "product_id") -> DataFrame:
    """The first rows by key, or everything. Apply it before a costly scorer."""
    return df if use_all else df.orderBy(key).limit(rows)


def seeded_order(seed: int, key: Column, purpose: str = "") -> Column:
    """A repeatable random order: the same seed and key give the same place on any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:{purpose}"), key.cast("string")))


def sample_state(
    df: DataFrame, examples: int = FEW_SHOT_EXAMPLES, seed: int = SEED, key: str = "product_id"
) -> DataFrame:
    """What a part of the rows contributes to a balanced sample: of each class, the rows that come first in the seeded
    order, half the examples. At most ``examples`` rows, whatever the part's size.

    States merge: the state of a union of parts is the merged state of the parts, in any order and grouping. Each class
    is a top-k, so no class is ever sorted or gathered whole.
    """
    picks = [
        df.where(F.col("label") == label)
        .select(key, "description", "label")
        .withColumn("_order", seeded_order(seed, F.col(key)))
        .orderBy("_order", key, "description")
        .limit(examples // 2)
        for label in (1, 0)
    ]
    return picks[0].unionByName(picks[1])


def merge_states(
    states: list[DataFrame], examples: int = FEW_SHOT_EXAMPLES, seed: int = SEED, key: str = "product_id"
) -> DataFrame:
    """One state of several."""
    return sample_state(reduce(DataFrame.unionByName, states), examples, seed, key)


def examples_of(state: DataFrame, seed: int = SEED, key: str = "product_id") -> DataFrame:
    """The few-shot examples of a state, in a seeded shuffled ``place``. If a class is short, both classes give as many
    as it has."""
    # a state has a handful of rows, so these windows do too
    ranked = state.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("label").orderBy("_order", key, "description"))
    )
    every = Window.partitionBy()
    usable = F.least(F.sum(F.col("label")).over(every), F.sum(1 - F.col("label")).over(every))
    balanced = ranked.withColumn("_usable", usable).where(F.col("_rank") <= F.col("_usable"))
    place = F.row_number().over(Window.orderBy(seeded_order(seed, F.col(key), "s:"), key, "description"))
    return balanced.select(
        place.cast("bigint").alias("place"), key, "description", label_name(F.col("label")).alias("label")
    )


def few_shot_examples(
    df: DataFrame, examples: int = FEW_SHOT_EXAMPLES, seed: int = SEED, key: str = "product_id"
) -> DataFrame:
    """Half the examples from each class, in a seeded random pick and a seeded shuffled ``place``.

    If a class is short, both classes give as many as it has.
    """
    return examples_of(sample_state(df, examples, seed, key), seed, key)
