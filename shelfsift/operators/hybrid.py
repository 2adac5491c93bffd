"""Weighted mix of a classifier's score and an external scorer's score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.fixed_values import CLASSICAL_WEIGHT, EXPLANATION_PREVIEW, SCORER_WEIGHT, THRESHOLD
from shelfsift.operators.metrics import threshold_label


def combined_score(
    classical: Column, scorer: Column, classical_weight: float = CLASSICAL_WEIGHT, scorer_weight: float = SCORER_WEIGHT
) -> Column:
    total = classical_weight + scorer_weight
    if total <= 0:
        raise ValueError("the weights must add up to more than 0")
    return (classical * classical_weight + scorer * scorer_weight) / total


def with_hybrid(
    df: DataFrame,
    classical: str = "classical_score",
    scorer: str = "llm_score",
    classical_weight: float = CLASSICAL_WEIGHT,
    scorer_weight: float = SCORER_WEIGHT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Append ``combined_score`` and ``is_spam`` (0/1, threshold included)."""
    return df.withColumn(
        "combined_score", combined_score(F.col(classical), F.col(scorer), classical_weight, scorer_weight)
    ).withColumn("is_spam", threshold_label(F.col("combined_score"), threshold))


def explain(df: DataFrame, key: str = "product_id", text: str = "description") -> DataFrame:
    """One readable row per listing: preview, verdict, the scores behind it, the scorer's reasoning."""
    return df.select(
        key,
        F.concat(F.substring(text, 1, EXPLANATION_PREVIEW), F.lit("...")).alias("text"),
        "is_spam",
        "combined_score",
        "classical_score",
        "llm_score",
        "llm_reasoning",
    )
