"""Evaluation tables. Every one is a single aggregation pass over (truth, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1_score")


def confusion_matrix(
    df: DataFrame, truth: str = "label", prediction: str = "prediction", by: tuple[str, ...] = ()
) -> DataFrame:
    """``tn, fp, fn, tp`` per group in ``by``; all four are there even if a class never occurs.

    A label or prediction that is NULL or not 0 or 1 fails loudly: leaving its row out would change every ratio.
    """
    y, p = F.col(truth), F.col(prediction)
    odd = F.raise_error(F.lit(f"{truth} and {prediction} must be 0 or 1 in every row")).cast("boolean")

    def cell(actual: int, predicted: int) -> Column:
        return F.count_if(F.when(y.isin(0, 1) & p.isin(0, 1), (y == actual) & (p == predicted)).otherwise(odd))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def ratio(top: Column, bottom: Column) -> Column:
    """Division where nothing over nothing counts as 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def classification_metrics(
    df: DataFrame, truth: str = "label", prediction: str = "prediction", by: tuple[str, ...] = ()
) -> DataFrame:
    """Accuracy (NULL without rows), precision, recall and F1 of class 1, with the matrix."""
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))
    return confusion_matrix(df, truth, prediction, by).select(
        *by,
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        tp.alias("tp"),
    )


def classification_report(
    df: DataFrame, truth: str = "label", prediction: str = "prediction", by: tuple[str, ...] = ()
) -> DataFrame:
    """``class, precision, recall, f1_score, support`` for 0 and 1, and their macro and weighted means."""
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))

    def scores(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + wrong + missed).alias("f1_score"),
            (hit + missed).alias("support"),
        )

    classes = confusion_matrix(df, truth, prediction, by).select(
        *by, scores("0", tn, fn, fp).alias("negative"), scores("1", tp, fp, fn).alias("positive")
    )
    total = F.col("negative.support") + F.col("positive.support")

    def mean(name: str, weigh: bool) -> Column:
        def combined(field: str) -> Column:
            low, high = F.col(f"negative.{field}"), F.col(f"positive.{field}")
            if not weigh:
                return (low + high) / 2
            return ratio(low * F.col("negative.support") + high * F.col("positive.support"), total)

        return F.struct(
            F.lit(name).alias("class"),
            *[combined(field).alias(field) for field in METRICS[1:]],
            total.alias("support"),
        )

    rows = F.array("negative", "positive", mean("macro avg", False), mean("weighted avg", True))
    return classes.select(*by, F.inline(rows))


def model_comparison(
    df: DataFrame, models: list[str], truth: str = "label", prediction: str = "prediction", model: str = "model"
) -> DataFrame:
    """One row per metric, one column per model, from rows of (model, truth, prediction)."""
    scored = classification_metrics(df, truth, prediction, (model,))
    cells = scored.select(
        model, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    )
    return cells.groupBy("metric").pivot(model, models).agg(F.max("value"))


def log_loss(
    df: DataFrame, truth: str = "label", probability: str = "probability", by: tuple[str, ...] = (), clip: float = 1e-15
) -> DataFrame:
    """Mean negative log-likelihood of the truth, with probabilities kept away from 0 and 1."""
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(probability)))
    loss = -F.when(F.col(truth) == 1, F.log(p)).otherwise(F.log(1 - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("logloss"), F.count("*").alias("n"))


def threshold_label(probability: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold upwards, else 0."""
    return (probability >= threshold).cast("int")


def class_counts(df: DataFrame, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count("*").alias("n"))
