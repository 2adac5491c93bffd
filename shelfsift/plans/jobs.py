"""End-to-end jobs: each takes listings and returns result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.fixed_values import (
    ENGLISH_STOP_WORDS,
    FEW_SHOT_EXAMPLES,
    HEAD_ROWS,
    SCORE_BATCH_SIZE,
    SEED,
    SYSTEM_PROMPT,
)
from shelfsift.functions.prompts import block_text, choose_examples, user_prompt
from shelfsift.functions.responses import parse_responses
from shelfsift.operators.hybrid import explain, with_hybrid
from shelfsift.operators.metrics import classification_metrics, classification_report, model_comparison
from shelfsift.operators.reports import report_lines
from shelfsift.operators.sampling import few_shot_examples, head_subset
from shelfsift.operators.score_ledger import score_with_ledger
from shelfsift.operators.scoring import Scorer, score_with
from shelfsift.operators.truecase import surface_forms
from shelfsift.plans.models import (
    BoostedModel,
    ForestModel,
    feature_importance,
    fit_boosted,
    fit_forest,
    notebook_frame,
    staged_log_loss,
)
from shelfsift.session import cut_lineage
from shelfsift.sources.listings import union_listings


@dataclass(frozen=True)
class NotebookResult:
    model: BoostedModel
    predictions: DataFrame
    metrics: DataFrame
    losses: DataFrame
    importance: DataFrame


def notebook_job(
    train: DataFrame,
    test: DataFrame,
    fit_on: str = "train",
    dictionary: DataFrame | None = None,
    stop_words: list[str] = ENGLISH_STOP_WORDS,
    **options,
) -> NotebookResult:
    """Union, clean, lemmas (if a dictionary is given), features, entities, two TF-IDF blocks, boosted trees, accuracy,
    importances."""
    both = union_listings(train, test)
    frame = notebook_frame(both, cut_lineage(surface_forms(both)), dictionary, stop_words)
    frame = cut_lineage(frame.drop("description"))
    model = fit_boosted(frame, fit_on, stop_words=stop_words, **options)
    tested = frame.where((F.col("split") == "test") & F.col("label").isNotNull())
    learnt = frame.where(F.col("label").isNotNull())
    learnt = learnt if fit_on == "all" else learnt.where(F.col("split") == "train")
    predictions = model.transform(tested)
    return NotebookResult(
        model,
        predictions,
        classification_metrics(predictions),
        staged_log_loss(model, {"train": learnt, "test": tested}),
        feature_importance(frame.sparkSession, model),
    )


@dataclass(frozen=True)
class ScoredResult:
    scored: DataFrame
    report: DataFrame
    metrics: DataFrame


def score_listings(
    listings: DataFrame,
    scorer: Scorer,
    examples: DataFrame | None = None,
    long_form: bool = True,
    batch_size: int = SCORE_BATCH_SIZE,
    concurrency: int | None = None,
    keep: tuple[str, ...] = ("product_id",),
    system: str | None = SYSTEM_PROMPT,
    ledger: tuple[str, str] | None = None,
) -> DataFrame:
    """``keep`` columns with ``is_spam, spam_score, reasoning, parse_status``; responses are written once, then read.

    With ``ledger`` (a folder, and the scorer's name and version), responses are kept there, and prompts that it has an
    answer for are not sent again, by this job or any later one.

    The scorer gets the system and the user message. Columns that later steps need go through scoring (``keep``), so
    nothing is joined back and repeated ids do no harm.
    """
    block = block_text(choose_examples(listings.sparkSession, examples))
    prompts = listings.select(*keep, user_prompt(F.col("description"), block, long_form).alias("prompt"))
    options = {"keep": keep, "batch_size": batch_size, "concurrency": concurrency, "system": system}
    if ledger:
        answered = score_with_ledger(prompts, scorer, *ledger, **options)
    else:
        answered = cut_lineage(score_with(prompts, scorer, **options))
    parsed = parse_responses(answered, error="score_error", lenient=long_form)
    return parsed.select(*keep, "is_spam", "spam_score", "reasoning", "parse_status")


def few_shot_job(
    test: DataFrame,
    scorer: Scorer,
    train: DataFrame | None = None,
    num_examples: int = HEAD_ROWS,
    use_all: bool = False,
    num_few_shot: int = FEW_SHOT_EXAMPLES,
    use_built_in: bool = False,
    seed: int = SEED,
    batch_size: int = SCORE_BATCH_SIZE,
    concurrency: int | None = None,
    ledger: tuple[str, str] | None = None,
) -> ScoredResult:
    """Pick examples, prompt, score, parse, report, measure. The subset is taken before scoring."""
    subset = head_subset(test, num_examples, use_all)
    picked = few_shot_examples(train, num_few_shot, seed) if train is not None and not use_built_in else None
    rows = score_listings(
        subset, scorer, picked, batch_size=batch_size, concurrency=concurrency,
        keep=("product_id", "description", "label"), ledger=ledger,
    )
    judged = rows.withColumnRenamed("is_spam", "prediction")
    scored = rows.drop("description", "label")
    return ScoredResult(scored, report_lines(judged, whole=use_all), classification_metrics(judged))


@dataclass(frozen=True)
class ComparisonResult:
    model: ForestModel
    judged: DataFrame
    report: DataFrame
    comparison: DataFrame


def comparison_job(
    train: DataFrame,
    test: DataFrame,
    scorers: dict[str, Scorer],
    head_rows: int | None = HEAD_ROWS,
    dictionary: DataFrame | None = None,
    concurrency: int | None = None,
    **options,
) -> ComparisonResult:
    """Forest on the whole test set next to each scorer on its first rows (``None``: on all of it)."""
    model = fit_forest(train, dictionary, **options)
    columns = ["model", "product_id", "label", "prediction"]
    judged = model.transform(test).withColumn("model", F.lit("Random Forest")).select(*columns)
    for name, scorer in scorers.items():
        subset = head_subset(test, head_rows or 0, use_all=head_rows is None)
        scored = score_listings(subset, scorer, concurrency=concurrency, keep=("product_id", "label"))
        rows = scored.withColumnRenamed("is_spam", "prediction").withColumn("model", F.lit(name))
        judged = judged.unionByName(rows.select(*columns))
    judged = cut_lineage(judged)  # read by both tables below
    names = ["Random Forest", *scorers]
    return ComparisonResult(
        model, judged, classification_report(judged, by=("model",)), model_comparison(judged, names)
    )


@dataclass(frozen=True)
class HybridResult:
    scored: DataFrame
    explained: DataFrame
    metrics: DataFrame


def hybrid_job(
    train: DataFrame, test: DataFrame, scorer: Scorer, concurrency: int | None = None, **options
) -> HybridResult:
    """Forest and scorer on the same rows, and their weighted mix, each measured."""
    model = fit_forest(train, **options)
    classical = model.transform(test).select(
        "product_id", "description", "label",
        F.col("probability").alias("classical_score"), F.col("prediction").alias("classical"),
    )
    both = score_listings(classical, scorer, concurrency=concurrency, keep=tuple(classical.columns)).select(
        *classical.columns, F.col("is_spam").alias("llm"), F.col("spam_score").alias("llm_score"),
        F.col("reasoning").alias("llm_reasoning"),
    )
    scored = cut_lineage(with_hybrid(both))
    stacked = scored.select(
        "label",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("model"), F.col(column).cast("int").alias("prediction"))
                    for name, column in (("Classical", "classical"), ("LLM", "llm"), ("Hybrid", "is_spam"))
                ]
            )
        ),
    )
    return HybridResult(scored, explain(scored), classification_metrics(stacked, by=("model",)))
