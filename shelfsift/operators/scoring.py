"""Batched scoring through a scorer the caller supplies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfsift.fixed_values import (
    BRANDS,
    PROMPT_BEFORE_TEXT,
    PROMPT_END_LONG,
    PROMPT_END_SHORT,
    SCORE_BATCH_SIZE,
    TAG_PHRASES,
    TAG_SECTION_MARKERS,
)

# What a scorer is asked: a user text, or the whole conversation as role and content.
Prompt = str | list[dict[str, str]]
# A scorer takes prompts and returns one response text per prompt, in order.
Scorer = Callable[[list[Prompt]], list[str]]
# About so many rows are turned into prompts at a time, so that memory does not grow with what Spark sends at once.
PIECE = 256


def score_with(
    df: DataFrame,
    scorer: Scorer,
    prompt: str = "prompt",
    keep: tuple[str, ...] = ("product_id",),
    batch_size: int = SCORE_BATCH_SIZE,
    concurrency: int | None = None,
    system: str | None = None,
) -> DataFrame:
    """``keep`` columns with ``response`` and ``score_error``, one row per input row.

    With ``system``, each prompt goes out as a conversation: that system message, then the user's text.

    Rows stream through each task in batches of ``batch_size``, and about PIECE rows are held as prompts and answers. If the scorer fails on a
    batch, its rows are tried one by one and the failure stays with the row that caused
    it. ``concurrency`` bounds how many tasks call the scorer at once. A retried task
    scores again, so write the result (``cut_lineage``) before using it more than once, or
    keep the responses in a ledger (``score_ledger.py``), which does not pay twice.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    schema = T.StructType(
        [
            *[df.schema[name] for name in keep],
            T.StructField("response", T.StringType()),
            T.StructField("score_error", T.StringType()),
        ]
    )

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scored_pieces(batches, scorer, prompt, keep, batch_size, system)

    source = df.select(*keep, prompt)
    if concurrency:
        source = source.repartition(concurrency)
    return source.mapInArrow(score_batches, schema)


def scored_pieces(
    batches: Iterator[pa.RecordBatch], scorer: Scorer, prompt: str, keep: tuple[str, ...], batch_size: int, system: str | None
) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches with their answers, a piece of them at a time."""
    piece = batch_size * max(1, PIECE // batch_size)
    for part in (batch.slice(at, piece) for batch in batches for at in range(0, batch.num_rows, piece)):
        prompts = [conversation(text, system) for text in part.column(prompt).to_pylist()]
        answers = [
            answer
            for start in range(0, len(prompts), batch_size)
            for answer in _answers(scorer, prompts[start : start + batch_size])
        ]
        said = [pa.array(column, pa.string(), from_pandas=True) for column in zip(*answers)]
        yield pa.RecordBatch.from_arrays([*map(part.column, keep), *said], [*keep, "response", "score_error"])


def conversation(text: str, system: str | None) -> Prompt:
    """What the scorer gets for one row."""
    if system is None:
        return text
    return [{"role": "system", "content": system}, {"role": "user", "content": text}]


def _answers(scorer: Scorer, prompts: list[Prompt]) -> list[tuple[str | None, str | None]]:
    try:
        responses = scorer(prompts)
        if len(responses) != len(prompts):
            raise ValueError(f"{len(responses)} responses for {len(prompts)} prompts")
        return [(response, None) for response in responses]
    except Exception as error:  # a scorer may fail in any way; the row says how
        if len(prompts) == 1:
            return [(None, str(error))]
        return [answer for single in prompts for answer in _answers(scorer, [single])]


def keyword_rule_scorer(prompts: list[Prompt]) -> list[str]:
    """A fixed keyword rule that answers in the asked-for JSON, for tests and dry runs.

    Not a model: spam means a tag section or at least two brand names.
    """
    answers = []
    for prompt in prompts:
        user = prompt if isinstance(prompt, str) else prompt[-1]["content"]
        text = user.rpartition(PROMPT_BEFORE_TEXT)[2]
        text = text.removesuffix(PROMPT_END_LONG).removesuffix(PROMPT_END_SHORT).lower()
        brands = sum(brand in text for brand in BRANDS)
        phrases = sum(phrase in text for phrase in TAG_PHRASES)
        section = any(marker in text for marker in TAG_SECTION_MARKERS)
        answers.append(
            json.dumps(
                {
                    "is_spam": section or brands >= 2,
                    "spam_score": min(1.0, (brands + phrases) / 4),
                    "reasoning": f"{brands} brands, {phrases} tag phrases",
                }
            )
        )
    return answers
