"""Scoring that does not pay twice: a ledger of responses by prompt.

A prompt (with its system message and the name of the scorer) is known by its hash. Before anything is scored, prompts
whose response the ledger holds are taken out by an anti join, and equal prompts become one. What is left is scored in tasks, which commit
their responses to the ledger folder every few batches, while they run, so a failed job leaves everything that was committed
before: a retried task first reads what earlier attempts of it have committed, and a new job over the same ledger asks only for the rest. What
can be paid for twice is the batches that a task had not yet committed when it was lost, at most ``commit_batches`` of
them, and what a speculative copy of a task scores; turn ``spark.speculation`` off for paid scorers.

The ledger is a folder of Parquet files that all executors reach under one name (a path on a shared mount, or any store that
``pyarrow.fs`` opens by URI). Tasks write a file under a hidden name and then rename it, so readers see whole files only.
Responses that are errors are kept for the report, and are asked for again by the next job.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.fixed_values import SCORE_BATCH_SIZE
from shelfsift.operators.scoring import Scorer, _answers, conversation

ENTRY = "prompt_key string, response string, score_error string"
_ARROW = pa.schema([("prompt_key", pa.string()), ("response", pa.string()), ("score_error", pa.string())])


def prompt_key(prompt: Column, scorer_name: str, system: str | None) -> Column:
    """The hash that stands for a prompt: scorer, system message and text, with their lengths, so that no two mix."""
    parts = [F.lit(scorer_name), F.lit(system), prompt]
    sized = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*sized), 256)


def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder given as a path or URI."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


class Journal:
    """What one task of one job writes to the ledger, and what earlier attempts of it have written."""

    def __init__(self, folder: str, run: str, part: int, attempt: int):
        self.fs, path = _store(folder)
        self.path, self.name, self.attempt, self.count = f"{path}/{run}", f"part-{part:06d}-", attempt, 0
        self.fs.create_dir(self.path, recursive=True)

    def committed(self) -> set[str]:
        """Keys with a response from any attempt of this task."""
        done: set[str] = set()
        for info in self.fs.get_file_info(pa.fs.FileSelector(self.path)):
            if info.base_name.startswith(self.name):
                with self.fs.open_input_file(info.path) as file:
                    table = pa.parquet.read_table(file)
                done.update(k for k, e in zip(table["prompt_key"].to_pylist(), table["score_error"].to_pylist()) if e is None)
        return done

    def commit(self, rows: list[tuple[str, str | None, str | None]]) -> None:
        """Add responses; they are either all there or not at all."""
        name = f"{self.name}{self.attempt}-{self.count:06d}.parquet"
        table = pa.table([pa.array(v, pa.string()) for v in zip(*rows)], schema=_ARROW)
        with self.fs.open_output_stream(f"{self.path}/_{name}") as file:
            pa.parquet.write_table(table, file)
        self.fs.move(f"{self.path}/_{name}", f"{self.path}/{name}")
        self.count += 1


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """prompt_key, response, score_error: one row per prompt, a response before an error."""
    fs, path = _store(folder)
    found = fs.get_file_info(pa.fs.FileSelector(path, recursive=True, allow_not_found=True))
    if not any(f.base_name.endswith(".parquet") and not f.base_name.startswith("_") for f in found):
        return spark.createDataFrame([], ENTRY)
    rows = spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(folder)
    best = F.struct(F.col("score_error").isNull().alias("good"), "response", "score_error")
    return rows.groupBy("prompt_key").agg(F.max(best).alias("best")).select("prompt_key", "best.response", "best.score_error")


def fill_ledger(
    prompts: DataFrame,
    scorer: Scorer,
    folder: str,
    batch_size: int = SCORE_BATCH_SIZE,
    commit_batches: int = 1,
    concurrency: int | None = None,
    system: str | None = None,
) -> int:
    """Score the prompts (prompt_key, prompt) that the ledger has no response for; returns how many there were.

    Runs as one job. ``concurrency`` bounds how many tasks call the scorer at once.
    """
    if batch_size < 1 or commit_batches < 1:
        raise ValueError("batch_size and commit_batches must be at least 1")
    spark = prompts.sparkSession
    paid = read_ledger(spark, folder).where("score_error IS NULL").select("prompt_key")
    open_prompts = prompts.join(paid, "prompt_key", "left_anti").dropDuplicates(["prompt_key"])
    # by key, so that a retried task meets the same prompts
    tasks = open_prompts.repartition(*([concurrency] if concurrency else []), "prompt_key")
    run = f"run-{uuid4().hex}"

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        journal = Journal(folder, run, context.partitionId(), context.taskAttemptId())
        done = journal.committed() if context.attemptNumber() else set()
        count, waiting, answered, batches = 0, [], [], 0

        def ask() -> None:
            nonlocal batches
            responses = _answers(scorer, [conversation(text, system) for _, text in waiting])
            answered.extend((key, *answer) for (key, _), answer in zip(waiting, responses))
            waiting.clear()
            batches += 1
            if batches % commit_batches == 0:
                commit()

        def commit() -> None:
            if answered:
                journal.commit(answered)
                answered.clear()

        for frame in frames:
            for key, text in zip(frame["prompt_key"], frame["prompt"]):
                if key not in done:
                    waiting.append((key, text))
                    count += 1
                if len(waiting) == batch_size:
                    ask()
        if waiting:
            ask()
        commit()
        yield pd.DataFrame({"scored": [count]})

    counted = tasks.select("prompt_key", "prompt").mapInPandas(score, "scored long")
    return counted.agg(F.coalesce(F.sum("scored"), F.lit(0))).first()[0]


def score_with_ledger(
    df: DataFrame,
    scorer: Scorer,
    folder: str,
    scorer_name: str,
    prompt: str = "prompt",
    keep: tuple[str, ...] = ("product_id",),
    batch_size: int = SCORE_BATCH_SIZE,
    commit_batches: int = 1,
    concurrency: int | None = None,
    system: str | None = None,
) -> DataFrame:
    """Like ``score_with``: ``keep`` columns with ``response`` and ``score_error``, one row per input row, in which no prompt
    of this ledger is paid for again. ``scorer_name`` says which scorer, in which version, the responses are from."""
    keyed = df.select(*keep, F.col(prompt).alias("prompt"), prompt_key(F.col(prompt), scorer_name, system).alias("prompt_key"))
    fill_ledger(keyed.select("prompt_key", "prompt"), scorer, folder, batch_size, commit_batches, concurrency, system)
    return keyed.drop("prompt").join(read_ledger(df.sparkSession, folder), "prompt_key", "left").drop("prompt_key")
