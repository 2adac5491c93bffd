"""The scoring ledger: every prompt is paid for once, whatever fails in between."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfsift.operators.score_ledger import Journal, fill_ledger, prompt_key, read_ledger, score_with_ledger
from shelfsift.operators.scoring import keyword_rule_scorer
from shelfsift.plans.jobs import score_listings


def paid(folder):
    return Counter(line for file in Path(folder).glob("*.paid") for line in file.read_text().splitlines())


def counting_scorer(folder, dies_at=None):
    """Answers with the prompt in upper case and notes what it answered; dies once, with its process, at one prompt."""
    mark = f"{folder}/died"

    def scorer(prompts):
        if dies_at in prompts and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        with open(f"{folder}/{os.getpid()}.paid", "a") as file:
            file.writelines(f"{p}\n" for p in prompts)
        return [p.upper() for p in prompts]

    return scorer


def scored(frame, scorer, folder, **options):
    rows = score_with_ledger(frame, scorer, str(folder), "upper-1", "description", **options)
    return sorted((r["product_id"], r["response"], r["score_error"]) for r in rows.collect())


def test_a_second_job_pays_for_what_is_new(spark, texts, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    scorer, ledger = counting_scorer(log), tmp_path / "ledger"
    first, both = [f"t{i}" for i in range(23)], [f"t{i}" for i in range(31)] + ["t0", "t0"]
    assert scored(texts(first).repartition(3), scorer, ledger) == [(i, f"T{i}", None) for i in range(23)]
    assert scored(texts(both), scorer, ledger) == sorted((i, t.upper(), None) for i, t in enumerate(both))
    assert paid(log) == Counter({f"t{i}": 1 for i in range(31)})
    assert scored(texts(both), scorer, ledger, batch_size=2) == sorted((i, t.upper(), None) for i, t in enumerate(both))
    assert sum(paid(log).values()) == 31


@pytest.mark.parametrize("commit_batches", [1, 3])
def test_a_killed_job_leaves_what_it_paid_for(spark, texts, tmp_path, commit_batches):
    log = tmp_path / "log"
    log.mkdir()
    ledger, frame = tmp_path / "ledger", texts([f"t{i}" for i in range(100)])
    scorer = counting_scorer(log, dies_at="t77")
    with pytest.raises(Exception):
        scored(frame, scorer, ledger, concurrency=1, batch_size=4, commit_batches=commit_batches)
    before = sum(paid(log).values())
    assert scored(frame, scorer, ledger, concurrency=1, batch_size=4, commit_batches=commit_batches) == [
        (i, f"T{i}", None) for i in range(100)
    ]
    twice = sum(n - 1 for n in paid(log).values())
    # at most the batches behind the last commit
    assert set(paid(log)) == {f"t{i}" for i in range(100)} and twice <= 4 * (commit_batches - 1) and before < 100


RETRY = """
import sys
sys.path[:0] = {paths!r}
from test_score_ledger import counting_scorer, paid, scored
from shelfsift.session import build_session
spark = build_session("retry", "local[2,4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
frame = spark.createDataFrame([(i, f"t{{i}}") for i in range(60)], "product_id bigint, description string")
rows = scored(frame, counting_scorer({log!r}, dies_at="t33"), {ledger!r}, batch_size=3, concurrency=2)
assert rows == [(i, f"T{{i}}", None) for i in range(60)], rows
"""


def test_a_retried_task_pays_once(tmp_path):
    """A task is killed in the middle and Spark runs it again: every prompt is counted once."""
    log = tmp_path / "log"
    log.mkdir()
    here = Path(__file__).resolve().parent
    code = RETRY.format(paths=[str(here), str(here.parent)], log=str(log), ledger=str(tmp_path / "ledger"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert (log / "died").exists() and paid(log) == Counter({f"t{i}": 1 for i in range(60)})


def test_errors_are_asked_again(spark, texts, tmp_path):
    frame = texts(["a", "bad", "b"])

    def refusing(prompts):
        if "bad" in prompts:
            raise RuntimeError("refused")
        return [p.upper() for p in prompts]

    assert scored(frame, refusing, tmp_path) == [(0, "A", None), (1, None, "refused"), (2, "B", None)]
    assert scored(frame, lambda prompts: [f"{p}!" for p in prompts], tmp_path) == [(0, "A", None), (1, "bad!", None), (2, "B", None)]


def test_nulls_repeats_and_no_rows(spark, texts, tmp_path):
    def scorer(prompts):
        return ["none" if p is None else p for p in prompts]

    rows = [None, "", "x", "x", None]
    found = score_with_ledger(texts(rows), scorer, str(tmp_path), "s", "description").collect()
    assert sorted((r[0], r[1]) for r in found) == [(0, "none"), (1, ""), (2, "x"), (3, "x"), (4, "none")]
    assert read_ledger(spark, str(tmp_path)).count() == 3
    assert score_with_ledger(texts(["x"]).limit(0), scorer, str(tmp_path), "s", "description").collect() == []


def test_scorer_and_system_message_are_part_of_the_key(spark):
    row = spark.range(1).select(
        prompt_key(F.lit("p"), "a", None).alias("k1"), prompt_key(F.lit("p"), "b", None).alias("k2"),
        prompt_key(F.lit("p"), "a", "").alias("k3"), prompt_key(F.lit("p"), "a", "s").alias("k4"),
        prompt_key(F.lit(None).cast("string"), "a", "p").alias("k5"), prompt_key(F.lit(""), "a", "p").alias("k6"),
    ).first()
    assert len(set(row)) == 6


def test_unfinished_files_are_not_read(spark, tmp_path):
    journal = Journal(f"file:{tmp_path}", "run-1", 0, 7)
    journal.commit([("k", "r", None), ("e", None, "refused")])
    (tmp_path / "run-1" / "_part-000000-8-000000.parquet").write_bytes(b"half a fi")
    assert Journal(str(tmp_path), "run-1", 0, 9).committed() == {"k"}
    assert Journal(str(tmp_path), "run-1", 1, 9).committed() == set()
    assert sorted(map(tuple, read_ledger(spark, str(tmp_path)).collect())) == [("e", None, "refused"), ("k", "r", None)]


def test_sizes_are_checked(texts, tmp_path):
    keyed = texts(["a"]).select(F.col("description").alias("prompt_key"), F.col("description").alias("prompt"))
    for options in ({"batch_size": 0}, {"commit_batches": 0}):
        with pytest.raises(ValueError):
            fill_ledger(keyed, list, str(tmp_path), **options)


def test_listings_job_with_a_ledger(spark, texts, tmp_path):
    frame = texts(["plain top", "nike adidas", "tags: a", None])
    plain = sorted(map(tuple, score_listings(frame, keyword_rule_scorer).collect()))
    ledger = (str(tmp_path), "keyword-rule-1")
    assert sorted(map(tuple, score_listings(frame, keyword_rule_scorer, ledger=ledger).collect())) == plain

    def silent(prompts):
        raise RuntimeError("asked again")

    assert sorted(map(tuple, score_listings(frame, silent, ledger=ledger).collect())) == plain
