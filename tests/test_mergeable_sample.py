"""Balanced samples that merge: parts, groupings and streams give the picks of the whole."""

import random

import pytest

from shelfsift.operators.sampling import examples_of, few_shot_examples, merge_states, sample_state
from shelfsift.streaming.sample_stream import read_sample, write_sample_stream

SCHEMA = "product_id bigint, description string, label int"


def rows_of(count, seed, spam=0.3):
    chance = random.Random(seed)
    labels = lambda: 1 if chance.random() < spam else chance.choice([0, 0, 0, 2, None])
    return [(chance.randrange(count), f"text {k}", labels()) for k in range(count)]


def picks(frame):
    return [tuple(r) for r in frame.orderBy("place").collect()]


@pytest.mark.parametrize("examples, spam", [(8, 0.3), (9, 0.01), (2, 0.5), (0, 0.5)])
def test_merge_law(spark, examples, spam):
    rows = rows_of(400, examples, spam)
    whole = picks(few_shot_examples(spark.createDataFrame(rows, SCHEMA), examples, seed=7))
    chance = random.Random(1)
    parts = [[], [], [], []]
    for row in rows:
        chance.choice(parts[:3]).append(row)  # the last part stays empty
    states = [sample_state(spark.createDataFrame(part, SCHEMA), examples, 7) for part in parts]
    assert all(s.count() <= examples for s in states)
    left = merge_states([merge_states(states[:2], examples, 7), merge_states(states[2:], examples, 7)], examples, 7)
    right = merge_states([states[3], merge_states([states[2], states[0]], examples, 7), states[1]], examples, 7)
    assert picks(examples_of(left, 7)) == picks(examples_of(right, 7)) == whole


def test_merging_a_state_with_itself_counts_rows_twice_only_if_they_are(spark):
    rows = [(1, "a", 1), (1, "a", 1), (2, "b", 0), (3, "c", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert len(picks(few_shot_examples(frame, 4))) == 4


def test_stream_gives_the_sample_of_the_whole(spark, tmp_path):
    rows = rows_of(300, 3)
    folders = {name: str(tmp_path / name) for name in ("in", "sample", "state")}
    for n, part in enumerate((rows[:100], rows[100:110], rows[110:])):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(folders["in"])
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(folders["in"])
        query = write_sample_stream(stream, folders["sample"], folders["state"], examples=10, seed=5)
        query.awaitTermination(120)
        assert query.exception() is None
        seen = rows[: (100, 110, 300)[n]]
        expected = picks(few_shot_examples(spark.createDataFrame(seen, SCHEMA), 10, seed=5))
        assert picks(examples_of(read_sample(spark, folders["sample"]), 5)) == expected and len(expected) == 10


def test_no_batches_yet(spark, tmp_path):
    assert read_sample(spark, str(tmp_path / "nothing")).count() == 0
