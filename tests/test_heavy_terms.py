"""The most frequent terms from bounded summaries: the same as counting every term, or an honest None."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfsift.operators import heavy_terms
from shelfsift.operators.heavy_terms import candidates, map_size, recount, top_terms, unseen_bound
from shelfsift.operators.tfidf import TfidfSpec, vocabulary


def bags(count, kinds, seed=1):
    """Rows of terms whose frequencies fall with their rank."""
    chance = random.Random(seed)
    weights = [1 / (k + 1) for k in range(kinds)]
    return [chance.choices([f"t{k}" for k in range(kinds)], weights, k=chance.randrange(60)) for _ in range(count)]


def frame_of(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "terms array<string>").repartition(6)


def by_hand(rows, wanted, low=1, high=None):
    cf, df = Counter(t for r in rows for t in r), Counter(t for r in rows for t in set(r))
    kept = [t for t in cf if df[t] >= low and (high is None or df[t] <= high)]
    return [(t, cf[t], df[t]) for t in sorted(kept, key=lambda t: (-cf[t], t))[:wanted]]


@pytest.mark.parametrize("low, high", [(1, None), (3, 150)])
def test_like_counting_all(spark, low, high):
    rows = bags(600, 3000)
    found = top_terms(frame_of(spark, rows), 50, least_df=low, most_df=high, tracked=1024, buckets=4)
    assert list(map(tuple, found.collect())) == by_hand(rows, 50, low, high)


def test_the_bound_holds(spark):
    rows = bags(400, 5000, seed=2)
    summary = candidates(frame_of(spark, rows), "terms", 20, tracked=128, buckets=2)
    chosen = {r["item"] for r in summary.select(F.inline("found")).collect()}
    counts = Counter(t for r in rows for t in r)
    assert len(chosen) < len(counts) and sum(r["n"] for r in summary.collect()) == sum(counts.values())
    assert max(n for t, n in counts.items() if t not in chosen) <= unseen_bound(summary, 128)


def test_without_proof_there_is_no_answer(spark, texts):
    """Terms that all occur equally often cannot be told apart by a small summary; counting all still can."""
    rows = [[f"t{k}" for k in range(at, at + 40)] for at in range(0, 4000, 4)]
    frame = frame_of(spark, rows)
    assert top_terms(frame, 30, tracked=64, buckets=2) is None
    found = vocabulary(frame, TfidfSpec(30, tracked=64))
    assert [tuple(r) for r in found.collect()] == by_hand(rows, 30)


def test_few_terms_are_proven_by_the_bound(spark):
    rows = [["a", "b", "a"], ["b"], [], ["c"]]
    assert list(map(tuple, top_terms(frame_of(spark, rows), 10).collect())) == [("a", 2, 1), ("b", 2, 2), ("c", 1, 1)]
    assert list(map(tuple, top_terms(frame_of(spark, rows), 10, least_df=2).collect())) == [("b", 2, 2)]


def test_no_terms(spark):
    assert top_terms(frame_of(spark, [[], []]), 10) is None
    assert vocabulary(frame_of(spark, [[], []]), TfidfSpec(10, tracked=64)).collect() == []


def test_a_term_in_a_third_of_all_places(spark):
    rows = [["hot", f"r{k}", f"s{k % 50}"] for k in range(1500)]
    found = top_terms(frame_of(spark, rows), 3, tracked=256, buckets=2)
    assert list(map(tuple, found.collect())) == by_hand(rows, 3)


def test_recount_is_exact(spark):
    rows = bags(200, 400, seed=5)
    names = ["t0", "t7", "t399", "never"]
    assert sorted(map(tuple, recount(frame_of(spark, rows), "terms", names).collect())) == sorted(
        c for c in by_hand(rows, 400) if c[0] in names
    )


def test_shuffled_rows_are_bounded(spark):
    """What the counting steps shuffle: a sketch per task and bucket, then a row per task and candidate."""
    rows = bags(500, 20_000, seed=6)
    frame = frame_of(spark, rows)
    distinct = len({t for r in rows for t in r})
    summary = candidates(frame, "terms", 20, tracked=256, buckets=2)
    most = 2 * (heavy_terms.LEAST_CANDIDATES + heavy_terms.SPARE * 10)
    names = [r["item"] for r in summary.select(F.inline("found")).collect()]
    assert len(names) <= most < distinct / 10
    assert recount(frame, "terms", names).count() == len(names)


def test_map_size():
    assert [map_size(n) for n in (3, 6, 64, 96, 97, 1 << 15)] == [4, 8, 128, 128, 256, 1 << 16]
