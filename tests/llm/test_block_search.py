"""Exact top-k search against scoring all pairs with Python's whole numbers."""

import math

import numpy as np
import pytest

from shelfsift.llm import block_search
from shelfsift.llm.block_search import Block, bounds, index, products, search, top_k

SCHEMA = "vec_id bigint, embedding array<float>, score int, rank string, part int"


def by_hand(rows, k=5, every=50, scale=256):
    held = [
        (i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (query, q) in enumerate(held):
        if query is not None and query % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), i is None, i) for n, (i, v) in enumerate(held) if n != at]
            for rank, (score, _, i) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
                out.append((query, rank, i, -score))
    return sorted(map(repr, out))


def frame_of(spark, rows, schema=SCHEMA, parts=5):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], schema).repartition(parts)


def collected(frame):
    assert frame.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(repr(tuple(r)) for r in frame.collect())


def vectors(count, seed, groups=6, width=64, noise=0.05):
    chance = np.random.default_rng(seed)
    centres = chance.normal(0, 0.2, (groups, width))
    found = centres[chance.integers(0, groups, count)] + chance.normal(0, noise, (count, width))
    return [[float(x) for x in v] for v in found.astype(np.float32)]


@pytest.mark.parametrize("groups, noise", [(6, 0.05), (400, 0.1)])
def test_like_all_pairs(spark, monkeypatch, groups, noise):
    monkeypatch.setattr(block_search, "BLOCK", 32)
    rows = list(enumerate(vectors(1200, groups, groups, noise=noise)))
    assert collected(top_k(frame_of(spark, rows), every=20)) == by_hand(rows, every=20)


def test_slices_and_shelves(spark, monkeypatch):
    """Several tasks for one part's queries, and several parts behind one entry of the directory."""
    monkeypatch.setattr(block_search, "BLOCK", 16)
    monkeypatch.setattr(block_search, "SLICE", 20)
    monkeypatch.setattr(block_search, "SHELVES", 3)
    rows = list(enumerate(vectors(600, 9)))
    assert collected(top_k(frame_of(spark, rows), every=5)) == by_hand(rows, every=5)


def test_awkward_rows(spark):
    good = vectors(60, 4)
    rows = list(enumerate(good))
    rows += [(50, good[50]), (50, good[3]), (50, good[50]), (0, good[0]), (None, good[0]), (None, good[7]), (-50, good[1])]
    odd = [None, [], good[0][:3], good[0] + [2.0, -1.0], [None, *good[0][1:]], [float("nan")] * 64, [float("-inf")] * 64]
    rows += [(100 + 50 * (k % 2) + k * 100, v) for k, v in enumerate(odd)] + [(2000, [0.0] * 64), (2001, [-0.0] * 64)]
    assert collected(top_k(frame_of(spark, rows))) == by_hand(rows)


def test_one_vector_in_a_third_of_all_rows(spark):
    some = vectors(150, 6)
    rows = [(k, some[0] if k % 3 == 0 else some[k % 150]) for k in range(1500)]
    assert collected(top_k(frame_of(spark, rows))) == by_hand(rows)


@pytest.mark.parametrize("count", [0, 1, 2, 4])
def test_few_vectors(spark, count):
    rows = list(enumerate(vectors(count, 7)))
    assert collected(top_k(frame_of(spark, rows))) == by_hand(rows)


def test_no_queries(spark):
    assert collected(top_k(frame_of(spark, [(k + 1, v) for k, v in enumerate(vectors(30, 2))]))) == []


def test_great_numbers(spark):
    rows = [(k, [x * 2.0**18 for x in v]) for k, v in enumerate(vectors(150, 8))]
    schema = SCHEMA.replace("array<float>", "array<double>")
    assert collected(top_k(frame_of(spark, rows, schema))) == by_hand(rows)
    rows = [(k, [x * 2.0**40 for x in v]) for k, v in rows]
    with pytest.raises(Exception, match="does not fit a long"):
        top_k(frame_of(spark, rows, schema)).collect()


def test_products_are_exact():
    chance = np.random.default_rng(3)
    for top in (1 << 10, 1 << 24, 1 << 40):
        a, b = (np.floor(chance.uniform(-top, top, (n, 9))) for n in (4, 5))
        expected = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert [[int(x) for x in row] for row in products(a, b)] == expected


def test_sums_of_maxima_bound_and_prune(spark, monkeypatch):
    """No score exceeds its block's bound, and blocks are left out where vectors lie in groups."""
    monkeypatch.setattr(block_search, "BLOCK", 16)
    rows = list(enumerate(vectors(4000, 11, groups=40, noise=0.01)))
    held = block_search.whole_vectors(frame_of(spark, rows), 256)
    entries = block_search.distinct_vectors(held, held.where("id % 50 = 0"), 6)
    blocks = [Block(r.asDict()) for r in index(entries).collect()]
    queries = np.array([b.matrix[m] for b in blocks for m in b.asked])
    assert len(queries) == 80
    most = bounds(queries, np.array([b.hi for b in blocks]), np.array([b.lo for b in blocks]))
    for k, block in enumerate(blocks):
        assert (products(queries, block.matrix).max(axis=1) <= most[:, k]).all()
    tops = [[] for _ in queries]
    scored = search(queries, tops, blocks, 6)
    assert scored < 0.6 * len(queries) * len(blocks) and all(len(t) == 6 for t in tops)
