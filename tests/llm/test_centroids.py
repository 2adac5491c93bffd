"""Centroid clustering: the search against all distances, whole runs against a plain version."""

import hashlib
import math

import numpy as np
import pytest

from shelfsift.llm.centroids import Search, cluster, numbers


def all_distances(rows, centroids):
    """Nearest centroid and squared distance with Python's whole numbers."""
    out = []
    for row in rows:
        each = [(sum((a - b) ** 2 for a, b in zip(row, c)), k) for k, c in enumerate(centroids)]
        out.append(min(each)[::-1])
    return out


@pytest.mark.parametrize("spread, top", [(3, 64), (1000, 64), (2, 3), (1, 64), (1 << 40, 16), (1 << 23, 64)])
def test_search_is_exact(spread, top):
    chance = np.random.default_rng(spread)
    rows = chance.integers(-spread, spread + 1, (300, top))
    centroids = chance.integers(-spread, spread + 1, (8, top))
    centroids[3] = centroids[5]  # ties go to the smaller number
    rows[:8] = centroids
    search = Search(centroids.tolist())
    given = numbers([r.astype("<f8").tobytes() for r in rows])
    best, distance = search.nearest(given)
    assert list(zip(best.tolist(), map(int, distance))) == all_distances(rows.tolist(), centroids.tolist())


def test_search_rejects():
    """Vectors in well-separated groups are measured against few centroids: both inequalities work."""
    chance = np.random.default_rng(1)
    by_mean = np.repeat(np.arange(8)[:, None] * 500, 64, 1)
    sign = np.where(np.arange(64) % 2, 1, -1)
    by_spread = np.array([sign * 300 * (k + 1) for k in range(8)])
    # with equal means every scan begins at the same end, so about half of the centroids are passed on the way
    for centroids, most in ((by_mean, 2.1), (by_spread, 5)):
        rows = centroids[chance.integers(0, 8, 1000)] + chance.integers(-3, 4, (1000, 64))
        search = Search(centroids.tolist())
        best, distance = search.nearest(rows)
        assert list(zip(best.tolist(), distance.tolist())) == all_distances(rows.tolist(), centroids.tolist())
        assert search.measured < most * len(rows)


def by_hand(rows, clusters=8, rounds=10, length=64):
    """Results of rows (vec_id, vector), keyed by position."""
    kept = [
        (k, i, [math.floor(1024 * float(x)) for x in v]) for k, (i, v) in enumerate(rows)
        if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)
    ]
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    first = sorted((i is None, digest(f"3:{i}"), np.array(v, "<f8").tobytes(), v) for _, i, v in kept)[:clusters]
    centroids = [f[-1] for f in first]
    for _ in range(rounds):
        near = [k for k, _ in all_distances([v for *_, v in kept], centroids)]
        for k in range(len(centroids)):
            mine = [v for n, (*_, v) in zip(near, kept) if n == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    near = all_distances([v for *_, v in kept], centroids)
    whole = sum(d for _, d in near)
    return sorted(
        (repr(i), k, d, sum(e for n, e in near if n == k), whole, digest(",".join(map(str, centroids[k]))))
        for (_, i, _), (k, d) in zip(kept, near)
    )


def collected(frame):
    return sorted((repr(r[0]), *r[1:]) for r in frame.collect())


SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, whole int"


def frame_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], schema).repartition(5)


def vectors(count, seed, groups=5):
    chance = np.random.default_rng(seed)
    centres = chance.normal(0, 0.3, (groups, 64))
    found = centres[chance.integers(0, groups, count)] + chance.normal(0, 0.02, (count, 64))
    return [[float(x) for x in v] for v in found.astype(np.float32)]


def test_like_plain_version(spark):
    rows = list(enumerate(vectors(700, 3)))
    assert collected(cluster(frame_of(spark, rows))) == by_hand(rows)


def test_awkward_rows(spark):
    good = vectors(40, 4)
    odd = [None, [], good[0][:63], good[0] + [0.0], [None, *good[0][1:]], [float("nan"), *good[0][1:]], [float("inf")] + good[0][1:]]
    rows = [*enumerate(good), *((100 + k, v) for k, v in enumerate(odd)), (7, good[7]), (7, good[9]), (7, good[9])]
    rows += [(None, good[3]), (None, good[3]), (500, [0.0] * 64), (501, [-0.0] * 64), (502, [3e4] * 64)]
    assert collected(cluster(frame_of(spark, rows))) == by_hand(rows)


def test_one_vector_in_a_third_of_all_rows(spark):
    some = vectors(200, 6)
    rows = [(k, some[0] if k % 3 == 0 else some[k % 200]) for k in range(900)]
    assert collected(cluster(frame_of(spark, rows), rounds=4)) == by_hand(rows, rounds=4)


@pytest.mark.parametrize("count", [0, 1, 5])
def test_few_vectors(spark, count):
    rows = list(enumerate(vectors(count, 7)))
    found = collected(cluster(frame_of(spark, rows)))
    assert found == (by_hand(rows) if rows else []) and len(found) == count


def test_great_numbers(spark):
    rows = [(k, [x * 2.0**35 for x in v]) for k, v in enumerate(vectors(60, 8))]
    schema = SCHEMA.replace("array<float>", "array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        cluster(frame_of(spark, rows, schema)).collect()
    rows = [(k, [x * 2.0**16 for x in v]) for k, v in enumerate(vectors(60, 8))]
    assert collected(cluster(frame_of(spark, rows, schema), rounds=3)) == by_hand(rows, rounds=3)
