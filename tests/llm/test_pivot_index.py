import random

import numpy as np
from test_llm_common import SMALL

from shelfsift.llm import pivot_index as V
from shelfsift.llm.queries import op7_pivot_index


def plain(rows, least=0.95):
    """vec_id -> links and component by comparing all pairs."""
    units = []
    for _, v in rows:
        fine = v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float) / max(map(abs, v))) / max(map(abs, v)) if fine else None)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                pairs += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least_id = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least_id[root(i)] = min(least_id.get(root(i), v), v)
    return sorted(((v, links[i], least_id.get(root(i))) for i, (v, _) in enumerate(rows)), key=repr), pairs


def clusters(count, width, seed):
    chance = np.random.default_rng(seed)
    out = []
    while len(out) < count:
        centre = chance.normal(size=width)
        for _ in range(chance.integers(1, 12)):
            out.append((centre + chance.normal(size=width) * chance.uniform(0, 0.26)).tolist())
    return out


def test_clusters_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    vectors = clusters(700, 24, 1)
    vectors += [vectors[5]] * 40 + [[x * 3 for x in vectors[5]]]
    rows = list(enumerate(vectors, 1000))
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    mine = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in V.near_duplicates(frame).collect()), key=repr)
    expected, pairs = plain(rows)
    found = sum(m[1] for m in mine) / 2
    assert pairs > 1000 and found <= pairs and found >= 0.99 * pairs
    assert sum(m == e for m, e in zip(mine, expected)) >= 0.98 * len(rows)


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    mine = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in op7_pivot_index(spark, SMALL).collect()), key=repr)
    assert mine == plain(rows)[0]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]),
        (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 1.0]), (None, [1.0, 1.01]), (0, [-1.0, -1.0]),
        (10, [1e300, 1e300]), (11, [5e-324, 5e-324]), (12, [0.0, -0.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id int, embedding array<double>, key string, id int")
    out = V.near_duplicates(frame).collect()
    mine = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr)
    assert mine == plain(rows)[0]
    assert {r["vec_id"] for r in out if not r["kept"]} == {8, None, 10, 11}
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert V.near_duplicates(empty).collect() == []


def test_large_dense_cluster_like_all_pairs(spark):
    """A third of all rows are distinct vectors of one cluster."""
    chance = np.random.default_rng(3)
    rest = chance.normal(size=(4000, 64))
    near = chance.normal(size=64) + chance.normal(size=(2000, 64)) * 0.2
    vectors = chance.permutation(np.concatenate([rest, near]))
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    mine = {r["vec_id"]: r["n_links"] for r in V.near_duplicates(frame).collect()}
    found = np.array([mine[i] for i in range(len(vectors))])
    assert links.sum() > 1_000_000 and (found <= links).all() and found.sum() >= 0.99 * links.sum()


def cone(rows, width, mean, seed):
    """Vectors with about this cosine to each other."""
    chance = np.random.default_rng(seed)
    centre = chance.normal(size=width)
    centre /= np.linalg.norm(centre)
    return centre + chance.normal(size=(rows, width)) * np.sqrt((1 / mean - 1) / width)


def with_twins(vectors, count, cosine, seed):
    """The vectors and, for the first ``count``, another at about this cosine."""
    chance = np.random.default_rng(seed)
    own = vectors[:count]
    noise = chance.normal(size=own.shape)
    noise *= np.linalg.norm(own, axis=1, keepdims=True) * np.sqrt(1 / cosine**2 - 1) / np.linalg.norm(noise, axis=1, keepdims=True)
    return chance.permutation(np.concatenate([vectors, own + noise]))


def recall(spark, vectors):
    """Links found of those that queries (ids divisible by 50) have with all rows."""
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    queries = np.arange(0, len(vectors), 50)
    links = (units[queries] @ units.T >= 0.95).sum(axis=1) - 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    mine = {r["vec_id"]: r["n_links"] for r in V.near_duplicates(frame).collect()}
    found = np.array([mine[i] for i in queries.tolist()])
    assert (found <= links).all() and links.sum() > 20
    return found.sum() / links.sum()


def test_loose_cluster_with_many_pivots(spark, monkeypatch):
    """A third of the rows at cosines of about 0.85, with as many pivots as a million rows would have: 12 pivots of each tell too little."""
    monkeypatch.setattr(V, "LEAST_PIVOTS", 2048)
    chance = np.random.default_rng(6)
    vectors = np.concatenate([cone(2000, 128, 0.85, 1), chance.normal(size=(3000, 128))])
    vectors = with_twins(vectors, 1500, 0.956, 2)
    assert recall(spark, vectors) >= 0.9


def test_cone(spark):
    """All vectors close to each other, some closer: there are pivots, and links are found."""
    vectors = cone(2500, 64, 0.93, 3)
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    assert len(V.thinned(units, 256, 0.9)) < V.WIDEST
    frame = spark.createDataFrame([(i, v.astype("<f8").tobytes(), bytes([i % 256, i // 256])) for i, v in enumerate(units)], "id bigint, unit binary, key binary")
    (pivots,) = V.choose_pivots(frame, 256).values()
    assert len(pivots) >= 64
    assert recall(spark, with_twins(vectors, 1200, 0.975, 4)) >= 0.9


def test_settings_by_recall():
    assert V.chosen_setting({}) == V.SETTINGS[0]
    assert V.chosen_setting(dict.fromkeys(V.SETTINGS, 0.5)) is None
    assert V.chosen_setting({**dict.fromkeys(V.SETTINGS, 0.5), V.SETTINGS[3]: 0.99}) == V.SETTINGS[3]


def test_vectors_that_pivots_cannot_tell_apart(spark, monkeypatch):
    """Without a setting that finds enough, all pairs are gone through in tiles."""
    monkeypatch.setattr(V, "chosen_setting", lambda recalls: None)
    monkeypatch.setattr(V, "BLOCK", 16)
    rows = list(enumerate(clusters(150, 8, 5) + [[1.0, 2.0], [1.0, 2.01]]))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    mine = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in V.near_duplicates(frame).collect()), key=repr)
    assert mine == plain(rows)[0]
