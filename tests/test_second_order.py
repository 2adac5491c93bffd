"""Second-order boosting against a plain in-memory version, and gains by name against SQL over the nodes."""

from math import exp, log

import duckdb
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfsift.plans.models import feature_importance, fit_boosted, notebook_frame, staged_log_loss
from shelfsift.plans.second_order import BoostSpec, bin_edges, entries, fit_second_order, gain_importance
from shelfsift.operators.metrics import log_loss
from shelfsift.operators.truecase import surface_forms
from shelfsift.session import cut_lineage
from shelfsift.sources.listings import listings


def plain_fit(x, y, spec, edges):
    """Trees as dictionaries node -> (feature, threshold, gain) or weight, over a dense matrix."""
    margin = np.full(len(y), log(spec.base / (1 - spec.base)))
    trees, losses = [], []
    for _ in range(spec.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        tree, at = {}, np.ones(len(y), int)
        for depth in range(spec.depth + 1):
            for node in range(1 << depth, 2 << depth):
                here = at == node
                if not here.any():
                    continue
                best = None
                for f in range(x.shape[1]) if depth < spec.depth else ():
                    for cut in edges.get(f, ()):
                        left = here & (x[:, f] <= cut)
                        right = here & ~left
                        if h[left].sum() < spec.least_cover or h[right].sum() < spec.least_cover:
                            continue
                        of = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + spec.l2)
                        gain = of(left) + of(right) - of(here)
                        if gain > 1e-6 and (best is None or round(gain, 9) > round(best[2], 9)):
                            best = (f, cut, gain)
                if best is None:
                    tree[node] = -spec.step * g[here].sum() / (h[here].sum() + spec.l2)
                    margin[here] += tree[node]
                    at[here] = 0
                else:
                    tree[node] = best
                    at[here] = np.where(x[here, best[0]] <= best[1], 2 * node, 2 * node + 1)
        trees.append(tree)
        losses.append(np.mean(np.log1p(np.exp(-np.where(y == 1, margin, -margin)))))
    return trees, losses, 1 / (1 + np.exp(-margin))


def data(rows, seed, dense=False):
    chance = np.random.default_rng(seed)
    x = np.round(chance.normal(0.5, 1, (rows, 6)), 1) * (chance.random((rows, 6)) < 0.4)
    x[:, 5] = 0  # a feature without entries
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] + x[:, 2] > 0.7) | (chance.random(rows) < 0.1)).astype(float)
    as_vector = (lambda r: Vectors.dense(r)) if dense else (lambda r: Vectors.sparse(6, [(i, v) for i, v in enumerate(r) if v]))
    return x, y, [(float(label), as_vector(row)) for row, label in zip(x.tolist(), y)]


def edges_of(frame, bins):
    return bin_edges(frame.select(entries("features").alias("entries")), bins)


@pytest.mark.parametrize("spec", [BoostSpec(), BoostSpec(rounds=3, depth=3, step=0.5, l2=0.0, base=0.3), BoostSpec(bins=8, least_cover=5.0)])
@pytest.mark.parametrize("dense", [False, True])
def test_like_the_plain_version(spark, spec, dense):
    x, y, rows = data(400, 3, dense)
    frame = cut_lineage(spark.createDataFrame(rows, ["label", "features"]).repartition(5))
    model = fit_second_order(frame, spec)
    trees, losses, probability = plain_fit(x, y, spec, edges_of(frame, spec.bins))
    for mine, plain in zip(model.trees, trees, strict=True):
        assert set(mine) == set(plain)
        for node, expected in plain.items():
            if isinstance(expected, tuple):
                assert (mine[node].feature, mine[node].threshold) == expected[:2]
                assert mine[node].gain == pytest.approx(expected[2], abs=1e-8)
            else:
                assert mine[node].weight == pytest.approx(expected, abs=1e-9)
    assert model.losses == pytest.approx(losses, abs=1e-9)
    assert model.staged_losses(frame) == pytest.approx(losses, abs=1e-9)
    found = sorted((r["label"], r["probability"]) for r in model.transform(frame).collect())
    assert [v for _, v in found] == pytest.approx([v for _, v in sorted(zip(y, probability))], abs=1e-9)


def test_few_values_have_a_bin_each(spark):
    rows = [(Vectors.sparse(2, {0: float(k % 7 + 1), 1: k / 1000 - 1.5}),) for k in range(3000)]
    edges = edges_of(spark.createDataFrame(rows, ["features"]), 16)
    assert edges[0].tolist() == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    assert 10 <= len(edges[1]) <= 17 and 0.0 in edges[1] and edges[1].max() == pytest.approx(1.499)


def test_one_class_and_no_rows(spark):
    frame = spark.createDataFrame([(1.0, Vectors.dense([float(k)])) for k in range(9)], ["label", "features"])
    model = fit_second_order(frame, BoostSpec(rounds=1))
    # the first tree of one class: G = -0.5 n, H = 0.25 n at base 0.5, and no split gains anything worth having
    assert all(r["prediction"] == 1 for r in model.transform(frame).collect())
    with pytest.raises(ValueError, match="no rows"):
        fit_second_order(frame.limit(0))


def test_root_by_hand(spark):
    """Four rows, one split: G and H by hand at p = 1/2."""
    rows = [(0.0, [0.0]), (0.0, [0.0]), (1.0, [2.0]), (1.0, [3.0])]
    frame = spark.createDataFrame([(y, Vectors.dense(x)) for y, x in rows], ["label", "features"])
    (tree,) = fit_second_order(frame, BoostSpec(rounds=1, depth=1, least_cover=0.4)).trees
    # left: G = 1, H = 0.5; right: G = -1, H = 0.5; all: G = 0
    assert (tree[1].feature, tree[1].threshold) == (0, 0.0) and tree[1].gain == pytest.approx(2 / 1.5)
    assert (tree[2].weight, tree[3].weight) == pytest.approx((-0.3 / 1.5, 0.3 / 1.5))


@pytest.fixture(scope="module")
def fitted(spark, folder):
    marked = (F.col("product_id") % 8).isin(1, 2, 4, 7).cast("int")
    rows = cut_lineage(listings(spark, folder).withColumn("label", marked))
    frame = cut_lineage(notebook_frame(rows, surface_forms(rows)))
    return frame, fit_boosted(frame, second_order=True, rounds=3)


def test_listings_are_learnt(fitted):
    frame, model = fitted
    predicted = model.transform(frame)
    assert predicted.where("prediction = label").count() >= 0.9 * predicted.count()
    assert "features" not in predicted.columns


def test_staged_losses_fall_and_agree(fitted):
    frame, model = fitted
    train = frame.where("split = 'train'")
    losses = [r["logloss"] for r in staged_log_loss(model, {"train": train}).orderBy("round").collect()]
    assert losses == pytest.approx(list(model.trees.losses)) and losses == sorted(losses, reverse=True)
    assert log_loss(model.transform(train)).first()[0] == pytest.approx(losses[-1], abs=1e-9)


def test_importance_by_sql_over_the_nodes(spark, fitted):
    frame, model = fitted
    names = model.feature_names()
    nodes = model.trees.node_table(spark, names)
    node_rows = nodes.toPandas()  # noqa: F841 (read by the SQL)
    by_sql = duckdb.sql(
        "SELECT feature_name, avg(gain) / sum(avg(gain)) OVER () AS share FROM node_rows"
        " WHERE feature_name IS NOT NULL GROUP BY feature_name"
    ).fetchall()
    table = feature_importance(spark, model).collect()
    assert len(table) == len(names)
    assert {r[0]: pytest.approx(r[1]) for r in by_sql} == {r[0]: r[1] for r in table if r[1] > 0}
    assert [tuple(r) for r in table] == sorted(map(tuple, table), key=lambda r: (-r[1], r[0]))
    full = gain_importance(nodes, names).where("splits > 0").agg(F.sum("splits"), F.sum("feature_importance")).first()
    assert full[0] == nodes.where("feature_name IS NOT NULL").count() and full[1] == pytest.approx(1)


def test_splits_and_leaves_make_trees(spark, fitted):
    _, model = fitted
    for nodes in model.trees.trees:
        for n, node in nodes.items():
            assert n == 1 or n // 2 in nodes
            assert (node.feature is None) == (2 * n not in nodes) == (node.weight is not None)
            if node.feature is not None:
                assert nodes[2 * n].cover + nodes[2 * n + 1].cover == pytest.approx(node.cover)
                assert nodes[2 * n].gradient + nodes[2 * n + 1].gradient == pytest.approx(node.gradient, abs=1e-9)


def test_probability_is_the_logistic_of_the_weights(spark):
    frame = spark.createDataFrame([(1.0, Vectors.dense([1.0])), (0.0, Vectors.dense([0.0]))] * 10, ["label", "features"])
    model = fit_second_order(frame, BoostSpec(rounds=2, depth=1))
    total = sum(nodes[3].weight for nodes in model.trees)
    row = model.transform(frame).where("label = 1").first()
    assert row["probability"] == pytest.approx(1 / (1 + exp(-total))) and row["prediction"] == 1
