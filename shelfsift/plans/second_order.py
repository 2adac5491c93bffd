"""Boosted trees by second-order gain: gradient and hessian histograms as Spark aggregations, one pass per tree level.

Values are cut into at most ``bins`` bins per feature (each distinct value is a bin where a feature has no more of them). For
every level of a tree, one aggregation sums gradients and hessians by node, feature and bin over the non-zero entries of
the rows; what is left of a node's totals is the feature's zeros, so nothing dense is ever made. What is shuffled are
sums (nodes x features x bins at most, whatever the number of rows), split points are found on cumulative sums in a window per
node and feature, and the driver receives the best split of each node. Rows are written as vectors and then binned; where a row is in a tree follows
from an expression, so they are never rewritten or moved.

With G and H the sums of gradients ``p - y`` and hessians ``p (1 - p)``, a split gains
``GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2)``, and a leaf weighs ``-step G / (H + l2)``. Of equal gains (to nine digits), the
smaller feature and then the smaller threshold counts. Rounds start from the log odds of ``base``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.fixed_values import BOOST_DEPTH, BOOST_ROUNDS, BOOST_STEP, THRESHOLD
from shelfsift.operators.metrics import threshold_label
from shelfsift.session import cut_lineage

# A split has to gain more than this.
LEAST_GAIN = 1e-6
# Hessians are at least this.
LEAST_HESSIAN = 1e-16
NODES = "tree int, node int, feature int, threshold double, gain double, cover double, weight double"


@dataclass(frozen=True)
class BoostSpec:
    """``l2``: added to hessians; ``least_cover``: hessians that either side of a split needs; ``base``: the first probability."""

    rounds: int = BOOST_ROUNDS
    depth: int = BOOST_DEPTH
    step: float = BOOST_STEP
    l2: float = 1.0
    least_cover: float = 1.0
    base: float = 0.5
    bins: int = 256


@dataclass(frozen=True)
class Node:
    """A split (``feature``, ``threshold``: values up to it go left, and the bin of it) or a leaf (``weight``). Children of
    node n are 2n and 2n + 1."""

    tree: int
    node: int
    gradient: float
    cover: float
    feature: int | None = None
    threshold: float | None = None
    bin: int | None = None
    gain: float | None = None
    weight: float | None = None


def entries(features: str) -> Column:
    """The non-zero entries of a vector column: array of (ix, value)."""
    parts = F.unwrap_udt(features)
    indices = F.coalesce(parts["indices"], F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    both = F.arrays_zip(indices.alias("ix"), parts["values"].alias("value"))
    return F.filter(both, lambda entry: entry["value"] != 0)


def bin_edges(vectors: DataFrame, bins: int) -> dict[int, np.ndarray]:
    """The greatest value of each bin, by feature; zero is always among them. At most ``bins`` numbers and one per feature."""
    # a slice of all of them keeps Spark from testing the entries for emptiness in a pass of their own
    values = vectors.select(F.inline(F.slice("entries", F.lit(1), F.size("entries"))))
    shares = F.array(*(F.lit((k + 1) / bins) for k in range(bins)))
    found = values.groupBy("ix").agg(
        F.approx_count_distinct("value", 0.02).alias("kinds"), F.percentile_approx("value", shares, 10_000).alias("cuts")
    )
    found = cut_lineage(found)
    edges = {r["ix"]: {0.0, *r["cuts"]} for r in found.collect()}
    # features with few values have a bin for each of them
    few = found.where(F.col("kinds") <= 0.9 * bins).select("ix")
    for r in values.join(F.broadcast(few), "ix", "left_semi").distinct().collect():
        edges[r["ix"]].add(r["value"])
    return {ix: np.array(sorted(of_feature)) for ix, of_feature in edges.items()}


def binned_rows(vectors: DataFrame, edges: dict[int, np.ndarray]) -> DataFrame:
    """label, ix and bin (arrays of the same length) of every row, stored."""
    shared = vectors.sparkSession.sparkContext.broadcast(edges)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def bins_of(ix: pa.Array, values: pa.Array) -> pa.Array:
        flat_ix, flat = ix.flatten().to_numpy(), values.flatten().to_numpy()
        out = np.zeros(len(flat), np.int32)
        order = np.argsort(flat_ix, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(flat_ix[order])) + 1) if len(order) else ():
            out[part] = np.searchsorted(shared.value[int(flat_ix[part[0]])], flat[part])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ix).to_numpy())])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))

    split = vectors.select(
        "label", F.transform("entries", lambda e: e["ix"]).alias("ix"), F.transform("entries", lambda e: e["value"]).alias("value")
    )
    return cut_lineage(split.select("label", "ix", bins_of("ix", "value").alias("bin")))


def _routed(nodes: dict[int, Node], leaf, left, at: int = 1) -> Column:
    """``leaf(node)`` of the node that a row comes to; ``left(node)`` tells whether it goes left at a split."""
    node = nodes.get(at)
    if node is None or node.feature is None:
        return leaf(at)
    return F.when(left(node), _routed(nodes, leaf, left, 2 * at)).otherwise(_routed(nodes, leaf, left, 2 * at + 1))


def _left_by_bin(zeros: dict[int, int]):
    def left(node: Node) -> Column:
        place = F.array_position("ix", F.lit(node.feature)).cast("int")
        own = F.when(place > 0, F.get("bin", place - 1)).otherwise(F.lit(zeros[node.feature]))
        return own <= node.bin

    return left


def _left_by_value(node: Node) -> Column:
    met = F.filter("_entries", lambda e: e["ix"] == node.feature)
    return F.coalesce(F.get(met, F.lit(0))["value"], F.lit(0.0)) <= node.threshold


def _weights(nodes: dict[int, Node], left) -> Column:
    return _routed(nodes, lambda at: F.lit(nodes[at].weight), left)


def _probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def _loss(margin: Column, label: Column) -> Column:
    """The log loss of a row, without rounding a probability to 0 or 1."""
    wrong = F.when(label == 1, -margin).otherwise(margin)
    return F.greatest(wrong, F.lit(0.0)) + F.log1p(F.exp(-F.abs(wrong)))


def best_splits(rows: DataFrame, zeros: dict[int, int], open_nodes: dict[int, Node], spec: BoostSpec) -> list:
    """The best split of each open node, if it gains anything. ``rows``: node, g, h, ix, bin."""
    spark = rows.sparkSession
    met = rows.select("node", "g", "h", F.inline(F.arrays_zip("ix", "bin")))
    sums = cut_lineage(met.groupBy("node", "ix", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")))
    totals = spark.createDataFrame([(n, v.gradient, v.cover) for n, v in open_nodes.items()], "node int, all_g double, all_h double")
    zero = spark.createDataFrame(list(zeros.items()), "ix int, bin int")
    # what no entry accounts for lies in the bin of zero; features without entries in a node cannot split it
    held = sums.groupBy("node", "ix").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).join(F.broadcast(totals), "node")
    rest = held.join(F.broadcast(zero), "ix").select(
        "node", "ix", "bin", (F.col("all_g") - F.col("g")).alias("g"), (F.col("all_h") - F.col("h")).alias("h")
    )
    every = sums.unionByName(rest).groupBy("node", "ix", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    so_far = Window.partitionBy("node", "ix").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = every.select("node", "ix", "bin", F.sum("g").over(so_far).alias("gl"), F.sum("h").over(so_far).alias("hl"))
    sides = sides.join(F.broadcast(totals), "node").withColumns(
        {"gr": F.col("all_g") - F.col("gl"), "hr": F.col("all_h") - F.col("hl")}
    )
    scores = [F.col(g) * F.col(g) / (F.col(h) + spec.l2) for g, h in (("gl", "hl"), ("gr", "hr"), ("all_g", "all_h"))]
    scored = sides.withColumn("gain", scores[0] + scores[1] - scores[2]).where(
        (F.col("hl") >= spec.least_cover) & (F.col("hr") >= spec.least_cover) & (F.col("gain") > LEAST_GAIN)
    )
    first = F.struct(F.round("gain", 9), -F.col("ix"), -F.col("bin"))
    best = F.max_by(F.struct("ix", "bin", "gain", "gl", "hl", "gr", "hr"), first).alias("best")
    return scored.groupBy("node").agg(best).select("node", "best.*").collect()


def grow_tree(rows: DataFrame, tree: int, edges: dict[int, np.ndarray], zeros: dict[int, int], root: Node, spec: BoostSpec) -> dict[int, Node]:
    """The nodes of one tree. ``rows``: ix, bin, g, h."""
    nodes, open_nodes = {1: root}, {1: root}
    for _ in range(spec.depth):
        at = _routed(nodes, F.lit, _left_by_bin(zeros)).alias("node")
        level = rows.select(at, "g", "h", "ix", "bin").where(F.col("node").isin(list(open_nodes)))
        following = {}
        for best in best_splits(level, zeros, open_nodes, spec):
            n, old = best["node"], open_nodes[best["node"]]
            nodes[n] = Node(
                tree, n, old.gradient, old.cover, best["ix"], float(edges[best["ix"]][best["bin"]]), best["bin"], best["gain"]
            )
            following[2 * n] = Node(tree, 2 * n, best["gl"], best["hl"])
            following[2 * n + 1] = Node(tree, 2 * n + 1, best["gr"], best["hr"])
        nodes |= following
        open_nodes = following
        if not open_nodes:
            break
    return {
        n: v if v.feature is not None else Node(tree, n, v.gradient, v.cover, weight=-spec.step * v.gradient / (v.cover + spec.l2))
        for n, v in nodes.items()
    }


@dataclass(frozen=True)
class SecondOrderModel:
    """Trees by their nodes, and the log loss of the training rows after each round."""

    spec: BoostSpec
    trees: tuple[dict[int, Node], ...]
    losses: tuple[float, ...] = field(default=())

    def margins(self) -> list[Column]:
        """The margin after 0, 1, ... rounds, over a column ``_entries``."""
        found = [F.lit(log(self.spec.base / (1 - self.spec.base)))]
        for nodes in self.trees:
            found.append(found[-1] + _weights(nodes, _left_by_value))
        return found

    def transform(self, df: DataFrame, threshold: float = THRESHOLD, features: str = "features") -> DataFrame:
        """Append ``probability`` and ``prediction``."""
        scored = df.withColumn("_entries", entries(features)).withColumn("probability", _probability(self.margins()[-1]))
        return scored.drop("_entries").withColumn("prediction", threshold_label(F.col("probability"), threshold))

    def staged_losses(self, df: DataFrame, features: str = "features") -> list[float]:
        """The log loss of labelled rows after each round."""
        rows = df.select(F.col("label").cast("double").alias("label"), entries(features).alias("_entries"))
        means = [F.avg(_loss(margin, F.col("label"))) for margin in self.margins()[1:]]
        return list(rows.agg(*means).first())

    def node_table(self, spark: SparkSession, names: list[str]) -> DataFrame:
        """``tree, node, feature_name, threshold, gain, cover, weight``; leaves have a weight and no feature."""
        rows = [
            (v.tree, v.node, None if v.feature is None else names[v.feature], v.threshold, v.gain, v.cover, v.weight)
            for nodes in self.trees for v in nodes.values()
        ]
        return spark.createDataFrame(rows, NODES.replace("feature int", "feature_name string"))


def fit_second_order(vectors: DataFrame, spec: BoostSpec = BoostSpec()) -> SecondOrderModel:
    """Fit on ``features`` (vector) and ``label`` (0 or 1). They are written first: edges and bins read them three times."""
    rows = cut_lineage(vectors.select("features", "label")).select(F.col("label").cast("double").alias("label"), entries("features").alias("entries"))
    edges = bin_edges(rows, spec.bins)
    zeros = {ix: int(np.searchsorted(of_feature, 0.0)) for ix, of_feature in edges.items()}
    binned = binned_rows(rows, edges)
    trees: list[dict[int, Node]] = []
    losses = []
    margin = F.lit(log(spec.base / (1 - spec.base)))
    for tree in range(spec.rounds):
        probability = _probability(margin)
        graded = binned.select("ix", "bin", "label", margin.alias("margin"), probability.alias("p")).select(
            "ix", "bin", (F.col("p") - F.col("label")).alias("g"),
            F.greatest(F.col("p") * (1 - F.col("p")), F.lit(LEAST_HESSIAN)).alias("h"),
            _loss(F.col("margin"), F.col("label")).alias("loss"),
        )
        # the loss of the rounds so far comes with the totals of the next tree
        total = graded.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.avg("loss").alias("loss")).first()
        if total["g"] is None:
            raise ValueError("no rows to fit")
        losses.append(total["loss"])
        trees.append(grow_tree(graded, tree, edges, zeros, Node(tree, 1, total["g"], total["h"]), spec))
        margin = margin + _weights(trees[-1], _left_by_bin(zeros))
    losses.append(binned.agg(F.avg(_loss(margin, F.col("label")))).first()[0])
    return SecondOrderModel(spec, tuple(trees), tuple(losses[1:]))


def gain_importance(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``feature_name, splits, total_gain, feature_importance`` from a table of nodes, most important first: the mean gain
    of a feature's splits, as a share of all features' mean gains."""
    spark = nodes.sparkSession
    used = nodes.where("feature_name IS NOT NULL").groupBy("feature_name").agg(
        F.count("*").alias("splits"), F.sum("gain").alias("total_gain"), F.avg("gain").alias("mean")
    )
    shares = F.coalesce(F.col("mean") / F.sum("mean").over(Window.partitionBy()), F.lit(0.0))
    every = spark.createDataFrame([(n,) for n in names], "feature_name string").join(used, "feature_name", "left")
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("splits", "total_gain")]
    table = every.select("feature_name", *counts, shares.alias("feature_importance"))
    return table.orderBy(F.desc("feature_importance"), "feature_name")
