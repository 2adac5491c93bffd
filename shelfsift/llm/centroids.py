"""Centroid clustering with whole numbers, nearest centroids by equal-average equal-variance search.

Vectors become whole numbers, ``floor(SCALE * x)``, and stay so: centroids are floors of means, distances are squared and
exact, so results do not depend on the order in which anything is added up. Each round reads the stored vectors once.
In a task, centroids are sorted by the sum of their components (their mean times the length). A vector starts at the
centroid whose sum is nearest to its own and scans outward on both sides. With S the sum, L the length and V the root
of the summed squared deviations from the mean, a distance is at least

    (Sx - Sc)^2 / L                     so a side ends where that exceeds the smallest distance so far (equal average)
    (Sx - Sc)^2 / L + (Vx - Vc)^2       so a centroid is passed over where that exceeds it (equal variance)

and only centroids that pass both are measured, with whole numbers. Bounds are compared with a margin above the rounding
of doubles, and only strictly greater ones reject, so ties between centroids always reach the exact comparison, where
the smaller number wins.

What the driver and each task hold is the centroids: ``clusters`` times ``length`` numbers, whatever the table's size.
Sums per cluster are combined in the task before they are shuffled.

Defined cases: only vectors with exactly ``length`` components, none null or non-finite, take part; others give no row.
Repeated ids and rows are vectors of their own; rows tied on the hash of their id come in
the order of their stored bytes; rows without an id take part, and start a cluster only where too few have one. With fewer vectors than clusters
there are as many clusters as vectors. An empty table gives no rows. Great numbers (``PLAIN``) are computed without
64-bit limits, with the same results; where a distance itself does not fit a long, the job fails and says so. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.support import inputs, stored

SCALE = 1024
# Vectors of L whole numbers up to this over L have exact 64-bit sums and squares; greater ones are Python's.
PLAIN = 1 << 30
# Rows that are compared with the centroids at once.
ROWS = 4096
_MARGIN = 1 + 1e-9


def whole_vectors(df: DataFrame, length: int = 64, scale: int = SCALE) -> DataFrame:
    """vec_id and ``whole``, the vector's ``floor(scale * x)`` as little-endian doubles, for the rows that take part; stored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the filter below leaves vectors of one length without nulls only
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            with np.errstate(over="ignore"):
                whole = np.floor(values * float(scale))
            if np.isinf(whole[np.isfinite(values).all(axis=1)]).any():
                raise ValueError(f"a component times {scale} exceeds the range of doubles")
            rows = [row.astype("<f8").tobytes() for row in whole]
            finite = pa.array(np.isfinite(values).all(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["vec_id", "whole"]).filter(finite)

    rows = inputs(df, vec_id="vec_id", vector="embedding").select(
        F.col("vec_id").cast("bigint"), F.col("vector").cast("array<double>").alias("vector")
    )
    fitting = (F.size("vector") == length) & ~F.exists("vector", lambda x: x.isNull())
    return stored(rows.where(F.coalesce(fitting, F.lit(False))).mapInArrow(read, "vec_id bigint, whole binary"), "whole-vectors")


def numbers(rows: list[bytes]) -> np.ndarray:
    """A matrix of whole numbers from stored vectors: 64-bit ones where all squares and sums fit, else Python's."""
    values = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    if not values.size or np.abs(values).max() <= PLAIN // values.shape[1]:
        return values.astype(np.int64)
    return np.array([[int(v) for v in row] for row in values.tolist()], object)


class Search:
    """Nearest centroids by the inequalities of equal averages and equal variances."""

    def __init__(self, centroids: list[list[int]]):
        wide = max(abs(v) for c in centroids for v in c) > PLAIN // len(centroids[0])
        given = np.array(centroids, object if wide else np.int64)
        self.sums = given.sum(axis=1)
        self.order = np.argsort(self.sums, kind="stable")
        self.length = given.shape[1]
        self.centroids, self.sums = given[self.order], self.sums[self.order]
        self.spreads = self._spreads(self.centroids, self.sums)
        self.measured = 0

    def _spreads(self, rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Per row, the root of the summed squared deviations from its mean, times the root of the length."""
        return np.sqrt((self.length * (rows * rows).sum(axis=1) - sums * sums).astype(float))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) for each row of whole numbers."""
        centroids = self.centroids
        if rows.dtype != centroids.dtype:
            rows, centroids = rows.astype(object), centroids.astype(object)
        size, last = len(rows), len(centroids) - 1
        sums = rows.sum(axis=1)
        spreads = self._spreads(rows, sums)
        # per row: the place of the centroid with the nearest sum
        up = np.searchsorted(self.sums, sums)
        near = np.clip(up, 0, last)
        below = np.clip(up - 1, 0, last)
        start = np.where(abs(self.sums[below] - sums) < abs(self.sums[near] - sums), below, near)
        best = np.full(size, len(centroids), np.int64)
        distance = np.full(size, -1, rows.dtype)
        self._measure(rows, centroids, np.arange(size), start, best, distance)
        going = {side: np.arange(size) for side in (1, -1)}
        for step in range(1, last + 1):
            for side, who in going.items():
                place = start[who] + side * step
                inside = (place >= 0) & (place <= last)
                who, place = who[inside], place[inside]
                # all bounds are times the length
                least = (distance[who] * self.length).astype(float) * _MARGIN
                average = (self.sums[place] - sums[who]).astype(float) ** 2
                within = average <= least
                going[side] = who = who[within]
                place, least, average = place[within], least[within], average[within]
                slack = 1e-9 * (self.spreads[place] + spreads[who])  # for the roots' own rounding
                variance = np.maximum(np.abs(self.spreads[place] - spreads[who]) - slack, 0.0) ** 2
                close = average + variance <= least
                self._measure(rows, centroids, who[close], place[close], best, distance)
        return best, distance

    def _measure(self, rows, centroids, who, place, best, distance) -> None:
        """Exact distances of some rows to one centroid each; keeps the smaller distance, then the smaller number."""
        apart = rows[who] - centroids[place]
        squared, number = (apart * apart).sum(axis=1), self.order[place]
        better = (distance[who] < 0) | (squared < distance[who]) | ((squared == distance[who]) & (number < best[who]))
        better = better.astype(bool)
        best[who[better]], distance[who[better]] = number[better], squared[better]
        self.measured += len(who)


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    rows = column.to_pylist()
    for at in range(0, len(rows), ROWS):
        yield at, numbers(rows[at : at + ROWS])


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in the order of these."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = vectors.select(named.alias("hash"), "whole").orderBy(F.asc_nulls_last("hash"), "whole").limit(clusters)
    return [[int(v) for v in np.frombuffer(r["whole"], "<f8").tolist()] for r in chosen.collect()]


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floors of the means of each centroid's vectors; a centroid without vectors stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    size = len(centroids)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = Search(shared.value), [0] * size, [0] * size
        for batch in batches:
            for _, rows in _blocks(batch.column(0)):
                cluster, _ = search.nearest(rows)
                for k in np.unique(cluster).tolist():
                    mine = rows[cluster == k]
                    sums[k] = sums[k] + mine.sum(axis=0).astype(object)
                    counts[k] += len(mine)
        met = [k for k in range(size) if counts[k]]
        out = [(k, i, Decimal(int(v)), counts[k]) for k in met for i, v in enumerate(sums[k])]
        columns = zip(*out) if out else ((),) * 4
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["k", "i", "total", "n"])

    parts = vectors.select("whole").mapInArrow(summed, "k int, i int, total decimal(38,0), n bigint")
    totals = parts.groupBy("k", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = [list(c) for c in centroids]
    for row in totals.collect():  # clusters times length rows
        moved[row["k"]][row["i"]] = int(row["total"]) // row["n"]
    shared.destroy()
    return moved


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value)
        for batch in batches:
            for at, rows in _blocks(batch.column(1)):
                cluster, distance = search.nearest(rows)
                if int(distance.max()) >= 1 << 63:
                    raise OverflowError("a squared distance does not fit a long")
                columns = [batch.column(0).slice(at, len(rows)), cluster.astype(np.int32), distance.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:])], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "whole").mapInArrow(assigned, "vec_id bigint, cluster int, distance bigint")


def cluster(
    df: DataFrame, clusters: int = 8, rounds: int = 10, length: int = 64, scale: int = SCALE, seed: str = "3"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that takes part."""
    spark = df.sparkSession
    vectors = whole_vectors(df, length, scale)
    centroids = first_centroids(vectors, clusters, seed)
    result = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        moved = next_centroids(vectors, centroids)
        if moved == centroids:  # every later round would give the same
            break
        centroids = moved
    found = stored(assign(vectors, centroids), "clusters")
    sums = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    whole = sum(map(int, sums.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    side = [(k, int(sums[k]), whole, names[k]) for k in sums]
    known = spark.createDataFrame(side, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(*(f.split()[0] for f in result.split(", ")))
