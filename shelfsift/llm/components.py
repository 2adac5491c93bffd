"""Connected components of a large link table, by alternating star contractions, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.support import stored

MOST_ROUNDS = 60
# A hub's links are dealt to so many tasks; a node with more than one in so many of all links is a hub.
SALTS = 64
HUBS = 1000


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a bigint, b bigint): root is the smallest node it reaches.

    Each round hangs every larger neighbour on the smallest neighbour (large star), then every smaller neighbour on
    the smallest of them (small star); the rounds grow with the logarithm of the longest chain. Minima are combined
    before the shuffle and links meet them in a join; the links of a hub are spread over tasks in both.
    Every round is written to the shared folder, which also cuts the lineage.
    """
    edges = stored(_downward(links.where("a <> b")).distinct(), "links")
    state, size = None, edges.count()
    for _ in range(MOST_ROUNDS):
        edges = stored(_small_star(stored(_large_star(edges, size), "links"), size).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state, size = now, now[0]
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def _downward(links: DataFrame) -> DataFrame:
    """Links from the greater node a to the smaller node b."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _least(links: DataFrame) -> DataFrame:
    """a, its smallest b and its number of links, stored; a hub's links are dealt to SALTS tasks before they meet."""
    salted = links.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    part = salted.agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return stored(part.groupBy("a").agg(F.min("m").alias("m"), F.sum("n").alias("n")), "least-neighbours")


def _with(links: DataFrame, least: DataFrame, size: int) -> DataFrame:
    """``links`` with the ``m`` of their a. Nodes with more than one in HUBS of the links are at most 2 * HUBS rows, which
    are copied, so that no hub's links go to one task."""
    most = max(1, size // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > most).select("a", "m"))
    rest = links.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    return links.join(hubs, "a").select("a", "b", "m").unionByName(rest.select("a", "b", "m"))


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = _least(both)
    met = _with(both.where("b > a"), least, size)
    return met.select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    least = _least(edges)
    hung = _with(edges, least, size).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b")))
