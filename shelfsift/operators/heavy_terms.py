"""The most frequent terms of a corpus, exactly, without shuffling every term.

Three steps. A summary: terms are dealt to BUCKETS by hash, and each bucket keeps Spark's mergeable frequent-items sketch, which
tracks a bounded number of items; tasks send their sketches, not their terms. A recount: the best candidates of all
buckets (a few times the terms wanted) are counted exactly in a second pass, in which rows look their terms up, so again
only candidates are shuffled. A proof: of a bucket with n occurrences, a sketch with a map of m items is off by at
most 3.5 / m * n, so a term that is no candidate occurs at most that often more than the last candidate of its bucket. If the
last term chosen occurs more often than that bound, no other can belong to the answer; if the proof fails, ``top_terms`` says
so, and all terms must be counted.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.session import cut_lineage

BUCKETS = 16
# Items that the sketch of a bucket tracks.
TRACKED = 1 << 15
# Candidates for each term wanted, and in any bucket.
SPARE = 3
LEAST_CANDIDATES = 64
# Spark's own limit for the number of items that a sketch returns.
MOST_CANDIDATES = 10_000


def map_size(tracked: int) -> int:
    """The size of a sketch's map: the power of two in which the tracked items fill at most three quarters."""
    return 1 << math.ceil(math.log2(tracked / 0.75))


def candidates(df: DataFrame, terms: str, wanted: int, tracked: int = TRACKED, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n (occurrences of all its terms), found (array of candidates with estimated counts), one row per bucket; stored."""
    each = min(MOST_CANDIDATES, LEAST_CANDIDATES + SPARE * -(-wanted // buckets), tracked)
    # appending nothing keeps Spark from testing the terms for emptiness in a pass of their own
    listed = df.select(F.explode(F.concat(terms, F.array().cast("array<string>"))).alias("term"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    sketched = listed.groupBy(bucket.alias("bucket")).agg(
        F.expr(f"approx_top_k(term, {each}, {tracked})").alias("found"), F.count("*").alias("n")
    )
    return cut_lineage(sketched.withColumn("each", F.lit(each)))


def unseen_bound(summary: DataFrame, tracked: int = TRACKED) -> int:
    """No term that is not a candidate occurs more often than this."""
    error = F.floor(3.5 / map_size(tracked) * F.col("n"))
    last = F.when(F.size("found") >= F.col("each"), F.array_min(F.transform("found", lambda c: c["count"]))).otherwise(0)
    return summary.agg(F.coalesce(F.max(error + last), F.lit(0))).first()[0]


def recount(df: DataFrame, terms: str, names: list[str]) -> DataFrame:
    """``term, cf, df`` of the named terms: occurrences, and rows that hold the term."""
    spark = df.sparkSession
    counted = CountVectorizerModel.from_vocabulary(names, terms, "_tf").transform(df.select(terms))
    entries = counted.select(F.unwrap_udt("_tf").alias("_tf")).select(
        F.inline(F.arrays_zip(F.col("_tf.indices").alias("ix"), F.col("_tf.values").alias("tf")))
    )
    counts = entries.groupBy("ix").agg(F.sum("tf").cast("bigint").alias("cf"), F.count("*").alias("df"))
    known = spark.createDataFrame(list(enumerate(names)), "ix int, term string")
    return counts.join(F.broadcast(known), "ix").select("term", "cf", "df")


def top_terms(
    df: DataFrame, wanted: int, terms: str = "terms", least_df: float = 1, most_df: float | None = None,
    tracked: int = TRACKED, buckets: int = BUCKETS,
) -> DataFrame | None:
    """``term, cf, df`` of the ``wanted`` most frequent terms within the df bounds, ties to the lesser term; None if
    the summary cannot prove them. Reads ``df`` twice: give a stored one (``cut_lineage``) where its terms are costly.
    """
    summary = candidates(df, terms, wanted, tracked, buckets)
    # at most SPARE times the terms wanted, and LEAST_CANDIDATES a bucket
    names = [r["item"] for r in summary.select(F.inline("found")).select("item").collect()]
    if not names:
        return None
    within = F.col("df") >= least_df
    if most_df is not None:
        within &= F.col("df") <= most_df
    top = cut_lineage(recount(df, terms, names).where(within).orderBy(F.desc("cf"), "term").limit(wanted))
    size, last = top.agg(F.count("*"), F.min("cf")).first()
    bound = unseen_bound(summary, tracked)
    proven = bound < max(1, least_df) or (size == wanted and last > bound)
    return top.orderBy(F.desc("cf"), "term") if proven else None
