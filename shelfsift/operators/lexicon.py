"""Lexicon terms that occur in a text as substrings, for lexicons given as tables."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.operators.lexicon_shards import sharded_matches
from shelfsift.session import BROADCAST_ROWS, cut_lineage, small_table


def lexicon_matches(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "description",
    row_key: str = "product_id",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """``row_key, term``, each once: every lexicon term (one column, lower case) inside the lowered text.

    A small lexicon goes to the tasks as one automaton, which reads each text once. A larger one is cut into shards, and
    a text visits those whose terms can begin in it (``lexicon_shards.py``).
    """
    terms = lexicon.toDF("term").where(F.length("term") > 0).distinct()
    lowered = df.select(F.col(row_key).alias("_key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    small = small_table(terms, limit)
    if small is not None:
        found = lowered.select("_key", F.explode(_automaton(df, small)("_text")).alias("term"))
    else:
        found = _by_shards(lowered, terms)
    return found.select(F.col("_key").alias(row_key), "term").distinct()


def _automaton(df: DataFrame, terms: pa.Table):
    shared = df.sparkSession.sparkContext.broadcast(_Terms(terms.column(0).to_pylist()))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def terms_in(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = shared.value.find
        for batch in texts:
            yield pa.array([find(text) for text in batch.to_pylist()], pa.list_(pa.string()))

    return terms_in


class _Terms:
    """Terms whose automaton is built once in each Python worker."""

    def __init__(self, terms: list[str]):
        self.terms, self.automaton = terms, None

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.terms, self.automaton = terms, None

    def find(self, text: str) -> list[str]:
        if not self.terms:
            return []
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for term in self.terms:
                self.automaton.add_word(term, term)
            self.automaton.make_automaton()
        return list({term for _, term in self.automaton.iter(text)})


def _by_shards(lowered: DataFrame, terms: DataFrame) -> DataFrame:
    # equal texts share what is found in them
    rows = cut_lineage(lowered.withColumn("content", F.sha2("_text", 256)))
    texts = rows.groupBy("content").agg(F.first("_text").alias("text"))
    return rows.select("_key", "content").join(sharded_matches(texts, terms), "content").select("_key", "term")


def lexicon_counts(df: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """``row_key, term_hits`` for every row of ``df``; rows without a hit get 0."""
    row_key = options.get("row_key", "product_id")
    hits = lexicon_matches(df, lexicon, **options).groupBy(row_key).agg(F.count("*").alias("term_hits"))
    return df.select(row_key).join(hits, row_key, "left").select(
        row_key, F.coalesce("term_hits", F.lit(0)).cast("bigint").alias("term_hits")
    )
