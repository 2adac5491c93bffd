"""Exact TF-IDF with n-grams and a bounded vocabulary.

Fitting is one pass and one shuffle of map-side combined term counts, or, for the many pairs of a large corpus, two
passes that shuffle bounded summaries only (``heavy_terms.py``). Weighing is
row-local: the vocabulary (at most ``max_features`` terms) goes to the tasks and each
row becomes a sparse vector there, so texts are never exploded or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.fixed_values import (
    ENGLISH_STOP_WORDS,
    GRAM_MAX_DF,
    GRAM_MIN_DF,
    GRAM_VOCABULARY,
    WORD_VOCABULARY,
)
from shelfsift.functions.text import bigrams, remove_stopwords, vector_terms
from shelfsift.operators.heavy_terms import TRACKED, top_terms


@dataclass(frozen=True)
class TfidfSpec:
    """``min_df`` and ``max_df``: a whole number is a row count, a fraction a share of rows.

    With ``tracked``, the vocabulary is found from bounded summaries, with the same result."""

    max_features: int
    min_df: float = 1
    max_df: float = 1.0
    pairs: bool = False
    stop_words: tuple[str, ...] = ()
    # items that a summary of the corpus tracks per bucket; without it all terms are counted
    tracked: int | None = None


WORD_SPEC = TfidfSpec(WORD_VOCABULARY, stop_words=tuple(ENGLISH_STOP_WORDS))
GRAM_SPEC = TfidfSpec(GRAM_VOCABULARY, GRAM_MIN_DF, GRAM_MAX_DF, pairs=True, tracked=TRACKED)


def with_terms(df: DataFrame, text: Column, spec: TfidfSpec, output: str = "terms") -> DataFrame:
    """Append the row's terms, repeats kept: words, then neighbouring pairs if asked for."""
    words = df.withColumn("_words", vector_terms(F.coalesce(text, F.lit("")))).withColumn(
        "_words", remove_stopwords(F.col("_words"), list(spec.stop_words))
    )
    terms = F.concat("_words", bigrams(F.col("_words"))) if spec.pairs else F.col("_words")
    return words.withColumn(output, terms).drop("_words")


def term_counts(df: DataFrame, terms: str = "terms") -> DataFrame:
    """``term, cf, df``: occurrences in the corpus, and rows that hold the term.

    A row lists its terms, then its distinct terms; the place in that list says which
    count an entry belongs to, so both counts come from one pass.
    """
    listed = df.select(
        F.size(terms).alias("repeats"), F.posexplode(F.concat(terms, F.array_distinct(terms))).alias("place", "term")
    )
    return listed.groupBy("term").agg(
        F.count_if(F.col("place") < F.col("repeats")).alias("cf"),
        F.count_if(F.col("place") >= F.col("repeats")).alias("df"),
    )


def vocabulary(df: DataFrame, spec: TfidfSpec, terms: str = "terms", rows: int | None = None) -> DataFrame:
    """``term, cf, df`` of the most frequent terms within the df bounds; ties go to the lesser term."""
    rows = df.count() if rows is None else rows
    low, high = _bound(spec.min_df, rows), _bound(spec.max_df, rows)
    if spec.tracked:
        found = top_terms(df, spec.max_features, terms, low, high, spec.tracked)
        if found is not None:
            return found
    counted = term_counts(df, terms)
    return (
        counted.where((F.col("df") >= low) & (F.col("df") <= high))
        .orderBy(F.desc("cf"), "term")
        .limit(spec.max_features)
    )


def _bound(value: float, rows: int) -> float:
    return value if isinstance(value, int) else value * rows


@dataclass(frozen=True)
class TfidfModel:
    """Terms in sorted order with their inverse document frequencies."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]

    def with_vector(self, df: DataFrame, terms: str = "terms", output: str = "tfidf", counts: str | None = None):
        """Append the L2-normalised sparse vector (all zero for a row without known terms)."""
        tf, weight = counts or f"_{output}_tf", f"_{output}_weight"
        counted = CountVectorizerModel.from_vocabulary(list(self.terms), terms, tf).transform(df)
        weighed = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol=tf, outputCol=weight
        ).transform(counted)
        normed = Normalizer(p=2.0, inputCol=weight, outputCol=output).transform(weighed)
        return normed.drop(weight) if counts else normed.drop(tf, weight)

    def long(self, df: DataFrame, terms: str = "terms", row_key: str = "product_id", suffix: str = "") -> DataFrame:
        """``row_key, term, tf, tfidf`` for the terms each row holds."""
        vectors = self.with_vector(df, terms, "_tfidf", counts="_tf").select(
            row_key, F.unwrap_udt("_tf").alias("_tf"), F.unwrap_udt("_tfidf").alias("_tfidf")
        )
        entries = vectors.select(
            row_key,
            F.inline(
                F.arrays_zip(
                    F.col("_tf.indices").alias("ix"),
                    F.col("_tf.values").alias("tf"),
                    F.col("_tfidf.values").alias("tfidf"),
                )
            ),
        )
        names = F.array(*[F.lit(term + suffix) for term in self.terms])
        return entries.select(
            row_key, F.get(names, F.col("ix")).alias("term"), F.col("tf").cast("bigint").alias("tf"), "tfidf"
        )

    def feature_names(self, suffix: str = "") -> list[str]:
        return [term + suffix for term in self.terms]


def fit_tfidf(df: DataFrame, spec: TfidfSpec, terms: str = "terms") -> TfidfModel:
    """Fit on the rows of ``df``: smoothed idf ``ln((1 + rows) / (1 + df)) + 1``."""
    rows = df.count()
    idf = F.log((F.lit(1.0) + rows) / (F.lit(1.0) + F.col("df"))) + 1
    kept = vocabulary(df, spec, terms, rows).select("term", idf.alias("idf")).collect()
    if not kept:
        raise ValueError("no terms remain: the vocabulary is empty")
    ordered = sorted((row["term"], row["idf"]) for row in kept)
    return TfidfModel(tuple(term for term, _ in ordered), tuple(weight for _, weight in ordered))
