"""Lemmas: the dictionary is a table, looked up per token; a corpus can supply one of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.fixed_values import ENGLISH_STOP_WORDS
from shelfsift.functions.text import (
    clean_description,
    clean_text,
    remove_stopwords,
    split_tokens,
    tokenize,
)
from shelfsift.operators.token_map import map_tokens, map_words

# (ending, replacement) of regular English inflections, tried in this order
SUFFIX_RULES = [("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ed", "")]
SHORTEST_STEM = 3


def lemmatize(df: DataFrame, tokens: str, dictionary: DataFrame, **options) -> DataFrame:
    """Replace tokens by their lemma; ``dictionary`` has columns form, lemma."""
    return map_tokens(df, tokens, dictionary, **options)


def corpus_dictionary(df: DataFrame, tokens: str) -> DataFrame:
    """``form, lemma`` for regular inflections whose base form occurs in the same corpus.

    One pass over the texts gives the distinct words; of the at most five base forms that a word could have,
    those stay that are words themselves. Of several readings the first rule's wins. Write the result
    (``cut_lineage``) if it is used more than once.
    """
    # array_distinct also keeps Spark from testing the token column twice for emptiness
    words = df.select(F.explode(F.array_distinct(tokens)).alias("word")).distinct()
    readings = [
        F.when(
            F.col("word").endswith(ending) & (F.length("word") >= SHORTEST_STEM + len(ending)),
            F.struct(
                F.lit(rank).alias("rank"),
                F.concat(F.expr(f"left(word, length(word) - {len(ending)})"), F.lit(base)).alias("lemma"),
            ),
        )
        for rank, (ending, base) in enumerate(SUFFIX_RULES)
    ]
    read = words.select(F.col("word").alias("form"), F.inline(F.array_compact(F.array(*readings))))
    known = read.join(words.withColumnRenamed("word", "lemma"), "lemma", "left_semi")
    return known.groupBy("form").agg(F.min_by("lemma", "rank").alias("lemma"))


def lemmatised_description(
    df: DataFrame, dictionary: DataFrame | None = None, text: str = "description", output: str = "clean_description", **options
) -> DataFrame:
    """Notebook cleaning, with the lemma of each blank-separated word where a dictionary (form, lemma) is given."""
    cleaned = df.withColumn(output, clean_description(F.col(text)))
    if dictionary is None:
        return cleaned
    return map_words(cleaned, output, dictionary, **options)


def preprocess(
    df: DataFrame,
    text: str = "description",
    output: str = "tokens",
    dictionary: DataFrame | None = None,
    remove_stop: bool = True,
    stop_words: list[str] = ENGLISH_STOP_WORDS,
    clean_column: str | None = None,
    **options,
) -> DataFrame:
    """Clean, lemmatise (if a dictionary is given), tokenise, drop stop words: a token array.

    ``join_tokens`` of the result is the preprocessed text. ``clean_column`` names a column that is clean already.
    """
    cleaned = df.withColumn("_clean", F.col(clean_column) if clean_column else clean_text(F.col(text)))
    if dictionary is not None:
        cleaned = map_words(cleaned, "_clean", dictionary, keep_empty=False, **options)
    cleaned = cleaned.withColumn("_tokens", tokenize(F.col("_clean")) if remove_stop else split_tokens(F.col("_clean")))
    kept = remove_stopwords(F.col("_tokens"), stop_words) if remove_stop else F.col("_tokens")
    return cleaned.withColumn(output, kept).drop("_clean", "_tokens")
