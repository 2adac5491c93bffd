"""Lemma rules learnt from a corpus: rewrites of word endings, scored by the words whose base form the corpus attests.

A rewrite turns an ending of 1 to 4 characters into a shorter one of at most one character behind the same stem
(``ies`` to ``y``, ``ing`` to nothing or to ``e``). It explains a word if what it makes of the word is a word of the corpus too. A
rewrite becomes a rule if it explains enough words, and a large enough share of all words with its ending. A word's
lemma is what the rule that explains most words makes of it, of those that lead to a word of the corpus.

Words meet in an equi join on the stem: a word has at most 4 stems as an inflected form and 2 as a base, and a stem at
most one base for each last character, so no stem gathers pairs without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.session import cut_lineage

SHORTEST_STEM = 3
LONGEST_ENDING = 4
# A rule explains so many words, and so many of a hundred words that have its ending.
LEAST_WORDS = 5
LEAST_PERCENT = 20


def _cut(word: str, characters: int) -> Column:
    """stem and ending of a word without its last characters, null if the stem is too short."""
    fits = F.length(word) >= SHORTEST_STEM + characters
    stem, ending = F.expr(f"left({word}, length({word}) - {characters})"), F.expr(f"right({word}, {characters})")
    return F.when(fits, F.struct(stem.alias("stem"), ending.alias("ending")))


def _cuts(words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """``word, stem, ending`` for every way to cut a word."""
    ways = F.array(*(_cut("word", n) for n in range(shortest, longest + 1)))
    return words.select("word", F.inline(F.array_compact(ways)))


def explained(words: DataFrame) -> DataFrame:
    """``form, ending, base_ending, lemma``: all rewrites that make a word of ``words`` (word, each once) of another."""
    forms = _cuts(words, 1, LONGEST_ENDING)
    bases = _cuts(words, 0, 1).select("stem", F.col("word").alias("lemma"), F.col("ending").alias("base_ending"))
    # the stem is as long as it can be: the endings begin differently
    shorter = (F.length("base_ending") < F.length("ending")) & (F.left("ending", F.length("base_ending")) != F.col("base_ending"))
    met = forms.join(bases, "stem").where((F.col("base_ending") == "") | shorter)
    return met.select(F.col("word").alias("form"), "ending", "base_ending", "lemma")


def learn_rules(
    words: DataFrame, rewrites: DataFrame, least_words: int = LEAST_WORDS, least_percent: int = LEAST_PERCENT
) -> DataFrame:
    """``ending, base_ending, explains, words``: rules with the number of words they explain, and of words with that ending."""
    support = rewrites.groupBy("ending", "base_ending").agg(F.count("*").alias("explains"))
    ends = _cuts(words, 1, LONGEST_ENDING).groupBy("ending").agg(F.count("*").alias("words"))
    enough = (F.col("explains") >= least_words) & (100 * F.col("explains") >= least_percent * F.col("words"))
    return support.join(ends, "ending").where(enough).select("ending", "base_ending", "explains", "words")


def learnt_dictionary(rewrites: DataFrame, rules: DataFrame) -> DataFrame:
    """``form, lemma``: of the rules that lead to a word, the one that explains most words; then the longer ending, then
    the lesser ending and base ending."""
    ranked = F.struct(-F.col("explains"), -F.length("ending"), "ending", "base_ending")
    known = rewrites.join(rules.select("ending", "base_ending", "explains"), ["ending", "base_ending"])
    return known.groupBy("form").agg(F.min_by("lemma", ranked).alias("lemma"))


def learn_lemmas(df: DataFrame, tokens: str, **bounds: int) -> tuple[DataFrame, DataFrame]:
    """(rules, dictionary) of the words in a token column; both read what is written on the way."""
    words = cut_lineage(df.select(F.explode(F.array_distinct(tokens)).alias("word")).where("word IS NOT NULL").distinct())
    rewrites = cut_lineage(explained(words))
    rules = cut_lineage(learn_rules(words, rewrites, **bounds))
    return rules, learnt_dictionary(rewrites, rules)
