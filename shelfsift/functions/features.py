"""Hand-made features as Column builders, named in registries so that a list of names selects them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.fixed_values import BRANDS, ENGLISH_STOP_WORDS, TAG_PHRASES, TAG_SECTION_MARKERS, WHITESPACE, WORD
from shelfsift.functions.text import blank_split, remove_urls, split_tokens, text_or_empty, words_only


def count_of(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("bigint")


def count_matching(text: Column, char_class: str) -> Column:
    """Characters of ``text`` inside a regex character class (the others go in whole runs)."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def blank_words(clean: Column) -> Column:
    """Words of a single-blank text without building an array."""
    return F.when(clean == "", F.lit(0)).otherwise(count_of(clean, " ") + 1).cast("bigint")


def phrase_hits(lowered: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur as substrings (each counted once; overlaps count)."""
    return sum((lowered.contains(phrase).cast("bigint") for phrase in phrases), F.lit(0).cast("bigint"))


def any_phrase(lowered: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | lowered.contains(phrase)
    return found.cast("bigint")


def per_character(count: Column, text: Column) -> Column:
    return count / F.greatest(F.length(text), F.lit(1))


RAW, LOWERED, CLEAN = "_raw", "_lowered", "_clean"

# Every builder reads three shared columns: raw text, lowered text, cleaned text.
LISTING_FEATURES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "text_length": lambda raw, low, clean: F.length(raw).cast("bigint"),
    "clean_text_length": lambda raw, low, clean: F.length(clean).cast("bigint"),
    "word_count": lambda raw, low, clean: blank_words(clean),
    "hashtag_count": lambda raw, low, clean: count_of(raw, "#"),
    "uppercase_ratio": lambda raw, low, clean: per_character(count_matching(raw, r"\p{IsUppercase}"), raw),
    "special_char_ratio": lambda raw, low, clean: per_character(
        F.length(F.regexp_replace(raw, rf"[\p{{L}}\p{{N}}{WHITESPACE}]+", "")), raw
    ),
    # words are counted in texts with a hashtag only
    "hashtag_to_text_ratio": lambda raw, low, clean: F.when(
        raw.contains("#"), count_of(raw, "#") / F.greatest(raw_words(raw), F.lit(1))
    ).otherwise(F.lit(0.0)),
    "contains_ignore": lambda raw, low, clean: low.contains("ignore").cast("bigint"),
    "contains_hashtags_at_end": lambda raw, low, clean: raw.rlike(rf"#[{WORD}]+[{WHITESPACE}]*\z").cast("bigint"),
    "hashtag_section_length": lambda raw, low, clean: F.when(
        raw.contains("#"), F.length(F.substring_index(raw, "#", -1))
    )
    .otherwise(0)
    .cast("bigint"),
    "brand_count": lambda raw, low, clean: phrase_hits(low, BRANDS),
    "tag_indicators": lambda raw, low, clean: phrase_hits(low, TAG_PHRASES),
    "keyword_density": lambda raw, low, clean: F.size(F.array_distinct(split_tokens(clean)))
    / F.greatest(blank_words(clean), F.lit(1)),
    "has_tag_section": lambda raw, low, clean: any_phrase(low, TAG_SECTION_MARKERS),
}


def raw_words(raw: Column) -> Column:
    """Whitespace-separated words of a raw text."""
    return F.regexp_count(raw, F.lit(f"[^{WHITESPACE}]+"))


def with_listing_features(
    df: DataFrame, text: str = "description", names: list[str] | None = None, cleaned: str | None = None
) -> DataFrame:
    """Append the named features (all 14 by default); the cleaned text is computed once per row, or taken from the
    column ``cleaned``."""
    shared = (
        df.withColumn(RAW, text_or_empty(F.col(text)))
        .withColumn(LOWERED, F.lower(F.col(RAW)))
        .withColumn(CLEAN, F.col(cleaned) if cleaned else words_only(remove_urls(F.col(LOWERED))))
    )
    chosen = {
        name: LISTING_FEATURES[name](F.col(RAW), F.col(LOWERED), F.col(CLEAN)) for name in names or LISTING_FEATURES
    }
    return shared.withColumns(chosen).drop(RAW, LOWERED, CLEAN)


# --- notebook features: read a cleaned description, tokens split on one blank ----


def blank_tokens(text: Column) -> Column:
    return count_of(text, " ") + 1


def proportion_of_stopwords(text: Column, stop_words: list[str] = ENGLISH_STOP_WORDS) -> Column:
    return F.size(F.filter(blank_split(text), lambda word: F.lower(word).isin(*stop_words))) / blank_tokens(text)


def average_length_of_word(text: Column) -> Column:
    return (F.length(text) - count_of(text, " ")) / blank_tokens(text)


def proportion_of_numbers(text: Column) -> Column:
    # the pattern is tried on words that begin with a digit only
    return F.size(F.filter(blank_split(text), lambda word: word.between("0", ":") & word.rlike("^[0-9]+$"))) / blank_tokens(text)


NOTEBOOK_FEATURES: dict[str, Callable[..., Column]] = {
    "proportion_of_stopwords": proportion_of_stopwords,
    "average_length_of_word": average_length_of_word,
    "proportion_of_numbers": proportion_of_numbers,
}


def with_notebook_features(
    df: DataFrame,
    text: str = "clean_description",
    names: list[str] | None = None,
    stop_words: list[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Append the named notebook features, computed on an already cleaned description."""
    cleaned = text_or_empty(F.col(text))
    columns = {}
    for name in names or NOTEBOOK_FEATURES:
        extra = (stop_words,) if name == "proportion_of_stopwords" else ()
        columns[name] = NOTEBOOK_FEATURES[name](cleaned, *extra)
    return df.withColumns(columns)
