"""Text cleaning and tokenising as Column expressions (batch or streaming)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsift.fixed_values import (
    CONTRACTIONS,
    ENGLISH_STOP_WORDS,
    NOT_SPAM,
    PREVIEW_KEEP,
    PREVIEW_LIMIT,
    PREVIEW_TAIL,
    SEPARATORS,
    SPAM,
    TRANSLITERATIONS,
    WHITESPACE,
    WORD,
)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, f"(http|www)[^{WHITESPACE}]+", "")


def words_only(text: Column) -> Column:
    """Every run of non-word characters (blanks included) becomes one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, f"[^{WORD}]+", " "))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def clean_text(text: Column) -> Column:
    """Lower case, no URLs, word characters only, single blanks. NULL gives ''."""
    return words_only(remove_urls(F.lower(text_or_empty(text))))


def split_tokens(clean: Column) -> Column:
    """Tokens of a text whose words are separated by single blanks; '' has none."""
    return F.array_remove(F.split(clean, " "), "")


def split_contractions(clean: Column) -> Column:
    """``cannot`` -> ``can not`` and the like, on whole words, any case."""
    heads = "|".join(f"{head}(?={tail}(?![^ ]))" for head, tail in CONTRACTIONS)
    return F.regexp_replace(clean, f"(?i)(?<![^ ])({heads})", "$1 ")


def tokenize(clean: Column) -> Column:
    """Treebank tokens of a cleaned text."""
    return split_tokens(split_contractions(clean))


def remove_stopwords(tokens: Column, stop_words: list[str] = ENGLISH_STOP_WORDS) -> Column:
    """Drop stop words, compared in lower case; order and case of the rest stay."""
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda token: ~F.lower(token).isin(*stop_words))


def join_tokens(tokens: Column) -> Column:
    return F.concat_ws(" ", tokens)


def vector_terms(text: Column) -> Column:
    """Words of two or more word characters, in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs within one row, as ``'first second'``."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs), F.slice(tokens, F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a, b)
    )


# --- notebook text path ---------------------------------------------------------


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: accented Latin letters to their base letter,
    single-character spellings, and combining marks (no counterpart, so dropped)."""
    table = {source: target for source, target in TRANSLITERATIONS if len(target) == 1}
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            table.setdefault(chr(code), base)
    marks = "".join(chr(code) for code in range(0x0300, 0x0370))
    return "".join(table) + marks, "".join(table.values())


def to_ascii(text: Column) -> Column:
    """ASCII spelling of Latin text. Texts that are ASCII already skip the work."""
    spelled = text
    for source, target in TRANSLITERATIONS:
        if len(target) > 1:
            spelled = F.replace(spelled, F.lit(source), F.lit(target))
    source, target = accent_table()
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(spelled, source, target)).otherwise(text)


def replace_separators(text: Column) -> Column:
    return F.regexp_replace(text, SEPARATORS, " ")


def keep_alphanumeric(text: Column) -> Column:
    """Drop (not blank out) everything but ASCII letters, digits, ``&`` and blanks."""
    return F.regexp_replace(text, r"[^\p{Alnum}& ]+", "")


def surface_text(text: Column) -> Column:
    """Notebook cleaning without the lower-casing: the forms words are written in."""
    ascii_text = keep_alphanumeric(to_ascii(replace_separators(text_or_empty(text))))
    return F.trim(F.regexp_replace(ascii_text, " +", " "))


def clean_description(text: Column) -> Column:
    """Notebook cleaning: lower, separators to blanks, ASCII, alphanumeric, single blanks."""
    return surface_text(F.lower(text_or_empty(text)))


def blank_split(text: Column) -> Column:
    """Split on every single blank; '' gives one empty token."""
    return F.split(text, " ")


def drop_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", "")


# --- report helpers -------------------------------------------------------------


def label_name(label: Column) -> Column:
    return F.when(label == 1, SPAM).otherwise(NOT_SPAM)


def preview(text: Column) -> Column:
    short = F.concat(F.substring(text, 1, PREVIEW_KEEP), F.lit(PREVIEW_TAIL))
    return F.when(F.length(text) > PREVIEW_LIMIT, short).otherwise(text)
