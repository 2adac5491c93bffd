"""True-casing from corpus counts, and entity tokens found by their capital or in a name table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.functions.text import blank_split, drop_digits, surface_text
from shelfsift.operators.token_map import map_tokens
from shelfsift.session import BROADCAST_ROWS, cut_lineage, sided, small_table, stored


def surface_forms(df: DataFrame, text: str = "description") -> DataFrame:
    """``lower_form, best_form, n``: the form each word is written in most often.

    Equal counts go to the greater form. Both counts combine map-side, so a word that
    makes up a third of the corpus costs one row per task.
    """
    words = df.select(F.explode(blank_split(drop_digits(surface_text(F.col(text))))).alias("form"))
    counted = words.where(F.col("form") != "").groupBy("form").agg(F.count("*").alias("n"))
    return counted.groupBy(F.lower("form").alias("lower_form")).agg(
        F.max_by("form", F.struct("n", "form")).alias("best_form"), F.max("n").alias("n")
    )


def truecase(df: DataFrame, tokens: str, forms: DataFrame, **options) -> DataFrame:
    """Write each lower-case token in its usual form. Only forms that differ are looked up."""
    changed = forms.where(F.col("lower_form") != F.col("best_form")).select("lower_form", "best_form")
    return map_tokens(df, tokens, changed, **options)


def capitalised_entities(tokens: Column, dedupe: bool = True) -> Column:
    """Tokens that start with a capital; each word once unless ``dedupe`` is off."""
    found = F.filter(tokens, lambda token: token.rlike("^[A-Z]"))
    return F.array_distinct(found) if dedupe else found


def gazetteer_entities(
    df: DataFrame,
    tokens: str,
    names: DataFrame,
    row_key: str = "product_id",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """``row_key, entity``, each once: names from a one-column table found as whole token runs.

    A small table goes to the tasks, where names are looked for by their first word. Of a larger one, a name meets the places
    of the word that fewest rows hold among its words, so a word that many names share costs nothing.
    """
    table = names.toDF("name").where(F.col("name").isNotNull()).distinct()
    words = df.select(F.col(row_key).alias("_key"), F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("_words"))
    small = small_table(table, limit)
    if small is not None:
        found = words.select("_key", F.explode(_names_in(df, small)("_words")).alias("entity"))
    else:
        found = _by_rarest_word(words, table)
    return found.select(F.col("_key").alias(row_key), "entity").distinct()


def _by_rarest_word(words: DataFrame, names: DataFrame) -> DataFrame:
    """``_key, entity`` by a positional join: the rarest word of a name says where the name would have to begin, and
    that place is compared. No group is gathered; names with a word that no row holds drop out first."""
    rows = stored(words.withColumn("_row", F.monotonically_increasing_id()))
    offsets = names.select("name", F.posexplode(F.split("name", " ")).alias("offset", "word"))
    counts = (
        rows.select(F.explode(F.array_distinct("_words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        .join(offsets.select("word").distinct(), "word", "left_semi")
    )
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("rarest")
    keyed = offsets.join(counts, "word", "left").groupBy("name").agg(rarest).where("rarest.n > 0")
    keyed = cut_lineage(keyed.select("name", "rarest.word", "rarest.offset"))
    # a table of names within the bounds goes to the places; of a larger one, both meet in a shuffle
    # the word before and the word behind are compared where they stand, so that few false places travel
    beside = F.transform(
        "_words", lambda word, i: F.struct(word.alias("word"), F.get("_words", i - 1).alias("before"), F.get("_words", i + 1).alias("behind"))
    )
    places = rows.select("_row", F.posexplode(beside).alias("at", "p")).select("_row", "at", "p.*")
    parts = F.split("name", " ")
    fits = [
        F.coalesce(part == found, part.isNull())
        for part, found in ((F.get(parts, F.col("offset") - 1), F.col("before")), (F.get(parts, F.col("offset") + 1), F.col("behind")))
    ]
    starts = places.join(sided(keyed, "name", "word") or keyed, "word").where(fits[0] & fits[1]).select("_row", "name", (F.col("at") - F.col("offset")).alias("start"))
    met = rows.join(starts.where("start >= 0"), "_row")
    return met.where(F.slice("_words", F.col("start") + 1, F.size(parts)) == parts).select("_key", F.col("name").alias("entity"))


class _Names:
    """Names by their first word, as tuples of words; the index is built once in each Python worker."""

    def __init__(self, names: list[str]):
        self.names, self.index = names, None

    def __getstate__(self):
        return self.names

    def __setstate__(self, names):
        self.names, self.index = names, None

    def find(self, words: list[str]) -> list[str]:
        if self.index is None:
            self.index = {}
            for name in self.names:
                parts = name.split(" ")
                self.index.setdefault(parts[0], []).append((name, parts))
        return list(
            {
                name
                for at, word in enumerate(words)
                for name, parts in self.index.get(word, ())
                if words[at : at + len(parts)] == parts
            }
        )


def _names_in(df: DataFrame, names: pa.Table):
    shared = df.sparkSession.sparkContext.broadcast(_Names(names.column(0).to_pylist()))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def names_in(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = shared.value.find
        for batch in lists:
            yield pa.array([find(words) for words in batch.to_pylist()], pa.list_(pa.string()))

    return names_in
