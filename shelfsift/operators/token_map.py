"""Replace or drop tokens by a lookup table, whatever the table's size, with the same rows either way.

A table small enough to copy to executors is looked up inside the task, column-wise and PIECE rows at a time, so texts are not
shuffled at all, and a task holds one Arrow batch and the results of a piece. The copy is Arrow columns and sorted hashes, not
a dictionary of Python strings, so its bytes bound it rather than its rows.
Of a larger table, the entries that any row asks for are often few enough for that. If not, only the FREQUENT entries
that most rows ask for are copied (a bounded number), so no token of the join that serves the others is held by many
rows. What leaves the rows for that join are hashes of those tokens that a bit field of the other entries lets through, never
whole token lists; lists that many rows share (at most HOT of them) get their entries by a copy as well, and rows that ask
for none of the other entries meet nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.session import cut_lineage, small_table

# Entries of a copied table: beside its text (at most BROADCAST_BYTES), an entry takes some 20 bytes of a worker.
COPIED_ROWS = 2_000_000
# Entries of a large table that are looked up inside the task because most rows ask for them.
FREQUENT = 10_000
# A token list that more than one in so many rows have is not a key of the join.
HOT = 1000

# Rows that a task looks up at a time, so that its memory does not grow with what Spark sends at once.
PIECE = 1000

# The bit field of the entries that are not copied has about so many bits for each, and at most 2 ** MOST_BITS (16 MB).
BITS_EACH = 16
MOST_BITS = 27

_FOUND = T.ArrayType(T.StructType([T.StructField("found", T.BooleanType()), T.StructField("value", T.StringType())]))


def map_tokens(
    df: DataFrame,
    tokens: str,
    table: DataFrame,
    output: str | None = None,
    limit: int = COPIED_ROWS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Replace each token found in ``table`` (columns: token, replacement).

    Tokens not found stay, and so do NULL tokens. A NULL replacement drops the token. Order is kept. A NULL token list
    becomes an empty one. In the table, NULL tokens are ignored, and of a repeated token the smallest replacement counts
    (NULL only if it has no other).
    """
    output = output or tokens
    pairs = _pairs(table)
    small = small_table(pairs, limit)
    if small is not None:
        return df.withColumn(output, _replacing(df, small)(F.col(tokens)))
    return _map_by_join(df, tokens, pairs, output, limit, frequent)


def map_words(
    df: DataFrame,
    text: str,
    table: DataFrame,
    output: str | None = None,
    keep_empty: bool = True,
    limit: int = COPIED_ROWS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """``map_tokens`` on the words of a text, parted by each blank, and joined again; empty words go without ``keep_empty``.

    With a small table, whole texts go to the task and are split there, not lists word by word. A NULL text becomes ''."""
    output = output or text
    pairs = _pairs(table)
    small = small_table(pairs, limit)
    if small is not None:
        return df.withColumn(output, _replacing_words(df, small, keep_empty)(F.col(text)))
    words = F.split(text, " ") if keep_empty else F.array_remove(F.split(text, " "), "")
    mapped = _map_by_join(df.withColumn("_words", words), "_words", pairs, "_words", limit, frequent)
    return mapped.withColumn(output, F.concat_ws(" ", "_words")).drop("_words")


def drop_tokens(df: DataFrame, tokens: str, words: DataFrame, **options) -> DataFrame:
    """Anti join of a token column with a one-column word table, compared as given."""
    gone = words.toDF("_token").withColumn("_value", F.lit(None).cast("string"))
    return map_tokens(df, tokens, gone, **options)


def _pairs(table: DataFrame) -> DataFrame:
    given = table.toDF("_token", "_value").where(F.col("_token").isNotNull())
    return given.groupBy("_token").agg(F.min("_value").alias("_value"))


def _hashes(tokens: pa.Array) -> np.ndarray:
    return np.fromiter(map(hash, tokens.to_pylist()), np.int64, len(tokens))


class Table:
    """A small lookup table as Arrow columns; its index, the sorted hashes of the keys, is built once in each Python worker."""

    def __init__(self, table: pa.Table):
        self.keys, self.values = (column.cast(pa.string()).combine_chunks() for column in table.columns)
        self.index: tuple[np.ndarray, np.ndarray, dict[str, int]] | None = None

    def __getstate__(self):
        return self.keys, self.values, None

    def __setstate__(self, state):
        self.keys, self.values, self.index = state

    def _indexed(self) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
        """Sorted hashes, the places of their keys, and the keys whose hash another key before them has."""
        parts = [_hashes(self.keys.slice(at, 1 << 16)) for at in range(0, len(self.keys), 1 << 16)]
        found = np.concatenate([np.zeros(0, np.int64), *parts])
        order = np.argsort(found, kind="stable").astype(np.int32)
        found = found[order]
        again = order[1:][found[1:] == found[:-1]].tolist()
        return found, order, {self.keys[place].as_py(): place for place in again}

    def find(self, tokens: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Whether the table has each token, and its value."""
        if self.index is None:
            self.index = self._indexed()
        hashes, order, others = self.index
        if not len(hashes):
            return pa.array(np.zeros(len(tokens), bool)), pa.nulls(len(tokens), pa.string())
        wanted = _hashes(tokens)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        met = np.flatnonzero(hashes[at] == wanted)
        places = order[at[met]]
        same = pc.equal(self.keys.take(pa.array(places)), tokens.take(pa.array(met))).to_numpy(zero_copy_only=False)
        where = np.full(len(tokens), -1, np.int64)
        where[met[same]] = places[same]
        if others:
            for place in met[~same].tolist():
                where[place] = others.get(tokens[place].as_py(), -1)
        found = pa.array(where >= 0)
        return found, self.values.take(pc.if_else(found, pa.array(where), pa.scalar(None, pa.int64())))


def _pieces(columns: Iterator[pa.Array]) -> Iterator[tuple[pa.DictionaryArray, np.ndarray]]:
    """PIECE rows at a time: the tokens by their distinct ones, and where the rows' lists begin and end."""
    for column in columns:
        for at in range(0, len(column), PIECE):
            piece = column.slice(at, PIECE)
            sizes = pc.fill_null(pc.list_value_length(piece), 0).to_numpy(zero_copy_only=False)
            # the distinct tokens are looked up, whatever the size of the table
            yield piece.flatten().dictionary_encode(), np.concatenate([[0], np.cumsum(sizes)])


def _lookup(df: DataFrame, small: pa.Table):
    """A column function: for each token, whether the table has it, and its replacement."""
    table = df.sparkSession.sparkContext.broadcast(Table(small))

    @F.arrow_udf(_FOUND)
    def look_up(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for coded, ends in _pieces(columns):
            found, values = table.value.find(coded.dictionary.cast(pa.string()))
            met = pc.fill_null(found.take(coded.indices), False)
            hits = pa.StructArray.from_arrays([met, values.take(coded.indices)], ["found", "value"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)

    return look_up


def _replaced(table: Table, coded: pa.DictionaryArray, ends: np.ndarray) -> pa.ListArray:
    given = coded.dictionary.cast(pa.string())
    found, values = table.find(given)
    gone = pc.fill_null(pc.and_(found, pc.is_null(values)).take(coded.indices), False)
    out = pc.if_else(found, values, given).take(coded.indices)
    if pc.any(gone).as_py():
        kept = pc.invert(gone)
        out = out.filter(kept)
        ends = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])[ends]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out)


def _replacing(df: DataFrame, small: pa.Table):
    """A column function: the tokens with what was found put in; dropped tokens are left out."""
    table = df.sparkSession.sparkContext.broadcast(Table(small))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def replaced(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for coded, ends in _pieces(columns):
            yield _replaced(table.value, coded, ends)

    return replaced


def _replacing_words(df: DataFrame, small: pa.Table, keep_empty: bool):
    """A column function: the text with what was found for its words put in."""
    table = df.sparkSession.sparkContext.broadcast(Table(small))

    def lists(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            for at in range(0, len(column), PIECE):
                yield pc.split_pattern(column.slice(at, PIECE), " ")

    @F.arrow_udf(T.StringType())
    def replaced(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for coded, ends in _pieces(lists(texts)):
            if not keep_empty:
                kept = pc.not_equal(coded.dictionary, "").take(coded.indices)
                ends = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])[ends]
                coded = coded.filter(kept)
            yield pc.binary_join(_replaced(table.value, coded, ends), " ").cast(pa.string())

    return replaced


def _passing(df: DataFrame, entries: DataFrame):
    """A column function: of each row's hashes, those that entries (``_hash``) may have, by a bit field of them."""
    power = min(MOST_BITS, max(10, math.ceil(math.log2(BITS_EACH * max(1, entries.count())))))
    place = F.shiftrightunsigned("_hash", 64 - power).alias("place")
    word = entries.select(place).groupBy(F.expr("place div 64").alias("word"))
    table = word.agg(F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (power - 6), np.uint64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def passing(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            hashes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = hashes.view(np.uint64) >> np.uint64(64 - power)
            kept = (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1
            ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[kept]))

    return passing


def _map_by_join(df: DataFrame, tokens: str, pairs: DataFrame, output: str, limit: int, frequent: int) -> DataFrame:
    """Rows with equal token lists share one key and one map of the entries they hit; texts meet it once."""
    counted = df.select(F.explode(F.array_distinct(tokens)).alias("_token")).groupBy("_token").agg(F.count("*").alias("_n"))
    asked = cut_lineage(counted.join(pairs, "_token"))
    small = small_table(asked.select("_token", "_value"), limit)
    if small is not None:
        return df.withColumn(output, _replacing(df, small)(F.col(tokens)))
    top = asked.orderBy(F.desc("_n"), "_token").limit(frequent).select("_token", "_value").toArrow()
    copied = df.sparkSession.createDataFrame(top.select(["_token"]), "_token string")
    rare = asked.select("_token", "_value", F.xxhash64("_token").alias("_hash"))
    rare = cut_lineage(rare.join(F.broadcast(copied), "_token", "left_anti"))
    row = F.monotonically_increasing_id()
    hashes = F.array_distinct(F.transform(tokens, lambda token: F.xxhash64(token)))
    keyed = df.withColumn("_maybe", _passing(df, rare)(hashes))
    # a row without such tokens has a key of its own: should it be another list's, that map changes nothing
    keyed = keyed.withColumn("_list", F.when(F.size("_maybe") > 0, F.xxhash64(tokens)).otherwise(row))
    # a token travels as a hash: what another token with the same hash would add is looked up by nobody
    lists = cut_lineage(keyed.where(F.size("_maybe") > 0).select("_list", "_maybe"))
    wanted = lists.select("_list", F.explode("_maybe").alias("_hash")).distinct()
    hit = F.struct("_token", F.struct("_value").alias("_hit"))
    maps = wanted.join(rare, "_hash").groupBy("_list").agg(F.map_from_entries(F.collect_list(hit)).alias("_map"))
    maps = cut_lineage(maps)
    often = lists.groupBy("_list").agg(F.count("*").alias("_n")).where(F.col("_n") > df.count() / HOT).select("_list")
    hot = maps.join(F.broadcast(often), "_list").withColumnRenamed("_map", "_hot")
    met = keyed.drop("_maybe").join(F.broadcast(hot), "_list", "left").withColumn(
        "_list", F.when(F.col("_hot").isNull(), F.col("_list")).otherwise(row)
    )
    none = F.create_map().cast("map<string,struct<_value:string>>")
    met = met.join(maps, "_list", "left").withColumn("_map", F.coalesce("_hot", "_map", none)).drop("_hot")
    # NULL tokens have no key in a map; what is dropped is told from what is not found
    looked = _lookup(df, top)

    def combined(hits: Column, token: Column) -> Column:
        other = F.when(token.isNotNull(), F.try_element_at("_map", token))
        return F.struct(
            F.when(hits["found"], hits["value"].isNull()).otherwise(other.isNotNull() & other["_value"].isNull()).alias("dropped"),
            F.when(hits["found"], hits["value"]).when(other.isNotNull(), other["_value"]).otherwise(token).alias("token"),
        )

    given = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    pairs_met = F.zip_with(looked(F.col(tokens)), given, combined)
    kept = F.transform(F.filter(pairs_met, lambda pair: ~pair["dropped"]), lambda pair: pair["token"])
    return met.withColumn(output, kept).drop("_map", "_list")
