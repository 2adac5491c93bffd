"""Substring search for lexicons that are too large for one automaton: bounded automata that texts visit by need.

Terms are dealt to shards by a hash of their first characters (8, 4, 2 or 1 of them: the most that a term has), at
most about SHARD terms to an automaton; a shard with more, whose terms share their beginnings, has several. A text is
read once, column-wise, against a filter: a bit field of bounded size that knows the beginnings of all terms, two bits
for each. Where a stretch of the text passes, the text visits the shard that the stretch's hash names, and only there an
automaton reads it; the stretches themselves go nowhere. The filter never misses a beginning, and a false answer costs a
visit. The visits of a shard are dealt to several tasks, each of which builds the automaton of its shard
before the texts stream through it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.session import cut_lineage

# A beginning is the first 8, 4, 2 or 1 characters of a term: the most that it has.
KEY_LENGTHS = (8, 4, 2, 1)
# Terms in an automaton, and texts that one task takes through it, about.
SHARD = 50_000
VISITS = 50_000
# The filter has about so many bits for each term, and at most 2 ** MOST_BITS of them (16 MB).
BITS_EACH = 128
MOST_BITS = 27
# A long text is hashed in pieces of so many characters.
PIECE = 1 << 20

_BASE = np.uint64(0x100000001B3)


def start_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each stretch of ``length`` code points."""
    count = len(codes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    found = np.full(count, length, np.uint64)
    for at in range(length):
        found = found * _BASE + codes[at : at + count].astype(np.uint64)
    # spread over all bits
    found ^= found >> np.uint64(30)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(27)
    found *= np.uint64(0x94D049BB133111EB)
    return found ^ (found >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _key_length(term: str) -> int:
    return next(n for n in KEY_LENGTHS if len(term) >= n)


class Filter:
    """Which shards a text has to visit: bits that are set for the beginnings of the lexicon's terms."""

    def __init__(self, power: int, shards: int, lengths: list[int], bits: np.ndarray | None = None):
        self.power, self.shards, self.lengths = power, shards, lengths
        self.bits = np.zeros(1 << (power - 6), np.uint64) if bits is None else bits

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two bits of each hash."""
        return hashes >> np.uint64(64 - self.power), hashes & np.uint64((1 << self.power) - 1)

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(13)) % np.uint64(self.shards)).astype(np.int64)

    def visits(self, text: str) -> set[int]:
        """The shards whose terms can occur in the text."""
        met: set[int] = set()
        for at in range(0, len(text), PIECE):
            codes = _codes(text[at : at + PIECE + KEY_LENGTHS[0] - 1])
            for length in self.lengths:
                hashes = start_hashes(codes, length)
                for which in (0, 1):
                    place = self.places(hashes)[which]
                    hashes = hashes[(self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) == 1]
                met.update(self.shard(hashes).tolist())
        return met


def build_filter(terms: DataFrame, count: int) -> tuple[Filter, DataFrame]:
    """The filter of a lexicon of ``count`` terms, and its terms with their ``shard``, stored."""
    power = min(MOST_BITS, max(10, math.ceil(math.log2(BITS_EACH * count))))
    made = Filter(power, -(-count // SHARD), [])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            lengths = [_key_length(w) for w in words]
            hashes = np.array([start_hashes(_codes(w[:n]), n)[0] for w, n in zip(words, lengths)], np.uint64)
            first, second = (p.astype(np.int64) for p in made.places(hashes))
            columns = (pa.array(lengths, pa.int32()), made.shard(hashes), first, second)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns)], ["term", "length", "shard", "first", "second"]
            )

    kept = cut_lineage(terms.mapInArrow(hashed, "term string, length int, shard bigint, first bigint, second bigint"))
    place = kept.select(F.explode(F.array("first", "second")).alias("place"))
    # at most 2 ** (MOST_BITS - 6) words of 64 bits come back
    words = place.groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias("bits"))
    table = words.toArrow()
    made.bits[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    made.lengths = sorted(r["length"] for r in kept.select("length").distinct().collect())
    return made, kept.select("term", "shard")


def sharded_matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``content, term`` for texts (content, text; each content once): the terms (a column of them, each once, none empty)
    that occur in them."""
    spark = texts.sparkSession
    terms = cut_lineage(terms.toDF("term"))
    made, sharded = build_filter(terms, max(1, terms.count()))
    sizes = dict(sharded.groupBy("shard").count().collect())  # one row per SHARD terms
    subs = {shard: -(-size // SHARD) for shard, size in sizes.items()}
    shared = spark.sparkContext.broadcast((made, subs))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, subs = shared.value
        for batch in batches:
            visits = [
                [{"shard": s, "sub": k} for s in sorted(filter_.visits(text)) for k in range(subs.get(s, 0))]
                for text in batch.column(1).to_pylist()
            ]
            kind = pa.list_(pa.struct([("shard", pa.int64()), ("sub", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, kind)], ["content", "text", "visits"])

    visits = texts.select("content", "text").mapInArrow(
        routed, "content string, text string, visits array<struct<shard: bigint, sub: int>>"
    )
    tasks = -(-texts.count() // VISITS) or 1
    sub = F.pmod(F.xxhash64("term"), F.element_at(_literal_map(subs), F.col("shard"))) if subs else F.lit(0)
    held = sharded.select(
        "shard", sub.cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"),
        F.lit(False).alias("is_text"), F.lit(None).cast("string").alias("content"), F.col("term").alias("value"),
    )
    asking = visits.select("content", "text", F.explode("visits").alias("v")).select(
        "v.shard", "v.sub", F.pmod(F.xxhash64("content"), F.lit(tasks)).cast("int").alias("task"),
        F.lit(True).alias("is_text"), "content", F.col("text").alias("value"),
    )
    unit = ["shard", "sub", "task"]
    met = held.unionByName(asking).repartition(*unit).sortWithinPartitions(*unit, "is_text")
    return met.mapInArrow(_search, "content string, term string")


def _literal_map(subs: dict[int, int]):
    return F.map_from_arrays(F.lit(list(subs)).cast("array<bigint>"), F.lit(list(subs.values())).cast("array<bigint>"))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts through the automaton of their shard, whose terms come first."""
    unit, automaton = None, None
    for batch in batches:
        contents, terms = [], []
        for *of_unit, is_text, content, value in zip(*(column.to_pylist() for column in batch.columns)):
            if of_unit != unit:
                unit, automaton = of_unit, ahocorasick.Automaton()
            if not is_text:
                automaton.add_word(value, value)
                continue
            if automaton.kind != ahocorasick.AHOCORASICK:
                automaton.make_automaton()
            if automaton.kind == ahocorasick.AHOCORASICK:  # else the shard has no terms
                for term in {term for _, term in automaton.iter(value)}:
                    contents.append(content)
                    terms.append(term)
        yield pa.RecordBatch.from_arrays([pa.array(contents, pa.string()), pa.array(terms, pa.string())], ["content", "term"])
