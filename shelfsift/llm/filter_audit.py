"""Filter interaction audit by sorted posting lists.

Every document is read once; what stays of it are its part, a row number and the filters it fails. Row numbers are cut
into ranges, and a part keeps one sorted list of failing row numbers per filter and range (its posting lists), plus
one list of its labelled good and one of its labelled toxic rows. In each range, the union of the lists of every set of
filters comes from a galloping k-way merge, and what a filter removes behind such a set from a galloping difference.
Sizes of ranges add up; an order of filters is then read off: its step s removes what its filter fails outside
the union of the filters before it, whatever their order.

A range holds at most ``RANGE`` rows, so no list grows with its part; a hot part has many ranges. The filter on repeated
texts takes the smallest id per text hash: minima are combined before the shuffle, and the few hashes that hold more
than one row in ``HOT`` are at most ``HOT`` rows, which are copied; other groups are small.

Defined cases: a null text is empty, a null source is the part ``''``, joined with an empty source; empty and
blank texts have no words; words and texts of any length are read whole; rows with a repeated id are rows of their own,
and a text is a repeat only of a smaller id, so rows that tie on the smallest id are all first ones; a null
id repeats nothing, is no smaller id, and has no label; several labels of one id count if any of them does; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.support import inputs, stored

FILTERS = "ABCDE"
# A text hash with more than one row in so many is joined by a copied table of at most so many rows.
HOT = 1000
# Row numbers are cut into ranges of so many.
RANGE = 1 << 16

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"
_MARKS = "row bigint, doc_id bigint, part string, fails int, text_hash binary"
_STEPS = "array<struct<filter_order: string, step: int, filter: int, places: array<int>>>"
_SIZES = "part string, filter int, before int, removed bigint, good_lost bigint, toxic_lost bigint, failing bigint, documents bigint"


def own_filters(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    data = text.encode()
    words = data.split()  # bytes are split at ASCII blanks only
    few = len(words) < 200
    repetitive = 100 * len(set(words)) < 50 * len(words)
    capitals = 100 * (len(data) - len(data.translate(None, _UPPER))) > 2 * len(text)
    signs = len(data.translate(None, _SIGNS)) < len(data)
    return few | repetitive << 1 | capitals << 2 | signs << 3


def marked(docs: DataFrame) -> DataFrame:
    """row, doc_id, part, fails (filters A to D) and a 128-bit hash of the text, stored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails, hashes = [], []
            for value in batch.column(3):
                text = value.as_py() or ""
                fails.append(own_filters(text))
                hashes.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
            columns = [*batch.columns[:3], pa.array(fails, pa.int32()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "part", "fails", "text_hash"])

    rows = inputs(docs, doc_id="doc_id", part="source", text="text").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"),
        F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"),
    )
    return stored(rows.mapInArrow(read, _MARKS), "audit-marks")


def with_repeats(marks: DataFrame) -> DataFrame:
    """``marks`` with bit 4 set where the text is that of a smaller id."""
    groups = marks.where("doc_id is not null").groupBy("text_hash").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("size")
    )
    repeated = stored(groups.where("most > least").select("text_hash", "least", "size"), "audit-repeats")
    hot_size = marks.count() / HOT
    hot = repeated.where(F.col("size") > hot_size).select("text_hash", F.col("least").alias("hot_least"))
    rest = repeated.where(F.col("size") <= hot_size).select("text_hash", "least")
    # rows of hot hashes go on under a key of their own row, so that they meet nothing in the shuffle of the others
    known = marks.join(F.broadcast(hot), "text_hash", "left")
    key = F.when(F.col("hot_least").isNull(), F.col("text_hash")).otherwise(F.encode(F.col("row").cast("string"), "UTF-8"))
    joined = known.withColumn("key", key).join(rest.withColumnRenamed("text_hash", "key"), "key", "left")
    repeat = F.coalesce(F.col("doc_id") > F.coalesce("hot_least", "least"), F.lit(False))
    return joined.select("row", "doc_id", "part", F.col("fails").bitwiseOR(F.when(repeat, 16).otherwise(0)).alias("fails"))


def with_labels(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """``marks`` with ``good`` and ``toxic`` from the labels of their ids."""
    flags = (
        inputs(labels, doc_id="doc_id", quality="quality", toxic="toxic")
        .where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("key"), F.lit(True).alias("has_id"))
        .agg(*(F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(f"is_{name}") for name in ("quality", "toxic")))
        .where("is_quality or is_toxic")
    )
    # rows without an id are spread by their row number and meet no label
    keyed = marks.withColumn("key", F.coalesce("doc_id", "row")).withColumn("has_id", F.col("doc_id").isNotNull())
    return keyed.join(flags, ["key", "has_id"], "left").select(
        "row", "part", "fails",
        F.coalesce("is_quality", F.lit(False)).alias("good"), F.coalesce("is_toxic", F.lit(False)).alias("toxic"),
    )


def postings(rows: DataFrame, span: int = RANGE) -> DataFrame:
    """Posting lists per part and range of row numbers, stored: documents (how many), one sorted list per filter, and
    the lists ``good`` and ``toxic``."""
    def listed(condition, name):
        return F.sort_array(F.collect_list(F.when(condition, F.col("row")))).alias(name)

    bits = [F.col("fails").bitwiseAND(1 << k) != 0 for k in range(len(FILTERS))]
    lists = rows.groupBy("part", F.expr(f"row div {span}").alias("range")).agg(
        F.count("*").alias("documents"),
        *(listed(bit, name) for bit, name in zip(bits, FILTERS)), listed(F.col("good"), "good"), listed(F.col("toxic"), "toxic"),
    )
    return stored(lists, "audit-postings")


def gallop(ids: list[int], value: int, start: int) -> int:
    """The first place from ``start`` on whose id is at least ``value``: doubling steps, then a search in the last."""
    step, low, end = 1, start, len(ids)
    while low + step < end and ids[low + step] < value:
        low += step
        step *= 2
    return bisect_left(ids, value, low, min(end, low + step + 1))


def union(lists: list[list[int]]) -> list[int]:
    """The k-way merge of sorted lists without repeats: runs below the other heads are found by galloping and copied whole."""
    heads = [[ids[0], ids, 0] for ids in lists if ids]
    out: list[int] = []
    while len(heads) > 1:
        heads.sort(key=lambda head: head[0])
        value, ids, at = heads[0]
        until = heads[1][0]
        if value == until:  # the other list holds it too
            stop = at + 1
        else:
            stop = gallop(ids, until, at)
            out += ids[at:stop]
        if stop < len(ids):
            heads[0] = [ids[stop], ids, stop]
        else:
            del heads[0]
    return out + heads[0][1][heads[0][2] :] if heads else out


def difference(ids: list[int], other: list[int]) -> list[int]:
    """The sorted ids that a second sorted list does not hold; both lists are galloped through in turn."""
    out: list[int] = []
    at, place = 0, 0
    while at < len(ids):
        place = gallop(other, ids[at], place)
        if place == len(other):
            return out + ids[at:]
        stop = gallop(ids, other[place], at)
        out += ids[at:stop]
        at = stop
        while at < len(ids) and place < len(other) and ids[at] == other[place]:
            at += 1
            place += 1
    return out


def range_sizes(lists: list[list[int]], good: list[int], toxic: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """filter, filters before it (bits), rows removed, and the good and toxic ones among them, for one range."""
    size = len(lists)
    for before in range(1 << size):
        gone = union([lists[k] for k in range(size) if before >> k & 1])
        for k in range(size):
            if not before >> k & 1:
                removed = difference(lists[k], gone)
                lost = (len(removed) - len(difference(removed, of_label)) for of_label in (good, toxic))
                yield k, before, len(removed), *lost


def sizes(lists: DataFrame) -> DataFrame:
    """Per part, filter and set of filters before it: removed, good_lost, toxic_lost, failing and documents."""

    def of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SIZES.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        for batch in batches:
            for row in range(batch.num_rows):
                part, documents, *held = (column[row].as_py() for column in batch.columns)
                own, (good, toxic) = held[: len(FILTERS)], held[len(FILTERS) :]
                found = [(part, *s, len(own[s[0]]), documents) for s in range_sizes(own, good, toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), kinds)], names)

    each = lists.select("part", "documents", *FILTERS, "good", "toxic").mapInArrow(of_ranges, _SIZES)
    return each.groupBy("part", "filter", "before").agg(
        *(F.sum(name).alias(name) for name in ("removed", "good_lost", "toxic_lost", "failing", "documents"))
    )


def orders() -> list[tuple[str, int, list[int]]]:
    """filter_order, step, and the places in ``_place`` of the sizes of all steps up to it, for all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before, places = 0, []
        for k in order:
            places.append(_place(k, before))
            before |= 1 << k
            out.append(("".join(FILTERS[k] for k in order), len(places), list(places)))
    return out


def _place(k, before):
    """One number for a filter and the set of filters before it."""
    return k * (1 << len(FILTERS)) + before


def audit(docs: DataFrame, labels: DataFrame, span: int = RANGE) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row per part,
    order and step."""
    found = sizes(postings(with_labels(with_repeats(marked(docs)), labels), span))
    width = len(FILTERS)
    every = (1 << width) - 1
    # in how many orders exactly these filters come before this one
    weights = F.array(*(F.lit(factorial(n) * factorial(width - 1 - n)).cast("bigint") for n in range(width)))
    weighted = F.col("removed") * F.get(weights, F.bit_count("before"))
    size = F.struct("removed", "good_lost", "toxic_lost", "failing")
    # a part has width * 2 ** (width - 1) sizes: one small map per part
    parts = found.groupBy("part").agg(
        F.max("documents").alias("documents"),
        F.map_from_entries(F.collect_list(F.struct(_place(F.col("filter"), F.col("before")), size))).alias("sizes"),
        F.array(*(F.sum(F.when(F.col("filter") == k, weighted)) for k in range(width))).alias("shapley"),
    )
    every_step = [
        {"filter_order": order, "step": step, "filter": places[-1] // (every + 1), "places": places}
        for order, step, places in orders()
    ]
    steps = F.from_json(F.lit(json.dumps(every_step)), _STEPS)
    rows = parts.withColumn("at", F.explode(steps)).select("part", "documents", "sizes", "shapley", "at.*")
    own = F.element_at("sizes", F.element_at("places", -1))
    alone = F.element_at("sizes", _place(F.col("filter"), F.lit(every) - F.expr("shiftleft(1, filter)")))
    gone = F.aggregate("places", F.lit(0).cast("bigint"), lambda n, p: n + F.element_at(F.col("sizes"), p)["removed"])
    return rows.select(
        "part", "filter_order", "step", (F.col("documents") - gone).alias("kept"), own["removed"].alias("removed"),
        (own["failing"] - own["removed"]).alias("redundant"), alone["removed"].alias("unique_fails"),
        own["good_lost"].alias("good_lost"), own["toxic_lost"].alias("toxic_lost"),
        F.get("shapley", F.col("filter")).alias("shapley"),
    )
