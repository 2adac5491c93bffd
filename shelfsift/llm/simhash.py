"""SimHash near duplicates by a Gray-order hierarchical index.

Fingerprints that occur are sorted by their Gray rank, so that neighbours differ in few bits, and cut into blocks by
range. A block's nodes hold, for a run of neighbours, the bits that all of them share (mask and pattern); a node's
own mask leaves out what the node above it has already fixed, so differences add up on the way down and a whole group
is left as soon as they exceed the limit. The upper levels over all blocks (at most MAX_BLOCKS patterns, made by
bitwise aggregates) tell each fingerprint which later blocks it must visit; in each block its members and its visitors
search the lower levels. Blocks report at most one link per fingerprint and one per pair of merged groups, which joins
the same components as all pairs within the limit would.

Defined cases: no words (null, empty, blank texts) give fingerprint zero, which links like any other; fewer words than
a shingle give one shingle of all words; texts of any length are hashed whole; equal fingerprints are one entry of the
index, whatever their number; repeated ids and rows are kept; an empty table gives an empty result; columns but doc_id
and text are not read (``keep_one`` carries them along), so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.components import components
from shelfsift.llm.support import column, inputs, stored

BLOCK = 512  # fingerprints in a block, about
MAX_BLOCKS = 1 << 16
LEAF = 16
FANOUT = 8
SEED = 42

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if it is set in over half of its shingles' hashes."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z and splits at ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - shingle + 1)
    spans = zip(starts[:count].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, count, 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text_hash: bool = False) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a bigint; with ``text_hash``, also a hash of the text."""
    names = ["doc_id", "fp", *["text_hash"] * text_hash]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(text.as_py(), shingle) for text in batch.column(1)], np.uint64)
            columns = [batch.column(0), pa.array(bits.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = inputs(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    if text_hash:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(of_batches, ", ".join(f"{name} bigint" for name in names))


def gray_rank(fp: str) -> Column:
    """The place of a fingerprint in Gray order, as a bigint that sorts like it."""
    rank = F.col(fp)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order


class Index:
    """Levels of nodes over entries in Gray order. ``same_one`` and ``same_any`` are each entry's bits that all below
    it have set, and that any has set; a fingerprint is the entry whose both are itself."""

    def __init__(self, every: np.ndarray, some: np.ndarray, first_step: int):
        self.levels = []  # from the entries up: residual masks, patterns, children per node
        step, levels = first_step, [(every, some)]
        while len(levels[-1][0]) > 1:
            every, some = levels[-1]
            at = np.arange(0, len(every), step)
            levels.append((np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)))
            self.levels.append(step)
            step = FANOUT
        self.steps = self.levels[::-1]
        shared = [~(a ^ o) for a, o in levels][::-1]
        self.patterns = [a for a, _ in levels][::-1]
        self.masks = [shared[0]]
        for level, step in enumerate(self.steps):
            above = np.repeat(shared[level], step)[: len(shared[level + 1])]
            self.masks.append(shared[level + 1] & ~above)

    def search(self, asked: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``asked``, entry) of all pairs whose shared bits differ in at most ``limit`` places."""
        who, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        apart = np.bitwise_count((asked ^ self.patterns[0][0]) & self.masks[0][0]).astype(np.uint8)
        who, node, apart = (x[apart <= limit] for x in (who, node, apart))
        for level, step in enumerate(self.steps):
            size = len(self.patterns[level + 1])
            children = (node[:, None] * step + np.arange(step)).ravel()
            who, apart = np.repeat(who, step), np.repeat(apart, step)
            real = children < size
            who, apart, node = who[real], apart[real], children[real]
            apart = apart + np.bitwise_count((asked[who] ^ self.patterns[level + 1][node]) & self.masks[level + 1][node])
            near = apart <= limit
            who, apart, node = who[near], apart[near], node[near]
        return who, node


def _u8(values) -> np.ndarray:
    return np.asarray(values, np.int64).view(np.uint64)


class _Groups:
    """Union-find over the positions of a block's members."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def near_links(distinct: DataFrame, limit: int = 2) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` (fp, each once) that join those within ``limit`` bits.

    Not every pair is listed: the links connect exactly the fingerprints that all pairs would connect.
    """
    spark = distinct.sparkSession
    count = distinct.count()
    blocks = max(1, min(MAX_BLOCKS, -(-count // BLOCK)))
    numbered = distinct.withColumn("rank", gray_rank("fp")).repartitionByRange(blocks, "rank").sortWithinPartitions("rank")
    members = stored(
        numbered.select(F.spark_partition_id().cast("bigint").alias("block"), "rank", "fp"), "gray-blocks"
    )
    nodes = members.groupBy("block").agg(F.bit_and("fp").alias("every"), F.bit_or("fp").alias("some")).orderBy("block")
    upper = nodes.toArrow()  # a pattern per block: bounded by MAX_BLOCKS
    if upper.num_rows == 0:
        return spark.createDataFrame([], "a bigint, b bigint")
    names, every, some = (upper.column(i).to_numpy() for i in range(3))
    shared = spark.sparkContext.broadcast((names, every, some))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, every, some = shared.value
        index = Index(_u8(every), _u8(some), FANOUT)
        for batch in batches:
            own, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(fps), 2048):
                who, node = index.search(_u8(fps[at : at + 2048]), limit)
                later = names[node] >= own[at + who]
                who, node = at + who[later], node[later]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[node]), pa.array(names[node] != own[who]), pa.array(fps[who])],
                    ["block", "visitor", "fp"],
                )

    routed = members.select("block", "fp").mapInArrow(visits, "block bigint, visitor boolean, fp bigint")
    by_block = routed.repartition("block").sortWithinPartitions("block", "visitor", gray_rank("fp"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members, visitors in _blocks(batches):
            mine = _u8(members)
            index, groups = Index(mine, mine, LEAF), _Groups(len(mine))
            for at in range(0, len(mine), 2048):
                who, entry = index.search(mine[at : at + 2048], limit)
                found = [(members[x], members[y]) for x, y in zip((at + who).tolist(), entry.tolist()) if groups.join(x, y)]
                yield _pairs(found)
            for asked in visitors:
                who, entry = index.search(_u8(asked), limit)
                found, met = [], {}
                for x, y in zip(who.tolist(), entry.tolist()):
                    if x not in met:
                        met[x] = y
                        found.append((asked[x], members[y]))
                    elif groups.join(met[x], y):
                        found.append((asked[x], members[y]))
                yield _pairs(found)

    return by_block.mapInArrow(links, "a bigint, b bigint")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Iterator[np.ndarray]]]:
    """Each block's members, and its visitors as they come; rows are sorted by block with the members first."""
    runs = _runs(batches)
    run = next(runs, None)
    while run is not None:
        block, members = run[0], []
        while run is not None and run[0] == block and not run[1]:
            members.append(run[2])
            run = next(runs, None)
        rest: list = [run]

        def visitors(block=block, rest=rest):
            while rest[0] is not None and rest[0][0] == block:
                yield rest[0][2]
                rest[0] = next(runs, None)

        yield np.concatenate(members), visitors()
        run = rest[0]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Stretches of rows of one block and one kind, at most 4096 long."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        visitor = batch.column(1).to_numpy(zero_copy_only=False)
        fps = batch.column(2).to_numpy()
        change = np.flatnonzero((block[1:] != block[:-1]) | (visitor[1:] != visitor[:-1])) + 1
        for a, b in zip([0, *change], [*change, len(fps)]):
            for at in range(a, b, 4096):
                yield int(block[a]), bool(visitor[a]), fps[at : min(b, at + 4096)]


def _rooted(rows: DataFrame, limit: int) -> DataFrame:
    """fp, least (smallest doc_id) and root (one fp per component), stored, for the fingerprints of ``rows``."""
    entries = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(entries.select("fp"), limit))
    rooted = entries.join(roots, entries["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    return stored(rooted, "rooted")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 2) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reached through links of at most ``limit`` differing bits)."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(rows, limit)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, limit: int = 2) -> DataFrame:
    """``docs`` without all but one row of each component: the row with the smallest id (null ids are greatest; of
    rows that share the smallest id, the one with the smallest text hash).

    Components are told apart by their root, so each one keeps a row, also where ids are missing or repeated."""
    prints = stored(fingerprints(docs, shingle, text_hash=True), "fingerprints")
    row = F.struct("no_id", "id", "text_hash")
    chosen = (
        prints.join(_rooted(prints, limit).select("fp", "root"), "fp")
        .select("root", "text_hash", *_id_key("doc_id"))
        .groupBy("root").agg(F.min(row).alias("row")).select("row.*")
    )
    chosen = stored(chosen, "chosen")
    rows = docs.select(
        F.struct(*(column(docs, name) for name in docs.columns)).alias("row"),
        F.xxhash64(column(docs, "text")).alias("text_hash"),
    ).select("row", "text_hash", *_id_key("row.doc_id"))
    key = ["no_id", "id", "text_hash"]
    # copies with one id and text: one of them, picked before the shuffle as well
    return rows.join(chosen, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row")).select("row.*")


def _id_key(doc_id: str) -> list[Column]:
    """An id as two columns without nulls, so that one shuffle serves both a join and a window."""
    given = F.col(doc_id).cast("bigint")
    return [F.coalesce(given, F.lit(0)).alias("id"), given.isNull().alias("no_id")]
