"""Embedding near duplicates by a pivot-permutation index.

A vector is described by the ordered list of its nearest pivots: vectors of a bounded sample, thinned so that no
two lie close to each other. A dense cluster has few pivots then, however large it is, and its members name the same
ones; where that leaves few pivots in all, as all vectors lie in a narrow cone, closer ones are let in. Lists per pivot hold
the vectors that name it among their first ``prefix``; two vectors are candidates if they share at least ``shared`` of these, and are then verified
by their cosine in double precision. Pivots are ranked by the length of their lists, rarest first: vectors that share
``shared`` of ``prefix`` pivots meet in the list of the rarest pivot that they share, which is among the first
``prefix - shared + 1`` of both, so only those lists are kept, and each pair is looked at in that one list only.

How many pivots to take and to share is measured, not assumed: a bounded sample of SAMPLE entries is compared with all
entries, and the first of SETTINGS that finds RECALL of the sample's links is used. Where none does, pivots tell these vectors
too little, and one list of all vectors is gone through in tiles: slow, but whole.

Equal vectors are one entry. A list is cut into blocks of about BLOCK entries by a hash, and each pair of blocks is a
task of its own, so a long list is never gathered. A tile reports per entry its number of links and one link into its
group, which joins the same components as all its pairs.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components link with nothing; vectors of
different length link with nothing; repeated ids and rows are vectors of their own; a null id is never the smallest;
pivots at the same distance come in the order of the sample; an empty table gives an empty result; columns but vec_id and
embedding are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.components import components
from shelfsift.llm.support import inputs, stored

# (prefix, shared) from cheap to costly.
SETTINGS = [(12, 3), (12, 2), (24, 4), (24, 2), (48, 4), (48, 1)]
WIDEST = max(prefix for prefix, _ in SETTINGS)
# Entries that are compared with all others to measure recall, the recall asked for, and pairs looked at in a batch.
SAMPLE = 128
RECALL = 0.98
SAMPLE_PAIRS = 4096
LEAST_PIVOTS, MOST_PIVOTS = 64, 8192
# Pivots have cosines below this, or below the square of the least cosine asked for if that is smaller.
APART = 0.9
BLOCK = 1024


def _unit(values: list | None) -> bytes:
    """The vector at length one, as doubles; empty if it cannot have a cosine."""
    if not values or None in values:
        return b""
    vector = np.array(values, "<f8")
    if not np.isfinite(vector).all() or not vector.any():
        return b""
    vector = vector / np.abs(vector).max()
    return (vector / np.sqrt(vector @ vector)).tobytes()


def _read(df: DataFrame) -> DataFrame:
    """vec_id, key (null for vectors without a cosine; equal for equal vectors), unit."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_unit(v) for v in batch.column(1).to_pylist()]
            keys = [hashlib.blake2b(u, digest_size=16).digest() if u else None for u in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["vec_id", "key", "unit"]
            )

    rows = inputs(df, vec_id="vec_id", vector="embedding")
    rows = rows.select(F.col("vec_id").cast("bigint"), F.col("vector").cast("array<double>"))
    return rows.mapInArrow(units, "vec_id bigint, key binary, unit binary")


def thinned(vectors: np.ndarray, count: int, apart: float) -> np.ndarray:
    """The first ``count`` of the vectors that have a cosine below ``apart`` with all that are taken before them."""
    taken = vectors[:0]
    for at in range(0, len(vectors), 256):
        block = vectors[at : at + 256]
        block = block[~(block @ taken.T >= apart).any(axis=1)]
        close, free = block @ block.T >= apart, np.ones(len(block), bool)
        for k in range(len(block)):
            if free[k]:
                free[k + 1 :] &= ~close[k, k + 1 :]
        taken = np.concatenate([taken, block[free]])
        if len(taken) >= count:
            break
    return taken[:count]


def choose_pivots(entries: DataFrame, count: int, apart: float = APART) -> dict[int, np.ndarray]:
    """Per vector length, at most ``count`` pivots: of the entries with the smallest key hashes, a bounded sample of up
    to four times as many, those that do not lie close to one taken before.

    Hashes are spread evenly, so about four times as many entries as wanted lie below a cut that follows from their
    number; only those are sorted.
    """
    hashed = entries.select("unit", "key", F.octet_length("unit").alias("length"), F.xxhash64("key").alias("h"))
    sample = min(MOST_PIVOTS, 4 * count)
    pivots: dict[int, np.ndarray] = {}
    for row in hashed.groupBy("length").count().collect():
        length, total = row["length"], row["count"]
        share = min(1.0, 4 * sample / total)
        cut = (1 << 63) - 1 if share == 1 else int(share * 2**64) - (1 << 63)
        low = hashed.where((F.col("length") == length) & (F.col("h") <= cut))
        chosen = low.orderBy("h", "key").limit(sample).select("unit").collect()
        vectors, limit = np.array([np.frombuffer(r["unit"], "<f8") for r in chosen], "<f8"), apart
        pivots[length] = thinned(vectors, count, limit)
        # all vectors in a narrow cone: closer pivots are better than few
        while len(pivots[length]) < min(count, len(vectors)) / 4 and limit < 0.999:
            limit = (1 + limit) / 2
            pivots[length] = thinned(vectors, count, limit)
    return pivots


def _matrix(units) -> np.ndarray:
    return np.array([np.frombuffer(u, "<f8") for u in units])


def permutations(entries: DataFrame, count: int, apart: float = APART) -> DataFrame:
    """id, size, unit and ``pivots``: the WIDEST nearest pivots in order, as numbers (apart for each vector length)."""
    shared = entries.sparkSession.sparkContext.broadcast(choose_pivots(entries, count, apart))
    bases = {length: k * MOST_PIVOTS for k, length in enumerate(sorted(shared.value))}

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(2).to_pylist()
            lengths = np.array([len(u) for u in units])
            named: list = [None] * len(units)
            for length in np.unique(lengths).tolist():
                pivots = shared.value[length]
                of_length = np.flatnonzero(lengths == length)
                for at in range(0, len(of_length), 1024):
                    mine = of_length[at : at + 1024]
                    near = -(_matrix([units[i] for i in mine]) @ pivots.T)
                    width = min(WIDEST, len(pivots))
                    first = np.argpartition(near, width - 1, axis=1)[:, :width]
                    order = np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable")
                    for i, row in zip(mine.tolist(), (np.take_along_axis(first, order, 1) + bases[length]).tolist()):
                        named[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(named, pa.list_(pa.int32()))],
                ["id", "size", "unit", "pivots"],
            )

    return entries.select("id", "size", "unit").mapInArrow(
        described, "id bigint, size bigint, unit binary, pivots array<int>"
    )


def measured(described: DataFrame, least_cosine: float) -> dict[tuple[int, int], float]:
    """For each of SETTINGS, the share of the sample's links that it finds (empty if the sample has no links)."""
    chosen = described.select("id", "unit", "pivots", F.xxhash64("unit").alias("h")).orderBy("h", "id").limit(SAMPLE).collect()
    shared = described.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["unit"]), r["pivots"]) for r in chosen])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, list] = {}
        for row in shared.value:
            by_length.setdefault(len(row[1]), []).append(row)
        for batch in batches:
            ids, units = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            lengths, names = np.array([len(u) for u in units]), batch.column(2).to_pylist()
            found = np.zeros(1 + len(SETTINGS), np.int64)
            for length, sample in by_length.items():
                mine = np.flatnonzero(lengths == length)
                if not len(mine):
                    continue
                own = np.array([row[0] for row in sample])
                near = _matrix([row[1] for row in sample]) @ _matrix([units[i] for i in mine]).T >= least_cosine
                x, y = np.nonzero(near & (own[:, None] != ids[mine][None, :]))
                if len(x) > SAMPLE_PAIRS:  # evenly from all of them
                    some = np.linspace(0, len(x) - 1, SAMPLE_PAIRS).astype(int)
                    x, y = x[some], y[some]
                if not len(x):
                    continue
                left = np.array([row[2] for row in sample])[x]
                right = np.array([names[i] for i in mine])[y]
                met = left[:, :, None] == right[:, None, :]
                found[0] += len(x)
                for k, (prefix, least) in enumerate(SETTINGS, 1):
                    common = met[:, :prefix, :prefix].sum(axis=(1, 2))
                    found[k] += (common >= min(least, left.shape[1])).sum()
            yield pa.RecordBatch.from_arrays([pa.array([n]) for n in found.tolist()], names_of)

    names_of = ["links", *(f"found_{k}" for k in range(len(SETTINGS)))]
    counts = described.select("id", "unit", "pivots").mapInArrow(compared, ", ".join(f"{n} bigint" for n in names_of))
    links, *found = counts.agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in names_of)).first()
    return {setting: n / links for setting, n in zip(SETTINGS, found)} if links else {}


def chosen_setting(recalls: dict[tuple[int, int], float]) -> tuple[int, int] | None:
    """The cheapest setting that finds enough; without links to judge by, the cheapest of all; None if none does."""
    return next((s for s in SETTINGS if recalls.get(s, 1.0) >= RECALL), None)


def _tiles(described: DataFrame, shared_pivots: int) -> DataFrame:
    """A row per entry and tile that it belongs to: list, i, j, side, id, size, unit, and its pivots' ranks in order."""
    spark = described.sparkSession
    # at most MOST_PIVOTS rows per vector length
    lengths = described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").count()
    ranks = {r["pivot"]: k for k, r in enumerate(lengths.orderBy("count", "pivot").collect())}
    shared = spark.sparkContext.broadcast(ranks)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = [sorted(shared.value[p] for p in row) for row in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(order, pa.list_(pa.int32()))], ["id", "size", "unit", "ranks"]
            )

    # with fewer pivots than asked for, as many as there are must serve
    rows = described.mapInArrow(ranked, "id bigint, size bigint, unit binary, ranks array<int>")
    needed = F.least(F.lit(shared_pivots), F.size("ranks"))
    kept = F.greatest(F.lit(1), F.size("ranks") - needed + 1)
    listed = stored(
        rows.select("id", "size", "unit", "ranks", F.explode(F.slice("ranks", 1, kept)).alias("list")), "pivot-lists"
    )
    counts = listed.groupBy("list").count().collect()
    blocks = {r["list"]: -(-r["count"] // BLOCK) for r in counts if r["count"] > BLOCK}
    long = spark.createDataFrame(list(blocks.items()) or [(-1, 1)], "list int, blocks int")
    cut = listed.join(F.broadcast(long), "list", "left").na.fill(1, ["blocks"])
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return (
        cut.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            (F.col("block") > F.col("other")).alias("side"), "id", "size", "unit", "ranks",
        )
    )


_LINKED = "id bigint, links bigint, root bigint"


def _of_tile(table: pa.Table, least_cosine: float, shared_pivots: int) -> pa.Table:
    """Links in one tile: each entry's number of linked vectors, and a link to the first entry of its group."""
    ids, sizes = table["id"].to_numpy(), table["size"].to_numpy()
    units = _matrix(table["unit"].to_pylist())
    here, i, j = table["list"][0].as_py(), table["i"][0].as_py(), table["j"][0].as_py()
    side = table["side"].to_numpy(zero_copy_only=False)
    ranks = table["ranks"].to_pylist()
    own = sorted({r for row in ranks for r in row})
    place = {r: k for k, r in enumerate(own)}
    named = np.zeros((len(ids), len(own)), np.float32)
    for row, of_row in zip(named, ranks):
        row[[place[r] for r in of_row]] = 1
    left, right = (np.arange(len(ids)),) * 2 if i == j else (np.flatnonzero(~side), np.flatnonzero(side))
    need = np.array([min(shared_pivots, len(r)) for r in ranks])
    rarer = named[:, : place[here]]
    links, up = np.zeros(len(ids), np.int64), list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for at in range(0, len(left), 512):
        mine = left[at : at + 512]
        near = (named[mine] @ named[right].T >= need[mine][:, None]) & (rarer[mine] @ rarer[right].T == 0)
        a, b = np.nonzero(near)
        a, b = mine[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        for part in range(0, len(a), 1 << 15):
            x, y = a[part : part + (1 << 15)], b[part : part + (1 << 15)]
            hit = np.einsum("ij,ij->i", units[x], units[y]) >= least_cosine
            x, y = x[hit], y[hit]
            np.add.at(links, x, sizes[y])
            np.add.at(links, y, sizes[x])
            for p, q in zip(x.tolist(), y.tolist()):
                p, q = root(p), root(q)
                up[max(p, q)] = min(p, q)
    met = np.flatnonzero(links)
    roots = ids[[root(x) for x in met.tolist()]] if len(met) else ids[:0]
    return pa.table({"id": ids[met], "links": links[met], "root": roots})


def near_duplicates(df: DataFrame, least_cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``df`` (vec_id, embedding)."""
    rows = stored(_read(df), "units")
    valid = rows.where("key is not null")
    grouped = valid.groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("unit").alias("unit")
    )
    entries = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "entries")
    wanted = 2 ** math.ceil(math.log2(4 * math.sqrt(max(1, entries.count()))))
    count, apart = max(LEAST_PIVOTS, min(MOST_PIVOTS, wanted)), min(APART, max(0.0, least_cosine) ** 2)
    described = stored(permutations(entries, count, apart), "permutations")
    setting = chosen_setting(measured(described, least_cosine))
    if setting is None:  # one list, of the vectors of each length
        prefix, shared = 1, 1
        described = described.withColumn("pivots", F.array(F.octet_length("unit")))
    else:
        prefix, shared = setting
    tiles = _tiles(described.withColumn("pivots", F.slice("pivots", 1, prefix)), shared)
    linked = stored(tiles.groupBy("list", "i", "j").applyInArrow(lambda t: _of_tile(t, least_cosine, shared), _LINKED), "tiles")
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    joined = (
        entries.select("id", "key", "least", "size").join(links, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    joined = stored(joined, "joined")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(smallest, "root").select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    found = valid.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
