"""Exact top-k search by inner product, a block at a time.

Vectors become whole numbers, ``floor(scale * x)``. Equal vectors are one entry, which holds its ``k + 1`` smallest ids.
Entries are ordered by their three nearest pivots (a bounded sample; the order decides how much is pruned, never what
is found) and cut into document-range blocks. A block keeps its forward index (its vectors and ids) and, per component,
the greatest and the smallest value, which are the maxima of the component's two terms, positive and negative. A query's
summed term maxima, the sum over its components of the greater product, bound all scores of a block. Queries take blocks in
the order of these sums, score a block through its forward index, and end where the next sum falls below the score of
their last place (or equals it and the block holds no smaller id).

Blocks lie in parts of at most PART entries, the unit of a task. A query first searches the part that it lies in itself, which gives
its last place a high score, and is then sent to those other parts whose own summed maxima can still reach it: whole
parts are left out the same way as blocks. The maxima of at most SHELVES runs of parts are copied to route the queries;
where there are more parts, a run holds several. If more than SLICE queries go to a part, they are dealt to several tasks.

Scores are products of doubles that hold whole numbers while these are exact, and Python's whole numbers beyond that.

Defined cases: null vectors and vectors with null or non-finite components take no part; components that a shorter
vector lacks count as zero; a query's own row is left out, other rows with its id or vector are not; repeated rows are
rows of their own, as queries and as candidates; ties go to the smaller id, rows without an id last; fewer than
``k`` candidates are all returned; an empty table, or one without queries, gives no rows; a score beyond a long fails the
job. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfsift.llm.support import inputs, stored

BLOCK = 64
# Entries in a part: about a sixteenth of small tables, at most PART of large ones.
LEAST_PARTS, PART = 16, 1 << 16
SHELVES = 4096
SLICE = 1 << 16
PIVOTS = 256

_FOUND = "scores array<bigint>, no_ids array<boolean>, ids array<bigint>"
_BLOCKS = (
    "part int, size int, width int, matrix binary, entries binary, asked binary, counts binary, no_ids binary, "
    "ids binary, hi array<double>, lo array<double>, least_none boolean, least bigint"
)
_HOMES = f"entry bigint, part int, place int, whole binary, self bigint, {_FOUND}"
_ROUTED = "part int, slice bigint, entry bigint, whole binary, last_score bigint, last_none boolean, last_id bigint"
_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64()),
}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(values, _ARROW[kind]) for (name, kind), values in zip(fields, columns)})


def _f8(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f8")


def matrix(rows: list[bytes]) -> np.ndarray:
    """Vectors as the rows of a matrix, zeros behind shorter ones."""
    found = [_f8(r) for r in rows]
    out = np.zeros((len(found), max(map(len, found), default=0)))
    for row, values in zip(out, found):
        row[: len(values)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two sets of whole-number vectors, exactly."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * width < 1 << 52:
        return a @ b.T
    plain = np.frompyfunc(int, 1, 1)
    return plain(a) @ plain(b).T


def bounds(queries: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Summed term maxima of each query in each block."""
    return products(np.maximum(queries, 0.0), hi) + products(np.minimum(queries, 0.0), lo)


class Block:
    """A document range: its forward index and its term maxima."""

    def __init__(self, row: dict):
        self.matrix = _f8(row["matrix"]).reshape(row["size"], row["width"])
        counts = np.frombuffer(row["counts"], "<i4")
        ends = np.cumsum(counts).tolist()
        no_ids = np.frombuffer(row["no_ids"], np.bool_).tolist()
        ids = np.frombuffer(row["ids"], "<i8").tolist()
        self.ids = [list(zip(no_ids[e - c : e], ids[e - c : e])) for e, c in zip(ends, counts.tolist())]
        self.entries = np.frombuffer(row["entries"], "<i8")
        self.asked = np.flatnonzero(np.frombuffer(row["asked"], np.bool_))
        self.hi, self.lo = np.array(row["hi"], float), np.array(row["lo"], float)
        self.least = (row["least_none"], row["least"])


def _stack(rows: list[np.ndarray]) -> np.ndarray:
    return matrix([r.tobytes() for r in rows])


def reaches(bound, least, last) -> bool:
    """Whether a range with this bound and smallest (no_id, id) can hold something before the last place."""
    return last is None or bound > -last[0] or (bound == -last[0] and least < last[1:])


def search(queries: np.ndarray, tops: list[list[tuple]], blocks: list[Block], places: int, last=None) -> int:
    """Fill ``tops``, each query's sorted list of at most ``places`` (-score, no_id, id), from the blocks; returns how many
    pairs of a query and a block were scored. ``last`` holds a place per query that others must beat, from elsewhere."""
    blocks = sorted(blocks, key=lambda b: b.least)
    most = bounds(queries, _stack([b.hi for b in blocks]), _stack([b.lo for b in blocks]))
    order = np.argsort(-most, axis=1, kind="stable")  # equal sums: blocks with smaller ids first
    last = list(last) if last is not None else [None] * len(queries)
    for q, top in enumerate(tops):
        last[q] = _last(top, places, last[q])
    active, scored = list(range(len(queries))), 0
    for step in range(len(blocks)):
        by_block: dict[int, list[int]] = {}
        still = []
        for q in active:
            b = int(order[q, step])
            if reaches(most[q, b], blocks[b].least, last[q]):  # later blocks reach no further
                by_block.setdefault(b, []).append(q)
                still.append(q)
        active = still
        if not active:
            break
        for b, asking in by_block.items():
            block, scored = blocks[b], scored + len(asking)
            for q, scores in zip(asking, products(queries[asking], block.matrix)):
                floor = -last[q][0] if last[q] else None
                if len(scores) > places:
                    own = np.partition(scores, len(scores) - places)[len(scores) - places]
                    floor = own if floor is None else max(own, floor)
                members = np.flatnonzero(scores >= floor) if floor is not None else range(len(scores))
                new = [(-int(scores[m]), *i) for m in members for i in block.ids[m]]
                if new:
                    tops[q] = sorted(tops[q] + new)[:places]
                    last[q] = _last(tops[q], places, last[q])
    return scored


def _last(top: list[tuple], places: int, given):
    """The place to beat: the last of a full list, or one that is given from elsewhere."""
    own = top[-1] if len(top) == places else None
    return min(own, given) if own and given else own or given


def _columns(top: list[tuple]) -> tuple[list, list, list]:
    if any(not -(1 << 63) <= -t[0] < 1 << 63 for t in top):
        raise OverflowError("a score does not fit a long")
    return [-t[0] for t in top], [t[1] for t in top], [t[2] for t in top]


def whole_vectors(df: DataFrame, scale: int) -> DataFrame:
    """no_id, id, key and ``whole`` (``floor(scale * x)`` as doubles) of the rows that take part, stored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keys = [], []
            for values in batch.column(2).to_pylist():
                vector = np.array(values, float)
                whole = np.floor(vector * float(scale)) + 0.0 if np.isfinite(vector).all() else None
                if whole is not None and not np.isfinite(whole).all():
                    raise ValueError(f"a component times {scale} exceeds the range of doubles")
                found.append(None if whole is None else whole.astype("<f8").tobytes())
                keys.append(None if whole is None else hashlib.blake2b(found[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["no_id", "id", "key", "whole"]
            )

    rows = inputs(df, vec_id="vec_id", vector="embedding").select(
        F.col("vec_id").isNull().alias("no_id"), F.coalesce(F.col("vec_id").cast("bigint"), F.lit(0)).alias("id"),
        F.col("vector").cast("array<double>").alias("vector"),
    )
    whole = rows.where("vector is not null and not exists(vector, x -> x is null)").mapInArrow(
        read, "no_id boolean, id bigint, key binary, whole binary"
    )
    return stored(whole.where("key is not null"), "whole-vectors")


def distinct_vectors(rows: DataFrame, asked: DataFrame, places: int) -> DataFrame:
    """entry, key, whole, ids (the first ``places``) and whether a query has this vector; stored."""
    spot = Window.partitionBy("key").orderBy("no_id", "id")
    # at most so many rows of a key leave a task: the limit is applied before the shuffle as well
    first = rows.withColumn("n", F.row_number().over(spot)).where(F.col("n") <= places)
    entries = first.groupBy("key").agg(
        F.first("whole").alias("whole"), F.array_sort(F.collect_list(F.struct("no_id", "id"))).alias("ids")
    )
    named = entries.join(asked.select("key").distinct().withColumn("asked", F.lit(True)), "key", "left")
    return stored(
        named.select(F.monotonically_increasing_id().alias("entry"), "key", "whole", "ids", F.coalesce("asked", F.lit(False)).alias("asked")),
        "vector-entries",
    )


def _ordered(entries: DataFrame) -> DataFrame:
    """``entries`` with their three nearest pivots by cosine."""
    chosen = entries.select("whole", F.xxhash64("key").alias("h"), "entry").orderBy("h", "entry").limit(PIVOTS).select("whole")
    shared = entries.sparkSession.sparkContext.broadcast([r["whole"] for r in chosen.collect()])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = matrix(shared.value)
        pivots = pivots / np.maximum(np.sqrt((pivots * pivots).sum(axis=1)), 1e-300)[:, None]
        for batch in batches:
            own = matrix(batch.column(1).to_pylist())
            width = min(own.shape[1], pivots.shape[1])
            near = np.argsort(-(own[:, :width] @ pivots[:, :width].T), axis=1, kind="stable")[:, :3].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "near"])

    rows = entries.select("entry", "whole", "ids", "asked")
    kinds = "entry bigint, whole binary, ids array<struct<no_id: boolean, id: bigint>>, asked boolean, near array<int>"
    return rows.mapInArrow(described, kinds)


def index(entries: DataFrame) -> DataFrame:
    """The blocks, stored: their part, forward index, term maxima and smallest id."""
    count = entries.count()
    parts = -(-count // min(PART, max(4 * BLOCK, -(-count // LEAST_PARTS)))) or 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = TaskContext.get().partitionId(), []
        for batch in batches:
            waiting += zip(*(batch.column(name).to_pylist() for name in ("entry", "whole", "ids", "asked")))
            while len(waiting) >= BLOCK:
                yield of_rows(part, waiting[:BLOCK])
                waiting = waiting[BLOCK:]
        if waiting:
            yield of_rows(part, waiting)

    def of_rows(part: int, rows: list[tuple]) -> pa.RecordBatch:
        entry, whole, ids, asked = zip(*rows)
        values = matrix(whole)
        flat = [(i["no_id"], i["id"]) for of_entry in ids for i in of_entry]
        row = (
            part, len(rows), values.shape[1], values.astype("<f8").tobytes(), np.array(entry, "<i8").tobytes(),
            np.array(asked, np.bool_).tobytes(), np.array([len(i) for i in ids], "<i4").tobytes(),
            np.array([i[0] for i in flat], np.bool_).tobytes(), np.array([i[1] for i in flat], "<i8").tobytes(),
            values.max(axis=0).tolist(), values.min(axis=0).tolist(), *min(flat),
        )
        return _table(_BLOCKS, [row]).to_batches()[0]

    order = [F.get("near", k) for k in range(3)]
    ranged = _ordered(entries).repartitionByRange(parts, *order, "entry").sortWithinPartitions(*order, "entry")
    return stored(ranged.mapInArrow(blocks, _BLOCKS), "vector-blocks")


def _home_search(blocks: DataFrame, places: int) -> DataFrame:
    """What each query finds in its own part, with the product with itself; stored."""

    def of_part(table: pa.Table) -> pa.Table:
        part, held = table["part"][0].as_py(), [Block(r) for r in table.to_pylist()]
        asked = [(int(b.entries[m]), b.matrix[m]) for b in held for m in b.asked.tolist()]
        if not asked:
            return _table(_HOMES, [])
        asked.sort(key=lambda a: a[0])
        queries, tops = _stack([v for _, v in asked]), [[] for _ in asked]
        search(queries, tops, held, places)
        rows = []
        for place, ((entry, vector), top) in enumerate(zip(asked, tops)):
            own = int(products(vector[None, :], vector[None, :])[0, 0])
            rows.append((entry, part, place, vector.astype("<f8").tobytes(), own, *_columns(top)))
        return _table(_HOMES, rows)

    return stored(blocks.groupBy("part").applyInArrow(of_part, _HOMES), "home-search")


def _directory(blocks: DataFrame, shelf) -> list[tuple[int, np.ndarray, np.ndarray, tuple]]:
    """Per run of parts: its number, term maxima and smallest id (at most SHELVES of them)."""
    shelved = blocks.select(shelf(F.col("part")).alias("shelf"), "hi", "lo", "least_none", "least")
    least = shelved.groupBy("shelf").agg(F.count("*").alias("n"), F.min(F.struct("least_none", "least")).alias("least"))
    maxima = (
        shelved.select("shelf", F.posexplode(F.arrays_zip("hi", "lo")).alias("i", "of"))
        .groupBy("shelf", "i").agg(F.max("of.hi").alias("hi"), F.min("of.lo").alias("lo"), F.count("*").alias("n"))
    )
    known = {r["shelf"]: (r["n"], tuple(r["least"])) for r in least.collect()}
    hi: dict[int, dict[int, float]] = {s: {} for s in known}
    lo: dict[int, dict[int, float]] = {s: {} for s in known}
    for r in maxima.collect():
        short = r["n"] < known[r["shelf"]][0]  # some blocks lack this component: it counts as zero there
        hi[r["shelf"]][r["i"]] = max(r["hi"], 0.0) if short else r["hi"]
        lo[r["shelf"]][r["i"]] = min(r["lo"], 0.0) if short else r["lo"]
    return [(s, *(np.array([of[s][i] for i in range(len(of[s]))]) for of in (hi, lo)), known[s][1]) for s in sorted(known)]


def _route(homes: DataFrame, blocks: DataFrame, places: int) -> DataFrame:
    """Queries and the other parts that can hold something for them."""
    spark = homes.sparkSession
    parts = sorted(r["part"] for r in blocks.select("part").distinct().collect())
    per_shelf = max(parts, default=0) // SHELVES + 1
    by_shelf: dict[int, list[int]] = {}
    for p in parts:
        by_shelf.setdefault(p // per_shelf, []).append(p)
    directory = _directory(blocks, lambda part: F.expr(f"part div {per_shelf}"))
    counts = dict(homes.groupBy("part").count().collect())
    before, total = {}, 0
    for p in parts:
        before[p], total = total, total + counts.get(p, 0)
    shared = spark.sparkContext.broadcast((directory, by_shelf, before))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, by_shelf, before = shared.value
        hi, lo = _stack([d[1] for d in directory]), _stack([d[2] for d in directory])
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024).to_pylist()
                most = bounds(matrix([r["whole"] for r in rows]), hi, lo)
                out = []
                for r, of_query in zip(rows, most):
                    last = (-r["scores"][-1], r["no_ids"][-1], r["ids"][-1]) if len(r["ids"]) == places else None
                    goal = (-last[0], *last[1:]) if last else (None, None, None)
                    part_slice = (before[r["part"]] + r["place"]) // SLICE
                    for (shelf, _, _, least), bound in zip(directory, of_query):
                        if reaches(bound, least, last):
                            out += [(p, part_slice, r["entry"], r["whole"], *goal) for p in by_shelf[shelf] if p != r["part"]]
                yield from _table(_ROUTED, out).to_batches()

    return homes.mapInArrow(routed, _ROUTED)


def _away_search(routed: DataFrame, blocks: DataFrame, places: int) -> DataFrame:
    """entry and what it finds in each part that it was sent to."""
    schema = f"entry bigint, {_FOUND}"

    def of_pair(queries: pa.Table, held: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return _table(schema, [])
        rows = queries.select(["entry", "whole", "last_score", "last_none", "last_id"]).to_pylist()
        last = [None if r["last_id"] is None else (-r["last_score"], r["last_none"], r["last_id"]) for r in rows]
        tops: list[list[tuple]] = [[] for _ in rows]
        search(matrix([r["whole"] for r in rows]), tops, [Block(r) for r in held.to_pylist()], places, last)
        return _table(schema, [(r["entry"], *_columns(top)) for r, top in zip(rows, tops) if top])

    routed = stored(routed, "routed-queries")
    pairs = routed.select(F.col("part").alias("of_part"), F.col("slice").alias("of_slice")).distinct()
    met = blocks.join(pairs, F.col("part") == F.col("of_part"))
    return routed.groupBy("part", "slice").cogroup(met.groupBy("of_part", "of_slice")).applyInArrow(of_pair, schema)


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows for each row whose id is divisible by ``every``."""
    rows = whole_vectors(df, scale)
    asked = rows.where(~F.col("no_id") & (F.col("id") % every == 0)).select("id", "key")
    entries = distinct_vectors(rows, asked, k + 1)  # one place more: a query meets its own row
    blocks = index(entries)
    homes = _home_search(blocks, k + 1)
    away = _away_search(_route(homes, blocks, k + 1), blocks, k + 1)
    found = homes.select("entry", "scores", "no_ids", "ids").unionByName(away)
    each = found.select("entry", F.explode(F.arrays_zip("scores", "no_ids", "ids")).alias("f")).select(
        "entry", F.col("f.scores").alias("score"), F.col("f.no_ids").alias("no_id"), F.col("f.ids").alias("id")
    )
    spot = Window.partitionBy("entry").orderBy(F.desc("score"), "no_id", "id")
    best = each.withColumn("n", F.row_number().over(spot)).where(F.col("n") <= k + 1)
    lists = best.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("n", "score", "no_id", "id"))).alias("top"))
    known = entries.where("asked").select("entry", "key").join(homes.select("entry", "self"), "entry").join(lists, "entry")
    own = F.array_position(
        F.transform("top", lambda t: F.struct(t["score"], t["no_id"], t["id"])),
        F.struct(F.col("self").alias("score"), F.lit(False).alias("no_id"), F.col("id")),
    )
    # own is 0 where the query's own row is not among them: then the last one is too many
    others = F.slice(F.filter("top", lambda t, i: i + 1 != F.col("own")), 1, k)
    ranked = asked.join(known, "key").withColumn("own", own).select("id", F.posexplode(others).alias("place", "t"))
    return ranked.select(
        F.col("id").alias("query_id"), (F.col("place") + 1).cast("int").alias("rank"),
        F.when(~F.col("t.no_id"), F.col("t.id")).alias("vec_id"), F.col("t.score").alias("score"),
    )
