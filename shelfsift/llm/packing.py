"""Mixture-controlled packing: deficit round-robin over source queues into windows of a fixed number of tokens.

Each source's documents form one queue of tokens. In every window the round visits all queues in order; a queue is
credited ``window * weight / total weight`` tokens, gives the whole tokens of its credit, and carries what is left of it
(its deficit, always less than one token) to the next window. The queue's whole tokens after ``i`` windows are therefore
``floor(i*L*A[k]/W) - floor(i*L*A[k-1]/W)`` with cumulative weights ``A``, so the state of the round follows from a
position alone: partitions need no hand-over, and each one cuts its documents by itself. When a queue cannot give its
credit any more, one window takes what it has, the others fill that window, and a new phase goes on without it. Only
the last window of all can be short.

Rounds nest, so that any number of sources and any weights keep their proportions. Queues that would get less than two tokens of
a window, and the smallest ones where a round would have more than CHILDREN, are first joined by a round of their own
(FAN queues of like weight, or two of unlike weight), whose window is just long enough to give each of them two tokens; its
stream is one queue of the round above, with the sum of their weights. A source's tokens stay within a few of its target
in all windows while its round's members last; what a member leaves goes to its own round first.

The driver holds totals per source and the nested rounds; their phases are worked out in the tasks that need them. Sources
beyond the MOST_SOURCES largest go one after another through one queue. Documents are encoded once, into a table in the shared folder.

Defined cases: a null text is empty (it holds the end id); texts of any length are cut into as many windows as they need; a
null source is a queue of its own; sources tied in size come in the order of their names; repeated rows are packed
as often as they occur; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import struct
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfsift.llm.encoding import encoder, share_tokenizer
from shelfsift.llm.support import inputs, small_side, stored

WINDOW = 4096
# Sources with a queue of their own: one number and one name each on the driver.
MOST_SOURCES = 1_000_000
# Queues of the outermost round, and of a round inside another.
CHILDREN = 200
FAN = 64
# Queues are of like weight if the heaviest weighs at most so many times the lightest.
LIKE = 4
# Weights are whole numbers out of about this total.
WEIGHT_TOTAL = 1 << 50

ENCODED = "part bigint, source string, before bigint, doc_id bigint, n bigint, ids binary"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
)
# the same with a checksum of the ids in their place
DIGESTS = PIECES.replace("ids binary", "ids_crc32 bigint")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Encoded documents, stored: task, source, tokens of that source before it in the task, id, length and ids."""
    shared = share_tokenizer(docs.sparkSession, tokenizer)
    ending = struct.pack("<I", end_id)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        part, given = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = [encode(text.as_py() or "") + ending for text in batch.column(2)]
            sources = batch.column(1).to_pylist()
            counts, before = [len(i) // 4 for i in ids], []
            for source, count in zip(sources, counts):
                before.append(given.get(source, 0))
                given[source] = before[-1] + count
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int64()), pa.array(sources, pa.string()),
                    pa.array(before, pa.int64()), batch.column(0), pa.array(counts, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["part", "source", "before", "doc_id", "n", "ids"],
            )

    rows = inputs(docs, doc_id="doc_id", source="source", text="text").select(
        F.col("doc_id").cast("bigint"),
        # a mark before the name keeps a null source apart from every name
        F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source").cast("string"))).alias("source"),
        "text",
    )
    return stored(rows.mapInArrow(encoded, ENCODED), "encoded")


def whole_weights(shares: list[float]) -> list[int]:
    """Weights as whole numbers, none of them zero."""
    total = sum(shares) or 1.0
    return [max(1, round(share / total * WEIGHT_TOTAL)) for share in shares]


class Round:
    """The round-robin over some queues with unchanging weights."""

    def __init__(self, weights: list[int], window: int):
        self.window, self.total = window, sum(weights)
        self.above = np.cumsum([0, *weights]).tolist()

    def given(self, k: int, windows: int) -> int:
        """Whole tokens that queue k gave in so many windows."""
        step = windows * self.window
        return step * self.above[k + 1] // self.total - step * self.above[k] // self.total

    def windows_for(self, k: int, position: int) -> int:
        """The window (from 0) in which queue k gives its token at this position."""
        weight = self.above[k + 1] - self.above[k]
        i = max(0, position * self.total // (self.window * weight) - 1)
        while self.given(k, i + 1) <= position:
            i += 1
        while i and self.given(k, i) > position:
            i -= 1
        return i

    def offset(self, k: int, i: int) -> int:
        """Where queue k's tokens begin in window i."""
        step = self.window * self.above[k]
        return (i + 1) * step // self.total - i * step // self.total


def ledger(tokens: list[int], weights: list[int], window: int = WINDOW) -> list[list[tuple]]:
    """For each queue its spans (first position, first window, round, place in the round) or, for a window that a
    queue leaves, (first position, window, None, offset), in the order of positions."""
    spans: list[list[tuple]] = [[] for _ in tokens]
    left, done, first = list(tokens), [0] * len(tokens), 0
    while active := [k for k, n in enumerate(left) if n]:
        turn = Round([weights[k] for k in active], window)
        full = min(turn.windows_for(place, left[k]) for place, k in enumerate(active))
        if full:
            for place, k in enumerate(active):
                spans[k].append((done[k], first, turn, place))
                taken = turn.given(place, full)
                done[k] += taken
                left[k] -= taken
            first += full
            active = [k for k in active if left[k]]
            if not active:
                break
            turn = Round([weights[k] for k in active], window)
        # the window that a queue leaves: what it has, and the others fill up, the fullest first
        share = {k: min(left[k], turn.given(place, 1)) for place, k in enumerate(active)}
        room = window - sum(share.values())
        for k in sorted(active, key=lambda k: (-left[k], k)):
            more = min(room, left[k] - share[k])
            share[k] += more
            room -= more
        offset = 0
        for k in active:
            if share[k]:
                spans[k].append((done[k], first, None, offset))
                offset += share[k]
                done[k] += share[k]
                left[k] -= share[k]
        first += 1
    return spans


def cut(position: int, count: int, spans: list[tuple], total: int) -> Iterator[tuple[int, int, int]]:
    """The pieces of ``count`` tokens from ``position`` of a queue: (length, window, offset)."""
    begins, end = [s[0] for s in spans], position + count
    while position < end:
        at = bisect_right(begins, position) - 1
        begin, first, turn, place = spans[at]
        stop = begins[at + 1] if at + 1 < len(spans) else total
        if turn is None:
            window, offset = first, place + position - begin
        else:
            i = turn.windows_for(place, position - begin)
            window, offset = first + i, turn.offset(place, i) + position - begin - turn.given(place, i)
            stop = min(stop, begin + turn.given(place, i + 1))
        length = min(end, stop) - position
        yield length, window, offset
        position += length


class Rounds:
    """A round over queues, each of them a source (its number) or another round."""

    def __init__(self, members: list[tuple[int, int, int | Rounds]], window: int):
        """``members``: weight, tokens and queue."""
        self.members, self.window = members, window
        self.weight, self.tokens = sum(m[0] for m in members), sum(m[1] for m in members)

    @cached_property
    def spans(self) -> list[list[tuple]]:
        return ledger([m[1] for m in self.members], [m[0] for m in self.members], self.window)

    def __getstate__(self):
        return self.members, self.window, self.weight, self.tokens

    def __setstate__(self, state):
        self.members, self.window, self.weight, self.tokens = state

    def paths(self, above: tuple = ()) -> dict[int, tuple]:
        """For each source, the rounds from its own to the outermost, with its place in each."""
        found = {}
        for place, (_, _, queue) in enumerate(self.members):
            path = ((self, place), *above)
            found |= queue.paths(path) if isinstance(queue, Rounds) else {queue: path}
        return found


def nested_rounds(tokens: list[int], weights: list[int], window: int = WINDOW) -> Rounds:
    """The outermost round over all queues that have tokens."""
    queues = sorted(((w, n, k) for k, (n, w) in enumerate(zip(tokens, weights)) if n), key=lambda q: (-q[0], q[2]))
    total = sum(q[0] for q in queues)
    while len(queues) > CHILDREN or (queues and window * queues[-1][0] < 2 * total):
        least = queues[-1][0]
        size = 1
        while size < min(FAN, len(queues)) and queues[-size - 1][0] <= LIKE * least:
            size += 1
        group = queues[-max(2, size) :]
        del queues[-len(group) :]
        inner = Rounds(group, -(-2 * sum(q[0] for q in group) // least))
        insort(queues, (inner.weight, inner.tokens, inner), key=lambda q: -q[0])
    return Rounds(queues, window)


def cut_path(path: tuple, position: int, count: int) -> Iterator[tuple[int, int, int]]:
    """The pieces of ``count`` tokens from ``position`` of a source, through its rounds: (length, window, offset)."""
    (rounds, place), *above = path
    for length, window, offset in cut(position, count, rounds.spans[place], rounds.members[place][1]):
        if above:
            yield from cut_path(above, window * rounds.window + offset, length)
        else:
            yield length, window, offset


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, temperature: float = 1.0, weights: dict | None = None, digests: bool = False
) -> DataFrame:
    """Pieces of documents in windows: doc_id, start, length, ids, doc_tokens, sequence_id, offset. With ``digests``, a
    CRC-32 of the ids (``ids_crc32``) comes in place of the ids, which then need not leave the task that cuts them.

    Target proportions: ``weights`` by source where given (a source that is missing there gets the smallest), else
    each source's tokens to the power of ``temperature`` (1: every window mirrors the corpus; less: small sources
    come earlier and more densely, and end before the large ones).
    """
    spark = docs.sparkSession
    encoded = encode_documents(docs, tokenizer, end_id)
    parts = encoded.groupBy("source", "part").agg(F.sum("n").alias("n"))
    parts = stored(parts, "queue-parts")
    totals = parts.groupBy("source").agg(F.sum("n").alias("n"))
    named = [r["source"] for r in totals.orderBy(F.desc("n"), "source").limit(MOST_SOURCES).collect()]
    names = spark.createDataFrame(list(zip(named, range(len(named)))), "source string, queue int")
    queued = stored(parts.join(small_side(names), "source", "left").na.fill(len(named), ["queue"]), "queue-parts")
    lengths = dict(queued.groupBy("queue").agg(F.sum("n")).collect())
    tokens = [lengths.get(k, 0) for k in range(len(named) + 1)]
    if weights is None:
        shares = [float(n) ** temperature for n in tokens]
    else:
        least = min(weights.values(), default=1.0)
        shares = [float(weights.get(s[1:] if s[0] == "1" else None, least)) for s in named] + [float(least)]
    shared = spark.sparkContext.broadcast(nested_rounds(tokens, whole_weights(shares)))

    # a queue goes through its sources and, in each, through the tasks in order
    before = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = queued.select(
        "source", "part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    placed = encoded.join(small_side(bases), ["source", "part"]).select(
        "doc_id", "queue", (F.col("base") + F.col("before")).alias("position"), "n", "ids"
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
        paths = shared.value.paths()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            docs, queues, positions, counts = (batch.column(i).to_pylist() for i in range(4))
            for doc, queue, position, count, ids in zip(docs, queues, positions, counts, batch.column(4)):
                ids, start = ids.as_py(), 0
                for length, window, offset in cut_path(paths[queue], position, count):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc, start, length, crc32(own) if digests else own, count, window, offset)
                    for values, value in zip(out, row):
                        values.append(value)
                    start += length
                size += 0 if digests else len(ids)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    schema = DIGESTS if digests else PIECES
    return placed.mapInArrow(pieces, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed windows: sequence_id, n_tokens, ids. A window's pieces are at most WINDOW, so a group is bounded."""
    parts = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens")
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["ids"]))
    return parts.select("sequence_id", "n_tokens", joined.alias("ids"))
