"""Large delimited files whose quoted fields hold line breaks, read by many tasks.

A file is split at line breaks, wherever these fall. Whether a split begins inside a quoted field follows from all quotes
before it, so a first pass reads every split both ways: from outside and from inside a quoted field, what state does
it leave? These maps are chained per file (a few bytes for each split), which tells every split its true beginning. The
second pass cuts each split into records with that knowledge. A record that crosses a border is put together from the
ends of its splits; the first pass keeps these ends for both readings, and where one is longer than FRAGMENT bytes, they come from
another pass instead. Records then go through Spark's own CSV parser as columns.

Quoting is by ``"`` at the beginning of a field, doubled inside it; a quote elsewhere in a field means nothing. Lines end
with ``\\n`` or ``\\r\\n``; a file whose lines end with ``\\r`` alone is one line here and needs Spark's own reader. Empty
lines between records are skipped.

The splits of the second pass must be those of the first. Spark plans them from the files' sizes, the session's settings and, for
inputs below the split size times the cores, the number of cores; if they changed in between, the job
fails and says so, and the file is to be read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.session import cut_lineage

# Ends of splits are kept in the first pass up to this size.
FRAGMENT = 1 << 20
# Records go back to Spark in batches of about this size.
BATCH = 8 << 20

_BORDERS = (
    "file string, start bigint, after_outside boolean, after_inside boolean, closes boolean, "
    "ends boolean, crlf boolean, lead binary, tail_outside binary, tail_inside binary"
)
_STATES = "file string, start bigint, inside boolean, origin bigint, open boolean, crlf boolean"
_RECORDS = "file string, origin bigint, start bigint, first boolean, crlf boolean, record binary"
# what stands before a closing quote; no other quote follows one that closes
_TO_CLOSING = re.compile(rb'(?:[^"]++|"")*+"')


class Quoting:
    """Follows the quoted fields of one delimiter through lines."""

    def __init__(self, sep: str):
        self.sep = sep.encode()

    def inside_after(self, line: bytes, inside: bool) -> bool:
        """Whether the break behind a line lies inside a quoted field, if its beginning does so or not."""
        if b'"' not in line:
            return inside
        at = 0
        if inside:
            closing = _TO_CLOSING.match(line)
            if not closing:
                return True
            at = line.find(self.sep, closing.end())
            if at < 0:
                return False
            at += len(self.sep)
        while True:
            # at a field's beginning
            if not line.startswith(b'"', at):
                opening = line.find(self.sep + b'"', at)
                if opening < 0:
                    return False
                at = opening + len(self.sep)
            closing = _TO_CLOSING.match(line, at + 1)
            if not closing:
                return True
            at = line.find(self.sep, closing.end())
            if at < 0:
                return False
            at += len(self.sep)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all splits, in order within each."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def _split_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """Each split of a task with its lines, a byte order mark taken off."""
    rows = _run(batches)
    row = next(rows, None)
    while row is not None:
        file, start = row[:2]
        rest = [row]

        def lines(file=file, start=start, rest=rest):
            first = start == 0
            while rest[0] is not None and rest[0][:2] == (file, start):
                yield rest[0][2].removeprefix(b"\xef\xbb\xbf") if first else rest[0][2]
                first = False
                rest[0] = next(rows, None)

        own = lines()
        yield file, start, own
        for _ in own:  # whatever was not asked for
            pass
        row = rest[0]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def borders(lines: DataFrame, sep: str, longest: int) -> DataFrame:
    """One row per split: the state after it for both readings, whether it closes a field that was open at its
    beginning, whether a record that is not empty ends in it when it is read from outside, whether the file's first line ends with
    ``\\r\\n``, and the ends of records that cross its borders (null if longer than ``longest``); stored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quoting = Quoting(sep)
        for file, start, own in _split_lines(batches):
            outside, inside, closes, ends, crlf = False, True, False, False, None
            lead, tail_outside, tail_inside = _Part(longest), _Part(longest), _Part(longest)
            for line in own:
                was_outside, was_inside = outside, inside
                outside = quoting.inside_after(line, outside)
                inside = quoting.inside_after(line, inside)
                crlf = start == 0 and line.endswith(b"\r") if crlf is None else crlf
                ends = ends or not (outside or _empty(line))
                tail_outside.follow(line, was_outside, outside)
                if closes:
                    tail_inside.follow(line, was_inside, inside)
                else:
                    lead.add(line)
                    closes = not inside
            row = (file, start, outside, inside, closes, ends, crlf, lead.joined(), tail_outside.joined(), tail_inside.joined())
            kinds = (pa.string(), pa.int64(), *[pa.bool_()] * 5, *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)], [f.split()[0] for f in _BORDERS.split(", ")]
            )

    return cut_lineage(lines.mapInArrow(read, _BORDERS))


def _empty(line: bytes) -> bool:
    return line in (b"", b"\r")


class _Part:
    """Lines of a part of a record, up to a size."""

    def __init__(self, longest: int):
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.lines: list[bytes] | None = []
        self.size = 0

    def add(self, line: bytes) -> None:
        self.size += len(line) + 1
        if self.size > self.longest:
            self.lines = None
        if self.lines is not None:
            self.lines.append(line)

    def follow(self, line: bytes, was_open: bool, is_open: bool) -> None:
        """Keep the lines of the record that is open now."""
        if not was_open:
            self.clear()
        if is_open:
            self.add(line)
        else:
            self.clear()

    def joined(self) -> bytes | None:
        return None if self.lines is None else b"\n".join(self.lines)


def states(found: DataFrame) -> DataFrame:
    """Per split: does it begin inside a quoted field, in which split did that record begin, and is a record open
    behind it? Chains the splits of each file, whose rows here hold a few bytes each; stored."""

    def chain(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        inside, origin, out = False, None, []
        for r in rows:
            after = r["after_inside"] if inside else r["after_outside"]
            out.append((r["file"], r["start"], inside, origin, after, rows[0]["crlf"]))
            if after and not (inside and not r["closes"]):
                origin = r["start"]
            elif not after:
                origin = None
            inside = after
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_())
        names = [f.split()[0] for f in _STATES.split(", ")]
        return pa.table({n: pa.array(v, k) for n, v, k in zip(names, zip(*out), kinds)})

    narrow = found.select("file", "start", "after_outside", "after_inside", "closes", "crlf")
    return cut_lineage(narrow.groupBy("file").applyInArrow(chain, _STATES))


def _known(state: DataFrame) -> dict[str, tuple[np.ndarray, ...]]:
    """Starts, states, origins and line ends by file: 18 bytes for each split, so about 14 MB for 100 TB in splits of 128 MB."""
    rows = state.select("file", "start", "inside", F.coalesce("origin", F.lit(-1)).alias("origin"), "crlf").toArrow()
    table = rows.sort_by([("file", "ascending"), ("start", "ascending")])
    files = np.array(table["file"].to_pylist(), object)
    cuts = np.flatnonzero(files[1:] != files[:-1]) + 1 if len(files) else []
    columns = [table[name].to_numpy() for name in ("start", "inside", "origin", "crlf")]
    return {files[a]: tuple(c[a:b] for c in columns) for a, b in zip([0, *cuts], [*cuts, len(files)]) if b > a}


def _cut(lines: DataFrame, sep: str, known) -> DataFrame:
    """Records of all splits: whole ones without an origin, parts of those that cross a border with theirs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quoting = Quoting(sep)
        out, size = [], 0
        for file, start, own in _split_lines(batches):
            starts, insides, origins, crlfs = known.value.get(file, ((),) * 4)
            at = int(np.searchsorted(starts, start))
            if at == len(starts) or starts[at] != start:
                raise RuntimeError(f"{file}: its splits changed since it was opened; read it again")
            inside, crlf = bool(insides[at]), bool(crlfs[at])
            origin, first = (int(origins[at]) if inside else None), start == 0
            part: list[bytes] = []
            for line in own:
                part.append(line)
                inside = quoting.inside_after(line, inside)
                if not inside:
                    out.append((file, origin, start, first, crlf, b"\n".join(part)))
                    size += len(out[-1][-1])
                    # empty lines before the header are skipped like any others
                    origin, first, part = None, first and _empty(out[-1][-1]), []
                    if size > BATCH or len(out) > 10_000:
                        yield _batch(out)
                        out, size = [], 0
            if part:
                out.append((file, start if origin is None else origin, start, first, crlf, b"\n".join(part)))
        if out:
            yield _batch(out)

    return lines.mapInArrow(cut, _RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
    names = [f.split()[0] for f in _RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)


def _crossing(found: DataFrame, state: DataFrame) -> DataFrame:
    """The parts of records that cross borders, from the ends that the first pass kept: null where one was too long."""
    both = found.drop("crlf").join(state, ["file", "start"])
    lead = both.where("inside").select(
        "file", "origin", "start", F.lit(False).alias("first"), "crlf", F.col("lead").alias("record")
    )
    tail = F.when(F.col("inside"), F.col("tail_inside")).otherwise(F.col("tail_outside"))
    # a header that crosses a border is the one record of its split
    opened = both.where("open AND (closes OR NOT inside)").select(
        "file", F.col("start").alias("origin"), "start", F.expr("start = 0 AND NOT ends").alias("first"), "crlf", tail.alias("record")
    )
    return lead.unionByName(opened)


def read_records(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """``record``: the text of every record of the files, without their first ones if these are headers."""
    lines = _lines(spark, path)
    found = borders(lines, sep, FRAGMENT)
    state = states(found)
    cut = _cut(lines, sep, spark.sparkContext.broadcast(_known(state)))
    whole = cut.where("origin IS NULL").select("first", "crlf", "record")
    if not state.where("open").isEmpty():
        parts = _crossing(found, state)
        if not parts.where("record IS NULL").isEmpty():
            parts = cut.where("origin IS NOT NULL")
        whole = whole.unionByName(_joined(parts))
    records = whole.where("NOT first") if header else whole
    text = F.rtrim(F.col("record").cast("string"), F.lit("\r"))
    # where lines end so, breaks within fields are taken for such line ends too, and become plain ones
    text = F.when(F.col("crlf"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    return records.select(text.alias("record")).where("record <> ''")


def _joined(parts: DataFrame) -> DataFrame:
    """Records put together from their parts: each group is one record."""
    ordered = F.array_sort(F.collect_list(F.struct("start", F.col("record").cast("string").alias("text"))))
    text = F.array_join(F.transform(ordered, lambda p: p["text"]), "\n")
    return parts.groupBy("file", "origin").agg(F.max("first").alias("first"), F.first("crlf").alias("crlf"), text.cast("binary").alias("record")).select(
        "first", "crlf", "record"
    )


def parsed(records: DataFrame, layout: list[tuple[str, str]], sep: str) -> DataFrame:
    """Records as columns: names and types by position, by Spark's own parser."""
    schema = ", ".join(f"_{k} {kind}" for k, (_, kind) in enumerate(layout))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    fields = records.select(F.from_csv("record", schema, options).alias("r"))
    return fields.select(*(F.col(f"r._{k}").alias(name) for k, (name, _) in enumerate(layout)))
