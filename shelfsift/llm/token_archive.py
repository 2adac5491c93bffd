"""Token files: one compressed frame per document under a shared zstandard dictionary, with an offset index.

Documents are put in ascending id order by a range partitioning, encoded, and written as segments. A segment holds,
in this order: a fixed head (format name, dictionary hash, number of documents), the index (id, id-is-null flag, number
of ids and frame end of every document), and the frames. A frame is one document's ids as little-endian unsigned 32-bit
integers, compressed by itself, so one short document is read without touching its neighbours. Segments are rows of a
Parquet folder, so that Spark's commit protocol guards them against lost executors on any shared store; the row also
carries what a reader needs to skip it (first and last id) and the number of ids before it in its file.

Defined cases: a null text is empty, an empty document holds only the end id; a null id comes first; repeated ids and
repeated rows are kept, in the order of id and text; texts of any length are one frame each; an empty table gives an
empty folder that reads back empty; columns but doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfsift.llm.encoding import encoder, share_tokenizer
from shelfsift.llm.support import inputs, new_folder, small_side

# A segment is closed at this many ids or documents, whichever comes first; a longer document has one of its own.
SEGMENT_IDS = 1 << 20
SEGMENT_DOCUMENTS = 4096
# The dictionary is trained on this many documents (the smallest hashes), at most so many ids of each.
SAMPLE_DOCUMENTS = 400
SAMPLE_IDS = 2048
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3

FORMAT = b"SIDSEG01"
HEAD = struct.Struct("<8s32sI")
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("ids", "<u8"), ("end", "<u8")])
SEGMENTS = (
    "file bigint, segment bigint, first_id bigint, last_id bigint, has_null boolean, documents bigint, ids bigint, "
    "ids_before bigint, dictionary string, content binary"
)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A zstandard dictionary from a bounded sample of encoded documents; empty if the sample is too small for one."""
    sample = inputs(docs, id="doc_id", text="text").where("text is not null")
    # first the largest hash that belongs to the sample, from ids alone; then only the sample's texts travel
    sample = sample.select(F.xxhash64("id").alias("h"), F.substring("text", 1, 4 * SAMPLE_IDS).alias("text"))
    last = sample.select("h").orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    rows = sample.where(F.col("h") <= last).orderBy("h", "text").limit(SAMPLE_DOCUMENTS).collect()
    shared = share_tokenizer(docs.sparkSession, tokenizer)
    encode = encoder(shared.value).encode
    frames = [encode(r["text"])[: 4 * SAMPLE_IDS] for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [f for f in frames if f]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


class _Segment:
    """Collects documents until the segment is full."""

    def __init__(self, name: bytes, compress):
        self.name, self.compress = name, compress
        self.index, self.frames, self.ids, self.end = [], [], 0, 0

    def add(self, doc: int | None, ids: bytes) -> None:
        frame = self.compress(ids)
        self.end += len(frame)
        self.ids += len(ids) // 4
        self.index.append((doc or 0, doc is None, len(ids) // 4, self.end))
        self.frames.append(frame)

    def full(self) -> bool:
        return self.ids >= SEGMENT_IDS or len(self.index) >= SEGMENT_DOCUMENTS

    def row(self, file: int, number: int, before: int) -> dict:
        known = [entry[0] for entry in self.index if not entry[1]]
        content = HEAD.pack(FORMAT, self.name, len(self.index)) + np.array(self.index, INDEX).tobytes()
        return {
            "file": file, "segment": number, "first_id": min(known, default=None), "last_id": max(known, default=None),
            "has_null": any(entry[1] for entry in self.index), "documents": len(self.index), "ids": self.ids,
            "ids_before": before, "dictionary": self.name.hex(), "content": content + b"".join(self.frames),
        }


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> str:
    """Write ``docs`` (doc_id, text) as token files in ascending id order; returns the folder."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    name = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(name.hex(), dictionary)], "dictionary string, content binary").write.parquet(
        f"{folder}/dictionary"
    )
    shared = share_tokenizer(spark, tokenizer)
    ending = struct.pack("<I", end_id)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        compress = zstandard.ZstdCompressor(level=LEVEL, **_codec(dictionary)).compress
        file, number, before, segment = TaskContext.get().partitionId(), 0, 0, _Segment(name, compress)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment.add(doc, encode(text.as_py() or "") + ending)
                if segment.full():
                    yield pa.RecordBatch.from_pylist([segment.row(file, number, before)], schema)
                    number, before, segment = number + 1, before + segment.ids, _Segment(name, compress)
        if segment.index:
            yield pa.RecordBatch.from_pylist([segment.row(file, number, before)], schema)

    schema = _arrow_schema()
    # the hash deals out rows that repeat an id; equal rows may lie in any order
    rows = inputs(docs, id="doc_id", text="text").withColumn("id", F.col("id").cast("bigint"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(segments, SEGMENTS).write.parquet(f"{folder}/segments")
    return folder


def _arrow_schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in SEGMENTS.split(", "))])


def read_index(content: bytes) -> tuple[bytes, np.ndarray, int]:
    """A segment's dictionary hash, its index and where its frames begin."""
    kind, name, documents = HEAD.unpack_from(content)
    if kind != FORMAT:
        raise ValueError("not a token segment")
    return name, np.frombuffer(content, INDEX, documents, HEAD.size), HEAD.size + documents * INDEX.itemsize


def read_ids(content: bytes, position: int, dictionary: bytes) -> np.ndarray:
    """One document's ids, by its position in the segment: only its own frame is decompressed."""
    name, index, frames = read_index(content)
    if hashlib.sha256(dictionary).digest() != name:
        raise ValueError("the segment was written with another dictionary")
    begin = int(index["end"][position - 1]) if position else 0
    frame = content[frames + begin : frames + int(index["end"][position])]
    return np.frombuffer(zstandard.ZstdDecompressor(**_codec(dictionary)).decompress(frame), "<u4")


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first()["content"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u4)."""
    dictionary = _dictionary(spark, folder)
    segments = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")
    # one row per file, in file order, which is id order
    files = segments.groupBy("file").agg(F.sum("ids").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = segments.join(small_side(bases), "file").select(
        (F.col("base") + F.col("ids_before")).alias("begin"), "content"
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor(**_codec(dictionary)).decompress
        for batch in batches:
            for begin, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_py()
                name, index, frames = read_index(content)
                if hashlib.sha256(dictionary).digest() != name:
                    raise ValueError("the segment was written with another dictionary")
                ends = index["end"].astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                counts = index["ids"].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(index["id"], mask=index["null"].astype(bool)),
                        pa.array(begin + np.cumsum(counts) - counts),
                        pa.array(counts),
                        pa.array([decompress(content[frames + a : frames + b]) for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this id, from the segments whose id range holds it."""
    dictionary = _dictionary(spark, folder)
    near = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").where(
        (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    )

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                content = content.as_py()
                _, index, _ = read_index(content)
                hits = np.flatnonzero((index["id"] == doc_id) & (index["null"] == 0))
                found = [read_ids(content, int(i), dictionary).tobytes() for i in hits]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["ids"])

    found = near.select("content").mapInArrow(frames, "ids binary").collect()
    return [np.frombuffer(row["ids"], "<u4") for row in found]

