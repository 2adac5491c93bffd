"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut where a rolling hash of the last 8 bytes has its top bits zero, so equal passages are cut alike wherever
they stand. A chunk that occurs in several blocks of documents is encoded once, in the block that owns it, and its ids
go to every block that has it; other chunks are encoded where they are. Chunks are encoded by themselves, so a join may
be wrong: the words around it are encoded again, in a window that grows until its ids agree with those of both sides
on a whole word at either end (or the window is all there is); then the sides are spliced there. In the word-end BPE
layout a run of ASCII blanks always ends a piece, which makes the spliced ids those of the whole text. Files of another
layout have no such sure place; their texts are encoded whole.

Documents travel as blocks of about BLOCK_BYTES of text, compressed, which are shuffled once; a passage that a third of
all rows share is asked for once per block, not once per row. Chunks are told apart by 128-bit hashes.

Defined cases: null and empty texts have no ids; texts of any length are encoded whole, in time that grows with their length; a
run without blanks that is longer than LONGEST_WORD is not cut; a chunk that several blocks hold belongs to the
smallest of them; repeated ids and rows are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.encoding import Encoder, encoder, lean, share_tokenizer
from shelfsift.llm.support import inputs, stored

BLOCK_BYTES = 128 * 1024
CUT_BITS = 10  # a cut every 2**CUT_BITS bytes on average, but no chunk shorter than LEAST_CHUNK
LEAST_CHUNK = 256
LONGEST_WORD = 2048
# Chunks with more than one in so many rows of (block, chunk) are copied rather than shuffled.
HOT = 1000
COPIED = 64 * 1024
# Pieces remembered per worker: less than elsewhere, as an executor runs encoders and decoders side by side.
MEMORY = 250_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def cut_points(text: bytes) -> list[int]:
    """Ends of the chunks of a text, as byte offsets between characters."""
    if len(text) <= max(LEAST_CHUNK, 8):
        return [len(text)] if text else []
    data = np.frombuffer(text, np.uint8)
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    ends = np.flatnonzero((windows * _MULTIPLIER) >> np.uint64(64 - CUT_BITS) == 0) + 8
    ends = ends[ends < len(data)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    blanks = np.concatenate([[-1], np.flatnonzero(_BLANK[data]), [len(data)]])
    behind = np.searchsorted(blanks, ends)
    ends = ends[(blanks[behind] - blanks[behind - 1]) <= LONGEST_WORD]
    kept, last = [], 0
    for end in ends.tolist():
        if end - last >= LEAST_CHUNK:
            kept.append(end)
            last = end
    return [*kept, len(text)]


def chunk_hash(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _splice(encode: Callable[[bytes], bytes], text: bytes, join: int, end: int, left: bytearray, right: bytes) -> None:
    """Make the ids of ``text[:end]`` of ``left``, those of ``text[:join]``, and of those of ``text[join:end]``. Only the end of
    ``left`` that lies in the window is touched, so the work does not grow with what stands before."""
    words = 2
    reach = 64
    while True:
        # the window: some words on either side of the join, as far as they lie within reach
        low, high = max(0, join - reach), min(end, join + reach)
        before = [m.start() for m in _WORD.finditer(text, low, join) if m.start() > low or low == 0]
        after = [m.end() for m in _WORD.finditer(text, join, high) if m.end() < high or high == end]
        first = before[-words] if len(before) >= words else low if low == 0 else None
        last = after[words - 1] if len(after) >= words else high if high == end else None
        if first is not None and last is not None:
            whole = encode(text[first:last])
            a, b = encode(text[first:join]), encode(text[join:last])
            # one word at either end must come out alike with and without what lies behind the join
            sure_a = encode(text[first : before[-words + 1]]) if first and words > 1 else b""
            sure_b = encode(text[after[words - 2] : last]) if last < end and words > 1 else b""
            agrees = left.endswith(a) and right.startswith(b)
            agrees = agrees and whole.startswith(sure_a) and a.startswith(sure_a)
            if agrees and whole.endswith(sure_b) and b.endswith(sure_b):
                del left[len(left) - len(a) :]
                left += whole
                left += right[len(b) :]
                return
            if first == 0 and last == end:
                left[:] = whole
                return
            words *= 2
        reach *= 4


def encode_by_chunks(encode: Callable[[bytes], bytes], text: bytes, known: dict[bytes, bytes]) -> bytes:
    """A text's ids; chunks in ``known`` (by hash) are taken from there, new ones are encoded and added."""
    done, ids = 0, bytearray()
    for end in cut_points(text):
        chunk = text[done:end]
        name = chunk_hash(chunk)
        if name not in known:
            known[name] = encode(chunk)
        own = known[name]
        if done == 0 or _BLANK[text[done - 1]] or _BLANK[text[done]]:
            ids += own  # the chunks part between words
        else:
            _splice(encode, text, done, end, ids, own)
        done = end
    return bytes(ids)


def _pack(rows: list[tuple[int | None, bytes]]) -> bytes:
    """A block of documents in one compressed string."""
    index = np.array([(doc or 0, doc is None, len(text)) for doc, text in rows], _INDEX)
    return zstandard.ZstdCompressor(level=3).compress(
        len(rows).to_bytes(4, "little") + index.tobytes() + b"".join(text for _, text in rows)
    )


_INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("size", "<u8")])


def _unpack(content: bytes) -> list[tuple[int | None, bytes]]:
    data = zstandard.ZstdDecompressor().decompress(content)
    index = np.frombuffer(data, _INDEX, int.from_bytes(data[:4], "little"), 4)
    rows, at = [], 4 + index.nbytes
    for doc, null, size in index.tolist():
        rows.append((None if null else doc, data[at : at + size]))
        at += size
    return rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int | None, bytes]]]]:
    """A task's documents in numbered blocks."""
    number, rows, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = (text.as_py() or "").encode()
            rows.append((doc, text))
            size += len(text) + 16
            if size >= BLOCK_BYTES:
                yield number, rows
                number, rows, size = number + 1, [], 0
    if rows:
        yield number, rows


@lean
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, rows in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_pack(rows)], pa.binary())], ["block", "content"])


@lean
def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, rows in _blocks(batches):
        names: set[bytes] = set()
        for _, text in rows:
            done = 0
            for end in cut_points(text):
                names.add(chunk_hash(text[done:end]))
                done = end
        yield pa.RecordBatch.from_arrays(
            [pa.array([number] * len(names), pa.int64()), pa.array(sorted(names), pa.binary())], ["block", "hash"]
        )


def _bytes_encoder(given: Encoder) -> Callable[[bytes], bytes]:
    return lambda text: given.encode(text.decode())


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text)."""
    shared = share_tokenizer(docs.sparkSession, tokenizer)
    rows = inputs(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    chunks = stored(rows.mapInArrow(_hashes, "block bigint, hash binary"), "chunk-hashes")
    owners = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.min("block").alias("owner")).where("n > 1")
    owners = stored(owners, "shared-chunks")

    # both joins below read one shuffle of the blocks; the filter that an inner join would put in stands in both
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.mapInArrow(_packed, "block bigint, content binary").where("block IS NOT NULL")
    blocks = blocks.repartition(partitions, "block")

    @lean
    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bytes = _bytes_encoder(encoder(shared.value, MEMORY))
        for batch in batches:
            for content, names in zip(batch.column(1), batch.column(2).to_pylist()):
                wanted, found = set(names), {}
                for _, text in _unpack(content.as_py()):
                    done = 0
                    for end in cut_points(text):
                        name = chunk_hash(text[done:end])
                        if name in wanted and name not in found:
                            found[name] = of_bytes(text[done:end])
                        done = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["hash", "ids"]
                )

    lists = owners.groupBy(F.col("owner").alias("block")).agg(F.collect_list("hash").alias("names"))
    dictionary = blocks.join(lists.hint("merge"), "block").select("block", "content", "names").mapInArrow(
        owned, "hash binary, ids binary"
    )
    # a chunk with more than one in HOT of all rows is joined by a copy: at most HOT chunks of at most COPIED bytes
    dictionary = stored(dictionary, "chunk-ids")
    hot = owners.where(F.col("n") > chunks.count() / HOT).select("hash")
    copied = stored(dictionary.join(F.broadcast(hot), "hash").where(F.octet_length("ids") <= COPIED), "hot-chunks")
    others = [side.join(F.broadcast(copied.select("hash")), "hash", "left_anti") for side in (chunks, dictionary)]
    asked = chunks.join(F.broadcast(copied), "hash").unionByName(others[0].join(others[1], "hash"))
    given = asked.groupBy("block").agg(F.collect_list(F.struct("hash", "ids")).alias("given"))
    met = blocks.join(given.hint("merge"), "block", "left").select("block", "content", "given")

    @lean
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, MEMORY)
        of_bytes = _bytes_encoder(own)
        for batch in batches:
            for content, entries in zip(batch.column(1), batch.column(2)):
                known = {e["hash"]: e["ids"] for e in entries.as_py() or ()}
                docs, ids = [], []
                for doc, text in _unpack(content.as_py()):
                    docs.append(doc)
                    ids.append(encode_by_chunks(of_bytes, text, known) if own.fast else of_bytes(text))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return met.mapInArrow(encoded, "doc_id bigint, ids binary")


class Decoder:
    """As the library's ``decode(ids, skip_special_tokens=False)``."""

    def __init__(self, text: str):
        layout = json.loads(text)
        self.library, self.names = None, None
        if layout.get("decoder") is None:
            # without a decoder, the library joins the tokens' names by blanks
            vocabulary = dict(layout["model"]["vocab"]) | {t["content"]: t["id"] for t in layout.get("added_tokens", [])}
            self.names = [""] * (max(vocabulary.values()) + 1)
            for name, number in vocabulary.items():
                self.names[number] = name
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(text)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.library is not None:
            return self.library.decode(numbers, skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, numbers))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the text that the ids stand for."""
    shared = share_tokenizer(encoded.sparkSession, tokenizer)

    @lean
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_ids = Decoder(shared.value).decode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([of_ids(ids.as_py()) for ids in part.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id bigint, ids binary, decoded string")
