import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_llm_common import SMALL, by_library, odd_texts

from shelfsift.llm import chunk_reuse as C
from shelfsift.llm.encoding import Encoder
from shelfsift.llm.queries import op5_chunk_reuse


def expected(pairs, library):
    out = Counter()
    for doc, text in pairs:
        ids = by_library(library, text)
        back = library.decode(ids, skip_special_tokens=False)
        out[doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest()] += 1
    return out


def test_whole_table_like_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = op5_chunk_reuse(spark, SMALL).collect()
    assert Counter(map(tuple, rows)) == expected([(d["doc_id"], d["text"]) for d in docs], library)


@pytest.mark.parametrize("bits,least", [(1, 1), (2, 2), (3, 5)])
def test_joins_anywhere_agree_with_the_library(tokenizer, library, monkeypatch, bits, least):
    """Cuts every few bytes, inside words, added tokens and composed letters."""
    monkeypatch.setattr(C, "CUT_BITS", bits)
    monkeypatch.setattr(C, "LEAST_CHUNK", least)
    with open(tokenizer) as file:
        text = file.read()
    own, decoder = Encoder(text), C.Decoder(text)
    chance = random.Random(bits)
    for sample in odd_texts(400, seed=bits, most=40) + [
        " ".join(chance.choice(["wo", "words", "l'été", "x<|endoftext|>y", "12", "e" + chr(0x301) * 3, "..!?"]) for _ in range(60))
        for _ in range(40)
    ]:
        ids = by_library(library, sample)
        known = {}
        got = C.encode_by_chunks(C._bytes_encoder(own), sample.encode(), known)
        assert np.frombuffer(got, "<u4").tolist() == ids, sample
        assert decoder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_equal_passages_are_cut_alike():
    chance = random.Random(4)
    words = lambda n: " ".join("".join(chance.choice("aeionrst") for _ in range(chance.randint(2, 9))) for _ in range(n))
    passage = words(9000)
    cuts = []
    for text in (words(300) + " " + passage, words(77) + " " + passage + words(50)):
        data, done, names = text.encode(), 0, set()
        ends = C.cut_points(data)
        assert ends[-1] == len(data) and ends == sorted(set(ends))
        for end in ends:
            names.add(C.chunk_hash(data[done:end]))
            done = end
        cuts.append(names)
    assert len(cuts[0] & cuts[1]) >= 20


def test_awkward_rows(spark, awkward, no_documents, tokenizer, library, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BYTES", 2000)
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    passage = " ".join(f"shared{i} passage" for i in range(900))
    docs += [(100 + i, f"doc {i} {passage} end{i}") for i in range(6)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    encoded = C.encode(frame, tokenizer)
    rows = C.decode(encoded, tokenizer).collect()
    got = Counter(
        (r["doc_id"], len(r["ids"]) // 4, hashlib.sha256(r["ids"]).hexdigest(),
         hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in rows
    )
    assert got == expected(docs, library)
    assert C.encode(no_documents, tokenizer).collect() == []


def test_work_grows_with_the_length(tokenizer):
    """Joins touch the ids around them only: of a text of megabytes, little more than its bytes are encoded."""
    with open(tokenizer) as file:
        own = Encoder(file.read())
    chance = random.Random(12)
    text = " ".join(chance.choice(["river", "mountain's", "12", "l'été", "x!"]) + str(chance.randrange(999)) for _ in range(300_000)).encode()
    asked = []

    def counting(part):
        asked.append(len(part))
        return own.encode(part.decode())

    ids = C.encode_by_chunks(counting, text, {})
    assert ids == own.encode(text.decode()) and len(text) > 2_000_000
    assert sum(asked) < 2 * len(text)
    begun = time.perf_counter()
    C.encode_by_chunks(lambda part: own.encode(part.decode()), text, {})
    middle = time.perf_counter()
    C.encode_by_chunks(lambda part: own.encode(part.decode()), text * 4, {})
    assert time.perf_counter() - middle < 12 * (middle - begun)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_a_chunk_in_every_block(spark, tokenizer, library, monkeypatch, hot):
    """A passage that all rows share, joined by a copy and by the shuffle; repeated, null and odd rows besides."""
    monkeypatch.setattr(C, "HOT", hot)
    monkeypatch.setattr(C, "BLOCK_BYTES", 3000)
    chance = random.Random(hot)
    passage = " ".join("".join(chance.choice("aeionrst") for _ in range(7)) for _ in range(400))
    rows = [(i % 70, f"{chance.random()} {passage} {chance.random()}") for i in range(120)] + [(None, None), (5, ""), (5, " ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string").repartition(6)
    encoded = C.encode(docs, tokenizer)
    assert encoded.columns == ["doc_id", "ids"]
    mine = Counter((r["doc_id"], bytes(r["ids"])) for r in encoded.collect())
    assert mine == Counter((i, np.array(by_library(library, t), "<u4").tobytes()) for i, t in rows)


def test_waiting_workers_remember_nothing(spark, tokenizer):
    """Workers that encoded and wait for their next task hold no pieces: they would stand beside those that encode."""
    docs = spark.createDataFrame([(i, f"word{i} of these {'texts ' * i}") for i in range(40)], "doc_id bigint, text string")
    assert C.decode(C.encode(docs, tokenizer), tokenizer).count() == 40

    def remembered(batches):
        from shelfsift.llm import encoding

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(e._pieces) + len(e._pieces.older) for e in encoding._encoders.values())]})

    assert {r["n"] for r in spark.range(8).mapInArrow(remembered, "n bigint").collect()} == {0}


def test_forgetting_changes_no_ids(tokenizer):
    with open(tokenizer) as file:
        own = Encoder(file.read())
    before = own.encode("some words, and l'été <|endoftext|>")
    own.forget()
    assert not own._pieces and own.encode("some words, and l'été <|endoftext|>") == before
