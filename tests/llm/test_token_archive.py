import zlib

import numpy as np
from test_llm_common import SMALL, by_library

from shelfsift.llm import token_archive as T
from shelfsift.llm.queries import op10_token_files


def check(rows, expected):
    rows = sorted(rows, key=lambda r: r["start"])
    begin = 0
    for row in rows:
        assert row["start"] == begin
        begin += row["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == expected


def test_whole_table_like_the_library(spark, library):
    rows = op10_token_files(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    check(rows, expected_of([(d["doc_id"], d["text"]) for d in docs], library))


def expected_of(pairs, library):
    out = []
    for doc, text in pairs:
        ids = np.array([*by_library(library, text), 1], "<u4")
        out.append((str(doc), len(ids), zlib.crc32(ids.tobytes())))
    return sorted(out)


def test_awkward_rows_and_single_documents(spark, awkward, tokenizer, library, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT_DOCUMENTS", 2)
    folder = T.write_token_files(awkward, tokenizer, 1)
    read = T.read_token_files(spark, folder)
    from pyspark.sql import functions as F

    rows = read.withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, expected_of([(r["doc_id"], r["text"]) for r in awkward.collect()], library))
    assert len(T.read_document(spark, folder, 9)) == 3 and T.read_document(spark, folder, 77) == []
    assert T.read_document(spark, folder, 1)[0].tolist() == [*library.encode("Plain text, twice.\nPlain text, twice.").ids, 1]


def test_empty_table(spark, no_documents, tokenizer):
    assert T.read_token_files(spark, T.write_token_files(no_documents, tokenizer, 1)).collect() == []
