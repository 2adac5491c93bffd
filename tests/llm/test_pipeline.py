import pytest
from test_llm_common import SMALL
from test_packing import check_pieces
from test_quality_rules import plain as plain_quality
from test_sanitize import plain_base
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline as P
from shelfsift.llm.support import stored


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(stored(stage(spark, out[-1], SMALL), name))
    return out


def as_rows(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_columns(stages):
    assert all(stage.columns == stages[0].columns for stage in stages[:-1])


def test_quality_and_near_duplicates(stages):
    docs, good, unique = (as_rows(s) for s in stages[:3])
    assert good == {i: r for i, r in docs.items() if not plain_quality(r["text"])[1]}
    parts = plain_components([(i, plain_fingerprint(r["text"])) for i, r in good.items()], 2)
    assert unique == {i: r for i, r in good.items() if i in {c for *_, c in parts}}


def test_personal_data(stages):
    unique, private = as_rows(stages[2]), as_rows(stages[3])
    assert set(unique) == set(private)
    for i, row in private.items():
        text, base = unique[i]["text"], plain_base(unique[i]["text"])
        assert row["n_chars"] == len(row["text"]) and row["lang"] == unique[i]["lang"]
        if not any(base.values()):
            assert row["text"] == text
        for spans in base.values():
            assert all(text[a:b] not in row["text"] for a, b in spans)


def test_packing(stages, library):
    docs = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    check_pieces(stages[4].collect(), docs, library, 2)


def test_run_and_awkward_rows(spark, stages, awkward, no_documents):
    rows = P.run(spark, SMALL)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, stages[-1].collect()))
    for docs in (awkward, no_documents):
        columns = docs.columns
        for name, stage in P.STAGES:
            docs = stored(stage(spark, docs, SMALL), name)
            assert docs.columns == columns or name == "packing"


def test_clean_book_stays(spark):
    book = "\n".join(f"Sentence word{i}a speaks word{i}b and word{i}c here word{i}d" for i in range(13_000))
    docs = spark.createDataFrame([(1, book), (2, "too short")], "doc_id bigint, text string")
    assert len(book.split()) > 100_000 and [r["doc_id"] for r in P.quality(spark, docs, SMALL).collect()] == [1]
