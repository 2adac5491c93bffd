import pytest
from pyspark.sql import functions as F

from shelfsift.sources.listings import (
    labelled_examples,
    listings,
    read_indexed_listings,
    read_labelled_text,
    read_listings,
    union_listings,
)
from shelfsift.sources.sinks import write_table

ROWS = [(1, 'say "hi", now\nline two', 0), (2, "tab\tand, comma", 1), (3, "", 0)]


def quote(text):
    return '"' + text.replace('"', '""') + '"'


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("label,extra,description\n" + "".join(f"{l},x,{quote(t)}\n" for _, t, l in ROWS[:2]), encoding="utf-8")
    rows = read_labelled_text(spark, str(path)).collect()
    assert sorted((r["description"], r["label"]) for r in rows) == sorted((t, l) for _, t, l in ROWS[:2])


def test_tsv_projection(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text(
        "product_id\tdescription\tlabel\tprice\n" + "".join(f"{i}\t{quote(t)}\t{l}\t9\n" for i, t, l in ROWS[:2]),
        encoding="utf-8",
    )
    frame = read_listings(spark, str(path), sep="\t")
    assert frame.columns == ["product_id", "description", "label"]
    assert sorted(tuple(r) for r in frame.collect()) == sorted(ROWS[:2])
    assert read_listings(spark, str(path), sep="\t", columns=["label"]).columns == ["label"]


def test_missing_column_is_named(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("description\nx\n", encoding="utf-8")
    with pytest.raises(ValueError, match="product_id"):
        read_listings(spark, str(path))


def test_shifted_header_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    body = "﻿product_id,description,label,\n" + "".join(f"{n},{i},{quote(t)},{l}\n" for n, (i, t, l) in enumerate(ROWS[:2]))
    path.write_text(body, encoding="utf-8")
    rows = read_indexed_listings(spark, str(path)).collect()
    assert sorted(tuple(r) for r in rows) == sorted(ROWS[:2])


def test_inline_examples_and_union(spark):
    train = labelled_examples(spark, [("a", 1), ("b", 0)])
    both = union_listings(train, train)
    assert sorted(tuple(r) for r in both.collect()) == [
        (1, "a", 1, "test"), (1, "a", 1, "train"), (2, "b", 0, "test"), (2, "b", 0, "train"),
    ]


@pytest.mark.parametrize("file_format", ["parquet", "json", "csv", "orc"])
def test_result_sink(spark, tmp_path, file_format):
    frame = labelled_examples(spark, [("a", 1)])
    path = str(tmp_path / file_format)
    write_table(frame, path, file_format)
    reader = spark.read.format(file_format)
    back = (reader.option("header", True) if file_format == "csv" else reader).load(path)
    assert [str(back.select(c).first()[0]) for c in ("product_id", "description", "label")] == ["1", "a", "1"]
    with pytest.raises(ValueError):
        write_table(frame, path, "xml")


def test_listings_plan_no_label_join_unless_asked(spark, folder):
    plain = listings(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plain
    assert listings(spark, folder, labelled=True).count() == listings(spark, folder).count() == 200


def test_scan_reads_only_what_is_used(spark, folder):
    plan = listings(spark, folder).select("product_id", F.length("description"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_delimited_sink_and_reader_agree(spark, tmp_path):
    """Line breaks, quotes and blanks at both ends come back as they were written; empty texts as missing ones."""
    rows = [(1, ' two\nlines, "quoted" ', 0), (2, "", 1), (3, None, None), (4, '"', 1), (5, "\ttab\r\nend  ", 0), (None, ",", 0)]
    frame = spark.createDataFrame(rows, "product_id bigint, description string, label int")
    write_table(frame.repartition(3), str(tmp_path / "out"), "csv")
    back = read_listings(spark, str(tmp_path / "out"))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((i, t or None, n)) for i, t, n in rows)
