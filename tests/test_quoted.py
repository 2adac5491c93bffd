"""Quoted files in many splits: the same rows as Spark's own multi-line reader, wherever the splits fall."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfsift.sources import quoted
from shelfsift.sources.listings import INDEXED_LISTING, LABELLED_TEXT, read_indexed_listings, read_listings
from shelfsift.sources.quoted import Quoting


def quote(text):
    return '"' + text.replace('"', '""') + '"'


def split_size(spark, size):
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{name}", str(size))


@pytest.fixture
def small_splits(spark):
    """Set the split size; the session's own comes back afterwards."""
    yield lambda size: split_size(spark, size)
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def description(chance):
    words = ["a", "bc", '"', '""', ",", "\n", "\r\n", "\n\n", 'say "hi", now', "é日本", " ", "'", "\t", '",', ',"', "x" * 40]
    return "".join(chance.choice(words) for _ in range(chance.randint(0, 12)))


def messy_csv(chance, count, end="\n"):
    out = ["product_id,description,label,price"]
    for i in range(count):
        text = description(chance)
        # a bare field holds no delimiter or break and does not begin with a quote, but may hold quotes
        bare = "".join(c for c in text if c not in ',\n\r').lstrip('"')
        out.append(f"{i},{quote(text) if chance.random() < 0.7 else bare},{i % 2},{chance.choice(['9', quote('9'), ''])}")
        if chance.random() < 0.1:
            out.append("")
    return end.join(out) + chance.choice(["", end])


@pytest.mark.parametrize("size", [7, 64, 300, 5000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_like_the_multi_line_reader(spark, tmp_path, small_splits, size, end):
    chance = random.Random(size)
    for n in range(2):
        (tmp_path / f"{n}.csv").write_bytes(messy_csv(chance, 25 if size < 64 else 120, end).encode())
    whole = rows(read_listings(spark, str(tmp_path), splittable=False))
    small_splits(size)
    frame = read_listings(spark, str(tmp_path))
    assert rows(frame) == whole and len(whole) > 40


@pytest.mark.parametrize("fragment", [1, 20])
def test_long_ends_come_from_another_pass(spark, tmp_path, small_splits, monkeypatch, fragment):
    monkeypatch.setattr(quoted, "FRAGMENT", fragment)
    (tmp_path / "a.csv").write_text(messy_csv(random.Random(4), 80), encoding="utf-8", newline="")
    whole = rows(read_listings(spark, str(tmp_path), splittable=False))
    small_splits(50)
    assert rows(read_listings(spark, str(tmp_path))) == whole


def test_many_tasks_read_one_file(spark, tmp_path, small_splits):
    text = "description,label\n" + "".join(f"{quote(f'line one of {i}' + chr(10) + 'x' * 500)},{i % 2}\n" for i in range(2000))
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    small_splits(100_000)
    frame = read_listings(spark, str(tmp_path / "a.csv"), schema=LABELLED_TEXT)
    per_task = [n for n in frame.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect() if n]
    assert sum(per_task) == 2000 and len(per_task) > 8 and max(per_task) < 400


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'row {i} of "one", field' for i in range(3000))
    text = f'"a header\nof two lines",description,label\nx,{quote(long)},1\ny,{quote("short" + chr(10))},0\n'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    small_splits(13 * 1000)
    frame = read_listings(spark, str(tmp_path / "a.csv"), schema=LABELLED_TEXT)
    assert sorted(map(tuple, frame.collect())) == [(long, 1), ("short\n", 0)]


@pytest.mark.parametrize("size", [5, 30, 10_000])
def test_header_over_splits_mark_and_index(spark, tmp_path, small_splits, size):
    text = '﻿\n\n"product\nid, of\nthe shop",description,label,\n' + "".join(
        f"{i},{100 + i},{quote(f'a{chr(10)}{i}')},{i % 2}\n" for i in range(9)
    )
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    small_splits(size)
    assert sorted(map(tuple, read_indexed_listings(spark, str(tmp_path)).collect())) == [(100 + i, f"a\n{i}", i % 2) for i in range(9)]
    assert INDEXED_LISTING.fieldNames()[0] == "ix"


@pytest.mark.parametrize("text", ["", "product_id,description,label", "product_id,description,label\n\n\n"])
def test_no_records(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text("product_id,description,label\n1,a,0\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(text, encoding="utf-8")
    assert rows(read_listings(spark, str(tmp_path))) == ["(1, 'a', 0)"]


def test_an_open_quote_at_the_end(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('product_id,description,label\n1,a,0\n2,"open\nfor\never', encoding="utf-8")
    small_splits(9)
    assert rows(read_listings(spark, str(tmp_path))) == ["(1, 'a', 0)", "(2, 'open\\nfor\\never', None)"]


def test_changed_splits_are_noticed(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text(messy_csv(random.Random(1), 200), encoding="utf-8", newline="")
    small_splits(400)
    frame = read_listings(spark, str(tmp_path))
    small_splits(333)
    with pytest.raises(Exception, match="splits changed"):
        frame.collect()


def by_hand(line, inside, sep):
    """The same state, a character at a time."""
    state = "quoted" if inside else "begin"
    for c in line:
        if state == "begin":
            state = "quoted" if c == '"' else "begin" if c == sep else "bare"
        elif state == "bare":
            state = "begin" if c == sep else "bare"
        elif state == "quoted":
            state = "quote" if c == '"' else "quoted"
        elif state == "quote":  # a second quote is a doubled one, anything else follows the closed field
            state = "quoted" if c == '"' else "begin" if c == sep else "bare"
    return state == "quoted"


@settings(max_examples=500)
@given(st.text(alphabet='",ab', max_size=14), st.booleans())
def test_states(line, inside):
    assert Quoting(",").inside_after(line.encode(), inside) == by_hand(line, inside, ",")


def test_a_megabyte_of_quotes():
    assert Quoting(",").inside_after(b'"' + b'""' * 1_000_000, False)
    assert not Quoting(",").inside_after(b'""' * 1_000_000, False)
