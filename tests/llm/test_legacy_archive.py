import hashlib

import pytest

from shelfsift.llm import legacy_archive as A

LONG = "<p>" + "é" * 80 + "</p>"
PAGES = [
    (5, "http://a.example/x", LONG), (3, "http://b.example/ y\n", LONG), (9, None, LONG), (9, None, LONG),
    (1, "http://c.example/", "short"), (2, "http://c.example/", "short"), (4, "", None), (6, "dns:x", ""),
    (None, "http://d.example/", LONG), (7, "http://e.example", "WARC/1.1\r\n\r\nfiledesc://x\n\r\n\r\n" * 20000),
    (8, "http://e.example", "X-Page-Id: 77\r\nContent-Length: 1\r\n\r\n" + "z" * 200),
]


@pytest.mark.parametrize("size", [1, 700, 1 << 20])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(A, "ARCHIVE_BYTES", size)
    frame = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id int, url string, html string, record_type string")
    folder = A.convert(spark, A.write_arc(frame.repartition(3)))
    read = A.stored(A.read_warc(spark, folder), "read")
    rows = A.resolve(read).collect()
    data = [(p, (h or "").encode()) for p, _, h in PAGES]
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in rows) == sorted(
        (str(p), len(h), hashlib.sha256(h).hexdigest()) for p, h in data
    )
    of = {str(r["page_id"]): (r["record_type"], r["refers_to"]) for r in rows}
    assert of["3"] == ("response", None) and of["5"] == of["9"] == of["None"] == ("revisit", 3)
    assert [r["record_type"] for r in rows].count("revisit") == 4
    assert len({r["record_id"] for r in rows}) == len(PAGES)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in read.where("record_type = 'response'").collect()}
    assert payloads[7] == data[9][1] and payloads[8] == data[10][1] and payloads[4] == b""
    assert {r["url"] for r in rows if r["page_id"] in (3, 9)} == {"http://b.example/%20y%0A", "unknown:"}


def test_versions_and_cut_off_records():
    two = A._arc_start(2, "19991231235959", "n") + A._arc_record(4, "http://u", b"body", 2, "19991231235959", "n", 9)
    (record,) = A.read_arc(two)
    assert (record.url, record.date, record.payload) == ("http://u", "19991231235959", b"body")
    one = A._arc_start(1, "1999", "n") + b"http://u v 1.2.3.4 19990101 text/plain 5\nhello\n"
    (record,) = A.read_arc(one)
    assert (record.url, record.ip, record.header, record.payload) == ("http://u v", "1.2.3.4", b"", b"hello")
    assert b"WARC-Type: resource" in next(A._members(A._as_warc(record, "a", None)))
    with pytest.raises(ValueError):
        list(A.read_arc(two[:-4]))
    with pytest.raises(ValueError):
        list(A.read_arc(b"filedesc://x 0 0 t 4\n3 0 \nURL Archive-length\n"))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert A.resolve(A.read_warc(spark, A.convert(spark, A.write_arc(empty)))).collect() == []


@pytest.mark.parametrize("rows", [200_000, 0])
def test_long_and_short_revisit_lists(spark, monkeypatch, rows):
    """The same records whether lists go to the archives or archives to their lists."""
    monkeypatch.setattr(A, "SMALL_ROWS", rows)
    html = ["x" * 99, "y" * 100, "y" * 100, "z" * 200_000, "z" * 200_000, "", None, "y" * 100]
    frame = spark.createDataFrame([(i, f"http://a.b/{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    records = A.resolve(A.read_warc(spark, A.convert(spark, A.write_arc(frame.repartition(3)))))
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in records.collect()}
    assert found == {
        0: ("response", None, 99), 1: ("response", None, 100), 2: ("revisit", 1, 100), 3: ("response", None, 200_000),
        4: ("revisit", 3, 200_000), 5: ("response", None, 0), 6: ("response", None, 0), 7: ("revisit", 1, 100),
    }


def test_members_of_any_size(monkeypatch):
    import gzip

    parts = [b"", b"a", b"b" * 100_000, bytes(range(256)) * 999]
    content = b"".join(gzip.compress(p) for p in parts)
    for piece in (1, 7, 1 << 16):
        monkeypatch.setattr(A, "PIECE", piece)
        assert list(A._members(content)) == parts
