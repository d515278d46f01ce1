import hashlib

import pytest

from attestra.llm import warc as W


def rows():
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "<p>" + "é" * 80 + "</p>"
    return [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "before " + inner + inner + " after " + "z" * 200), (8, "u", inner), (9, "u", big + "WARC/1.0\r\n"), (10, "u", "\r\n\r\n" * 50), (11, "u", "x" * 100), (12, "u", "x" * 100), (13, "u", "y" * 30000)]


@pytest.mark.parametrize("split", ["64m", "300"])
def test_round_trip(spark, tmp_path, split):
    pages = spark.createDataFrame([(*r, 1) for r in rows()], "page_id long, url string, html string, n int").coalesce(2)
    W.write_warc(pages, str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r["page_id"]: r for r in W.read_warc(spark, str(tmp_path / "w")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == [r[0] for r in rows()]
    first = {}
    for i, _, html in rows():
        b = (html or "").encode()
        digest = hashlib.sha256(b).hexdigest()
        again = first.setdefault(digest, i) if len(b) >= 100 else i
        assert got[i]["payload_bytes"] == len(b) and got[i]["payload_digest"] == digest
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if again == i else ("revisit", again))


def test_empty(spark, tmp_path):
    W.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert W.read_warc(spark, str(tmp_path / "w")).count() == 0
