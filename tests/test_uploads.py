"""Uploaded files page by page, and what is merged over their pages."""

import pytest

from attestra.functions import ocr
from attestra.sources import uploads

CLEANED = "path string, page int, kind string, raw_text string, normalized_text string, confidence double, citations array<string>, sections array<string>, parties array<struct<canonical:string,aliases:array<string>>>"


def load(path: str) -> bytes:
    """A file whose bytes say how many pages it has."""
    return path.partition("-")[2].partition(".")[0].encode()


def typed(content: bytes, page: int) -> str:
    return f"page {page} of the long petition, u/s {300 + page % 4} ipc" if page % 3 else "short"


def test_a_long_file_is_read_by_many_tasks(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([("a-1000.pdf",), ("b-3.PDF",), ("c-0.pdf",), ("d-1.png",), ("e.txt",)], "path string")
    ranges = uploads.page_ranges(files, load, int, per_range=50)
    assert {(r["path"], r["n"], r["pages"]) for r in ranges.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.expr("last - first + 1")).alias("pages")).collect()} == {("a-1000.pdf", 20, 1000), ("b-3.PDF", 1, 3), ("d-1.png", 1, 1)}
    pages = uploads.ranged_pages(ranges, load, typed, lambda content, page: ("seen  by\nmachine", 0.6), tasks=6)
    got = pages.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got if r["path"] == "a-1000.pdf"}) > 3
    assert sorted(r["page"] for r in got if r["path"] == "a-1000.pdf") == list(range(1, 1001))
    kinds = {(r["path"], r["page"]): (r["kind"], r["text"], r["base"]) for r in got}
    assert kinds["b-3.PDF", 3] == ("scanned_pdf", "seen by machine", 0.6) and kinds["b-3.PDF", 1] == ("typed_pdf", typed(b"", 1), None) and kinds["d-1.png", 1] == ("image", "seen by machine", 0.6)


def test_files_of_pages(spark):
    files = spark.createDataFrame([("a-7.pdf",), ("b-2.pdf",), ("d-1.png",)], "path string")
    pages = uploads.ranged_pages(uploads.page_ranges(files, load, int, per_range=2), load, lambda c, p: typed(c, p) if c == b"7" else "", lambda c, p: ("A1R 1978 SC 597" if c == b"7" else "", 0.1))
    got = {r["path"]: r for r in uploads.files_merged(uploads.cleaned_pages(pages)).collect()}
    a = got["a-7.pdf"]
    assert (a["mode"], a["extraction_method"], a["page_count"]) == ("mixed_pdf", "hybrid_pdf", 7)
    assert a["sections"] == ["Section 301 IPC", "Section 302 IPC", "Section 300 IPC", "Section 303 IPC"] and a["citations"] == ["AIR 1978 SC 597"]
    assert a["extracted_text"].split("\n")[:3] == ["page 1 of the long petition, Section 301 IPC", "page 2 of the long petition, Section 302 IPC", "AIR 1978 SC 597"] and a["raw_extracted_text"].split("\n")[2] == "A1R 1978 SC 597"
    each = [round(0.72 + len(typed(b"", p)) / 2000, 3) if p % 3 else 0.45 + len("A1R 1978 SC 597") / 1500 for p in range(1, 8)]
    assert a["confidence"] == pytest.approx(round(sum(each) / 7, 3), abs=1e-9)
    b, d = got["b-2.pdf"], got["d-1.png"]
    assert (b["mode"], b["extracted_text"], b["confidence"], b["sections"], b["parties"]) == ("scanned_pdf", "", 0.1, [], []) and d["mode"] == "image_ocr"


def test_values_of_pages_stand_where_they_first_do(spark):
    """Against the plain rule, on pages in any order with repeats, nulls and parties alike by name."""
    import random

    random.seed(3)
    rows, names = [], ["A", "B", "C", "D", "E"]
    for f in range(6):
        for page in range(1, 30):
            pick = lambda: random.sample(names, random.randint(0, 4))
            rows.append((str(f), page, "image", "t", "t", 0.5, pick(), pick() if f else None, [(n, [n, f"{page}"]) for n in pick()]))
    random.shuffle(rows)
    got = {r["path"]: r for r in uploads.files_merged(spark.createDataFrame(rows, CLEANED).repartition(7)).collect()}
    for f in map(str, range(6)):
        own = sorted(r for r in rows if r[0] == f)
        for i, name in ((6, "citations"), (7, "sections")):
            assert got[f][name] == list(dict.fromkeys(v for r in own for v in r[i] or []))
        first = {}
        for r in own:
            for p in r[8]:
                first.setdefault(p[0], p)
        assert [(p["canonical"], p["aliases"]) for p in got[f]["parties"]] == list(first.values())
    assert uploads.files_merged(spark.createDataFrame([], CLEANED)).count() == 0


def test_text_without_sections_is_kept_as_it_is(spark):
    from pyspark.sql import functions as F

    rows = [("plain\x01 words",), ("u/s 3O2 ipc and Sec. 41 crpc, u/s 302 IPC",), ("second thoughts",), ("",), (None,)]
    d = spark.createDataFrame(rows, "x string")
    text, found = ocr.with_sections(F.col("x"))
    got = {r["x"]: (r["t"], r["f"]) for r in d.select("x", text.alias("t"), found.alias("f")).collect()}
    assert got["plain\x01 words"] == ("plain\x01 words", []) and got["second thoughts"] == ("second thoughts", []) and got[""] == ("", [])
    assert got[rows[1][0]] == ("Section 302 IPC and Section 41 CrPC, Section 302 IPC", ["Section 41 CrPC", "Section 302 IPC"])
