import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import vectorcodes as V


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label), vectors sound and of one length; codes, errors and the codebooks by Python's integers."""
    ints = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v], lab) for i, v, lab in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    size = len(ints[0][1]) // parts
    books = [[v[p * size : (p + 1) * size] for _, v, _ in ints[:entries]] for p in range(parts)]
    nearest = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in ints:
                groups.setdefault(nearest(v, p)[1], []).append(v[p * size : (p + 1) * size])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, v, lab in ints:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("scale", [10, 3000, 2**28])
def test_tree_equals_every_entry(scale):
    r = np.random.default_rng(scale)
    for n, d in ((1, 3), (7, 1), (9, 2), (256, 16), (100, 0)):
        entries = r.integers(-scale, scale, (n, d)).astype(np.float64)
        entries[r.integers(0, n, n // 4)] = entries[0]
        rows = np.concatenate([entries[: n // 2], r.integers(-scale, scale, (300, d)).astype(np.float64)])
        q, e = V.exact(rows, entries)
        index, best = V.VantageTree(e).nearest(q)
        for x, i, b in zip(rows.tolist(), index.tolist(), best.tolist()):
            want = min((sum((int(a) - int(c)) ** 2 for a, c in zip(x, y)), k) for k, y in enumerate(entries.tolist()))
            assert (int(b), i) == want


def frame(spark, rows):
    wide = [(i, v, lab, "x", 1) for i, v, lab in rows]
    return spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int, code string, error int")


def test_codes_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(r.randrange(1000), [float(np.float32(r.gauss(0, 0.3))) for _ in range(8)], r.choice([None, 1, 2])) for _ in range(120)]
    rows += rows[:10] + [(None, [0.5] * 8, 1), (None, [-0.25] * 8, None)]
    broken = [(1, None, 1), (2, [0.1, None] * 4, 1), (3, [float("nan")] * 8, None), (4, [float("inf")] * 8, 2), (5, [1.0, 2.0], 7), (6, [], 7)]
    codes, books = V.compressed(frame(spark, rows + broken), entries=40)
    got = codes.collect()
    want, want_books = brute(rows, entries=40)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(x) for x in got if x["code"]), key=key) == sorted(want, key=key)
    assert [[[int(v) for v in e] for e in b.tolist()] for b in books] == want_books
    assert sorted((x["vec_id"], x["label"], x["error"]) for x in got if x["code"] is None) == [(5, 7, None), (6, 7, None)]
    sums = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + e
    got = V.with_label_errors(codes).select("label", "label_error").distinct().collect()
    assert {x[0]: x[1] for x in got} == sums | {7: None}


def test_large_components_stay_exact(spark):
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.uniform(-5e5, 5e5))) for _ in range(4)], None) for i in range(40)]
    codes, _ = V.compressed(frame(spark, rows), entries=8)
    want, _ = brute(rows, entries=8)
    assert sorted(tuple(x) for x in codes.select("vec_id", "code", "error").collect()) == sorted((i, c, e) for i, _, c, e in want)


def test_parts_that_differ_in_length_and_empty_tables(spark):
    codes, books = V.compressed(frame(spark, [(1, [0.5] * 6, 1), (2, [0.25] * 6, 1)]))
    assert [b.shape for b in books] == [(2, 2), (2, 2), (2, 1), (2, 1)]
    assert sorted(x["code"] for x in codes.collect()) == ["00000000", "01010101"]
    codes, books = V.compressed(frame(spark, []))
    assert V.with_label_errors(codes).count() == 0 and V.codebooks_text(books) == ""


def test_query_equals_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = V.op11_vectorcodes(spark, sf)
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    found = sorted(tuple(r) for r in got.select(columns).collect())
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert found == sorted(con.sql(f"select {', '.join(columns)} from ({V.ORACLE})").fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", F.col("label")).collect()]
    want, books = brute(rows)
    assert [(r[0], r[1], r[2]) for r in found] == sorted((i, c, e) for i, _, c, e in want)
    assert {r[4] for r in found} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
