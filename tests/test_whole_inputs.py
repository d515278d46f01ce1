"""Queries without SQL against brute force on small tables: every row takes part."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from attestra.operators import retrieval as R
from attestra.operators.collections import open_points
from attestra.plans import case_queries as K
from attestra.plans import retrieval_queries as Q
from attestra.plans.domain import Domain


def vector(text):
    v = [0.0] * 24
    for w in text.strip().lower().split():
        for i, x in enumerate(hashlib.sha256(w.encode()).digest()[:24]):
            v[i] += x / 255 - 0.5
    n = math.sqrt(sum(x * x for x in v))
    return [round(x / (n or 1), 8) for x in v]


def test_dense_list_searches_all_documents(spark, tmp_path):
    word = lambda i: f"w{i * 7919 % 211}"
    rows = [(i, " ".join(word(i * k) for k in range(1, 400 if i % 3 == 0 else 20)), "en" if i % 4 == 0 else "de") for i in range(1, 60)]
    items = [(k, rows[k][1], rows[k][0]) for k in (1, 4, 5, 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([i[:2] for i in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    vectors = {d: vector(t) for d, t, _ in rows}
    got = Q.dense(Domain(spark, str(tmp_path))).collect()
    for k, text, own in items:
        v = vector(text)
        score = {d: sum(a * b for a, b in zip(v, w)) for d, w in vectors.items()}
        mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == k)
        best = sorted(score.values(), reverse=True)[:20]
        assert len(mine) == 20 and mine[0][1] == own
        assert [s for _, _, s in mine] == pytest.approx(best, abs=2e-6)
        assert all(score[d] == pytest.approx(s, abs=2e-6) for _, d, s in mine)


def windows(sizes, most=220):
    out, i = [], 0
    while i < len(sizes):
        e = i + 1
        while e < len(sizes) and sum(sizes[i : e + 1]) <= most:
            e += 1
        out.append((i, e))
        i = len(sizes) if e == len(sizes) else max(i + 1, e - 1)
    return out


def test_report_windows_of_all_documents(spark, tmp_path):
    sizes = {i: [(i * k * 37) % 130 + 1 for k in range(i % 9)] + [300] * (i % 2) for i in range(40)}
    rows = [(i, "\n".join(" ".join(["w"] * n) for n in s) + "\n \n") for i, s in sizes.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["chunk_index"], r["first"], r["end"]) for r in K.report_windows(spark, str(tmp_path)).collect())
    assert got == [(i, n, a, b) for i, s in sizes.items() for n, (a, b) in enumerate(windows(s))]


def test_items_of_any_length_are_found(spark, tmp_path):
    texts = {1: "the quick brown fox jumps over it", 2: "prequick brown foxes", 3: "quick", 4: "a b c d e f", 5: ""}
    items = {1: "quick brown fox", 2: "quick", 3: "brown", 4: "a b c d e", 5: "k b", 6: "b c", 7: "x y z", 8: "quick brown fox jumps over"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["case_id"], r["doc_id"]) for r in Q.qrels(Domain(spark, str(tmp_path))).collect()}
    assert got == {(i, d) for i, x in items.items() for d, t in texts.items() if x in t}


def test_days_of_any_year_are_open(spark):
    """Days beyond 2262 (nanoseconds) and beyond 9999 (Python's dates)."""
    days = {1: 0, 2: 200_000, 3: 4_000_000}
    p = spark.createDataFrame([(i, [1.0, 0.5], n) for i, n in days.items()], "point_id long, vector array<double>, day int")
    p = p.select("point_id", "vector", F.lit("sc_judgments").alias("collection"), F.lit("GOOD_LAW").alias("current_validity"), F.lit(None).cast("boolean").alias("is_in_force"), F.lit(None).cast("string").alias("section_number"), F.date_add(F.to_date(F.lit("1950-01-01")), F.col("day")).alias("date"), F.array(F.lit("All India")).alias("jurisdiction_binding"), F.array(F.lit("civil")).alias("practice_area"))
    q = spark.createDataFrame([(1, [1.0, 0.5], True), (2, [1.0, 0.5], False)], "query_id long, vector array<double>, time_sensitive boolean")
    q = q.select("*", F.lit("general_legal").alias("query_type"), F.lit("general").alias("practice_area"), F.to_date(F.lit("1951-06-01")).alias("reference_date"), F.array().cast("array<string>").alias("courts"), F.array().cast("array<string>").alias("numbers"))
    assert sorted((r["query_id"], r["point_id"]) for r in R.dense(q, p, allowed=open_points).collect()) == [(1, 1), (2, 1), (2, 2), (2, 3)]


def test_words_keep_their_vectors_when_the_worker_forgets(monkeypatch):
    from attestra.functions import vectors as V

    monkeypatch.setattr(V, "CACHE_WORDS", 5)
    words = V.WordVectors(24)
    for text in ("a b a c", "d e f g h i", "a z", "", "h h b"):
        one = [[x / 255 - 0.5 for x in hashlib.sha256(w.encode()).digest()[:24]] for w in text.split()]
        assert words.known(text.split()).tolist() == one
