"""Chains of operators with callables in place of models, stores and retrieval."""

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from attestra.functions import chunks as K
from attestra.operators import collections as L
from attestra.operators import corrective as C
from attestra.operators import answers as A
from attestra.operators import execution as X
from attestra.operators import listings as N
from attestra.operators import retrieval as R
from attestra.sources import ingest, statutes

RESULT = "query_id int, rank int, doc_id int, doc_type string, act string, section string, court string, issue string, text string"


def test_drafts_say_what_they_lack(spark):
    q = spark.createDataFrame([(1, "q1", "statutory_lookup"), (2, "q2", "case_specific"), (3, "q3", "general_legal")], "query_id int, query string, query_type string")
    r = spark.createDataFrame([(1, 1, 7, "judgment", None, None, "Court", "on x", "Held so. More."), (2, 1, 8, "statute", "Act", "6", None, None, "Text here.")], RESULT)
    got = {(x["query_id"], x["title"]): (x["kind"], x["paragraph"]) for x in X.drafts(q, r).collect()}
    assert got[1, "Key Authorities"] == ("CITE", "Held so. [CITE: Court on x]") and got[1, "Applicable Law"] == ("UNSUPPORTED", f"[UNSUPPORTED: {X.NO_LAW}]")
    assert got[2, "Applicable Law"] == ("STATUTE", "Text here. [STATUTE: Act, Section 6]") and got[2, "Key Authorities"][0] == "UNSUPPORTED"
    assert got[3, "Research Note"][1] == f"{X.NOTHING} [UNSUPPORTED: primary authority required for: q3]" and len(got) == 5


def test_claims_by_their_citations_and_badges(spark):
    claims = spark.createDataFrame([(1,), (2,), (3,), (4,)], "claim_id int")
    kind = "claim_id int, position int, verified boolean, citation string, grounding string, pending boolean, reason string, doc_id int"
    rows = [(1, 1, True, "A", "VERIFIED", False, "fits", 5), (1, 2, True, "A", "UNCERTAIN", False, "near", 6), (2, 1, False, "B", None, None, None, None), (4, 1, True, "C", "VERIFIED", True, "open", 9)]
    cites = spark.createDataFrame(rows, kind)
    got = {r["claim_id"]: r for r in X.verified_claims(claims, cites, lambda bad: spark.createDataFrame([(2, 1, True, "D", "VERIFIED", False, "found", 4)], kind)).collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["UNCERTAIN", "VERIFIED", "UNSUPPORTED", "UNCERTAIN"]
    assert (got[1]["citation"], got[1]["reason"], got[1]["doc_id"]) == ("A", "fits; near", 5) and got[2]["reretrieved"] and not got[3]["reretrieved"] and got[3]["reason"] == X.NO_CITATION
    c = X.assessed(claims, cites)
    res = spark.createDataFrame([(1, 1, "[T]", "A", True, "direct", 5), (2, 1, "[U]", "[UNVERIFIED: u]", False, "missing", None)], "claim_id int, position int, token string, rendered string, verified boolean, message string, doc_id int")
    b = {(r["claim_id"], r["position"]): r for r in X.badges(c, res).collect()}
    assert b[1, 1]["status"] == "UNCERTAIN" and b[1, 1]["message"] == "fits; near direct" and b[2, 1]["status"] == "UNVERIFIED" and b[2, 1]["citation"] is None and b[4, 0]["label"] == "C" and (3, 0) not in b


def test_execution_of_queries(spark):
    q = spark.createDataFrame([(1, "q1", "general_legal"), (2, "q2", "general_legal")], "query_id int, query string, query_type string")
    found = spark.createDataFrame([(1, 1, 8, "statute", "Act", "6", None, None, "Text here.")], RESULT)
    resolve = lambda p: p.select("query_id", "token", F.when(F.col("kind") == "STATUTE", "Act, Section 6").otherwise("[UNVERIFIED]").alias("rendered"))
    cite = lambda c: c.where(F.col("answer_id") == 1).select("claim_id", F.lit(1).alias("position"), F.lit(True).alias("verified"), F.lit("Act, Section 6").alias("citation"), F.lit("VERIFIED").alias("grounding"), F.lit(False).alias("pending"), F.lit("ok").alias("reason"), F.lit(8).alias("doc_id"))
    out = X.executed(q, lambda _: found, resolve, cite)
    text = {r["query_id"]: r["text"] for r in out["text"].collect()}
    assert text[1] == "Applicable Law\nText here. Act, Section 6" and "[UNVERIFIED]" in text[2]
    assert {r["answer_id"]: r["overall_status"] for r in out["answers"].collect()} == {1: "VERIFIED", 2: "UNSUPPORTED"}


def test_correction_takes_queries_apart(spark):
    entity = "array<struct<kind:string,text:string>>"
    kind = f"query_id long, query string, query_type string, practice_area string, jurisdiction string, reference_date string, sections array<string>, equivalents array<string>, entities {entity}"
    names = ["query_id", "rank", "chunk_id", "doc_id", "text", "header", "act", "section", "citation", "court", "appellant", "respondent", "doc_type", "practice_areas", "authority", "current_validity", "valid", "warning"]
    q = spark.createDataFrame([(1, "What does IPC 302 say", "statutory_lookup", "general", "Court", "2024-08-01", ["IPC 302"], [], [("SECTION", "IPC 302")]), (2, "zzz yyy", "general_legal", "general", "Court", "2024-08-01", [], [], [("CASE_NAME", "a v b")])], kind).withColumn("reference_date", F.to_date("reference_date"))
    schema = "query_id long, rank int, chunk_id int, doc_id int, text string, header string, act string, section string, citation string, court string, appellant string, respondent string, doc_type string, practice_areas array<string>, authority string, current_validity string"
    asked = []

    def retrieve(queries):
        rows = queries.select("query_id", "query").collect()
        asked.append(sorted(r["query"] for r in rows))
        return spark.createDataFrame([(r["query_id"], 1, 7, 7, "text", None, "IPC", "302" if "?" in r["query"] else "9", None, None, None, None, "statute", [], "persuasive", "GOOD_LAW") for r in rows], schema)

    def analyse(sub):
        return sub.select("query_id", "query", F.lit("statutory_lookup").alias("query_type"), F.lit("general").alias("practice_area"), F.lit("Court").alias("jurisdiction"), "reference_date", F.array(F.lit("IPC 302")).alias("sections"), F.array().cast("array<string>").alias("equivalents"), F.array().cast(entity).alias("entities"))

    validity = lambda r, _: r.withColumn("valid", F.lit(True)).withColumn("warning", F.lit(None).cast("string"))
    results, told = C.corrected(q, validity, retrieve, analyse, lambda bad: bad.select("query_id"))
    got = {r["query_id"]: r for r in told.collect()}
    assert asked[1] == ["How have courts interpreted IPC 302?", "What does IPC 302 say?"] and got[1]["action"] == "REFINED" and got[1]["n_results"] == 1
    assert got[2]["action"] == "WEB_SUPPLEMENTED" and {(r["query_id"], r["section"]) for r in results.select(*names).collect()} == {(1, "302"), (2, "9")}


def test_points_open_to_queries():
    q = [Row(query_type="case_specific", practice_area="general", time_sensitive=True, reference_date=pd.Timestamp("2020-01-01"), courts=["Delhi High Court"], numbers=[]), Row(query_type="statutory_lookup", practice_area="criminal", time_sensitive=False, reference_date=None, courts=[], numbers=["5"])]
    p = pd.DataFrame([
        ("hc_judgments", "GOOD_LAW", None, None, "2019-01-01", ["Delhi High Court"], ["criminal"]), ("hc_judgments", "GOOD_LAW", None, None, "2021-01-01", ["Delhi High Court"], ["criminal"]), ("hc_judgments", "OVERRULED", None, None, "2019-01-01", ["All India"], ["criminal"]),
        ("statutes", "GOOD_LAW", True, "5", None, ["All India"], []), ("statutes", "GOOD_LAW", False, "5", None, ["All India"], []), ("statutes", "GOOD_LAW", True, "6", None, ["All India"], []), ("sc_judgments", "GOOD_LAW", None, None, "2019-01-01", ["All India"], ["civil"]),
    ], columns=["collection", "current_validity", "is_in_force", "section_number", "date", "jurisdiction_binding", "practice_area"])
    q = pd.DataFrame([r.asDict() for r in q])
    assert L.open_points(q, p).T.tolist() == [[True, False, False, False, False, False, True], [False, False, False, True, False, False, False]]


def test_dense_blocks_ragged_and_null_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=5).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 5), (62, [1.0, None, 0.0, 0.0, 0.0])]
    p = spark.createDataFrame(rows, "point_id int, vector array<double>")
    q = spark.createDataFrame([(i, v) for i, v in rows[:7]], "query_id int, vector array<double>")
    got = R.dense(q, p, 3, block=2).collect()
    assert sorted(got) == sorted(R.dense(q, p, 3, block=2, sent=3).collect())
    many = q.crossJoin(spark.range(1500)).select(F.col("id").alias("query_id"), "vector")
    assert R.dense(many, p, 3, block=100)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    m = {i: np.array([x or 0.0 for x in v]) for i, v in rows if v}
    for i, v in rows[:7]:
        cos = {j: round(float(m[i] @ w / np.linalg.norm(m[i]) / np.linalg.norm(w)), 6) if np.linalg.norm(w) else 0.0 for j, w in m.items()}
        assert [(x["point_id"], x["score"]) for x in sorted((x for x in got if x["query_id"] == i), key=lambda x: x["rank"])] == sorted(cos.items(), key=lambda c: (-c[1], c[0]))[:3]
    assert R.dense(q.where("false"), p).count() == 0


def test_registry_and_runs(spark):
    reg = ingest.catalog(spark).where("source_key = 'nclt'").withColumn("display_name", F.lit("old"))
    used = spark.createDataFrame([("nclt", "u", "X", "p"), ("india_code", "u", "X", "p"), ("own", "http://own", "UPLOAD", "p9")], "source_key string, base_url string, source_type string, parser_version string")
    got = {r["source_key"]: r for r in ingest.registry_merged(reg, used).collect()}
    assert set(got) == {"nclt", "india_code", "own"} and got["nclt"]["display_name"] == "National Company Law Tribunal" and (got["own"]["access"], got["own"]["parser_version"], got["own"]["approval"]) == ("manual", "p9", "APPROVED")
    runs = spark.createDataFrame([("a", "completed", True, "2024-01-01", 1), ("b", "completed", True, "2024-02-01", 2), ("c", "completed", False, "2024-03-01", 3), ("d", "queued", True, None, 4)], "run_id string, status string, is_public boolean, completed_at string, n int")
    assert N.latest_public_run(runs).first()["n"] == 2 and N.latest_public_run(runs.where("false")).count() == 0


def test_articles_of_a_constitution(spark):
    d = spark.createDataFrame([(1, "The Constitution\nEffective Date: 1950-01-26\nArticle 14: Equality\nThe State shall not deny.\nArticle 21 - Life\nNo person\n shall be deprived.")], "doc_id int, text string")
    got = [(r["number"], r["header"], r["text"]) for r in statutes.articles(d).orderBy("section_index").collect()]
    assert got == [("14", "Article 14 - Equality", "The State shall not deny."), ("21", "Article 21 - Life", "No person shall be deprived.")]


def test_authorities_stand_once(spark):
    d = spark.createDataFrame([(1, 1, "a", "c"), (1, 2, "b", "c"), (1, 3, "a", "c"), (2, 1, "a", "c")], "case_id int, position int, doc_id string, chunk_id string")
    assert sorted((r["case_id"], r["position"]) for r in X.authorities_deduped(d).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_chunks_of_every_kind(spark):
    j = spark.createDataFrame([(1, ["Head."], None, None, None, None, None)], "doc_id int, headnotes array<string>, ratio array<string>, obiter array<string>, paragraphs array<string>, headers array<string>, body string")
    s = spark.createDataFrame([(2, 1, "5", "Heading", "One. Two.")], "doc_id int, section_index long, number string, heading string, text string")
    a = spark.createDataFrame([(3, 1, "14", "Equality", "Text.")], "doc_id int, section_index long, number string, heading string, text string")
    r = spark.createDataFrame([(4, ["p one", "p two"])], "doc_id int, paragraphs array<string>")
    got = sorted((x["doc_id"], x["kind"], x["header"], x["total_chunks"]) for x in K.chunked(j, s, a, r).collect())
    assert got == [(1, "headnote", "Headnote", 1), (2, "statute_section", "Section 5 - Heading", 1), (3, "constitution_article", "Article 14 - Equality", 1), (4, "lc_report_paragraphs", None, 1)]


def test_common_tokens_are_looked_up_for_the_best_alone(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61) ** 1.1
    docs = [(i, sorted({*r.choice(words, r.integers(1, 25), p=p / p.sum())}), bool(i % 5)) for i in range(400)]
    queries = [(i, list(r.choice(words, r.integers(1, 8), p=p / p.sum()))) for i in range(30)] + [(99, ["unknown"])]
    q = spark.createDataFrame([(i, [str(x) for x in t]) for i, t in queries], "query_id int, tokens array<string>")
    d = spark.createDataFrame([(i, [str(x) for x in t], ok) for i, t, ok in docs], "doc_id int, tokens array<string>, ok boolean")
    for valid in (None, F.col("ok")):
        for k in (3, 20):
            one, two = (sorted((x["query_id"], x["rank"], x["doc_id"], x["score"], tuple(x["matched"])) for x in R.bm25(q, d, k, valid, whole=n).collect()) for n in (10**9, 0))
            assert one == two and len(one) > 60


def test_documents_scored_where_read_are_those_of_the_shuffle(spark, monkeypatch):
    """All three ways give the same rows, with copies (ties), ids of strings, statistics of all documents, and tasks that pass on their best alone."""
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(80)]
    p = 1 / np.arange(1, 81) ** 1.1
    docs = [(f"d{i:03}", sorted({str(x) for x in r.choice(words, r.integers(1, 25), p=p / p.sum())})) for i in range(300)]
    docs += [(f"c{i:03}", ["w1", "w2", "w70"]) for i in range(60)] + [("none", None), ("empty", [])]
    d = spark.createDataFrame(docs, "doc_id string, tokens array<string>").repartition(5)
    about = d.select("doc_id", (F.substr("doc_id", F.lit(3), F.lit(9)) != "07").alias("good"))
    q = spark.createDataFrame([(i, [str(x) for x in r.choice(words, r.integers(1, 8), p=p / p.sum())]) for i in range(40)] + [(50, ["w70", "w70", "w2"]), (51, ["unknown"]), (52, [])], "query_id int, tokens array<string>")
    rows = lambda df: sorted((x["query_id"], x["rank"], x["doc_id"], x["score"], tuple(x["matched"])) for x in df.collect())
    for valid, more in ((None, None), (F.col("good"), about)):
        monkeypatch.setattr(R, "BROADCAST_TERMS", 500_000)
        found = R._where_read(q.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times")), d, F.lit(True), None, 3, R.K1, R.B)
        assert found.count() <= 41 * 3 * max(5, found.rdd.getNumPartitions())
        read = rows(R.bm25(q, d, 7, valid, about=more))
        monkeypatch.setattr(R, "BROADCAST_TERMS", 0)
        assert read == rows(R.bm25(q, d, 7, valid, about=more, whole=10**9)) == rows(R.bm25(q, d, 7, valid, about=more, whole=0))
        assert [x[2] for x in read if x[0] == 50] == [f"c{i:03}" for i in range(8) if valid is None or i != 7][:7]


def test_claims_are_numbered_alike_whenever_they_are_made(spark):
    """Paragraphs of one section, whose sentences stand at the same places, in any order of rows."""
    rows = [(1, "Key Authorities", f"Held {w}. More {w}.", ["[T]"], n) for n, w in enumerate(["z", "a", "m", "b"])] + [(1, "Applicable Law", "[T]", ["[T]"], 1)]
    kind = "answer_id int, section string, paragraph string, tokens array<string>, n int"
    want = [f"{head} {w}." for w in ["z", "a", "m", "b"] for head in ("Held", "More")]
    for order in (rows, rows[::-1]):
        c = A.claims(spark.createDataFrame(order, kind).repartition(3))
        assert [r["claim"] for r in c.orderBy("claim_id").collect()] == want and "n" not in c.columns
    again = A.claims(spark.createDataFrame(rows, kind).drop("n"))
    assert [r["claim"] for r in again.orderBy("claim_id").collect()][:2] == ["Held a.", "More a."]


def test_citations_see_the_resolutions(spark):
    q = spark.createDataFrame([(1, "q1", "general_legal")], "query_id int, query string, query_type string")
    results = spark.createDataFrame([(1, 1, 8, "statute", "Act", "6", None, None, "Text here."), (1, 2, 9, "judgment", None, None, "Court", "on x", "Held so.")], RESULT)
    resolve = lambda p: p.select("query_id", "token", F.concat(F.lit("value "), F.col("doc_id").cast("string")).alias("rendered"), "doc_id", (F.col("doc_id") == 8).alias("verified"))

    def cite(claims, resolutions):
        c = claims.select("claim_id", F.col("answer_id").alias("query_id"), F.posexplode("tokens").alias("position", "token")).join(resolutions, ["query_id", "token"])
        return c.select("claim_id", "position", "verified", F.col("rendered").alias("citation"), F.lit("VERIFIED").alias("grounding"), F.lit(False).alias("pending"), F.lit("ok").alias("reason"), "doc_id")

    out = X.executed(q, lambda _: results, resolve, cite)
    assert {(r["claim"], r["status"], r["citation"]) for r in out["claims"].collect()} == {("Text here.", "VERIFIED", "value 8"), ("Held so.", "UNSUPPORTED", None)}
    assert out["text"].first()["text"] == "Applicable Law\nText here. value 8\n\nKey Authorities\nHeld so. value 9" and out["resolutions"].count() == 2
