"""Steps that once were made several times, or went on longer than their input needs."""

import re

from pyspark.sql import functions as F

from attestra.functions import ocr
from attestra.functions import text as T
from attestra.operators import citations as C
from attestra.operators import graph as G
from attestra.plans import corrective_queries, text_queries
from attestra.plans.domain import Domain

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_token_lists_space_a_text_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "2147483632")
    assert plan(text_queries.token_lists(spark, DIR)).count("[^a-z0-9()]+") == 1
    texts = ["a  b", " a b ", "a-b c.\td", "(x) - [y]", "é a é", "", "...", "a b", "  ", "a . b", "x\n\ny z"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(T.spaced(F.col("t"))).collect()] == [re.sub("[^a-z0-9()]+", " ", t).strip(" ") for t in texts]


def test_recognised_texts_are_corrected_once(spark):
    assert plan(text_queries.ocr_corrections(spark, DIR)).count("artlcle\\b") == 2  # whether it fits, and in its place


def test_guards_lose_no_correction(spark):
    texts = ["SECTL0N 3 and SECTION 4, Sectlon", "secfion ARTLCLE", "Respondent: A v. B", "A1R a1r", "0NLINE", "plain", "", None, "u/s 3O crpc, sec 4 Code of Criminal Procedure, Section 5 LPC", "sec. 3\x01 ipc", "AIR 19l0 sc 1O, (2O10) 1 SCC 5, 2010 scc online del 4"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")

    def corrected(t):
        found = []
        for p, to, label in ocr.CORRECTIONS:
            if re.search(p, t):
                found += [label]
            t = re.sub(p, to, t)
        return t, list(dict.fromkeys(found))

    got = [tuple(r) for r in d.select(*ocr.corrected(F.col("t"))).collect()]
    assert [g for g, t in zip(got, texts) if t is not None] == [corrected(t) for t in texts if t is not None]
    s = d.select(ocr.with_sections(F.col("t"))[1], ocr.with_citations(F.col("t"))[1]).collect()
    assert s[8][0] == ["Section 4 CrPC", "Section 30 CrPC", "Section 5 IPC"] and s[10][1] == ["AIR 1910 SC 10", "(2010) 1 SCC 5", "2010 SCC OnLine DEL 4"]
    assert d.select(ocr.with_sections(F.col("t"))[0]).collect()[9][0] == "Section 3 IPC"


def test_circles_end_with_the_longest_chain(spark, monkeypatch):
    made = []
    real = G.stored
    monkeypatch.setattr(G, "stored", lambda df: made.append(1) or real(df))
    n = 4000
    links = [(i, i + 1) for i in range(5)] + [(100 + i, 100 + (i + 1) % n) for i in range(n)] + [(9000, 100)]
    got = {r.node: (r.last, r.steps) for r in G.chains(spark.createDataFrame(links, "node long, next long")).collect()}
    assert got == {i: (5, 5 - i) for i in range(5)} | {100 + i: (None, None) for i in range(n)} | {9000: (None, None)}
    assert len(made) <= 6  # log2 of all nodes would be 12 rounds


def test_results_of_queries_are_a_table(spark):
    d = Domain(spark, DIR)
    assert "Join" not in plan(corrective_queries.results(d))
    only = spark.createDataFrame([(3,), (5,), (3,), (-1,)], "doc_id long")
    assert sorted(d.legal_documents(only).collect()) == sorted(d.legal_documents().where("doc_id in (3, 5)").collect())


def test_pages_look_for_sections_without_a_pattern(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "2147483632")
    d = spark.createDataFrame([("u/S 3O crpc",), ("U.S. 4 bns",), ("no law",)], "t string")
    out = d.select(ocr.sections(F.col("t")).alias("s"))
    assert "(?i)u/s" not in plan(out)
    assert [list(r.s.found) for r in out.collect()] == [["Section 30 CrPC"], ["Section 4 BNS"], []]


def test_placeholders_meet_one_of_many_alike(spark, monkeypatch):
    seen = []
    real = C.sharing
    monkeypatch.setattr(C, "sharing", lambda q, c, *a, **k: seen.append(c.count()) or real(q, c, *a, **k))
    n = 120
    documents = spark.createDataFrame([(i, "statute" if i % 2 else "judgment", "Delhi High Court", None, f"AIR {i}", "A", "State", ["criminal"], "GOOD_LAW", "body") for i in range(n)], "doc_id long, doc_type string, court string, date date, citation string, appellant string, respondent string, practice_areas array<string>, current_validity string, body string")
    chunks = spark.createDataFrame([(i, i, 0, f"alpha bravo text{i}", "heading", "penal act" if i % 2 else None, "5" if i % 2 else None, True, "GOOD_LAW", None) for i in range(n)], "doc_id long, chunk_id long, chunk_index int, chunk_text string, header string, act string, section string, in_force boolean, chunk_validity string, chunk_citation string")
    p = spark.createDataFrame([(1, "STATUTE", "penal act section 5", None, None), (2, "CITE", "the high court on alpha bravo", None, None)], "placeholder_id int, kind string, description string, doc_id long, chunk_id long")
    got = {r.placeholder_id: (r.status, r.doc_id, r.chunk_id) for r in C.resolved_placeholders(p, documents, chunks).collect()}
    assert got == {1: ("VERIFIED", 1, 1), 2: ("VERIFIED", 0, 0)}
    assert seen and max(seen) == 1
