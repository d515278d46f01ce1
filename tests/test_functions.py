import math

from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.vectors import cosine, embedding
from attestra.operators import evaluation as E
from attestra.operators import graph as G
from attestra.operators import routing as R
from attestra.operators import state as S
from attestra.operators import verify as V
from attestra.operators.filters import compiled
from attestra.sources import lines
from attestra.streaming import events as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_initials_and_references(spark):
    t = one(spark, T.tokens(F.col("x")), x="Justice K.S. Puttaswamy vs. Union, Section 302 IPC and Article 21; AIR 1978 SC 597 (2017) 10 SCC 1")
    assert {"ks", "puttaswamy", "v", "302_ipc", "section_ipc", "article_21", "air_1978_sc_597", "2017_10_scc_1"} <= set(t)
    assert len(t) == len(set(t))


def test_query_tokens_repeat(spark):
    t = one(spark, T.query_tokens(F.col("x")), x="murder ipc 302")
    assert t.count("ipc") == 2


def test_document_tokens_take_aliases(spark):
    t = one(spark, T.document_tokens(F.col("x"), F.col("a"), F.col("s")), x="whoever", a="Bharatiya Nyaya Sanhita, 2023", s="101")
    assert {"bns", "bns_101", "section_101", "bharatiya"} <= set(t)


def test_sentences_and_packing(spark):
    assert one(spark, T.sentences(F.col("x")), x="One two. Three four! Five") == ["One two.", "Three four!", "Five"]
    assert one(spark, T.packed_sentences(F.col("x"), 4), x="One two. Three four! Five six seven eight nine. Ten.") == ["One two. Three four!", "Five six seven eight nine.", "Ten."]
    assert one(spark, T.packed_sentences(F.col("x"), 4), x="") == []


def test_embedding_is_unit_and_cosine(spark):
    df = spark.createDataFrame([("some words here", "")], "a string, b string").select(embedding(F.col("a")).alias("a"), embedding(F.col("b")).alias("b"))
    r = df.select("a", "b", cosine(F.col("a"), F.col("a")).alias("same"), cosine(F.col("a"), F.col("b")).alias("none")).first()
    assert len(r["a"]) == 24 and set(r["b"]) == {0.0} and abs(r["same"] - 1) < 1e-6 and r["none"] == 0


def test_ir_metrics_graded(spark):
    ranking = spark.createDataFrame([("g", d, i) for i, d in enumerate(["b", "b", "a", "d", "c"], 1)], "case_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("g", "a", True, 3), ("g", "b", True, 2), ("g", "c", True, 1)], "case_id string, doc_id string, relevant boolean, grade int")
    r = E.ir_metrics(ranking, qrels, (1, 3)).first()
    assert r["p_1"] == 1 and abs(r["r_3"] - 2 / 3) < 1e-5 and abs(r["ap"] - (1 + 1 + 0.75) / 3) < 1e-5
    ideal = 7 + 3 / math.log2(3) + 1 / 2
    assert abs(r["ndcg_3"] - (3 + 7 / math.log2(3)) / ideal) < 1e-5


def test_routing(spark):
    rows = [(1, "my landlord locked me out", False), (2, "Section 302 IPC", False), (3, "A v B on Bombay High Court and Delhi High Court, difference between them", False), (4, "anything", True), (5, "Article 21 scope", False)]
    got = {r["query_id"]: r for r in R.analyzed(spark.createDataFrame(rows, "query_id int, query string, uploaded boolean")).collect()}
    assert [got[i]["query_type"] for i in range(1, 6)] == ["vague_natural", "statutory_lookup", "comparative", "document_specific", "constitutional"]
    assert got[2]["sections"] == ["IPC 302"] and got[3]["jurisdiction"] == "Bombay High Court"


def test_filters_reject_unindexed():
    import pytest

    with pytest.raises(ValueError):
        compiled({"must": [{"key": "x", "match": {"value": 1}}]}, {"y": "keyword"})


def test_entailment(spark):
    label = lambda p, h: one(spark, V.entailment(F.lit(p), F.lit(h)), x=1)
    assert label("the appeal court allowed bail", "appeal court allowed bail") == "ENTAILMENT"
    assert label("the appeal court allowed bail", "appeal court never allowed bail") == "CONTRADICTION"


def test_claims_are_checked_in_their_document(spark):
    claims = spark.createDataFrame([(1, "bail is the rule", 7, None), (2, "bail", None, None), (3, "bail", 99, None)], "claim_id int, claim string, doc_id int, preferred_chunk int")
    chunks = spark.createDataFrame([(7, 1, "bail is the rule", "bail"), (7, 2, "other words", None)], "doc_id int, chunk_id int, text string, header string")
    got = {r["claim_id"]: r["status"] for r in V.checked_claims(claims, chunks).collect()}
    assert got == {1: "VERIFIED", 2: "UNCERTAIN", 3: "MISGROUNDED"}


def test_timeline_phases(spark):
    df = spark.range(4).select(G.phase(F.col("id").cast("int"), F.lit(4)).alias("p"))
    assert [r["p"] for r in df.collect()] == ["foundational", "development", "current", "current"]


def test_targets_by_priority(spark):
    docs = spark.createDataFrame([(1, "AIR 1", None, "r1", "a v b"), (2, None, "AIR 1", "r2", "c v d")], "doc_id int, citation string, neutral_citation string, source_document_ref string, case_key string")
    refs = spark.createDataFrame([("AIR 1",), ("c v d",), ("none",)], "reference string")
    assert {r["reference"]: r["doc_id"] for r in G.resolved_targets(refs, docs).collect()} == {"AIR 1": 1, "c v d": 2}


def test_edge_rules(spark):
    rules = [("overrules", [" overruled "]), ("follows", [" followed "])]
    got = one(spark, G.edge_type(F.lit(None).cast("string"), F.col("x"), rules), x="It was followed here")
    assert got == "follows"


def test_sections_of_lines(spark):
    text = "Act: X\nSection 1: Short title\nThis Act\nis short.\nSection 2 - Scope\nAll."
    got = lines.sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("section_index").collect()
    assert [(r["number"], r["heading"], r["text"]) for r in got] == [("1", "Short title", "This Act is short."), ("2", "Scope", "All.")]


def test_codes(spark):
    ref = lambda x: one(spark, S.code_reference(F.col("x")), x=x)
    assert tuple(ref("Section 302 IPC")) == ("IPC", "302") and tuple(ref("bnss 480")) == ("BNSS", "480") and ref("nothing") is None


def test_reducer_matches_steps():
    s = X.blank()
    for kind, step in [("STEP_START", "a"), ("STEP_START", "b"), ("STEP_COMPLETE", "a"), ("STEP_COMPLETE", "z"), ("STEP_ERROR", "y")]:
        X.applied(s, {"type": kind, "step": step, "error": "e", "token": None, "confidence": None})
    assert s["steps"] == [["a", "completed"], ["b", "completed"], ["y", "error"]] and s["status"] == "error"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("q", i, k, s, "", None, t, None) for i, (k, s, t) in enumerate([("STEP_START", "a", None), ("TOKEN", None, "x"), ("TOKEN", None, "y"), ("STEP_COMPLETE", "a", None)])]
    spark.createDataFrame(rows, X.EVENT).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(X.EVENT).json(str(tmp_path / "in"))
    q = X.reduced_stream(stream).writeStream.outputMode("update").format("memory").queryName("reduced").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120) is not False
    got = spark.table("reduced").first()
    batch = X.reduced(spark.createDataFrame(rows, X.EVENT)).first()
    assert got["output"] == batch["output"] == "xy" and got["steps"] == batch["steps"]


def test_docx():
    import io
    import zipfile

    from attestra.sources.uploads import WORD_SPACE, docx_text

    ns = WORD_SPACE.strip("{}")
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>Bail</w:t></w:r><w:r><w:t> order</w:t></w:r></w:p></w:body></w:document>')
    assert docx_text(b.getvalue()) == "Bail order"
