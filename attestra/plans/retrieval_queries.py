"""Published queries: retrieval, ranking and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine, embedding
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.collections import MODEL, VERSION, open_points, projected
from ..sources.ingest import collection, default_binding
from ..tables import stored
from .domain import Domain

#: Tokens as the engine makes them, for texts without statute references and reports.
TOKENS = r"""list_distinct(regexp_extract_all(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\bvs?\.?\b', ' v ', 'g'), '[^a-z0-9() ]+', ' ', 'g'), '\s+', ' ', 'g')), '[a-z]+[a-z0-9]*|\d+[a-z]?'))"""
LEXICAL = f"""
d AS (SELECT doc_id, {TOKENS} AS tokens FROM documents),
s AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM d),
p AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS token FROM d),
f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
q AS (SELECT item_id AS query_id, unnest({TOKENS}) AS token FROM benchmark),
m AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / greatest(avg_length, 1)))), 6) AS score
      FROM q JOIN p USING (token) JOIN f USING (token), s GROUP BY query_id, doc_id),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 20)
"""
QRELS = "qrels AS (SELECT item_id AS case_id, doc_id, TRUE AS relevant, 1 AS grade FROM benchmark b JOIN documents t ON contains(t.text, b.text))"


def lexical(d: Domain, top_k: int = 20) -> DataFrame:
    q = d.benchmark_queries().select("query_id", T.tokens(F.col("text")).alias("tokens"))
    return R.bm25(q, d.document_tokens(), top_k)


def dense(d: Domain, top_k: int = 20) -> DataFrame:
    """All documents by their hashed embeddings."""
    vectors = lambda t, key: t.select(key, embedding(F.col("text")).alias("vector"))
    points = vectors(d.table("documents").withColumnRenamed("doc_id", "point_id"), "point_id")
    return R.dense(vectors(d.benchmark_queries(), "query_id"), points, top_k).withColumnRenamed("point_id", "doc_id")


def open_dense(d: Domain, top_k: int = 20) -> DataFrame:
    """Documents by their hashed embeddings, those that a query's collections and filters leave open to it."""
    i, law = F.col("doc_id"), F.col("doc_type") == "statute"
    p = d.legal_documents().select(
        i.alias("point_id"), embedding(F.col("text")).alias("vector"), collection(F.col("doc_type"), F.col("court")).alias("collection"), "current_validity", F.when(law, i % 10 != 3).alias("is_in_force"), F.when(law, (i % 40).cast("string")).alias("section_number"),
        "date", default_binding(F.col("court"), F.col("doc_type")).alias("jurisdiction_binding"), areas().alias("practice_area"),
    )
    q = analysed(d).withColumn("vector", embedding(F.col("query"))).drop("query", "entities", "sections")
    return R.dense(q, p, top_k, allowed=open_points).withColumnRenamed("point_id", "doc_id")


TYPES = ["statutory_lookup", "case_specific", "vague_natural", "general_legal"]


def areas():
    return F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("criminal"))).otherwise(F.array(F.lit("civil")))


def analysed(d: Domain) -> DataFrame:
    """Benchmark items as analysed queries, kinds and filters by number."""
    i = F.col("query_id")
    number = (i % 40).cast("string")
    entities = F.array(F.struct(F.lit("CASE_NAME").alias("kind"), F.concat(F.lit("party "), (i * 3).cast("string"), F.lit(" v state")).alias("text")))
    return d.benchmark_queries().select(
        "query_id", F.col("text").alias("query"), F.element_at(F.array(*map(F.lit, TYPES)), (i % 4 + 1).cast("int")).alias("query_type"), F.when(i % 5 == 0, "criminal").otherwise("general").alias("practice_area"), (i % 3 == 0).alias("time_sensitive"),
        F.to_date(F.lit("1951-06-01")).alias("reference_date"), F.when(i % 2 == 0, F.array(F.lit("Bombay High Court"))).otherwise(F.array(F.lit("Delhi High Court"))).alias("courts"), F.when(i % 7 == 0, F.array(number)).otherwise(F.array().cast("array<string>")).alias("numbers"),
        F.array(F.concat(F.lit("Indian Evidence Act "), number)).alias("sections"), entities.alias("entities"),
    )


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(Domain(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


def bm25_valid_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents, results of good law only."""
    d = Domain(spark, sf_dir)
    q = d.benchmark_queries().select("query_id", T.tokens(F.col("text")).alias("tokens"))
    return R.bm25(q, d.document_tokens(), 10, valid=F.col("current_validity") == "GOOD_LAW", about=d.legal_documents().select("doc_id", "current_validity")).select("query_id", "doc_id", "score", "rank")


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.corpus_statistics(Domain(spark, sf_dir).document_tokens())
    return s.select("n_docs", F.col("total_length").cast("long").alias("total_length"), F.round("avg_length", 6).alias("avg_length"))


def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.document_frequencies(Domain(spark, sf_dir).document_tokens())


def qrels(d: Domain) -> DataFrame:
    """Documents that contain an item's text: by a run of its inner words first, so that no text is held against all items. Items without inner words are held against every text."""
    key = lambda words: F.xxhash64(F.array_join(words, " "))
    b = d.table("benchmark").select("item_id", F.col("text").alias("item"), F.split("text", " ").alias("w"))
    b = b.withColumn("size", F.least(F.size("w") - 2, F.lit(3)))
    keyed = b.where("size > 0").select("item_id", "item", "size", key(F.slice("w", F.lit(2), F.col("size"))).alias("key"))
    t = d.table("documents").select("doc_id", "text", F.split("text", " ").alias("w"))
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.struct(F.lit(n).alias("size"), key(F.slice(F.col("w"), i + 1, F.lit(n))).alias("key")))
    sizes = [r[0] for r in keyed.select("size").distinct().collect()]
    met = t.select("doc_id", F.explode_outer(F.concat(*[runs(n) for n in sizes] or [F.array().cast("array<struct<size:int,key:bigint>>")])).alias("r")).select("doc_id", "r.size", "r.key")
    found = met.join(F.broadcast(keyed.select("size", "key").distinct()), ["size", "key"], "left_semi").distinct().join(keyed, ["size", "key"]).select("doc_id", "item_id", "item")
    # a table of known size: few, they meet the texts where these are read
    found = stored(found).join(d.table("documents").select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item"))).select("item_id", "doc_id")
    short = b.where("size <= 0").select("item_id", "item")
    if not short.isEmpty():
        found = found.unionByName(t.join(short, F.contains("text", F.col("item"))).select("item_id", "doc_id"))
    return found.select(F.col("item_id").alias("case_id"), "doc_id", F.lit(True).alias("relevant"), F.lit(1).alias("grade")).distinct()


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return E.ir_metrics(lexical(d).withColumnRenamed("query_id", "case_id"), qrels(d), (1, 5, 10))


def ir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro(ir_metrics(spark, sf_dir))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is a multiple of 25 as queries, against all."""
    e = Domain(spark, sf_dir).table("embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.dense(q, e.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector")), 10)


def filtered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.filters import compiled

    p = Domain(spark, sf_dir).table("embeddings").select("vec_id", "label", (F.col("vec_id") % 9 + 1).cast("int").alias("bench_size"), F.when(F.col("vec_id") % 3 == 0, "OVERRULED").otherwise("GOOD_LAW").alias("current_validity"))
    clause = {
        "must": [{"key": "current_validity", "match": {"value": "GOOD_LAW"}}, {"key": "bench_size", "range": {"gte": 3, "lt": 8}}],
        "should": [{"key": "label", "match": {"any": [1, 2, 3]}}, {"key": "bench_size", "match": {"value": 7}}],
        "must_not": [{"key": "label", "match": {"value": 2}}],
    }
    return p.where(compiled(clause, {"current_validity": "keyword", "bench_size": "integer", "label": "integer"}))


def hybrid(d: Domain) -> DataFrame:
    """Lexical and hashed-embedding lists fused, reranked, ranked by authority."""
    return R.fused(lexical(d), open_dense(d))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical list and one of other documents and of some of the same: every query's neighbours by number."""
    d = Domain(spark, sf_dir)
    lex = lexical(d)
    near = d.benchmark_queries().select("query_id", F.explode(F.array(*[F.col("query_id") * 4 + k for k in range(12)])).alias("doc_id"))
    some = lex.where("doc_id % 2 = 0").select("query_id", "doc_id")
    other = near.unionByName(some).distinct().withColumn("score", (F.col("doc_id") % 97).cast("double"))
    other = R.ranked(other, "query_id", [F.desc("score"), F.asc("doc_id")])
    return R.fused(lex, other).select("query_id", "doc_id", "fused_score", "rank")


def authority_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    lex = lexical(d)
    rows = lex.join(d.legal_documents().select("doc_id", "doc_type", "court", "coram", "current_validity"), "doc_id").where("current_validity = 'GOOD_LAW'")
    tier = R.authority_tier(F.col("doc_type"), F.col("court"), F.col("coram"), F.lit("Bombay High Court"))
    rows = rows.select("query_id", "doc_id", F.least(F.col("score") / 100, F.lit(1.0)).alias("rerank_score"), tier.alias("tier"))
    return R.authority_order(rows).select("query_id", "doc_id", "tier", "authority", "rank")


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole retrieval: fusion of lexical and dense lists, reranking with what else speaks for a result, authority quotas."""
    d = Domain(spark, sf_dir)
    i = F.col("doc_id")
    q = analysed(d).withColumn("query_tokens", T.tokens(F.col("query"))).drop("query", "courts", "numbers", "time_sensitive", "reference_date")
    docs = d.legal_documents().where("current_validity = 'GOOD_LAW'").withColumn("section", F.when(F.col("doc_type") != "judgment", (i % 40).cast("string"))).withColumn("title", F.when(F.col("doc_type") == "judgment", F.concat(F.lit("Party "), i.cast("string"), F.lit(" v State")))).withColumn("areas", areas())
    # a table of known size meets the texts where they are read
    rows = stored(hybrid(d).join(q, "query_id")).join(docs, "doc_id")
    bonus = R.rerank_bonus(F.col("entities"), F.col("sections"), F.col("query_type"), F.col("practice_area"), F.col("title"), F.col("section"), F.col("doc_type"), F.col("areas"))
    score = R.rerank_score(F.col("query_tokens"), T.tokens(F.col("text")), F.col("dense_score"), F.col("lexical_score"), bonus)
    rows = R.ranked(rows.withColumn("rerank_score", F.round(score, 6)), "query_id", [F.desc("rerank_score"), F.asc("doc_id")], 8, name="reranked")
    rows = rows.withColumn("tier", R.authority_tier(F.col("doc_type"), F.col("court"), F.col("coram"), F.lit("All India")))
    return R.authority_order(rows.select("query_id", "doc_id", "rerank_score", "tier"))


def embedded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as points: a third is stored and unchanged, a third stored with another text, the rest new."""
    d = Domain(spark, sf_dir)
    docs = d.legal_documents().select(F.col("doc_id").alias("chunk_id"), "doc_id", "doc_type", "court", F.when(F.col("doc_id") % 2 == 0, F.col("current_validity")).alias("current_validity"), "text")
    stored = docs.where("doc_id % 3 < 2").select("chunk_id", F.lit(MODEL).alias("model"), F.lit(VERSION).alias("version"), F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise("old").alias("checksum"))
    p = projected(docs, stored, collection(F.col("doc_type"), F.col("court")))
    return p.select("point_id", "collection", "chunk_id", F.size("vector").alias("dimension"), "payload", "checksum")


def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Domain(spark, sf_dir).table("benchmark").select("item_id", F.posexplode(embedding(F.col("text"))).alias("dimension", "value"))
    return b.select("item_id", "dimension", F.round("value", 4).alias("value"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the one that follows it."""
    e = Domain(spark, sf_dir).table("embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    return e.join(n, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("following")), 4).alias("cosine"))


def refined_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of refined queries, each document once: the last query's value holds."""
    c = Domain(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_quantity")
    w = Window.partitionBy("doc_id").orderBy(F.desc("l_linenumber"), F.desc("l_quantity"))
    return c.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "l_linenumber", "l_quantity")


IR = f"""
WITH {LEXICAL}, {QRELS},
r AS (SELECT l.query_id AS case_id, l.doc_id, l.rank AS i, coalesce(CAST(relevant AS INT), 0) AS hit, (pow(2, coalesce(grade, 0)) - 1) / log2(l.rank + 1) AS gain
      FROM lexical l LEFT JOIN qrels g ON g.case_id = l.query_id AND g.doc_id = l.doc_id),
h AS (SELECT *, sum(hit) OVER (PARTITION BY case_id ORDER BY i) AS hits FROM r),
found AS (SELECT case_id, sum(CASE WHEN i <= 1 THEN hit ELSE 0 END) AS h1, sum(CASE WHEN i <= 5 THEN hit ELSE 0 END) AS h5, sum(CASE WHEN i <= 10 THEN hit ELSE 0 END) AS h10,
  sum(CASE WHEN i <= 1 THEN gain ELSE 0 END) AS d1, sum(CASE WHEN i <= 5 THEN gain ELSE 0 END) AS d5, sum(CASE WHEN i <= 10 THEN gain ELSE 0 END) AS d10,
  min(CASE WHEN hit = 1 THEN i END) AS first_hit, sum(CASE WHEN hit = 1 THEN hits / i ELSE 0 END) AS psum FROM h GROUP BY case_id),
o AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, doc_id) AS i FROM qrels),
w AS (SELECT case_id, count(*) AS n, sum(CASE WHEN i <= 1 THEN 1 / log2(i + 1) ELSE 0 END) AS i1, sum(CASE WHEN i <= 5 THEN 1 / log2(i + 1) ELSE 0 END) AS i5, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) ELSE 0 END) AS i10 FROM o GROUP BY case_id),
metrics AS (SELECT w.case_id, round(coalesce(h1, 0) / 1, 6) AS p_1, round(coalesce(h1, 0) / n, 6) AS r_1, round(coalesce(d1, 0) / i1, 6) AS ndcg_1,
  round(coalesce(h5, 0) / 5, 6) AS p_5, round(coalesce(h5, 0) / n, 6) AS r_5, round(coalesce(d5, 0) / i5, 6) AS ndcg_5,
  round(coalesce(h10, 0) / 10, 6) AS p_10, round(coalesce(h10, 0) / n, 6) AS r_10, round(coalesce(d10, 0) / i10, 6) AS ndcg_10,
  round(coalesce(1 / first_hit, 0), 6) AS rr, round(coalesce(psum, 0) / n, 6) AS ap FROM w LEFT JOIN found USING (case_id))
"""
VALIDITY = "v AS (SELECT t.doc_id, CASE WHEN toxic = 1 THEN 'OVERRULED' ELSE 'GOOD_LAW' END AS current_validity FROM documents t LEFT JOIN labels USING (doc_id))"
COURT = "CASE doc_id % 4 WHEN 0 THEN 'Supreme Court' WHEN 1 THEN 'Bombay High Court' WHEN 2 THEN 'Delhi High Court' ELSE 'NCLT Principal Bench' END"

FUSED = """fu AS (SELECT coalesce(l.query_id, o.query_id) AS query_id, coalesce(l.doc_id, o.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + o.rank), 0), 9) AS fused_score, l.rank AS a, o.rank AS b FROM lexical l FULL JOIN other o ON o.query_id = l.query_id AND o.doc_id = l.doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, a NULLS LAST, b NULLS LAST, doc_id) AS rank FROM fu),
fused AS (SELECT fr.query_id, fr.doc_id, fused_score, fr.rank, l.score AS lexical_score, o.dense_score FROM fr LEFT JOIN lexical l ON l.query_id = fr.query_id AND l.doc_id = fr.doc_id LEFT JOIN (SELECT query_id, doc_id, rank AS dr, score AS dense_score FROM other) o ON o.query_id = fr.query_id AND o.doc_id = fr.doc_id WHERE fr.rank <= 30)"""
#: Hashed embeddings of documents and items, the filters of collections, cosine.
DENSE = """wd AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS word FROM documents), wq AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS word FROM benchmark),
hv AS (SELECT word, k, CAST('0x' || substr(sha256(word), 2 * k + 1, 2) AS INT) / 255.0::DOUBLE - 0.5 AS x FROM (SELECT word FROM wd UNION SELECT word FROM wq), range(24) t(k)),
dv AS (SELECT doc_id, k, sum(n * x) AS v FROM (SELECT doc_id, word, count(*) AS n FROM wd GROUP BY ALL) JOIN hv USING (word) GROUP BY ALL), qv AS (SELECT item_id, k, sum(n * x) AS v FROM (SELECT item_id, word, count(*) AS n FROM wq GROUP BY ALL) JOIN hv USING (word) GROUP BY ALL),
pt AS (SELECT doc_id, doc_id % 5 < 3 AS judgment, doc_id % 5 = 3 AS statute, COURTS AS court, current_validity = 'GOOD_LAW' AS good, CAST(DATE '1950-01-01' + CAST(doc_id AS INT) AS DATE) AS date FROM v),
cs AS (SELECT a.item_id AS query_id, b.doc_id, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v)) / sqrt(sum(b.v * b.v)), 6) AS score FROM qv a JOIN dv b USING (k) GROUP BY ALL),
co AS (SELECT cs.* FROM cs JOIN pt USING (doc_id) WHERE good AND NOT (statute AND doc_id % 10 = 3) AND (query_id % 4 <> 1 OR judgment) AND (NOT statute OR query_id % 7 <> 0 OR doc_id % 40 = query_id % 40)
  AND (NOT judgment OR court = 'Supreme Court' OR court = CASE WHEN query_id % 2 = 0 THEN 'Bombay High Court' ELSE 'Delhi High Court' END) AND (NOT judgment OR query_id % 3 <> 0 OR date <= DATE '1951-06-01') AND (statute OR query_id % 5 <> 0 OR doc_id % 3 = 0)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM co) WHERE rank <= 20)""".replace("COURTS", COURT)
RANKED = """a AS (SELECT *, CASE WHEN tier <= 8 THEN 'binding' ELSE 'persuasive' END AS authority, row_number() OVER (PARTITION BY query_id ORDER BY -CAST(trunc(rs / 0.05::DOUBLE) AS INT), tier, rs DESC, doc_id) AS overall FROM t),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, authority ORDER BY overall) AS n2 FROM a), x AS (SELECT *, CASE WHEN authority = 'binding' THEN n2 <= 5 ELSE n2 <= 3 END AS chosen FROM c),
y AS (SELECT *, sum(CAST(chosen AS INT)) OVER (PARTITION BY query_id) < least(count(*) OVER (PARTITION BY query_id), 8) AS short FROM x)"""

QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_valid_only": bm25_valid_only,
    "corpus_statistics": corpus_statistics,
    "document_frequencies": document_frequencies,
    "ir_metrics": ir_metrics,
    "ir_summary": ir_summary,
    "dense_topk": dense_topk,
    "filtered_points": filtered_points,
    "rrf_fusion": rrf_fusion,
    "authority_ranking": authority_ranking,
    "hybrid_retrieval": hybrid_retrieval,
    "embedded_points": embedded_points,
    "hashed_embeddings": hashed_embeddings,
    "vector_pairs": vector_pairs,
    "refined_union": refined_union,
}
ORACLE_SQL = {
    "bm25_topk": f"WITH {LEXICAL} SELECT query_id, doc_id, score, rank FROM lexical",
    "bm25_valid_only": f"WITH {LEXICAL}, {VALIDITY} SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m JOIN v USING (doc_id) WHERE current_validity = 'GOOD_LAW') WHERE rank <= 10",
    "corpus_statistics": f"WITH d AS (SELECT {TOKENS} AS tokens FROM documents) SELECT count(*) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS total_length, round(avg(len(tokens)), 6) AS avg_length FROM d",
    "document_frequencies": f"SELECT token, count(*) AS df FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token",
    "ir_metrics": IR + "SELECT * FROM metrics",
    "ir_summary": IR + "SELECT count(*) AS n_cases, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ["p_1", "r_1", "ndcg_1", "p_5", "r_5", "ndcg_5", "p_10", "r_10", "ndcg_10", "rr", "ap"]) + " FROM metrics",
    "dense_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(list_cosine_similarity(q.v, p.v), 6) AS score FROM e q, e p WHERE q.vec_id % 25 = 0)
SELECT query_id, point_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s) WHERE rank <= 10""",
    "filtered_points": """SELECT * FROM (SELECT vec_id, label, CAST(vec_id % 9 + 1 AS INT) AS bench_size, CASE WHEN vec_id % 3 = 0 THEN 'OVERRULED' ELSE 'GOOD_LAW' END AS current_validity FROM embeddings)
WHERE current_validity = 'GOOD_LAW' AND bench_size >= 3 AND bench_size < 8 AND (label IN (1, 2, 3) OR bench_size = 7) AND label <> 2""",
    "rrf_fusion": f"""WITH {LEXICAL}, o AS (SELECT query_id, doc_id FROM lexical WHERE doc_id % 2 = 0 UNION SELECT item_id, item_id * 4 + k FROM benchmark, range(12) r(k)), other AS (SELECT query_id, doc_id, doc_id % 97 AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 97 DESC, doc_id) AS rank FROM o), {FUSED}
SELECT query_id, doc_id, fused_score, rank FROM fused""",
    "hybrid_retrieval": f"""WITH {LEXICAL}, {VALIDITY}, {DENSE}, other AS (SELECT query_id, doc_id, score, rank FROM dense), {FUSED},
r0 AS (SELECT fu.query_id, fu.doc_id, least(1.0, 0.35 * CASE WHEN len(q.asked) = 0 OR len(t.tokens) = 0 THEN 0 ELSE len(list_intersect(q.asked, t.tokens)) / len(q.asked) END + CASE WHEN coalesce(dense_score, 0) <> 0 THEN 0.30 * (dense_score + 1) / 2 ELSE 0 END + 0.20 * least(coalesce(lexical_score, 0) / 6, 1.0)
  + CASE WHEN judgment AND contains('party ' || fu.doc_id || ' v state', 'party ' || (fu.query_id * 3) || ' v state') THEN 0.12 ELSE 0 END + CASE WHEN NOT judgment AND fu.doc_id % 40 = fu.query_id % 40 THEN 0.22 ELSE 0 END + CASE WHEN fu.query_id % 4 = 0 AND NOT judgment THEN 0.18 ELSE 0 END
  + CASE WHEN fu.query_id % 5 = 0 AND fu.doc_id % 3 = 0 THEN 0.05 ELSE 0 END) AS s, judgment, court, 1 + fu.doc_id % 9 AS coram
  FROM fused fu JOIN (SELECT item_id AS query_id, {TOKENS} AS asked FROM benchmark) q USING (query_id) JOIN pt ON pt.doc_id = fu.doc_id JOIN d t ON t.doc_id = fu.doc_id WHERE good),
r1 AS (SELECT *, round(s, 6) AS rs, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS n FROM r0),
t AS (SELECT *, CASE WHEN NOT judgment THEN 0 WHEN court = 'Supreme Court' THEN CASE WHEN coram >= 9 THEN 1 WHEN coram >= 5 THEN 2 WHEN coram >= 3 THEN 3 WHEN coram >= 2 THEN 4 ELSE 5 END WHEN contains(court, 'High Court') THEN 9 ELSE 10 END AS tier FROM r1 WHERE n <= 8), {RANKED}
SELECT query_id, doc_id, rs AS rerank_score, tier, authority, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT chosen THEN 2 WHEN authority = 'binding' THEN 0 ELSE 1 END, overall) AS rank FROM y WHERE chosen OR short""",
    "embedded_points": f"""WITH {VALIDITY}, x AS (SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'statute' WHEN 4 THEN 'constitution' ELSE 'judgment' END AS kind, {COURT} AS court, CASE WHEN doc_id % 2 = 0 THEN current_validity END AS ok, sha256(text) AS checksum FROM documents JOIN v USING (doc_id) WHERE doc_id % 3 > 0),
y AS (SELECT *, CASE kind WHEN 'statute' THEN 'statutes' WHEN 'constitution' THEN 'constitution' ELSE CASE court WHEN 'Supreme Court' THEN 'sc_judgments' ELSE 'hc_judgments' END END AS collection FROM x)
SELECT sha1(collection || '|' || doc_id) AS point_id, collection, doc_id AS chunk_id, 24 AS dimension, '{{"doc_id":' || doc_id || ',"chunk_id":' || doc_id || ',"doc_type":"' || kind || '","court":"' || court || '"' || CASE WHEN ok IS NULL THEN '' ELSE ',"current_validity":"' || ok || '"' END || ',"collection_name":"' || collection || '","embedding_model":"{MODEL}","embedding_version":"{VERSION}"}}' AS payload, checksum FROM y""",
    "authority_ranking": f"""WITH {LEXICAL}, {VALIDITY},
r AS (SELECT query_id, doc_id, least(score / 100, 1.0) AS rs, {COURT} AS court, 1 + doc_id % 9 AS coram, doc_id % 5 AS k FROM lexical JOIN v USING (doc_id) WHERE current_validity = 'GOOD_LAW'),
t AS (SELECT *, CASE WHEN k IN (3, 4) THEN 0 WHEN court = 'Supreme Court' THEN CASE WHEN coram >= 9 THEN 1 WHEN coram >= 5 THEN 2 WHEN coram >= 3 THEN 3 WHEN coram >= 2 THEN 4 ELSE 5 END
  WHEN court = 'Bombay High Court' THEN CASE WHEN coram >= 3 THEN 6 WHEN coram >= 2 THEN 7 ELSE 8 END WHEN court = 'Delhi High Court' THEN 9 ELSE 10 END AS tier FROM r),
a AS (SELECT *, CASE WHEN tier <= 8 THEN 'binding' ELSE 'persuasive' END AS authority, row_number() OVER (PARTITION BY query_id ORDER BY -CAST(trunc(rs / 0.05::DOUBLE) AS INT), tier, rs DESC, doc_id) AS overall FROM t),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, authority ORDER BY overall) AS n FROM a),
x AS (SELECT *, CASE WHEN authority = 'binding' THEN n <= 5 ELSE n <= 3 END AS chosen FROM c),
y AS (SELECT *, sum(CAST(chosen AS INT)) OVER (PARTITION BY query_id) < least(count(*) OVER (PARTITION BY query_id), 8) AS short FROM x)
SELECT query_id, doc_id, tier, authority, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT chosen THEN 2 WHEN authority = 'binding' THEN 0 ELSE 1 END, overall) AS rank FROM y WHERE chosen OR short""",
    "hashed_embeddings": """WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda x: x <> '')) AS word FROM benchmark),
g AS (SELECT item_id, d AS dimension, sum(CAST('0x' || substr(sha256(word), 2 * d + 1, 2) AS INT) / 255.0::DOUBLE - 0.5) AS v FROM w, range(24) t(d) GROUP BY item_id, d)
SELECT item_id, CAST(dimension AS INT) AS dimension, round(round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 8), 4) AS value FROM g""",
    "vector_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "refined_union": "SELECT doc_id, l_linenumber, l_quantity FROM (SELECT l_orderkey AS doc_id, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) AS n FROM lineitem) WHERE n = 1",
}
