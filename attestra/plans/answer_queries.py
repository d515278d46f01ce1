"""Published queries: verified answers, from retrieval to badges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations as C
from ..operators import execution as X
from ..operators import retrieval as R
from ..operators import verify as V
from .citation_queries import _word, word
from .document_queries import SQUEEZED
from .domain import Domain
from .retrieval_queries import COURT, LEXICAL, TOKENS, VALIDITY
from .text_queries import CLAIM, FIRST_SENTENCE

KINDS = ["statutory_lookup", "case_specific", "general_legal"]


def asked(d: Domain) -> DataFrame:
    i = F.col("item_id")
    return d.table("benchmark").select(i.alias("query_id"), F.col("text").alias("query"), F.element_at(F.array(*map(F.lit, KINDS)), (i % len(KINDS) + 1).cast("int")).alias("query_type"))


def corpus(d: Domain) -> DataFrame:
    """Documents with what a placeholder and an answer say of them."""
    i, law = F.col("doc_id"), F.col("doc_type") != "judgment"
    return d.legal_documents().select(
        "doc_id", "text", "doc_type", "court", "current_validity", F.when(law, F.concat_ws(" ", word(i, 2), F.lit("act"))).alias("act"), F.when(law, i.cast("string")).alias("section"), F.concat(F.lit("on matter "), i.cast("string")).alias("issue"),
        F.when(~law & (i % 3 == 0), F.concat(F.lit("AIR "), i.cast("string"))).alias("citation"), F.when(~law & (i % 7 != 0), F.concat(F.lit("Party "), i.cast("string"))).alias("appellant"), F.when(~law, F.lit("State")).alias("respondent"), F.array().cast("array<string>").alias("practice_areas"),
    )


def found(d: Domain, queries: DataFrame) -> DataFrame:
    """The ten best documents of good law, of those that a query's number leaves open: judgments, law, none or all."""
    ranked = R.bm25(queries.select("query_id", T.tokens(F.col("query")).alias("tokens")), d.document_tokens(), 10, valid=F.col("current_validity") == "GOOD_LAW", about=d.legal_documents().select("doc_id", "current_validity"))
    r = ranked.select("query_id", "doc_id", "rank").join(corpus(d).select("doc_id", "doc_type", "act", "section", "court", "issue", "text"), "doc_id")
    i, law = F.col("query_id"), F.col("doc_type") != "judgment"
    return r.where(F.when(i % 9 == 5, False).when(i % 4 == 0, ~law).when(i % 4 == 1, law).otherwise(True))


def halves(d: Domain) -> DataFrame:
    """Passages of documents: their halves, of every third the second alone."""
    i, n = F.col("doc_id"), F.floor(F.char_length("text") / 2).cast("int")
    k = corpus(d).select("*", F.posexplode(F.array(F.substr("text", F.lit(1), n), F.substr("text", n + 1))).alias("chunk_index", "chunk_text")).where((i % 3 != 0) | (F.col("chunk_index") == 1))
    none = F.lit(None).cast("string")
    return k.select("doc_id", (i * 2 + F.col("chunk_index")).alias("chunk_id"), "chunk_index", "chunk_text", none.alias("header"), "act", "section", F.when(F.col("act").isNotNull(), True).alias("in_force"), F.lit("GOOD_LAW").alias("chunk_validity"), none.alias("chunk_citation"))


def verified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item asked: documents found, a draft, placeholders resolved, claims held against the passages of their source, badges, and what the answer is worth."""
    d = Domain(spark, sf_dir)
    queries, documents, chunks = asked(d), corpus(d), halves(d)

    def resolve(paragraphs: DataFrame) -> DataFrame:
        p = paragraphs.select("query_id", "token", "kind", "doc_id").distinct()
        p = p.withColumn("description", F.expr("substr(token, length(kind) + 4, length(token) - length(kind) - 4)")).withColumn("placeholder_id", F.concat_ws("|", F.col("query_id").cast("string"), "token")).withColumn("chunk_id", F.col("doc_id") * 2 + 1)
        done = C.resolved_placeholders(p.select("placeholder_id", "kind", "description", "doc_id", "chunk_id"), documents.drop("text", "issue", "act", "section").withColumn("body", F.lit("")), chunks)
        return p.select("placeholder_id", "query_id", "token").join(done.select("placeholder_id", "rendered", (F.col("status") == "VERIFIED").alias("verified"), "citation", "doc_id", "message"), "placeholder_id").drop("placeholder_id")

    def cite(claims: DataFrame, resolutions: DataFrame) -> DataFrame:
        c = claims.select("claim_id", "claim", F.col("answer_id").alias("query_id"), F.posexplode("tokens").alias("position", "token")).join(resolutions, ["query_id", "token"])
        key = F.concat_ws("#", "claim_id", F.col("position").cast("string"))
        checked = V.checked_claims(c.where("verified").select(key.alias("claim_id"), "claim", "doc_id", (F.col("doc_id") * 2).alias("preferred_chunk")), chunks.withColumnRenamed("chunk_text", "text"))
        grounded = checked.select(F.col("claim_id").alias("key"), F.col("status").alias("grounding"))
        return c.withColumn("key", key).join(grounded, "key", "left").select("claim_id", "position", "verified", F.coalesce("citation", "rendered").alias("citation"), "grounding", (F.col("doc_id") % 11 == 0).alias("pending"), F.concat(F.lit("source is "), F.lower("grounding")).alias("reason"), "doc_id")

    out = X.executed(queries, lambda q: found(d, q), resolve, cite)
    of_claims = out["claims"].select("claim_id", F.col("answer_id").alias("query_id"), F.posexplode("tokens").alias("position", "token")).join(out["resolutions"].drop("citation"), ["query_id", "token"]).drop("query_id")
    badges = X.badges(out["claims"], of_claims).groupBy(F.substring_index("claim_id", "|", 1).cast("long").alias("query_id")).agg(F.count("*").alias("n_badges"), F.count_if(F.col("status") == "UNVERIFIED").alias("n_unverified"))
    a = out["answers"].withColumnRenamed("answer_id", "query_id")
    return queries.select("query_id").join(a, "query_id", "left").join(badges, "query_id", "left").join(out["text"].select("query_id", F.md5("text").alias("text")), "query_id", "left")


QUERIES = {"verified_answers": verified_answers}
TOKENS_OF = lambda c: TOKENS.replace("lower(text)", f"lower({c})")
LAW = "(doc_id % 5 >= 3)"
ANSWERED = rf"""{LEXICAL}, {VALIDITY},
qs AS (SELECT item_id AS query_id, text AS query, ([{', '.join(f"'{k}'" for k in KINDS)}])[item_id % 3 + 1] AS kind FROM benchmark),
tp AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m JOIN v USING (doc_id) WHERE current_validity = 'GOOD_LAW'),
fd AS (SELECT query_id, doc_id, {LAW} AS law, row_number() OVER (PARTITION BY query_id, {LAW} ORDER BY rank) AS n FROM tp WHERE rank <= 10 AND CASE WHEN query_id % 9 = 5 THEN FALSE WHEN query_id % 4 = 0 THEN NOT {LAW} WHEN query_id % 4 = 1 THEN {LAW} ELSE TRUE END),
dr AS (SELECT * FROM fd WHERE n <= CASE WHEN law THEN 2 ELSE 3 END),
us AS (SELECT DISTINCT doc_id, law FROM dr), fs AS (SELECT doc_id, law, text, {SQUEEZED} AS t FROM us JOIN documents USING (doc_id)),
ex AS (SELECT doc_id, text, {CLAIM.format(f"regexp_replace({FIRST_SENTENCE}, '{T.REPORTER}', '', 'g')")} AS said,
  CASE WHEN law THEN {_word('doc_id', 2)} || ' act, Section ' || doc_id WHEN doc_id % 7 <> 0 THEN 'Party ' || doc_id || ' v State' || CASE WHEN doc_id % 3 = 0 THEN ', AIR ' || doc_id ELSE '' END WHEN doc_id % 3 = 0 THEN 'AIR ' || doc_id ELSE {COURT} END AS named FROM fs),
cl AS (SELECT doc_id, trim(c) AS c, i FROM (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace({CLAIM.format("said")}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS cs FROM ex)) WHERE trim(c) <> ''),
hv AS (SELECT doc_id, k, CASE k WHEN 0 THEN substr(text, 1, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END AS p FROM ex, (SELECT unnest([0, 1]) AS k) WHERE doc_id % 3 <> 0 OR k = 1),
tx AS (SELECT p AS s FROM hv UNION SELECT c FROM cl),
hw AS (SELECT s, word, count(*) AS n FROM (SELECT s, unnest(list_filter(regexp_split_to_array(lower(trim(s)), '\s+'), lambda x: x <> '')) AS word FROM tx) GROUP BY ALL), hx AS (SELECT word, k, CAST('0x' || substr(sha256(word), 2 * k + 1, 2) AS INT) / 255.0::DOUBLE - 0.5 AS x FROM (SELECT DISTINCT word FROM hw), range(24) t(k)),
ve AS (SELECT s, list(v ORDER BY k) AS v FROM (SELECT s, k, sum(n * x) AS v FROM hw JOIN hx USING (word) GROUP BY ALL) GROUP BY s), tk AS (SELECT s, {TOKENS_OF('s')} AS t FROM tx),
st AS (SELECT {T.GROUNDING_STOPWORDS!r} AS s, {T.NEGATIONS!r} AS g),
pa AS (SELECT cl.doc_id, i, k, list_filter(a.t, lambda x: NOT list_contains(st.s, x)) AS h, list_filter(b.t, lambda x: NOT list_contains(st.s, x)) AS q, len(list_intersect(a.t, g)) > 0 AS hn, len(list_intersect(b.t, g)) > 0 AS pn, coalesce(list_cosine_similarity(x.v, y.v), 0) AS near
  FROM cl JOIN hv USING (doc_id) JOIN tk a ON a.s = c JOIN tk b ON b.s = p LEFT JOIN ve x ON x.s = c LEFT JOIN ve y ON y.s = p, st),
sc AS (SELECT *, greatest(near, share) AS sim FROM (SELECT *, CASE WHEN len(h) = 0 OR len(q) = 0 THEN 0 ELSE len(list_intersect(h, q)) / len(h) END AS share, len(list_intersect(h, q)) AS met FROM pa)),
be AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY round(least(0.55 * sim + 0.35 * share + CASE WHEN k = 0 THEN 0.1 ELSE 0 END, 1), 6) DESC, k) AS place FROM sc),
gr AS (SELECT doc_id, i, CASE WHEN met >= 2 AND hn <> pn OR share < 0.35 THEN 2 WHEN sim >= 0.82 AND share >= 0.65 AND doc_id % 11 <> 0 THEN 0 WHEN sim >= 0.55 OR share < 0.65 THEN 1 ELSE 2 END AS worth FROM be WHERE place = 1),
ct AS (SELECT query_id, count(*) FILTER (worth = 0) AS verified, count(*) FILTER (worth = 1) AS uncertain, count(*) FILTER (worth = 2) AS unsupported FROM dr JOIN gr USING (doc_id) GROUP BY query_id),
hs AS (SELECT query_id, kind, query, coalesce(bool_or(law), FALSE) AS law, coalesce(bool_or(NOT law), FALSE) AS judged FROM qs LEFT JOIN dr USING (query_id) GROUP BY ALL),
pg AS (SELECT query_id, CASE WHEN law THEN 1 ELSE 2 END AS o, n, said || ' ' || named AS p FROM dr JOIN ex USING (doc_id)
  UNION ALL SELECT query_id, 1, 1, '[UNVERIFIED: {X.NO_LAW}]' FROM hs WHERE judged AND NOT law AND kind = 'statutory_lookup' UNION ALL SELECT query_id, 2, 1, '[UNVERIFIED: {X.NO_CASE}]' FROM hs WHERE law AND NOT judged AND kind = 'case_specific'
  UNION ALL SELECT query_id, 3, 1, '{X.NOTHING} [UNVERIFIED: primary authority required for: ' || query || ']' FROM hs WHERE NOT law AND NOT judged),
bd AS (SELECT query_id, o, (['Applicable Law', 'Key Authorities', 'Research Note'])[o] || chr(10) || string_agg(p, chr(10) ORDER BY n) AS body FROM pg GROUP BY query_id, o), an AS (SELECT query_id, md5(string_agg(body, chr(10) || chr(10) ORDER BY o)) AS text FROM bd GROUP BY query_id),
wh AS (SELECT query_id, CASE WHEN law OR judged THEN verified ELSE 0 END AS verified, CASE WHEN law OR judged THEN uncertain ELSE 0 END AS uncertain, CASE WHEN law OR judged THEN unsupported ELSE 1 END AS unsupported FROM hs LEFT JOIN ct USING (query_id))"""
ORACLE_SQL = {
    "verified_answers": f"""WITH {ANSWERED} SELECT query_id, verified, uncertain, unsupported, CASE WHEN unsupported > 0 THEN 'UNSUPPORTED' WHEN uncertain > 0 THEN 'UNCERTAIN' WHEN verified > 0 THEN 'VERIFIED' END AS overall_status,
verified + uncertain + unsupported AS n_badges, unsupported AS n_unverified, text FROM wh LEFT JOIN an USING (query_id)""",
}
