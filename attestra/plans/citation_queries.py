"""Published queries: placeholders resolved, sources and sections looked up, what users see of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import appeals as A
from ..operators import citations as C
from ..operators import listings as L
from .appeal_queries import AUTHORITIES, authorities
from .domain import Domain

WORDS = ["alpha", "bravo", "carol", "delta", "echo", "foxtrot", "golf", "hotel", "india", "julia", "kilo"]


def word(i, step: int = 1):
    return F.element_at(F.array(*map(F.lit, WORDS)), (F.floor(i / step) % len(WORDS) + 1).cast("int"))


def beyond(d: Domain) -> int:
    """Ids that are asked for go a fifth beyond those of the documents."""
    return d.table("documents").count() * 6 // 5


def documents(d: Domain) -> DataFrame:
    i, law = F.col("doc_id"), F.col("doc_type") != "judgment"
    return d.legal_documents().select(
        "doc_id", "doc_type", "court", "date", F.when(~law & (i % 3 == 0), F.concat(F.lit("AIR "), i.cast("string"))).alias("citation"), F.when(~law & (i % 7 != 0), F.concat(F.lit("Party "), i.cast("string"))).alias("appellant"), F.when(~law, F.lit("State")).alias("respondent"),
        F.when(i % 2 == 0, F.array(F.lit("criminal"))).otherwise(F.array().cast("array<string>")).alias("practice_areas"), "current_validity", F.lit("body").alias("body"),
    )


def chunks(d: Domain) -> DataFrame:
    """One chunk a document, two for every tenth: sections of acts, headed parts of judgments, in words by number."""
    i, law = F.col("doc_id"), F.col("doc_type") != "judgment"
    both = F.explode(F.when(i % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    k = d.legal_documents().select("*", both.alias("chunk_index"))
    return k.select(
        "doc_id", (i * 2 + F.col("chunk_index")).alias("chunk_id"), "chunk_index", F.concat_ws(" ", word(i), word(i, 11), F.col("chunk_index").cast("string")).alias("chunk_text"), F.when(law | (i % 5 == 1), F.concat_ws(" ", F.lit("heading"), word(i, 3))).alias("header"),
        F.when(law & (i % 9 != 0), F.concat_ws(" ", word(i, 2), F.lit("act"))).alias("act"), F.when(law & (i % 6 != 0), (i % 50).cast("string")).alias("section"), F.when(law, i % 8 != 0).alias("in_force"), F.when(i % 17 == 0, "OVERRULED").otherwise("GOOD_LAW").alias("chunk_validity"),
        F.when(i % 4 == 2, F.concat(F.lit("CH "), i.cast("string"))).alias("chunk_citation"),
    )


def placeholders(d: Domain) -> DataFrame:
    """Orders as placeholders: a third come with a document, the rest describe one."""
    o = d.table("orders").where("o_orderkey is not null").select(F.col("o_orderkey").alias("k"))
    i = F.col("k")
    law = F.concat_ws(" ", word(i, 2), F.lit("act"), F.lit("section"), (i % 50).cast("string"))
    case = F.concat_ws(" ", F.lit("the high court on"), word(i), word(i, 11), F.when(i % 2 == 0, F.lit("criminal")))
    kind = F.when(i % 10 == 9, "UNSUPPORTED").when(i % 2 == 0, "STATUTE").otherwise("CITE")
    return o.select(i.alias("placeholder_id"), kind.alias("kind"), F.when(i % 2 == 0, law).otherwise(case).alias("description"), F.when(i % 3 == 0, F.floor(i / 3) % beyond(d)).alias("doc_id"), F.when(i % 6 == 0, F.floor(i / 3) % beyond(d) * 2).alias("chunk_id"))


def placeholder_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return C.resolved_placeholders(placeholders(d), documents(d), chunks(d)).withColumn("confidence", F.round("confidence", 6))


def citation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document looked up, some by a chunk of their own, some by another's."""
    d = Domain(spark, sf_dir)
    i = F.col("doc_id")
    r = d.table("documents").select(i.alias("request_id"), "doc_id", F.when(i % 20 == 0, i * 2 + 1).when(i % 7 == 0, (i + 1) * 2).alias("chunk_id"))
    c = d.table("documents").select(i.alias("citation_id"), "doc_id", F.lit(True).alias("verified"))
    v = A.validated_citations(c, authorities(d), chunks(d))
    return C.sources(r, documents(d), chunks(d), v).select("request_id", "effective_doc_id", "chunk_id", "effective_chunk_id", "citation", "effective_citation", "title", "passage", "status")


def section_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests of a section of an act: some acts and some sections are not there."""
    d = Domain(spark, sf_dir)
    r = d.table("part").select((F.col("p_partkey") % beyond(d)).alias("act_id"), (F.col("p_partkey") % 50).cast("string").alias("section")).distinct()
    acts = d.legal_documents().where("doc_type <> 'judgment'")
    statutes = acts.select("doc_id", F.concat(F.lit("act "), F.col("doc_id").cast("string")).alias("act_name"))
    sections = acts.select("doc_id", (F.col("doc_id") % 50).cast("string").alias("section"), F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("section_text")).where("doc_id % 3 > 0")
    return C.sections_found(r, statutes, sections)


def requested_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return C.judgments(d.table("part").select((F.col("p_partkey") % beyond(d)).alias("doc_id")), documents(d)).select("doc_id", "court", "citation")


def workspace_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Domain(spark, sf_dir).table("events")
    h = e.select(F.col("event_id").alias("query_id"), "user_id", F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 4).cast("string")).alias("workspace_id"), F.col("ts").alias("created_at"))
    return L.queries_of_workspaces(h, 5).select("user_id", "workspace_id", "rank", "query_id")


def user_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Domain(spark, sf_dir).table("orders")
    none = F.lit(None).cast("string")
    c = o.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("owner_id"), F.col("o_clerk").alias("appellant") if "o_clerk" in o.columns else none.alias("appellant"), none.alias("respondent"), none.alias("court"), none.alias("case_number"), F.col("o_orderstatus").alias("stage"), none.alias("case_type"),
        F.lit(1).alias("n_documents"), F.to_date("o_orderdate").alias("updated_at"), F.to_date("o_orderdate").alias("created_at"),
    )
    return L.workspaces_of_users(c).select("owner_id", "rank", "case_id", "stage")


def kept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = Domain(spark, sf_dir).table("lineitem")  # noqa: E741
    a = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("answer_id"), (F.col("l_suppkey") % 10).alias("user_id"), F.col("l_returnflag").alias("workspace_id"), F.to_date("l_shipdate").alias("created_at"))
    return L.saved_answers(a.distinct()).select("user_id", "workspace_id", "rank", "answer_id")


W = "['" + "', '".join(WORDS) + "']"


def _word(i: str, step: int = 1) -> str:
    return f"({W})[(({i}) // {step}) % {len(WORDS)} + 1]"


CORPUS = f"""dc AS (SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'statute' WHEN 4 THEN 'constitution' ELSE 'judgment' END AS doc_type, doc_id % 5 >= 3 AS law, CASE doc_id % 4 WHEN 0 THEN 'Supreme Court' WHEN 1 THEN 'Bombay High Court' WHEN 2 THEN 'Delhi High Court' ELSE 'NCLT Principal Bench' END AS court,
  CASE WHEN doc_id % 5 < 3 AND doc_id % 3 = 0 THEN 'AIR ' || doc_id END AS citation, CASE WHEN doc_id % 5 < 3 AND doc_id % 7 <> 0 THEN 'Party ' || doc_id || ' v State' END AS name, doc_id % 2 = 0 AS criminal, coalesce(toxic, 0) = 0 AS good FROM documents LEFT JOIN labels USING (doc_id)),
ck AS (SELECT doc_id, doc_id * 2 + i AS chunk_id, i AS chunk_index, {_word('doc_id')} || ' ' || {_word('doc_id', 11)} || ' ' || i AS chunk_text, CASE WHEN law OR doc_id % 5 = 1 THEN 'heading ' || {_word('doc_id', 3)} END AS header,
  CASE WHEN law AND doc_id % 9 <> 0 THEN {_word('doc_id', 2)} || ' act' END AS act, CASE WHEN law AND doc_id % 6 <> 0 THEN CAST(doc_id % 50 AS VARCHAR) END AS section, NOT (law AND doc_id % 8 = 0) AS live, doc_id % 17 <> 0 AS cgood, CASE WHEN doc_id % 4 = 2 THEN 'CH ' || doc_id END AS chunk_citation FROM dc, range(2) r(i) WHERE i = 0 OR doc_id % 10 = 0)"""
RENDERED = """CASE WHEN {k} = 'STATUTE' THEN CASE WHEN section IS NOT NULL THEN coalesce(act, court) || ', Section ' || section ELSE coalesce(header, act, court) END
 ELSE coalesce(name || ', ' || coalesce(citation, chunk_citation), citation, chunk_citation, name, court) END"""
SPLIT = r"list_distinct(regexp_extract_all(lower({0}), '[a-z]+[a-z0-9]*|\d+[a-z]?'))"
PLACEHOLDERS = f"""ph AS (SELECT o_orderkey AS pid, CASE WHEN o_orderkey % 10 = 9 THEN 'UNSUPPORTED' WHEN o_orderkey % 2 = 0 THEN 'STATUTE' ELSE 'CITE' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN {_word('o_orderkey', 2)} || ' act section ' || (o_orderkey % 50)
 ELSE 'the high court on ' || {_word('o_orderkey')} || ' ' || {_word('o_orderkey', 11)} END AS description, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 % (SELECT count(*) * 6 // 5 FROM documents) END AS gd, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey // 3 % (SELECT count(*) * 6 // 5 FROM documents) * 2 END AS gc FROM orders),
di AS (SELECT pid, 1.0::DOUBLE AS score, gd AS doc_id, ck.chunk_id, '{C.DIRECT}' AS message FROM ph JOIN dc ON dc.doc_id = gd AND good LEFT JOIN ck ON ck.chunk_id = gc WHERE kind <> 'UNSUPPORTED' AND (ck.chunk_id IS NULL OR (cgood AND (kind <> 'STATUTE' OR live)))),
uq AS (SELECT DISTINCT kind, description FROM ph WHERE kind <> 'UNSUPPORTED' AND pid NOT IN (SELECT pid FROM di)),
sa AS (SELECT description, chunk_id, doc_id, least(1.0, len(list_intersect(asked, own)) / len(asked) + CASE WHEN act IS NOT NULL AND contains(description, act) THEN 0.35 ELSE 0 END + CASE WHEN section IS NOT NULL AND contains(description, 'section ' || section) THEN 0.45 ELSE 0 END) AS score
  FROM (SELECT description, {SPLIT.format('description')} AS asked FROM uq WHERE kind = 'STATUTE') a, (SELECT ck.*, {SPLIT.format("concat_ws(' ', act, section, header, chunk_text)")} AS own FROM ck JOIN dc USING (doc_id) WHERE law AND good AND live) c),
ca AS (SELECT description, chunk_id, doc_id, least(1.0, len(list_intersect(asked, own)) / len(asked) + CASE WHEN contains(court, 'High Court') THEN 0.25 ELSE 0 END + CASE WHEN header IS NOT NULL AND len(list_intersect(asked, hown)) / len(asked) > 0.5 THEN 0.10 ELSE 0 END) AS score
  FROM (SELECT description, list_filter({SPLIT.format('description')}, lambda x: x NOT IN ('the', 'high', 'court', 'on')) AS asked FROM uq WHERE kind = 'CITE') a,
  (SELECT ck.*, court, {SPLIT.format("concat_ws(' ', court, header, CASE WHEN criminal THEN 'criminal' END, chunk_text)")} AS own, {SPLIT.format("coalesce(header, '')")} AS hown FROM ck JOIN dc USING (doc_id) WHERE NOT law AND good) c),
be AS (SELECT description, round(score, 6) AS score, doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY description ORDER BY round(score, 6) DESC, chunk_id) AS n FROM (SELECT * FROM sa UNION ALL SELECT * FROM ca)) WHERE n = 1),
fo AS (SELECT * FROM di UNION ALL SELECT pid, score, doc_id, chunk_id, '{C.SEARCHED}' FROM ph JOIN be USING (description) WHERE kind <> 'UNSUPPORTED' AND pid NOT IN (SELECT pid FROM di) AND score >= CASE kind WHEN 'STATUTE' THEN 0.85 ELSE 0.80 END)"""
QUERIES = {f.__name__: f for f in [placeholder_resolution, citation_sources, section_lookups, requested_judgments, workspace_queries, user_workspaces, kept_answers]}
ORACLE_SQL = {
    "placeholder_resolution": f"""WITH {CORPUS}, {PLACEHOLDERS}
SELECT ph.pid AS placeholder_id, CASE WHEN score IS NOT NULL THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status, CASE WHEN score IS NOT NULL THEN {RENDERED.format(k='ph.kind')} ELSE '[UNVERIFIED: ' || ph.description || ']' END AS rendered,
CASE WHEN score IS NOT NULL THEN CASE WHEN ph.kind = 'STATUTE' THEN CASE WHEN section IS NOT NULL THEN coalesce(act, court) || ', Section ' || section WHEN fo.chunk_id IS NOT NULL THEN coalesce(act, court) END ELSE coalesce(citation, chunk_citation) END END AS citation,
fo.doc_id, fo.chunk_id, coalesce(score, 0) AS confidence, CASE WHEN score IS NOT NULL THEN message WHEN ph.kind = 'UNSUPPORTED' THEN '{C.UNSUPPORTED}' ELSE '{C.MISSING}' END AS message
FROM ph LEFT JOIN fo USING (pid) LEFT JOIN dc ON dc.doc_id = fo.doc_id LEFT JOIN ck ON ck.chunk_id = fo.chunk_id""",
    "citation_sources": f"""WITH RECURSIVE {CORPUS}, {AUTHORITIES},
rq AS (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN doc_id * 2 + 1 WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id * 2 END AS chunk_id FROM dc),
st AS (SELECT au.*, NOT pending AND use_doc_id <> doc_id AS moved, CASE WHEN pending THEN 'PENDING' WHEN outcome = 'REVERSED' AND use_doc_id <> doc_id THEN 'REDIRECTED' WHEN outcome IN ('MODIFIED', 'REMANDED') THEN outcome WHEN outcome = 'DISMISSED' AND warning IS NOT NULL THEN 'DISMISSED' ELSE 'VALID' END AS status FROM au),
og AS (SELECT rq.doc_id, rq.chunk_id, law, {RENDERED.format(k="CASE WHEN law THEN 'STATUTE' ELSE 'CITE' END")} AS citation FROM rq JOIN dc ON dc.doc_id = rq.doc_id JOIN ck ON ck.chunk_id = rq.chunk_id),
ef AS (SELECT og.doc_id AS request_id, og.chunk_id, og.citation AS own, og.law AS own_law, status, CASE WHEN moved THEN use_doc_id ELSE og.doc_id END AS e, CASE WHEN moved THEN use_doc_id * 2 ELSE og.chunk_id END AS ec FROM og JOIN st USING (doc_id))
SELECT request_id, e AS effective_doc_id, ef.chunk_id, ec AS effective_chunk_id, own AS citation, {RENDERED.format(k="CASE WHEN own_law THEN 'STATUTE' ELSE 'CITE' END")} AS effective_citation,
coalesce(name, act || ', Section ' || section, header, citation, court) AS title, chunk_text AS passage, status FROM ef JOIN dc ON dc.doc_id = e JOIN ck ON ck.chunk_id = ec""",
    "section_lookups": "WITH r AS (SELECT DISTINCT p_partkey % (SELECT count(*) * 6 // 5 FROM documents) AS act_id, CAST(p_partkey % 50 AS VARCHAR) AS section FROM part) SELECT act_id, section, CASE WHEN doc_id IS NOT NULL THEN 'act ' || doc_id END AS act_name, CASE WHEN doc_id % 3 > 0 AND section = CAST(doc_id % 50 AS VARCHAR) THEN 'text ' || doc_id END AS section_text, CASE WHEN doc_id IS NULL THEN 'statute' WHEN NOT (doc_id % 3 > 0 AND section = CAST(doc_id % 50 AS VARCHAR)) THEN 'section' END AS missing FROM r LEFT JOIN documents ON doc_id = act_id AND doc_id % 5 >= 3",
    "requested_judgments": f"WITH {CORPUS} SELECT doc_id, court, citation FROM dc WHERE NOT law AND doc_id IN (SELECT p_partkey % (SELECT count(*) * 6 // 5 FROM documents) FROM part)",
    "workspace_queries": "SELECT user_id, workspace_id, rank, event_id AS query_id FROM (SELECT *, CAST(event_id % 4 AS VARCHAR) AS workspace_id, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE event_id % 4 > 0 AND user_id IS NOT NULL) WHERE rank <= 5",
    "user_workspaces": "SELECT o_custkey AS owner_id, rank, o_orderkey AS case_id, o_orderstatus AS stage FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 25",
    "kept_answers": "WITH a AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS answer_id, l_suppkey % 10 AS user_id, l_returnflag AS workspace_id, CAST(l_shipdate AS DATE) AS created_at FROM lineitem) SELECT user_id, workspace_id, rank, answer_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, workspace_id ORDER BY created_at DESC, answer_id DESC) AS rank FROM a) WHERE rank <= 20",
}
