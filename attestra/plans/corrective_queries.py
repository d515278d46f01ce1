"""Published queries: corrective validation of lexical results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corrective as C
from ..tables import stored
from .domain import Domain
from .graph_queries import LD
from .retrieval_queries import LEXICAL, TOKENS, lexical

TYPES = ["statutory_lookup", "case_specific", "vague_natural", "general_legal"]


def number(c: str, n: int = 40):
    return (F.col(c) % n).cast("string")


def queries(d: Domain) -> DataFrame:
    """Benchmark items as analysed queries: type, area and day by number; each names a section and a case."""
    q = d.benchmark_queries()
    section = F.concat(F.lit("Indian Evidence Act "), number("query_id"))
    case = F.concat(F.lit("party "), (F.col("query_id") * 3).cast("string"), F.lit(" v state"))
    entity = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    entities = F.when(F.col("query_id") % 5 == 0, F.array().cast("array<struct<kind:string,text:string>>")).otherwise(F.array(entity("SECTION", section), entity("CASE_NAME", case)))
    asked = F.when(F.col("query_id") % 3 == 0, F.concat_ws(" ", "text", F.lit("as the courts held"))).otherwise(F.col("text"))
    return q.select(
        "query_id", asked.alias("query"), F.element_at(F.array(*map(F.lit, TYPES)), (F.col("query_id") % 4 + 1).cast("int")).alias("query_type"), F.when(F.col("query_id") % 2 == 0, "criminal").otherwise("general").alias("practice_area"),
        F.lit("Bombay High Court").alias("jurisdiction"), F.to_date(F.when(F.col("query_id") % 2 == 0, "2024-08-01").otherwise("2023-08-01")).alias("reference_date"), F.array(section).alias("sections"), F.array().cast("array<string>").alias("equivalents"), entities.alias("entities"),
    )


def results(d: Domain) -> DataFrame:
    """The first eight lexical results of every query, each document one chunk, as a table."""
    law = F.col("doc_type") != "judgment"
    first = lexical(d, 8).select("query_id", "rank", "doc_id")
    t = d.legal_documents(first.select("doc_id")).select(
        "doc_id", F.col("doc_id").alias("chunk_id"), "text", F.when(law, F.lit("heading")).alias("header"), F.when(law, F.when(F.col("doc_id") % 2 == 0, "Indian Evidence Act").otherwise("Specific Relief Act")).alias("act"), F.when(law, number("doc_id")).alias("section"),
        F.lit(None).cast("string").alias("citation"), "court", F.when(~law, F.concat(F.lit("Party "), F.col("doc_id").cast("string"))).alias("appellant"), F.when(~law, F.lit("State")).alias("respondent"), "doc_type",
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("criminal"))).otherwise(F.array(F.lit("civil"))).alias("practice_areas"), F.when(F.col("doc_id") % 4 == 1, "binding").otherwise("persuasive").alias("authority"),
        F.when(F.col("doc_id") % 4 != 3, F.date_add("date", 100)).alias("embedded_on"), F.date_add("date", 300).alias("amended_on"), "current_validity", (F.col("doc_id") + 1).alias("overruled_by"),
    )
    return stored(first.join(t, "doc_id"))


def found(d: Domain) -> DataFrame:
    met = results(d)
    law = stored(d.legal_documents(met.select("doc_id")).where("doc_type <> 'judgment'").select("doc_id", "date"))
    statutes = law.select("doc_id", (F.col("doc_id") % 7 != 0).alias("in_force"), (F.col("doc_id") + 2).alias("replaced_by"))
    sections = law.where("doc_id % 9 <> 0").select("doc_id", number("doc_id").alias("section"), F.lit("new text").alias("section_text"), F.when(F.col("doc_id") % 4 < 3, F.concat(F.lit("BSA "), number("doc_id"))).alias("new_section"))
    amendments = law.where("doc_id % 3 = 0").select("doc_id", number("doc_id").alias("section"), F.when(F.col("doc_id") % 2 == 0, F.date_add("date", 200)).alias("effective_on"), F.date_add("date", 50).alias("amended_on"))
    return C.temporal_findings(met, queries(d), statutes, sections, amendments)


def temporal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(Domain(spark, sf_dir)).select("query_id", "chunk_id", "valid", "severity", "reason", "replacement", "warning")


def result_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return C.relevance(results(d), queries(d)).select("query_id", "chunk_id", F.round(F.col("relevance") + 1e-9, 6).alias("relevance"))


def corrective_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    a = C.assessed(found(d), queries(d))
    return a.select("query_id", F.col("n_results").cast("long").alias("n_results"), *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("relevance", "entity_coverage", "coverage", "score")], "action", "warning")


def refined_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.decomposed(queries(Domain(spark, sf_dir))).select("query_id", "part", F.md5("refined").alias("refined"))


QUERY = f"""{LEXICAL}, {LD},
cq AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN text || ' as the courts held' ELSE text END AS text, (['statutory_lookup', 'case_specific', 'vague_natural', 'general_legal'])[item_id % 4 + 1] AS kind, item_id % 2 = 0 AS even,
  'Indian Evidence Act ' || (item_id % 40) AS section, CAST(item_id % 40 AS VARCHAR) AS num, 'party ' || (item_id * 3) || ' v state' AS cas, item_id % 5 = 0 AS bare FROM benchmark),
qt AS (SELECT *, {TOKENS} AS asked, regexp_matches(lower(text), 'interpret|held|courts|case law') AS reads FROM cq),
t AS (SELECT ld.*, d.text, NOT judgment AS law, CASE WHEN NOT judgment THEN CAST(ld.doc_id % 40 AS VARCHAR) END AS section,
  CASE ld.doc_id % 4 WHEN 0 THEN 'Supreme Court' WHEN 1 THEN 'Bombay High Court' WHEN 2 THEN 'Delhi High Court' ELSE 'NCLT Principal Bench' END AS court FROM ld JOIN documents d USING (doc_id)),
r AS (SELECT l.query_id, l.rank, t.* EXCLUDE (text), t.text || CASE WHEN law THEN ' heading ' || CASE WHEN doc_id % 2 = 0 THEN 'Indian Evidence Act' ELSE 'Specific Relief Act' END || ' ' || section ELSE '' END || ' ' || court || CASE WHEN judgment THEN ' Party ' || doc_id || ' State' ELSE '' END AS text
  FROM lexical l JOIN t USING (doc_id) WHERE l.rank <= 8),
rt AS (SELECT *, {TOKENS} AS own FROM r),
w AS (SELECT rt.*, least(1.0, 0.35 * CASE WHEN len(asked) = 0 OR len(own) = 0 THEN 0 ELSE len(list_intersect(asked, own)) / len(asked) END + CASE WHEN rt.section = num THEN 0.25 ELSE 0 END
  + CASE WHEN NOT bare AND contains(lower(rt.text), cas) THEN 0.25 ELSE 0 END + CASE WHEN kind = 'statutory_lookup' AND law THEN 0.20 WHEN kind = 'case_specific' AND judgment THEN 0.15 ELSE 0 END
  + CASE WHEN judgment AND kind = 'case_specific' THEN 0.10 WHEN judgment AND reads THEN 0.18 ELSE 0 END + CASE WHEN even AND doc_id % 3 = 0 THEN 0.05 ELSE 0 END + CASE WHEN court = 'Bombay High Court' THEN 0.05 ELSE 0 END + CASE WHEN doc_id % 4 = 1 THEN 0.05 ELSE 0 END) AS relevance
  FROM rt JOIN qt USING (query_id)),
f0 AS (SELECT r.*, law AND doc_id % 7 = 0 AS repealed, law AND doc_id % 9 <> 0 AND doc_id % 3 = 0 AND CASE WHEN doc_id % 2 = 0 THEN 200 ELSE 50 END > CASE WHEN doc_id % 4 <> 3 THEN 100 ELSE 300 END AS amended,
  law AND doc_id % 9 <> 0 AND even AND doc_id % 2 = 0 AND doc_id % 4 < 3 AS old, judgment AND validity = 'OVERRULED' AS ended FROM r JOIN cq USING (query_id)),
ff AS (SELECT query_id, rank, doc_id AS chunk_id, law, judgment, lower(text) AS whole, CASE WHEN repealed THEN 'CRITICAL' WHEN amended THEN 'IMPORTANT' WHEN old THEN 'WARNING' WHEN ended THEN 'CRITICAL' END AS severity,
  CASE WHEN repealed THEN 'Act repealed. Replaced by: ' || (doc_id + 2) WHEN amended THEN 'Section amended on ' || CAST(date + CASE WHEN doc_id % 2 = 0 THEN 200 ELSE 50 END AS DATE) WHEN ended AND NOT old THEN 'Judgment validity is OVERRULED.' END AS reason,
  CASE WHEN repealed THEN doc_id + 2 WHEN ended THEN doc_id + 1 END AS replacement, CASE WHEN NOT repealed AND NOT amended AND old THEN 'New equivalent: BSA ' || (doc_id % 40) || '. Use the new criminal code provision for post-July-2024 offences.' END AS warning FROM f0),
g AS (SELECT *, severity IS NULL OR severity = 'WARNING' AS valid FROM ff)"""
QUERIES = {f.__name__: f for f in [temporal_findings, result_relevance, corrective_validation, refined_queries]}
ORACLE_SQL = {
    "temporal_findings": f"WITH {QUERY} SELECT query_id, chunk_id, valid, severity, reason, replacement, warning FROM g",
    "result_relevance": f"WITH {QUERY} SELECT query_id, doc_id AS chunk_id, round(relevance + 1e-9, 6) AS relevance FROM w",
    "corrective_validation": f"""WITH {QUERY},
pp AS (SELECT g.query_id, count(*) AS n, avg(relevance) AS relevance, string_agg(whole, ' ' ORDER BY g.rank) AS texts, bool_or(g.law) AS has_law, bool_or(g.judgment) AS has_case FROM g JOIN w ON w.query_id = g.query_id AND w.doc_id = g.chunk_id WHERE valid GROUP BY g.query_id),
v AS (SELECT query_id, arg_min(warning, rank) AS warning FROM g WHERE warning IS NOT NULL GROUP BY query_id),
a AS (SELECT qt.query_id, coalesce(n, 0) AS n_results, coalesce(relevance, 0) AS relevance, CASE WHEN bare THEN 1 ELSE (CAST(coalesce(contains(texts, lower(section)) OR contains(texts, num), FALSE) AS INT) + CAST(coalesce(contains(texts, cas), FALSE) AS INT)) / 2 END AS entity_coverage,
  CASE WHEN n IS NULL THEN 0 WHEN kind = 'statutory_lookup' THEN CASE WHEN has_law THEN 0.5 ELSE 0 END + CASE WHEN reads THEN CASE WHEN has_case THEN 0.5 ELSE 0 END ELSE 0.5 END WHEN kind = 'case_specific' THEN CASE WHEN has_case THEN 1 ELSE 0 END WHEN kind = 'vague_natural' THEN 1 ELSE CASE WHEN bare THEN 0 ELSE 0.5 END END::DOUBLE AS coverage, warning
  FROM qt LEFT JOIN pp USING (query_id) LEFT JOIN v USING (query_id)),
sc AS (SELECT *, 0.4 * relevance + 0.25 * entity_coverage + 0.35 * coverage AS score FROM a),
z AS (SELECT *, CASE WHEN score > 0.70 AND n_results > 0 THEN 'PROCEED' WHEN score > 0.40 THEN 'REFINED' ELSE 'INSUFFICIENT' END AS action FROM sc)
SELECT query_id, n_results, round(relevance + 1e-9, 4) AS relevance, round(entity_coverage + 1e-9, 4) AS entity_coverage, round(coverage + 1e-9, 4) AS coverage, round(score + 1e-9, 4) AS score, action, CASE WHEN action = 'INSUFFICIENT' THEN '{C.NO_ANSWER}' ELSE warning END AS warning FROM z""",
    "refined_queries": r"""WITH q AS (SELECT item_id, 'Indian Evidence Act ' || (item_id % 40) AS s, 'party ' || (item_id * 3) || ' v state' AS c, CASE WHEN item_id % 3 = 0 THEN text || ' as the courts held' ELSE text END AS text FROM benchmark),
a AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN ['What does ' || s || ' say?', 'How have courts interpreted ' || s || '?'] WHEN item_id % 4 = 1 AND item_id % 5 <> 0 THEN ['What was held in ' || c || '?']
  WHEN contains(lower(text), ' and ') THEN list_transform(list_filter(list_transform(string_split(text, ' and '), lambda p: regexp_replace(trim(p), '\?+$', '')), lambda p: p <> ''), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))) ELSE [] END AS x FROM q)
SELECT item_id AS query_id, CAST(i - 1 AS INT) AS part, md5(x[i]) AS refined FROM a, unnest(range(1, len(x) + 1)) u(i)""",
}
