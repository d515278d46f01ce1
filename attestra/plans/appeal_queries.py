"""Published queries: appeal histories, final authorities, citations of appealed judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import appeals as A
from .domain import Domain

NAMES = ["upheld", "reversed", "modified", "remanded", "dismissed"]


def documents(d: Domain) -> DataFrame:
    ref = F.concat(F.lit("REF "), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    return d.legal_documents().select("doc_id", F.when(F.col("doc_id") % 3 == 0, ref).alias("citation"), F.when(F.col("doc_id") % 3 == 1, ref).alias("neutral_citation"), F.when(F.col("doc_id") % 3 == 2, ref).otherwise(none).alias("source_ref"), "court", "date", "current_validity")


def links(d: Domain) -> DataFrame:
    """Within blocks of four every document is an appeal from the one before it; some tell no outcome, some name nobody, some are not final."""
    i = F.col("doc_id")
    target = F.when(i % 13 == 0, F.lit("REF none")).otherwise(F.concat(F.lit("REF "), (i - 1).cast("string")))
    return d.table("documents").where("doc_id % 4 > 0").select(
        i.alias("source"), target.alias("reference"), F.lit("appeal_from").alias("relation"), F.when(i % 11 != 0, F.element_at(F.array(*map(F.lit, NAMES)), (i % 5 + 1).cast("int"))).alias("outcome"), F.when(i % 7 == 0, False).alias("is_final"),
        F.lit(None).cast("string").alias("court"), F.lit(None).cast("date").alias("judged_on"),
    )


def resolved(d: Domain) -> DataFrame:
    return A.resolved_links(links(d), documents(d))


def authorities(d: Domain) -> DataFrame:
    return A.final_authorities(documents(d), A.appeal_nodes(resolved(d)))


def appeal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(Domain(spark, sf_dir)).select("source", "parent", "outcome", "is_final", "court_level")


def appeal_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.appeal_nodes(resolved(Domain(spark, sf_dir))).select("owner", "parent", "child", "court_level", "outcome", "is_final")


def appeal_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return A.parent_validity(documents(d), resolved(d))


def final_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = authorities(Domain(spark, sf_dir))
    return a.select("doc_id", "use_doc_id", "outcome", "is_final", "pending", "warning", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def appeal_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation of every document, one in six unverified."""
    d = Domain(spark, sf_dir)
    c = d.table("documents").select(F.col("doc_id").alias("citation_id"), "doc_id", (F.col("doc_id") % 6 != 0).alias("verified"))
    chunks = d.table("documents").select("doc_id", (F.col("doc_id") * 10).alias("chunk_id"), F.lit(0).alias("chunk_index"))
    return A.validated_citations(c, authorities(d), chunks).select("citation_id", "status", "severity", "warning", "banner", "use_doc_id", "chunk_id")


LINKS = """ld AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 4 WHEN 3 THEN 1 ELSE 3 END AS level, CASE WHEN toxic = 1 THEN 'OVERRULED' ELSE 'GOOD_LAW' END AS validity FROM documents LEFT JOIN labels USING (doc_id)),
rl AS (SELECT l.doc_id AS source, p.doc_id AS parent, CASE WHEN l.doc_id % 11 <> 0 THEN (['UPHELD', 'REVERSED', 'MODIFIED', 'REMANDED', 'DISMISSED'])[l.doc_id % 5 + 1] END AS outcome, l.doc_id % 7 <> 0 AS is_final, level AS court_level
FROM ld l LEFT JOIN documents p ON p.doc_id = l.doc_id - 1 AND l.doc_id % 13 <> 0 WHERE l.doc_id % 4 > 0),
lk AS (SELECT * FROM rl WHERE parent IS NOT NULL AND outcome IS NOT NULL)"""
NODES = f"""{LINKS}, up(child, owner) AS (SELECT source, parent FROM lk UNION SELECT up.child, lk.parent FROM up JOIN lk ON lk.source = up.owner),
nd AS (SELECT source AS owner, parent, NULL AS child, court_level, outcome, is_final, source FROM lk UNION ALL SELECT parent, parent, source, court_level, outcome, is_final, source FROM lk
UNION ALL SELECT up.owner, parent, source, court_level, outcome, is_final, source FROM lk JOIN up ON up.child = parent),
nodes AS (SELECT owner, parent, child, court_level, outcome, is_final AND source = max(source) OVER (PARTITION BY owner) AS is_final, source FROM nd)"""
#: In a block of four each judgment has one appeal at most: the path is what follows, the last node is that of the latest source.
AUTHORITIES = f"""{NODES}, pa AS (SELECT owner, list(child ORDER BY child) AS ids, list(outcome ORDER BY child) AS outs, arg_max(is_final, child) AS fin FROM nodes WHERE child IS NOT NULL GROUP BY owner),
ow AS (SELECT owner, outcome, is_final FROM nodes WHERE child IS NULL),
fa AS (SELECT ld.doc_id, ids IS NOT NULL OR ow.owner IS NOT NULL AS has, coalesce(ids, []) AS ids, CASE WHEN fin THEN outs WHEN ids IS NULL AND ow.is_final THEN [ow.outcome] END AS outs, CASE WHEN fin THEN ids[-1] ELSE ld.doc_id END AS use
FROM ld LEFT JOIN pa ON pa.owner = doc_id LEFT JOIN ow ON ow.owner = doc_id),
fb AS (SELECT *, list_reduce(list_prepend('UPHELD', outs), lambda s, x: CASE WHEN x = 'REVERSED' THEN CASE WHEN s = 'REVERSED' THEN 'UPHELD' ELSE 'REVERSED' END WHEN x IN ('UPHELD', 'DISMISSED') THEN s ELSE x END) AS st FROM fa),
fc AS (SELECT *, CASE WHEN outs IS NULL THEN NULL WHEN st = 'UPHELD' AND list_contains(outs, 'DISMISSED') THEN 'DISMISSED' ELSE st END AS outcome, has AND outs IS NULL AS pending FROM fb),
au AS (SELECT doc_id, use AS use_doc_id, outcome, NOT has OR (outs IS NOT NULL AND use = doc_id) AS is_final, pending, CASE WHEN pending THEN 'Appeal history exists but final authority could not be resolved.' WHEN outcome = 'REVERSED' AND use <> doc_id THEN 'This judgment was reversed on appeal. Use final authority: ' || use || '.'
 WHEN outcome = 'MODIFIED' AND use <> doc_id THEN 'This judgment was modified on appeal. Use final authority: ' || use || '.' WHEN outcome = 'REMANDED' THEN 'This matter was remanded on appeal.' WHEN outcome = 'DISMISSED' AND use <> doc_id THEN 'The appeal was dismissed. Final authority remains: ' || use || '.' END AS warning,
 array_to_string(list_prepend(doc_id, CASE WHEN outs IS NULL THEN [] ELSE ids END), ',') AS path FROM fc)"""
QUERIES = {f.__name__: f for f in [appeal_links, appeal_histories, appeal_validity, final_authorities, appeal_validation]}
ORACLE_SQL = {
    "appeal_links": f"WITH {LINKS} SELECT * FROM rl",
    "appeal_histories": f"WITH RECURSIVE {NODES} SELECT owner, parent, child, court_level, outcome, is_final FROM nodes",
    "appeal_validity": f"WITH {LINKS} SELECT doc_id, CASE WHEN outcome = 'REVERSED' THEN 'REVERSED_ON_APPEAL' ELSE validity END AS current_validity FROM ld LEFT JOIN lk ON parent = doc_id",
    "final_authorities": f"WITH RECURSIVE {AUTHORITIES} SELECT * FROM au",
    "appeal_validation": f"""WITH RECURSIVE {AUTHORITIES}, v AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 'VALID' WHEN pending THEN 'PENDING' WHEN outcome = 'REVERSED' AND use_doc_id <> doc_id THEN 'REDIRECTED' WHEN outcome IN ('MODIFIED', 'REMANDED') THEN outcome WHEN outcome = 'DISMISSED' AND warning IS NOT NULL THEN 'DISMISSED' ELSE 'VALID' END AS status FROM au)
SELECT doc_id AS citation_id, status, CASE WHEN status = 'REDIRECTED' THEN 'CRITICAL' WHEN status IN ('PENDING', 'MODIFIED', 'REMANDED') THEN 'WARNING' ELSE 'INFO' END AS severity,
CASE WHEN doc_id % 6 = 0 THEN NULL WHEN status = 'PENDING' THEN 'Appeal pending — this may not be the final judgment.' WHEN status = 'MODIFIED' THEN coalesce(warning, 'This judgment was modified on appeal. Use final authority: ' || use_doc_id || '.') ELSE warning END AS warning, status = 'REDIRECTED' AS banner,
CASE WHEN doc_id % 6 <> 0 AND NOT pending AND use_doc_id <> doc_id THEN use_doc_id END AS use_doc_id, CASE WHEN doc_id % 6 <> 0 AND NOT pending AND use_doc_id <> doc_id THEN use_doc_id * 10 END AS chunk_id FROM v""",
}
