"""Published queries: a day's validity updates, and law as it was on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import daily as V
from ..operators.asof import asof
from ..operators.routing import TEMPORAL, analyzed
from .domain import Domain
from .document_queries import _any
from .relational_queries import EDGES
from .text_queries import form, form_sql


def tables(d: Domain) -> dict[str, DataFrame]:
    i = F.col("doc_id")
    none = lambda t: F.lit(None).cast(t)
    docs = d.legal_documents().select("doc_id", "doc_type", F.when((F.col("doc_type") != "judgment") & (i % 11 == 4), "REPEALED").otherwise(F.col("current_validity")).alias("current_validity"), none("long").alias("overruled_by"), none("date").alias("overruled_date"), none("string").alias("replaced_by"), F.lit(False).alias("stale"), none("string").alias("stale_reason"), F.lit(False).alias("reembed"))
    s = docs.where("doc_type <> 'judgment'").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    sections = s.select("doc_id", F.col("k").cast("string").alias("section"), F.concat_ws(" ", F.lit("text"), i.cast("string"), F.col("k").cast("string")).alias("text"), none("string").alias("original_text"), ((i + F.col("k")) % 7 > 0).alias("in_force"), F.array(F.floor(i / 2), F.floor(i / 3)).alias("cases"))
    return {"documents": docs, "sections": sections, "edges": d.edges().select("source", "target")}


def updates(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = F.col("doc_id")
    law = d.legal_documents().where("doc_type <> 'judgment' and doc_id % 15 in (3, 4)")
    statutes = law.select(i.alias("position"), "doc_id", (i % 2 == 0).alias("valid"), F.when(i % 4 == 1, "Act B").alias("replaced_by"))
    none = lambda t: F.lit(None).cast(t)
    texts = law.where("doc_id % 7 > 0").select((i * 2).alias("position"), "doc_id", F.lit("0").alias("section"), F.when(i % 3 == 0, "new").otherwise(F.concat_ws(" ", F.lit("text"), i.cast("string"), F.lit("0"))).alias("text"), none("boolean").alias("in_force"), F.when(i % 8 == 0, "Act of 2024").alias("label"))
    force = law.where("doc_id % 4 = 0").select((i * 2 + 1).alias("position"), "doc_id", F.lit("1").alias("section"), none("string").alias("text"), F.lit(False).alias("in_force"), none("string").alias("label"))
    judgments = d.legal_documents().where("doc_id % 20 = 1").select(i.alias("position"), "doc_id", F.lit("OVERRULED").alias("validity"), (i + 1).alias("authority"), F.col("date").alias("authority_date"), F.when(i % 40 == 1, "noted").alias("note"))
    return statutes, texts.unionByName(force), judgments


def daily_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return V.applied(tables(d), *updates(d))["documents"].withColumn("overruled_date", F.col("overruled_date").cast("string"))


def daily_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return V.applied(tables(d), *updates(d))["sections"].drop("cases")


def law_on_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for a section as of its day: sections have up to six versions, some none, some two of one day."""
    d = Domain(spark, sf_dir)
    i = F.col("doc_id")
    v = d.table("documents").select((i % 50).alias("act"), F.floor(i / 50).alias("section"), F.explode(F.sequence(F.lit(0), (i % 7).cast("int"))).alias("k"), "doc_id").where("k < doc_id % 7")
    v = v.select("act", "section", F.expr("date_add(DATE '1992-03-01', CAST(k * (200 + doc_id % 500) AS INT))").alias("since"), F.concat_ws(" ", F.lit("version"), "k", F.lit("of"), "doc_id").alias("text"), ((i + F.col("k")) % 5 > 0).alias("in_force"))
    twice = v.where("section % 4 = 0").withColumn("text", F.concat("text", F.lit(" corrected")))
    k = F.col("o_orderkey")
    asked = d.table("orders").select("o_orderkey", (k % 50).alias("act"), F.floor(k / 50) % (d.table("documents").count() * 6 // 5 // 50 + 1), F.to_date("o_orderdate").alias("day")).toDF("o_orderkey", "act", "section", "day")
    return asof(asked, v.unionByName(twice), ["act", "section"]).withColumns({"day": F.col("day").cast("string"), "since": F.col("since").cast("string")})


CODED = [["Section ", (900, 1), " IPC"], ["Section ", (900, 1), " Indian Evidence Act"], ["plain"], ["Article ", (300, 1)]]


def query_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with references: what they are called in the new codes, and whether time counts; parts are the mappings."""
    d = Domain(spark, sf_dir)
    p = F.col("p_partkey")
    one = lambda old, new, shift: d.table("part").select(F.lit(old).alias("legacy_code"), p.cast("string").alias("legacy_section"), F.lit(new).alias("new_code"), (p + shift).cast("string").alias("new_section"), (p % 10 > 0).alias("is_active"))
    t = d.table("conversations")
    i = F.col("conv_id") + F.col("turn")
    q = t.select(F.struct("conv_id", "turn").alias("query_id"), F.concat_ws(" ", form(CODED, i), "text").alias("query"), F.lit(False).alias("uploaded"), F.when(i % 2 == 0, F.to_date(F.lit("2023-01-01"))).otherwise(F.to_date(F.lit("2024-09-01"))).alias("reference_date"))
    a = analyzed(q, one("IPC", "BNS", 100).unionByName(one("Indian Evidence Act", "BSA", 7)))
    return a.select("query_id.conv_id", "query_id.turn", F.array_join("equivalents", "|").alias("equivalents"), "time_sensitive")


DAY = f"""{EDGES},
dc AS (SELECT doc_id AS i, CASE doc_id % 5 WHEN 3 THEN 'statute' WHEN 4 THEN 'constitution' ELSE 'judgment' END AS doc_type, CASE WHEN doc_id % 5 >= 3 AND doc_id % 11 = 4 THEN 'REPEALED' WHEN toxic = 1 THEN 'OVERRULED' ELSE 'GOOD_LAW' END AS was FROM documents LEFT JOIN labels USING (doc_id)),
st AS (SELECT i, i % 2 = 0 AS valid, CASE WHEN i % 4 = 1 THEN 'Act B' END AS repl FROM dc WHERE doc_type <> 'judgment' AND i % 15 IN (3, 4)),
ch AS (SELECT i, '0' AS section, i * 2 AS p, CASE WHEN i % 3 = 0 THEN 'new' ELSE 'text ' || i || ' 0' END AS text, CAST(NULL AS BOOLEAN) AS force, i % 8 = 0 AS named FROM st WHERE i % 7 > 0 UNION ALL SELECT i, '1', i * 2 + 1, NULL, FALSE, FALSE FROM st WHERE i % 4 = 0),
se AS (SELECT i, CAST(k AS VARCHAR) AS section, 'text ' || i || ' ' || k AS text, (i + k) % 7 > 0 AS in_force FROM dc, range(2) r(k) WHERE doc_type <> 'judgment'),
sa AS (SELECT se.i, se.section, coalesce(ch.text, se.text) AS text, CASE WHEN ch.text <> se.text THEN se.text END AS original_text, coalesce(force, in_force) AS in_force, p, coalesce(ch.text <> se.text, FALSE) OR coalesce(force <> in_force, FALSE) OR coalesce(named, FALSE) AS changed FROM se LEFT JOIN ch ON ch.i = se.i AND ch.section = se.section)"""
QUERIES = {f.__name__: f for f in [daily_documents, daily_sections, law_on_days, query_equivalents]}
ORACLE_SQL = {
    "daily_documents": f"""WITH {DAY},
jd AS (SELECT i, CASE WHEN i % 40 = 1 THEN 'noted' END AS note FROM dc WHERE i % 20 = 1),
why AS (SELECT i AS doc_id, (0, i, -1, 0) AS pt, 'Statute repealed. Replacement: ' || coalesce(repl, 'not specified') AS reason, FALSE AS anew FROM st WHERE NOT valid
  UNION ALL SELECT i, (0, i, p, 0), 'Section ' || section || ' amended.', TRUE FROM sa WHERE changed UNION ALL SELECT unnest([i // 2, i // 3]), (0, i, p, 1), 'Interpreted statute text changed for section ' || section || '.', TRUE FROM sa WHERE changed
  UNION ALL SELECT i, (1, i, 0, 0), coalesce(note, 'Judgment validity updated to OVERRULED.'), FALSE FROM jd UNION ALL SELECT source, (1, i, 0, 1), 'Cites judgment ' || i || ' whose validity changed to OVERRULED.', FALSE FROM jd JOIN e ON target = i),
rs AS (SELECT doc_id, arg_max(reason, pt) AS reason, bool_or(anew) AS anew FROM why GROUP BY doc_id)
SELECT dc.i AS doc_id, doc_type, CASE WHEN jd.i IS NOT NULL THEN 'OVERRULED' WHEN NOT valid THEN 'REPEALED' WHEN valid AND EXISTS (SELECT 1 FROM sa WHERE sa.i = dc.i AND changed) THEN 'AMENDED' WHEN valid AND was = 'REPEALED' THEN 'GOOD_LAW' ELSE was END AS current_validity,
CASE WHEN jd.i IS NOT NULL THEN jd.i + 1 END AS overruled_by, CASE WHEN jd.i IS NOT NULL THEN CAST(CAST(DATE '1950-01-01' + CAST(jd.i AS INT) AS DATE) AS VARCHAR) END AS overruled_date, repl AS replaced_by, reason IS NOT NULL AS stale, reason AS stale_reason, coalesce(anew, FALSE) AS reembed
FROM dc LEFT JOIN st ON st.i = dc.i LEFT JOIN jd ON jd.i = dc.i LEFT JOIN rs ON rs.doc_id = dc.i""",
    "daily_sections": f"WITH {DAY} SELECT i AS doc_id, section, text, original_text, in_force FROM sa",
    "law_on_days": """WITH v AS (SELECT doc_id % 50 AS act, doc_id // 50 AS section, CAST(DATE '1992-03-01' + CAST(k * (200 + doc_id % 500) AS INT) AS DATE) AS since, 'version ' || k || ' of ' || doc_id || CASE WHEN doc_id // 50 % 4 = 0 THEN ' corrected' ELSE '' END AS text, (doc_id + k) % 5 > 0 AS in_force FROM documents, range(6) r(k) WHERE k < doc_id % 7),
o AS (SELECT o_orderkey, o_orderkey % 50 AS act, o_orderkey // 50 % ((SELECT count(*) FROM documents) * 6 // 5 // 50 + 1) AS section, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, o.act, o.section, CAST(day AS VARCHAR) AS day, CAST(since AS VARCHAR) AS since, text, in_force FROM o ASOF LEFT JOIN v ON o.act = v.act AND o.section = v.section AND o.day >= v.since""",
    "query_equivalents": f"""WITH t AS (SELECT conv_id, turn, conv_id + turn AS i, (conv_id + turn) % 900 + 1 AS n, {form_sql(CODED, '(conv_id + turn)')} || ' ' || text AS q FROM conversations),
e AS (SELECT *, CASE WHEN n % 10 > 0 AND n IN (SELECT p_partkey FROM part) THEN CASE i % 4 WHEN 0 THEN 'BNS ' || (n + 100) WHEN 1 THEN 'BSA ' || (n + 7) ELSE '' END ELSE '' END AS equivalents, trim(regexp_replace(regexp_replace(lower(q), '[^\\p{{L}}\\p{{N}}_\\s./-]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM t)
SELECT conv_id, turn, equivalents, i % 4 = 0 OR equivalents <> '' OR {_any('norm', TEMPORAL)} AS time_sensitive FROM e""",
}
