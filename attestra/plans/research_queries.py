"""Published queries: authorities that ground a case's findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import research as R
from .citation_queries import CORPUS, _word, chunks, documents, word
from .domain import Domain

STAGES = ["bail", "appeal", "trial", "other"]
CODES = list(R.CODE_NAMES)


def at(values: list[str], i):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def laws(d: Domain) -> DataFrame:
    """Sections of good law in force; every seventh act has a name that a code stands for."""
    c = chunks(d).join(documents(d).where("doc_type <> 'judgment' and current_validity = 'GOOD_LAW'").select("doc_id"), "doc_id", "left_semi").where("in_force")
    named = F.array(*[F.lit(v[-1].title()) for v in R.CODE_NAMES.values()])
    act = F.when(F.col("doc_id") % 7 == 3, F.concat(F.element_at(named, (F.floor(F.col("doc_id") / 7) % len(CODES) + 1).cast("int")), F.lit(" 1950"))).otherwise(F.col("act"))
    return c.select("chunk_id", "doc_id", act.alias("act"), "section", "header", "chunk_text")


def judgments(d: Domain) -> DataFrame:
    """Parts of judgments of good law; what their court binds."""
    i = F.col("doc_id")
    own = documents(d).where("doc_type = 'judgment' and current_validity = 'GOOD_LAW'").select("doc_id", "citation", "appellant", "respondent", "court")
    text = F.concat_ws(" ", "chunk_text", F.when(i % 13 == 0, F.lit("anticipatory bail")), word(i, 121))
    binding = F.when(F.col("court") == "Supreme Court", F.array(F.lit("All India"))).when(i % 3 == 0, F.array("court", F.lit("All India"))).otherwise(F.array("court"))
    return chunks(d).select("doc_id", "chunk_id", "header", text.alias("chunk_text")).join(own, "doc_id").withColumn("binding", binding)


def cases(d: Domain) -> DataFrame:
    """Orders as case files: two references, findings, a stage and a court by number."""
    i = F.col("o_orderkey")
    one = F.when(i % 4 == 0, F.concat_ws(" ", at(CODES, F.floor(i / 4)), (i % 50).cast("string"))).otherwise(F.concat_ws(" ", F.upper(word(i)), (F.floor(i / 3) % 50).cast("string")))
    two = F.when(i % 3 == 0, F.lit("unnumbered")).otherwise(F.concat_ws(" ", F.upper(word(i, 3)), F.lit("Act"), (i * 7 % 60).cast("string")))
    court = at(["Supreme Court", "Bombay High Court", "Delhi High Court", ""], F.floor(i / 2))
    return d.table("orders").select(
        i.alias("case_id"), F.array(one, two).alias("references"), F.concat_ws(" ", F.lit("charge of"), word(i, 5)).alias("statutory"), F.concat_ws(" ", F.lit("authority on"), word(i, 11)).alias("precedent"), word(i).alias("query"),
        F.when(i % 5 > 0, at(STAGES, i)).alias("stage"), court.alias("court"),
    )


def statute_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return R.statute_authorities(cases(d), laws(d)).drop("passage", "message")


def precedent_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return R.precedent_authorities(cases(d), judgments(d)).drop("passage", "message").withColumn("score", F.round("score", 6))


W = r"list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
CODE_LIST = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
NAME_LIST = "[" + ", ".join(f"'{v[-1].title()} 1950'" for v in R.CODE_NAMES.values()) + "]"
CODE_TABLE = "cn AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, v in R.CODE_NAMES.items() for n in v) + ") t(code, name))"
CASES = f"""cs AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 4 = 0 THEN ({CODE_LIST})[o_orderkey // 4 % {len(CODES)} + 1] || ' ' || o_orderkey % 50 ELSE upper({_word('o_orderkey')}) || ' ' || o_orderkey // 3 % 50 END AS r1,
  CASE WHEN o_orderkey % 3 = 0 THEN 'unnumbered' ELSE upper({_word('o_orderkey', 3)}) || ' Act ' || o_orderkey * 7 % 60 END AS r2, 'charge of ' || {_word('o_orderkey', 5)} AS statutory, 'authority on ' || {_word('o_orderkey', 11)} AS precedent, {_word('o_orderkey')} AS query,
  CASE WHEN o_orderkey % 5 > 0 THEN (['bail', 'appeal', 'trial', 'other'])[o_orderkey % 4 + 1] ELSE '' END AS stage, (['Supreme Court', 'Bombay High Court', 'Delhi High Court', ''])[o_orderkey // 2 % 4 + 1] AS court FROM orders)"""
QUERIES = {f.__name__: f for f in [statute_authorities, precedent_authorities]}
ORACLE_SQL = {
    "statute_authorities": f"""WITH {CORPUS}, {CODE_TABLE}, {CASES},
lw AS (SELECT chunk_id, doc_id, CASE WHEN doc_id % 7 = 3 THEN ({NAME_LIST})[doc_id // 7 % {len(CODES)} + 1] ELSE act END AS act, section, header, chunk_text FROM ck JOIN dc USING (doc_id) WHERE law AND good AND live),
lo AS (SELECT *, {W.format("concat_ws(' ', act, section, header, chunk_text)")} AS own FROM lw),
rf AS (SELECT i AS case_id, p AS position, CASE p WHEN 0 THEN r1 ELSE r2 END || ' ' || statutory AS query, CASE p WHEN 0 THEN r1 ELSE r2 END AS reference FROM cs, range(2) t(p)),
qs AS (SELECT DISTINCT query, split_part(upper(reference), ' ', 1) AS code, upper(regexp_extract(reference, '\\S+$')) AS section, {W.format('query')} AS asked FROM rf WHERE contains(reference, ' ')),
am AS (SELECT DISTINCT code, act FROM (SELECT DISTINCT code FROM qs) q, (SELECT DISTINCT act FROM lo WHERE act IS NOT NULL) a WHERE EXISTS (SELECT 1 FROM cn WHERE cn.code = q.code AND contains(lower(act), name)) OR (NOT EXISTS (SELECT 1 FROM cn WHERE cn.code = q.code) AND contains(lower(act), lower(q.code)))),
sc AS (SELECT query, chunk_id, round(CASE WHEN lo.section = qs.section THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN am.act IS NOT NULL THEN 0.75::DOUBLE ELSE 0 END + least(len(list_intersect(asked, own)) / len(asked), 0.4), 9) AS score
  FROM qs JOIN lo ON TRUE LEFT JOIN am ON am.code = qs.code AND am.act = lo.act),
be AS (SELECT query, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS n FROM sc WHERE score >= 1.0) WHERE n = 1),
on_ AS (SELECT case_id, chunk_id, min(position) AS position FROM rf JOIN be USING (query) GROUP BY ALL)
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY position) AS INT) AS rank, doc_id, chunk_id,
CASE WHEN act IS NOT NULL AND section IS NOT NULL THEN array_to_string(string_split(act, ' ')[1:2], ' ') || ' ' || section ELSE coalesce(act, header, CAST(chunk_id AS VARCHAR)) END AS label,
CASE WHEN act IS NOT NULL AND section IS NOT NULL THEN act || ', Section ' || section ELSE header END AS citation FROM on_ JOIN lo USING (chunk_id)""",
    "precedent_authorities": f"""WITH {CORPUS}, {CASES},
jd AS (SELECT chunk_id, doc_id, court, citation, coalesce(name, citation, CAST(doc_id AS VARCHAR)) AS label, header, concat_ws(' ', chunk_text, CASE WHEN doc_id % 13 = 0 THEN 'anticipatory bail' END, {_word('doc_id', 121)}) AS passage, court <> 'Supreme Court' AND doc_id % 3 > 0 AS own_only FROM ck JOIN dc USING (doc_id) WHERE NOT law AND good),
jo AS (SELECT *, {W.format("concat_ws(' ', citation, label, header, passage, court)")} AS own FROM jd),
kq AS (SELECT i AS case_id, stage, court, list_sort(list_distinct(list_concat({W.format("concat_ws(' ', query, precedent, stage, court)")}, CASE stage WHEN 'bail' THEN ['bail', 'anticipatory', 'custody', 'liberty'] WHEN 'appeal' THEN ['appeal', 'reversal', 'sentence'] WHEN 'trial' THEN ['trial', 'evidence', 'charge'] ELSE [] END))) AS asked FROM cs),
ks AS (SELECT DISTINCT stage, court, asked FROM kq),
sc AS (SELECT ks.*, chunk_id, round(len(list_intersect(asked, own)) / len(asked) + CASE WHEN stage = 'bail' AND len(list_intersect(own, ['bail', 'anticipatory', 'custody', 'liberty'])) > 0 THEN 0.35::DOUBLE ELSE 0 END
  + CASE WHEN jo.court = 'Supreme Court' THEN 0.3::DOUBLE WHEN ks.court <> '' AND jo.court = ks.court THEN 0.2::DOUBLE WHEN NOT own_only THEN 0.1::DOUBLE ELSE 0 END, 9) AS score FROM ks, jo),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stage, court, asked ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score >= 0.2) WHERE rank <= 2)
SELECT case_id, CAST(rank AS INT) AS rank, round(score, 6) AS score, jo.doc_id, be.chunk_id, label, citation FROM kq JOIN be ON be.stage = kq.stage AND be.court = kq.court AND be.asked = kq.asked JOIN jo ON jo.chunk_id = be.chunk_id""",
}
