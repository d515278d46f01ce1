"""Published queries: events of executions, answers as Markdown, references and mappings kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import quality as Q
from ..operators import state as S
from ..streaming import build as B
from .domain import Domain


def executions(d: Domain) -> DataFrame:
    """Orders as executions of a query: their lines as resolutions, their comment as text."""
    li = d.table("lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_suppkey", "l_quantity").alias("l")).groupBy("k").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    o = d.table("orders").withColumnRenamed("o_orderkey", "k").join(li, "k", "left")
    status = lambda x: F.when(x["l_quantity"] < 10, "UNVERIFIED").otherwise("VERIFIED")
    resolutions = F.transform(F.col("ls"), lambda x: F.struct(F.concat(F.lit("[P"), x["l_linenumber"].cast("string"), F.lit("]")).alias("placeholder"), x["l_suppkey"].cast("string").alias("rendered"), status(x).alias("status")))
    text = F.repeat(F.lit("0123456789"), (F.col("k") % 23).cast("int"))
    return o.where("ls is not null").select(
        F.col("k").cast("string").alias("query_id"), F.lit("hybrid_rag").alias("pipeline"), F.col("o_orderstatus").alias("query_type"), F.lit("civil").alias("practice_area"), F.col("o_orderpriority").alias("query"), F.lit("PROCEED").alias("action"), (F.col("k") % 9).alias("n_results"),
        (F.col("k") % 4).alias("n_findings"), F.size("ls").alias("n_placeholders"), F.lit(3).alias("n_sections"), resolutions.alias("resolutions"), (F.col("k") % 5).alias("verified"), (F.col("k") % 3).alias("uncertain"), F.lit(0).alias("unsupported"), (F.col("k") % 5 + F.col("k") % 3).alias("n_claims"),
        F.lit("UNCERTAIN").alias("overall_status"), F.lit("{}").alias("answer"), text.alias("text"), F.col("o_custkey").alias("customer"),
    )


def verified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.verified_events(executions(Domain(spark, sf_dir)))
    return e.select("query_id", "sequence", "type", "step", "placeholder", "citation", "status", "token", F.round("confidence", 6).alias("confidence"), F.get_json_object("metrics", "$.event_count").cast("int").alias("event_count"), F.get_json_object("data", "$.verified").cast("int").alias("n_verified"))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each type: queries of every third customer stand in a workspace, of which some are unknown and some run by agents."""
    e = executions(Domain(spark, sf_dir))
    q = e.select("query_id", F.when(F.col("customer") % 3 == 0, (F.col("customer") % 11).cast("string")).alias("workspace_id"))
    known = spark.range(8).select(F.col("id").cast("string").alias("case_id"))
    logs = F.array(F.struct(F.lit("planner").alias("agent"), F.lit("planned").alias("message")), F.struct(F.lit("checker").alias("agent"), F.lit("checked").alias("message")))
    agents = e.where("customer % 2 = 0").select("query_id", (F.col("customer") % 11).cast("string").alias("workspace_id"), F.lit("uploads").alias("reason"), logs.alias("logs"), F.lit(4).alias("n_questions"), F.lit(2).alias("n_authorities"), F.lit(0.5).alias("confidence"), F.lit("{}").alias("answer"), "text")
    return B.streamed(q, known, e.drop("customer"), agents).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("n_queries"), F.sum("sequence").alias("places"))


def answer_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers in JSON, keys in either spelling, read and written as Markdown."""
    o = Domain(spark, sf_dir).table("orders")
    k = F.col("o_orderkey")
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    claim = F.concat(F.lit('{"text": "claim '), k.cast("string"), F.lit('", "status": '), quoted(F.when(k % 2 == 0, "VERIFIED").otherwise("ODD")), F.lit(', "citation": '), F.when(k % 3 == 0, quoted(k)).otherwise("null"), F.lit(', "'), F.when(k % 2 == 0, "sourcePassage").otherwise("source_passage"), F.lit('": '), F.when(k % 5 == 0, F.lit('"passage"')).otherwise("null"), F.lit("}"))
    item = F.concat(F.lit('{"label": "checked", "value": 3, "status": "VERIFIED"}'))
    section = F.concat(F.lit('{"kind": "KEY_CASES", "title": "Cases", "claims": ['), claim, F.lit('], "'), F.when(k % 2 == 0, "statusItems").otherwise("status_items"), F.lit('": ['), F.when(k % 4 == 0, item).otherwise(F.lit("")), F.lit("]}"))
    answer = F.when(k % 13 == 0, F.lit("no answer")).otherwise(F.concat(F.lit('{"'), F.when(k % 2 == 0, "overallStatus").otherwise("overall_status"), F.lit('": "VERIFIED", "query": "'), F.when(k % 7 > 0, F.col("o_orderpriority")).otherwise(F.lit("")), F.lit('", "sections": ['), section, F.lit("]}")))
    n = o.select("o_orderkey", A.normalised(answer).alias("a"))
    return n.select("o_orderkey", F.col("a.overall_status").alias("overall_status"), F.size("a.sections").alias("n_sections"), F.md5(A.markdown(F.col("a"))).alias("markdown"))


def amendment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendments of parts' sections: half are there, updates of every third put new text in their place or add rows."""
    p = Domain(spark, sf_dir).table("part").select(F.col("p_partkey").alias("k"))
    row = lambda text: [(F.col("k") % 100).alias("statute_id"), F.col("k").cast("string").alias("section"), F.lit("act").alias("amending_act"), F.to_date(F.lit("2020-01-01")).alias("amended_on"), F.lit("old").alias("previous_text"), F.lit(text).alias("new_text"), F.when(F.col("k") % 5 > 0, F.to_date(F.lit("2021-01-01"))).alias("effective_on")]
    return S.amendments_merged(p.where("k % 2 = 0").select(*row("kept")), p.where("k % 3 = 0").select(*row("changed"))).select("statute_id", "section", "new_text", F.col("effective_on").cast("string").alias("effective_on"))


def mappings(d: Domain) -> DataFrame:
    return d.table("part").select(F.lit("IPC").alias("legacy_code"), F.col("p_partkey").cast("string").alias("legacy_section"), F.lit("BNS").alias("new_code"), (F.col("p_partkey") + 100).cast("string").alias("new_section"), F.lit(True).alias("is_active"))


def mapping_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a mapping; every third changes one further on, adds one, or lacks an end."""
    d = Domain(spark, sf_dir)
    k = F.col("p_partkey")
    section = F.concat(F.lit(" "), (k + 20).cast("string"), F.when(k % 2 == 0, "a").otherwise(""))
    c = d.table("part").where("p_partkey % 3 = 0").select(F.lit("IPC").alias("legacy_code"), section.alias("legacy_section"), F.lit("BNS").alias("new_code"), F.when(k % 10 > 0, (k + 120).cast("string")).alias("new_section"), F.lit(False).alias("is_active"))
    return S.mappings_upserted(mappings(d), c)


def beyond(d: Domain) -> int:
    return d.table("part").count() * 6 // 5


def expanded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query of two sections is searched by, before and after the cutover."""
    d = Domain(spark, sf_dir)
    q = d.table("part").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, F.to_date(F.lit("2024-08-01"))).otherwise(F.to_date(F.lit("2023-08-01"))).alias("reference_date"), F.array(F.concat(F.lit("IPC "), (F.col("p_partkey") % beyond(d)).cast("string")), F.concat(F.lit("Section "), (F.col("p_partkey") % beyond(d) + 101).cast("string"), F.lit(" BNS")), F.concat(F.lit("IPC "), (F.col("p_partkey") % beyond(d)).cast("string"))).alias("r"))
    r = q.select("query_id", "reference_date", F.posexplode("r").alias("position", "reference"))
    return S.references_expanded(r, mappings(d)).select("query_id", F.array_join("references", "|").alias("references"))


def code_awareness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cases of which code is preferred on a day; a third expect the wrong one."""
    d = Domain(spark, sf_dir)
    k = F.col("p_partkey") * 7 % beyond(d) + 1
    new = F.col("p_partkey") % 2 == 0
    expected = F.when(F.col("p_partkey") % 3 == 0, F.lit("IPC 0")).when(new, F.concat(F.lit("BNS "), (k + 100).cast("string"))).otherwise(F.concat(F.lit("IPC "), k.cast("string")))
    c = d.table("part").select(F.col("p_partkey").alias("case_id"), F.concat(F.lit("IPC "), k.cast("string")).alias("reference"), F.when(new, F.to_date(F.lit("2024-08-01"))).otherwise(F.to_date(F.lit("2023-08-01"))).alias("reference_date"), expected.alias("expected"))
    return Q.code_awareness(c, S.mapped_references(c.select("reference", "reference_date").distinct(), mappings(d))).select("case_id", "preferred", "correct")


EXECUTIONS = """li AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS i FROM lineitem), ls AS (SELECT k, count(*) AS m, count(*) FILTER (q >= 10) AS good FROM li GROUP BY k),
ex AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS query_id, m, good, o_orderkey % 23 * 10 AS len, (o_orderkey % 23 * 10 + 47) // 48 AS toks, o_orderkey % 5 AS v, o_orderkey % 5 + o_orderkey % 3 AS claims, o_custkey AS customer FROM orders JOIN ls ON ls.k = o_orderkey)"""
STEPS = [("Analyzing query...", "Query analyzed"), ("Retrieving authorities...", "Authorities retrieved"), ("Building placeholder draft...", "Placeholder draft built"), ("Resolving citations...", "Citations resolved"), ("Verifying claims...", "Claims verified")]


def _event(place: str, kind: str, step: str = "NULL", extra: str = "NULL, NULL, NULL, NULL, NULL, NULL, NULL", source: str = "ex") -> str:
    return f"SELECT query_id, CAST({place} AS INT) AS sequence, '{kind}' AS type, {step} AS step, {extra} FROM {source}"


_rows = []
for _i, (_before, _after) in enumerate(STEPS):
    _at = f"{2 * _i + 1}" + (" + m" if _i == 4 else "")
    _rows.append(_event(_at, "STEP_START", f"'{_before}'"))
    _rows.append(_event(f"{2 * _i + 2}" + (" + m" if _i >= 3 else ""), "STEP_COMPLETE", f"'{_after}'", "NULL, NULL, NULL, NULL, NULL, NULL, " + ("CAST(good AS INT)" if _i == 3 else "NULL")))
_rows.append("SELECT query_id, CAST(7 + i AS INT), 'CITATION_RESOLVED', NULL, '[P' || n || ']', CAST(s AS VARCHAR), CASE WHEN q < 10 THEN 'UNVERIFIED' ELSE 'VERIFIED' END, NULL, NULL, NULL, NULL FROM li JOIN ex USING (k)")
_rows.append(_event("11 + m", "ANSWER_READY"))
_rows.append("SELECT query_id, CAST(12 + m + t AS INT), 'TOKEN', NULL, NULL, NULL, NULL, substr(repeat('0123456789', k % 23), t * 48 + 1, 48), NULL, NULL, NULL FROM ex, range(5) r(t) WHERE t < toks")
_rows.append(_event("12 + m + toks", "COMPLETE", "NULL", "NULL, NULL, NULL, NULL, round(v / greatest(claims, 1), 6), CAST(12 + m + toks AS INT), NULL"))
VERIFIED = "ve(query_id, sequence, type, step, placeholder, citation, status, token, confidence, event_count, n_verified) AS (" + " UNION ALL ".join(_rows) + ")"
MARKDOWN = """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority ELSE 'Structured Answer' END AS title FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 13 > 0 THEN 'VERIFIED' END AS overall_status, CASE WHEN k % 13 > 0 THEN 1 END AS n_sections, CASE WHEN k % 13 > 0 THEN md5('# ' || title || NN || 'Overall status: VERIFIED' || NN || '## Cases' || NN || '- claim ' || k || N || '  - Status: ' || CASE WHEN k % 2 = 0 THEN 'VERIFIED' ELSE 'UNCERTAIN' END
|| CASE WHEN k % 3 = 0 THEN N || '  - Citation: ' || k ELSE '' END || CASE WHEN k % 5 = 0 THEN N || '  - Source passage: passage' ELSE '' END || CASE WHEN k % 4 = 0 THEN NN || '### Verification' || NN || '- checked: 3 (VERIFIED)' ELSE '' END) END AS markdown FROM a""".replace("NN", "chr(10) || N").replace(" N ", " chr(10) ")
QUERIES = {f.__name__: f for f in [verified_events, streamed_events, answer_markdown, amendment_rows, mapping_changes, expanded_references, code_awareness]}
ORACLE_SQL = {
    "verified_events": f"WITH {EXECUTIONS}, {VERIFIED} SELECT * FROM ve",
    "streamed_events": f"""WITH {EXECUTIONS}, {VERIFIED}, w AS (SELECT *, CASE WHEN customer % 3 <> 0 THEN 'v' WHEN customer % 11 >= 8 THEN 'lost' WHEN customer % 2 = 0 THEN 'agent' ELSE 'v' END AS way FROM ex),
al AS (SELECT v.query_id, sequence, type FROM ve v JOIN w USING (query_id) WHERE way = 'v' UNION ALL SELECT query_id, i, CASE i WHEN 1 THEN 'STEP_ERROR' ELSE 'COMPLETE' END FROM w, range(1, 3) r(i) WHERE way = 'lost'
UNION ALL SELECT query_id, i, CASE WHEN i IN (1, 3) THEN 'STEP_START' WHEN i IN (2, 6) THEN 'STEP_COMPLETE' WHEN i IN (4, 5) THEN 'AGENT_LOG' WHEN i = 7 THEN 'ANSWER_READY' WHEN i = 8 + toks THEN 'COMPLETE' ELSE 'TOKEN' END FROM w, range(1, 14) r(i) WHERE way = 'agent' AND i <= 8 + toks)
SELECT type, count(*) AS n, count(DISTINCT query_id) AS n_queries, CAST(sum(sequence) AS BIGINT) AS places FROM al GROUP BY type""",
    "answer_markdown": MARKDOWN,
    "amendment_rows": "SELECT p_partkey % 100 AS statute_id, CAST(p_partkey AS VARCHAR) AS section, CASE WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'kept' END AS new_text, CASE WHEN p_partkey % 5 > 0 THEN '2021-01-01' END AS effective_on FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0",
    "mapping_changes": """WITH c AS (SELECT p_partkey + 20 AS n, p_partkey % 2 = 0 AS lettered FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 10 > 0)
SELECT 'IPC' AS legacy_code, CAST(p_partkey AS VARCHAR) AS legacy_section, 'BNS' AS new_code, CAST(p_partkey + 100 AS VARCHAR) AS new_section, p_partkey NOT IN (SELECT n FROM c WHERE NOT lettered) AS is_active FROM part
UNION ALL SELECT 'IPC', n || CASE WHEN lettered THEN 'A' ELSE '' END, 'BNS', CAST(n + 100 AS VARCHAR), FALSE FROM c WHERE lettered OR n NOT IN (SELECT p_partkey FROM part)""",
    "expanded_references": """WITH m AS (SELECT count(*) * 6 // 5 AS m FROM part), q AS (SELECT p_partkey AS query_id, p_partkey % m AS a, p_partkey % m + 1 AS b, p_partkey % 2 = 0 AS post FROM part, m),
x AS (SELECT query_id, CASE WHEN a IN (SELECT p_partkey FROM part) THEN CASE WHEN post THEN ['BNS ' || (a + 100), 'IPC ' || a] ELSE ['IPC ' || a, 'BNS ' || (a + 100)] END ELSE ['IPC ' || a] END AS r1,
CASE WHEN b IN (SELECT p_partkey FROM part) THEN CASE WHEN post THEN ['BNS ' || (b + 100), 'IPC ' || b] ELSE ['IPC ' || b, 'BNS ' || (b + 100)] END ELSE ['BNS ' || (b + 100)] END AS r2 FROM q)
SELECT query_id, array_to_string(r1 || r2, '|') AS "references" FROM x""",
    "code_awareness": """WITH m AS (SELECT count(*) * 6 // 5 AS m FROM part), c AS (SELECT p_partkey AS i, p_partkey * 7 % m + 1 AS k, p_partkey % 2 = 0 AS post FROM part, m)
SELECT i AS case_id, CASE WHEN post AND k IN (SELECT p_partkey FROM part) THEN 'BNS ' || (k + 100) ELSE 'IPC ' || k END AS preferred, i % 3 > 0 AND (NOT post OR k IN (SELECT p_partkey FROM part)) AS correct FROM c""",
}
