"""Published queries: ingest, ids, case files, answers, billing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..operators import answers as A
from ..operators import cases as K
from ..operators import execution as X
from ..operators import graph as G
from ..operators import quality as Q
from ..operators import state as S
from ..operators.export import appeal_statements, edge_statements
from ..sources import ingest, uploads
from .domain import Domain


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir).table("documents")
    return d.select("doc_id", ingest.document_id(F.col("source"), F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("uuid"))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir).legal_documents()
    return d.select("doc_id", ingest.collection(F.col("doc_type"), F.col("court")).alias("collection"), ingest.default_binding(F.col("court"), F.col("doc_type"))[0].alias("binding"))


def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in three forms and read back."""
    o = Domain(spark, sf_dir).table("orders")
    form = lambda f: F.date_format("o_orderdate", f)
    t = F.when(F.col("o_orderkey") % 3 == 0, form("d MMMM yyyy")).when(F.col("o_orderkey") % 3 == 1, form("d/M/yyyy")).otherwise(form("yyyy-MM-dd"))
    return o.select("o_orderkey", K.text_date(F.concat(F.lit("order of "), t, F.lit(" was allowed"))).cast("string").alias("date"))


def order_files(d: Domain) -> DataFrame:
    """Orders of customers as one-sentence documents of their case file."""
    o = d.table("orders")
    words = F.when(F.col("o_orderstatus") == "F", "Bail was rejected").when(F.col("o_orderstatus") == "O", "Bail was granted").otherwise("The order is reserved")
    text = F.concat(words, F.lit(" by the Bombay High Court on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("."))
    charged = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.concat(F.lit("Section "), (F.col("o_orderkey") % 40).cast("string"), F.lit(" IPC")))).otherwise(F.array().cast("array<string>"))
    return o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("doc_index"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("file_name"), text.alias("text"), ((F.col("o_orderkey") % 8) / 8).alias("confidence"), charged.alias("sections"))


def order_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders told in case files: outcomes by status, none for reserved ones."""
    return K.previous_orders(order_files(Domain(spark, sf_dir))).select("case_id", F.col("doc_index").cast("long").alias("doc_index"), "outcome", "court", F.col("date").cast("string").alias("date"))


def bail_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bail of every case; a case whose documents speak of bail in no order has one pending entry."""
    d = order_files(Domain(spark, sf_dir))
    d = d.withColumn("text", F.when(F.col("case_id") % 7 == 0, F.lit("Papers on bail were filed.")).otherwise(F.col("text")))
    return K.bail_history(d).select("case_id", F.col("doc_index").cast("long").alias("doc_index"), F.col("date").cast("string").alias("date"), "status", "summary")


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of every customer: type, stage, confidence, charges, issues."""
    c = K.case_files(order_files(Domain(spark, sf_dir)))
    return c.select("case_id", "case_type", "stage", "court", F.round("confidence", 3).alias("confidence"), F.size("sections").alias("n_sections"), F.array_join("statutes", ",").alias("statutes"), F.size("key_facts").alias("n_facts"), F.array_join("open_issues", "|").alias("open_issues"))


def edge_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many follow and distinguish it, and the last that overrules it."""
    d = Domain(spark, sf_dir)
    return G.linkage(d.edges(), d.legal_documents()).withColumn("overruled_date", F.col("overruled_date").cast("string")).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("followed_by", "distinguished_by")})


def research_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case files of customers through the agents: plan, findings, notes."""
    c = K.case_files(order_files(Domain(spark, sf_dir))).withColumn("query", F.concat(F.lit("case "), F.col("case_id").cast("string"))).withColumn("petitioner", F.when(F.col("case_id") % 2 == 0, F.lit("A"))).withColumn("equivalents", F.array().cast("array<string>"))
    a = X.agentic(c)
    return a.select("case_id", F.md5("synthesis").alias("synthesis"), F.array_join(F.transform("plan", lambda q: q["question"]), "|").alias("questions"), "verification.issues_flagged", F.element_at("logs", 2).message.alias("planned"))


def claim_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims, their lines as citations: status, what is named, why; orders without lines have no citation."""
    d = Domain(spark, sf_dir)
    claims = d.table("orders").select(F.col("o_orderkey").alias("claim_id"))
    li = d.table("lineitem")
    grounding = F.when(F.col("l_quantity") > 45, "MISGROUNDED").when(F.col("l_quantity") > 35, "UNCERTAIN").otherwise("VERIFIED")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_quantity", "l_partkey"))
    cites = li.select(F.col("l_orderkey").alias("claim_id"), at.alias("position"), (F.col("l_suppkey") % 7 != 0).alias("verified"), F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")).alias("citation"), grounding.alias("grounding"), (F.col("l_suppkey") % 11 == 0).alias("pending"), F.lit("checked").alias("reason"), F.col("l_suppkey").alias("doc_id"))
    return X.assessed(claims, cites).select("claim_id", "status", "citation", F.md5("reason").alias("reason"), "doc_id")


def case_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of a case that label its sides, or leave them to the parties that are listed."""
    o = Domain(spark, sf_dir).table("orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Case WP/"), (k % 1000).cast("string"), F.lit("/2020. "), F.when(F.col("o_custkey") % 3 == 0, F.lit("Petitioner: A Kumar. ")).otherwise(""), F.when(F.col("o_custkey") % 4 == 0, F.lit("Respondent: State of Goa. ")).otherwise(""), F.lit("Adv. Rao"), F.lit(" for the side."))
    d = o.select(F.col("o_custkey").alias("case_id"), k.alias("doc_index"), text.alias("text"))
    names = F.array(F.lit("Union of India"), F.lit("B. Singh"), F.lit("b singh"), F.lit("Commissioner"))
    c = o.select(F.col("o_custkey").alias("case_id")).distinct().where("case_id % 5 < 4").select("case_id", F.posexplode(names).alias("place", "canonical")).withColumn("aliases", F.array("canonical"))
    m = K.merged_parties(c)
    sides = K.case_sides(d, m)
    n = m.groupBy("case_id").agg(F.count("*").alias("n_parties"), F.max(F.size("aliases")).alias("n_aliases"))
    return sides.join(n, "case_id", "left").select("case_id", "petitioner", "respondent", F.array_join("advocates", ",").alias("advocates"), "case_number", "n_parties", "n_aliases")


def verification_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    k = F.col("o_orderkey")
    a = d.table("orders").select(k.alias("answer_id"), (k % 3).alias("verified"), (k % 4).alias("uncertain"), (k % 2).alias("unsupported"))
    r = d.table("lineitem").select(F.col("l_orderkey").alias("answer_id"), (F.col("l_quantity") > 20).alias("verified"))
    return X.verification_items(a, r)


def cited_documents(d: Domain) -> DataFrame:
    return d.legal_documents().withColumn("citation", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("AIR "), F.col("doc_id").cast("string"))))


def graph_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return edge_statements(d.edges(), cited_documents(d))


def appeal_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an appeal from the one before it in its block of four."""
    n = Domain(spark, sf_dir).table("documents").where("doc_id % 4 > 0")
    outcome = F.element_at(F.array(*map(F.lit, ["UPHELD", "REVERSED", "DISMISSED"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return appeal_statements(n.select((F.col("doc_id") - 1).alias("parent"), F.col("doc_id").alias("child"), outcome.alias("outcome"), (F.col("doc_id") % 4 == 3).alias("is_final")))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Domain(spark, sf_dir).table("orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = o.withColumn("n", F.row_number().over(w)).where("n <= 20")
    return o.select("o_custkey", "o_orderkey", "n", F.round(F.col("o_totalprice") * 100, 0).cast("long").alias("amount_minor"), F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("paid_at"))


def subscription_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer put in place of their oldest row; periods of 30 days."""
    o = Domain(spark, sf_dir).table("orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    old = S.latest(o, ["o_custkey"], [F.asc("day"), F.asc("o_orderkey")])
    new = S.latest(o, ["o_custkey"], [F.desc("day"), F.desc("o_orderkey")]).where("o_custkey % 2 = 0")
    return S.upserted(old, new, ["o_custkey"]).select("o_custkey", "o_orderkey", F.date_add("day", 30).cast("string").alias("period_end"))


def upload_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as pages of a file, typed or scanned by return flag."""
    p = Domain(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.when(F.col("l_returnflag") == "R", "typed_pdf").otherwise("scanned_pdf").alias("kind"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))
    return uploads.document_modes(p).select("path", "mode")


def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order's lines as its sources, in order of first mention."""
    a = Domain(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").alias("answer_id"), (F.col("l_suppkey") % 3).alias("doc_id"), F.lit(0).alias("chunk_id"), F.lit("c").alias("citation"), F.col("l_linenumber").alias("position"))
    return A.sources(a).select("answer_id", "doc_id", "position", "rank")


def answer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Domain(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").cast("string").alias("query_id"), F.col("l_returnflag").alias("section"), F.col("l_suppkey").alias("doc_id"))
    nodes, _ = A.answer_graph(a)
    return nodes.groupBy("level").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("y"))


def rouge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item against the next: longest common subsequence, METEOR."""
    m = Q.quality(item_cases(Domain(spark, sf_dir)))
    return m.select(F.col("case_id").alias("item_id"), F.round("rouge_l", 6).alias("rouge_l"), F.round("meteor", 6).alias("meteor"))


def item_cases(d: Domain) -> DataFrame:
    """Items as answers to the next item; contexts are the two after."""
    b = d.table("benchmark").select("item_id", "text")
    after = lambda k: b.select((F.col("item_id") - k).alias("item_id"), F.col("text").alias(f"t{k}"))
    c = b.join(after(1), "item_id").join(after(2), "item_id", "left").join(after(3), "item_id", "left")
    none = F.array().cast("array<string>")
    noisy = F.when((F.col("item_id") % 3 == 0) & F.col("t3").isNotNull(), F.array("t3")).otherwise(none)
    return c.select(F.col("item_id").alias("case_id"), F.coalesce("t2", F.lit("")).alias("query"), F.col("text").alias("answer"), F.col("t1").alias("reference"), F.array_compact(F.array("t2", F.when(F.col("item_id") % 2 == 0, F.col("text")))).alias("contexts"), noisy.alias("noisy_contexts"), none.alias("reference_entities"), none.alias("reference_contexts"))


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Q.summary(Q.quality(item_cases(Domain(spark, sf_dir))))
    return s.select("n_cases", *[F.round(m, 4).alias(m) for m in Q.MEASURES])


def report_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs of reports, in overlapping windows."""
    d = Domain(spark, sf_dir).table("documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("paragraphs"))
    return C.report_chunks(d).select("doc_id", "chunk_index", "first", "end")


QUERIES = {f.__name__: f for f in [document_ids, collections, text_dates, order_statements, bail_histories, case_files, case_sides, verification_items, research_notes, claim_assessments, edge_linkage, graph_statements, appeal_exports, invoices, subscription_periods, upload_modes, answer_sources, answer_graph, rouge_scores, quality_summary, report_windows]}
EDGES = """WITH e AS (SELECT DISTINCT source, target, (['follows','distinguishes','explains','refers_to','affirms','overrules','follows','refers_to','explains'])[source % 9 + 1] AS type
FROM (SELECT doc_id AS source, unnest([doc_id // 2, doc_id // 3]) AS target FROM documents) WHERE source <> target)"""
#: Items against the next: a row of the subsequence table per step; k-th stems of either side aligned.
ROUGE = r"""tk AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark), pr AS (SELECT a.item_id, a.t AS a, b.t AS b FROM tk a JOIN tk b ON b.item_id = a.item_id + 1),
lr AS (SELECT item_id, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS cells FROM pr
UNION ALL SELECT item_id, a, b, i + 1, list_prepend(0, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN cells[k] + 1 ELSE cells[k + 1] END)))) FROM lr WHERE i < len(a)),
ls AS (SELECT item_id, cells[-1] AS lcs FROM lr WHERE i = len(a)),
sx AS (SELECT item_id, a, b, list_transform(a, lambda t: STEM) AS sa, list_transform(b, lambda t: STEM) AS sb FROM pr),
pa AS (SELECT *, row_number() OVER (PARTITION BY item_id, s ORDER BY i) AS k FROM (SELECT item_id, unnest(sa) AS s, unnest(range(len(sa))) AS i FROM sx)), pb AS (SELECT *, row_number() OVER (PARTITION BY item_id, s ORDER BY j) AS k FROM (SELECT item_id, unnest(sb) AS s, unnest(range(len(sb))) AS j FROM sx)),
al AS (SELECT item_id, i, j, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM pa JOIN pb USING (item_id, s, k) WINDOW w AS (PARTITION BY item_id ORDER BY i)),
ag AS (SELECT item_id, count(*) AS m, 1 + count(*) FILTER (pi IS NOT NULL AND NOT (i = pi + 1 AND j = pj + 1)) AS runs FROM al GROUP BY item_id),
sc AS (SELECT * FROM sx JOIN ls USING (item_id) LEFT JOIN ag USING (item_id))""".replace("STEM", "CASE " + " ".join(f"WHEN t LIKE '%{s}' AND length(t) >= {len(s) + 3} THEN left(t, length(t) - {len(s)})" for s in Q.SUFFIXES) + " ELSE t END")
#: What the contexts hold. Sentences are whole items here; equal texts support each other, others do where their vectors are near.
SUPPORT = r"""it AS (SELECT item_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM benchmark),
cx AS (SELECT a.item_id, a.text AS answer, b.text AS reference, c.text AS query, list_filter([c.text, CASE WHEN a.item_id % 2 = 0 THEN a.text END], lambda x: x IS NOT NULL) AS contexts, CASE WHEN a.item_id % 3 = 0 THEN d.text END AS noise FROM it a JOIN it b ON b.item_id = a.item_id + 1 LEFT JOIN it c ON c.item_id = a.item_id + 2 LEFT JOIN it d ON d.item_id = a.item_id + 3),
sn AS (SELECT item_id, 'a' AS side, unnest(SENTENCES(answer)) AS s FROM cx UNION ALL SELECT item_id, 'c', unnest(SENTENCES(c)) FROM (SELECT item_id, unnest(contexts) AS c FROM cx) UNION ALL SELECT item_id, 'r', unnest(SENTENCES(c)) FROM (SELECT item_id, reference AS c FROM cx)),
tx AS (SELECT DISTINCT s FROM (SELECT s FROM sn UNION ALL SELECT answer FROM cx UNION ALL SELECT reference FROM cx UNION ALL SELECT query FROM cx UNION ALL SELECT unnest(contexts) FROM cx UNION ALL SELECT noise FROM cx)),
hw AS (SELECT s, word, count(*) AS n FROM (SELECT s, unnest(list_filter(regexp_split_to_array(lower(trim(s)), '\s+'), lambda x: x <> '')) AS word FROM tx) GROUP BY ALL), hx AS (SELECT word, k, CAST('0x' || substr(sha256(word), 2 * k + 1, 2) AS INT) / 255.0::DOUBLE - 0.5 AS x FROM (SELECT DISTINCT word FROM hw), range(24) t(k)),
ve AS (SELECT s, list(v ORDER BY k) AS v FROM (SELECT s, k, sum(n * x) AS v FROM hw JOIN hx USING (word) GROUP BY ALL) GROUP BY s),
fa AS (SELECT a.item_id, a.side, a.s, max(list_cosine_similarity(x.v, y.v)) AS best FROM sn a JOIN sn c ON c.item_id = a.item_id AND a.side <> 'c' AND c.side = 'c' JOIN ve x ON x.s = a.s JOIN ve y ON y.s = c.s GROUP BY ALL),
fs AS (SELECT item_id, avg(CASE WHEN best >= 0.72 THEN 1.0 ELSE 0 END) FILTER (side = 'a') AS faith, avg(CASE WHEN best >= 0.72 THEN 1.0 ELSE 0 END) FILTER (side = 'r') AS recalled FROM fa GROUP BY item_id),
si AS (SELECT item_id, coalesce(list_cosine_similarity(x.v, y.v), 0) AS alike, coalesce(list_cosine_similarity(x.v, z.v), 0) AS relevant FROM cx LEFT JOIN ve x ON x.s = answer LEFT JOIN ve y ON y.s = reference LEFT JOIN ve z ON z.s = query),
pc AS (SELECT item_id, noisy, avg(CASE WHEN list_cosine_similarity(x.v, y.v) >= 0.55 THEN 1.0 ELSE 0 END) AS p FROM (SELECT item_id, answer, 0 AS noisy, unnest(contexts) AS c FROM cx UNION ALL SELECT item_id, answer, 1, unnest(list_append(contexts, noise)) FROM cx WHERE noise IS NOT NULL) z JOIN ve x ON x.s = answer JOIN ve y ON y.s = c GROUP BY ALL),
en AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(reference), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT regexp_full_match(t, '\d+') AND NOT list_contains([STOPS], t))) AS names, lower(array_to_string(contexts, ' ')) AS whole, lower(answer) AS said FROM cx),
su AS (SELECT cx.item_id, coalesce(faith, 0) AS faith, coalesce(recalled, 0) AS recalled, alike, relevant, coalesce(p0.p, 0) AS helpful, CASE WHEN len(names) = 0 THEN 1 ELSE len(list_filter(names, lambda n: contains(said, n))) / len(names) END AS named, CASE WHEN noise IS NULL THEN 1 ELSE greatest(0, 1 - abs(coalesce(p0.p, 0) - p1.p)) END AS robust, CASE WHEN len(names) = 0 THEN 0 ELSE len(list_filter(names, lambda n: contains(whole, n))) / len(names) END AS recall
FROM cx JOIN en USING (item_id) JOIN si USING (item_id) LEFT JOIN fs USING (item_id) LEFT JOIN pc p0 ON p0.item_id = cx.item_id AND p0.noisy = 0 LEFT JOIN pc p1 ON p1.item_id = cx.item_id AND p1.noisy = 1)""".replace("STOPS", ", ".join(f"'{w}'" for w in Q.STOPWORDS))
SUPPORT = SUPPORT.replace("SENTENCES(answer)", "string_split(regexp_replace(trim(regexp_replace(answer, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))").replace("SENTENCES(c)", "string_split(regexp_replace(trim(regexp_replace(c, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))")
ORDER_FILES = """o AS (SELECT o_custkey AS case_id, o_orderkey AS doc_index, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
CASE o_orderstatus WHEN 'F' THEN 'Bail was rejected' WHEN 'O' THEN 'Bail was granted' ELSE 'The order is reserved' END || ' by the Bombay High Court on ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '.' AS text FROM orders)"""
TYPE = "CASE doc_id % 5 WHEN 3 THEN 'statute' WHEN 4 THEN 'constitution' ELSE 'judgment' END"
ORACLE_SQL = {
    "document_ids": """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '|' || doc_id || '|' || sha256(text))) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""",
    "collections": f"SELECT doc_id, CASE {TYPE} WHEN 'statute' THEN 'statutes' WHEN 'constitution' THEN 'constitution' ELSE CASE WHEN doc_id % 4 = 0 THEN 'sc_judgments' ELSE 'hc_judgments' END END AS collection, CASE WHEN doc_id % 5 >= 3 OR doc_id % 4 = 0 THEN 'All India' WHEN doc_id % 4 = 1 THEN 'Bombay High Court' WHEN doc_id % 4 = 2 THEN 'Delhi High Court' ELSE 'NCLT Principal Bench' END AS binding FROM documents",
    "text_dates": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders",
    "order_statements": "SELECT o_custkey AS case_id, o_orderkey AS doc_index, CASE o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'O' THEN 'granted' END AS outcome, 'Bombay High Court' AS court, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders",
    "bail_histories": f"""WITH {ORDER_FILES}
SELECT case_id, doc_index, day AS date, CASE o_orderstatus WHEN 'F' THEN 'rejected' ELSE 'granted' END AS status, text AS summary FROM o WHERE case_id % 7 <> 0 AND o_orderstatus IN ('F', 'O')
UNION ALL SELECT case_id, min(doc_index), NULL, 'pending', 'Bail proceedings referenced in order-' || min(doc_index) || '.' FROM o WHERE case_id % 7 = 0 GROUP BY case_id""",
    "case_files": f"""WITH {ORDER_FILES},
c AS (SELECT case_id, bool_or(o_orderstatus IN ('F', 'O')) AS bail, bool_or(o_orderstatus = 'F') AS refused, round(avg((doc_index % 8) / 8), 3) AS confidence, count(DISTINCT (day, text)) AS n_facts FROM o GROUP BY case_id),
f AS (SELECT case_id, doc_index % 40 AS s, min(doc_index) AS first FROM o WHERE doc_index % 3 = 0 GROUP BY ALL), g AS (SELECT case_id, list('IPC ' || s ORDER BY first) AS sections FROM f GROUP BY case_id)
SELECT case_id, CASE WHEN sections IS NOT NULL OR bail THEN 'criminal' END AS case_type, CASE WHEN bail THEN 'bail' END AS stage, 'Bombay High Court' AS court, confidence, CAST(coalesce(len(sections), 0) AS INT) AS n_sections, CASE WHEN sections IS NULL THEN '' ELSE 'IPC' END AS statutes, CAST(n_facts AS INT) AS n_facts,
CASE WHEN bail THEN 'Whether bail should be granted for ' || coalesce(array_to_string(sections[1:2], ', '), 'the alleged offences') || '.' || CASE WHEN refused THEN '|Whether changed circumstances justify bail after the earlier rejection order.' ELSE '' END
 WHEN sections IS NOT NULL THEN 'What relief is available under ' || sections[1] || '?' ELSE '' END AS open_issues FROM c LEFT JOIN g USING (case_id)""",
    "research_notes": f"""WITH {ORDER_FILES}, b AS (SELECT case_id, bool_or(o_orderstatus IN ('F', 'O')) AS bail, bool_or(o_orderstatus = 'F') AS refused, count(*) FILTER (o_orderstatus = 'F') AS n_refused FROM o GROUP BY case_id),
f AS (SELECT case_id, doc_index % 40 AS s, min(doc_index) AS first FROM o WHERE doc_index % 3 = 0 GROUP BY ALL), g AS (SELECT case_id, list('IPC ' || s ORDER BY first) AS sections FROM f GROUP BY case_id),
x AS (SELECT *, CASE WHEN bail THEN 'bail' END AS stage, CASE WHEN bail THEN ['Whether bail should be granted for ' || coalesce(array_to_string(sections[1:2], ', '), 'the alleged offences') || '.'] || CASE WHEN refused THEN ['Whether changed circumstances justify bail after the earlier rejection order.'] ELSE [] END
 WHEN sections IS NOT NULL THEN ['What relief is available under ' || sections[1] || '?'] ELSE [] END AS issues FROM b LEFT JOIN g USING (case_id))
SELECT case_id, md5('Legal Position: For ' || CASE WHEN case_id % 2 = 0 THEN 'A' ELSE 'the applicant' END || ', the uploaded record indicates a ' || coalesce(stage, 'current proceedings') || ' matter. Statutory Findings: ' || coalesce('Primary statutory charge identified: ' || sections[1] || '.', 'No explicit criminal-code sections were extracted from the uploaded record.')
|| ' Precedent Findings: Binding precedents must align with the ' || coalesce(stage, 'general') || ' stage and uploaded court context. Priority should be given to authorities binding on Bombay High Court. Earlier adverse orders must be distinguished with changed circumstances. Counterpoints: '
|| CASE WHEN n_refused > 0 THEN rtrim(repeat('Prior order from Bombay High Court was rejected. ', n_refused)) ELSE 'No internal contradiction detected in uploaded procedural history.' END || ' Open Issues: ' || CASE WHEN len(issues) > 0 THEN array_to_string(issues, ' ') ELSE 'No additional open issues extracted.' END) AS synthesis,
CASE WHEN bail THEN 'What statutory bail framework applies to ' || coalesce(sections[1], 'the alleged offences') || '?|Which binding precedents support bail despite allegations under ' || coalesce(sections[1], 'the alleged offences') || '?|How should the earlier rejection order be distinguished?|' || issues[1]
 ELSE 'What is the controlling legal issue in the uploaded matter: case ' || case_id || '?|Which statutes and precedents are most directly implicated?' END AS questions, CAST(greatest(1, n_refused) AS INT) AS issues_flagged,
'Planned ' || CASE WHEN bail THEN 4 ELSE 2 END || ' research questions using ' || coalesce(stage, 'general') || '-focused uploaded-document research.' AS planned FROM x""",
    "claim_assessments": f"""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_partkey) AS i, l_suppkey % 7 <> 0 AS ok, 'S' || (l_suppkey % 5) AS c, l_suppkey AS d, CASE WHEN l_suppkey % 7 = 0 OR l_quantity > 45 THEN 2 WHEN l_suppkey % 11 = 0 OR l_quantity > 35 THEN 1 ELSE 0 END AS worst FROM lineitem),
n AS (SELECT k, string_agg(c, '; ' ORDER BY i) AS citation FROM (SELECT k, c, min(i) AS i FROM l WHERE ok GROUP BY k, c) GROUP BY k),
a AS (SELECT k, max(worst) AS worst, string_agg(CASE WHEN ok THEN 'checked' ELSE '{X.UNVERIFIED}' END, '; ' ORDER BY i) AS reason, arg_min(d, i) FILTER (ok) AS d FROM l GROUP BY k)
SELECT o_orderkey AS claim_id, CASE worst WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'UNCERTAIN' ELSE 'UNSUPPORTED' END AS status, citation, md5(coalesce(reason, '{X.NO_CITATION}')) AS reason, d AS doc_id FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN n ON n.k = o_orderkey""",
    "case_sides": """WITH c AS (SELECT o_custkey AS case_id, min(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT case_id, CASE WHEN case_id % 3 = 0 THEN 'A Kumar' WHEN case_id % 5 < 4 THEN 'B. Singh' END AS petitioner, CASE WHEN case_id % 4 = 0 THEN 'State of Goa' WHEN case_id % 5 < 4 THEN 'Union of India' END AS respondent, 'Rao' AS advocates, 'WP/' || (k % 1000) || '/2020' AS case_number, CASE WHEN case_id % 5 < 4 THEN 3 END AS n_parties, CASE WHEN case_id % 5 < 4 THEN 2 END AS n_aliases FROM c""",
    "verification_items": """WITH r AS (SELECT l_orderkey AS k, count(*) FILTER (l_quantity > 20) AS f, count(*) FILTER (NOT l_quantity > 20) AS m FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey AS k, o_orderkey % 3 AS v, o_orderkey % 4 AS u, o_orderkey % 2 AS x, coalesce(f, 0) AS f, coalesce(m, 0) AS m FROM orders LEFT JOIN r ON r.k = o_orderkey)
SELECT k AS answer_id, CAST(p AS INT) AS place, (['Verified Claims', 'Claims Requiring Review', 'Unverified Claims', 'Resolved Citations', 'Unresolved Citations'])[p + 1] AS label, CAST(([v, u, x, f, m])[p + 1] AS VARCHAR) AS value,
CASE WHEN p IN (0, 3) OR ([v, u, x, f, m])[p + 1] = 0 THEN 'VERIFIED' WHEN p = 1 THEN 'UNCERTAIN' ELSE 'UNVERIFIED' END AS status FROM a, range(5) t(p)""",
    "appeal_exports": "SELECT doc_id - 1 AS parent, doc_id AS child, 'MERGE (parent:JudgmentNode {doc_id: QQ' || (doc_id - 1) || 'QQ})' || chr(10) || 'MERGE (child:JudgmentNode {doc_id: QQ' || doc_id || 'QQ})' || chr(10) || 'MERGE (parent)-[:APPEALED_TO {outcome: QQ' || (['UPHELD', 'REVERSED', 'DISMISSED'])[doc_id % 3 + 1] || 'QQ, is_final_authority: ' || (doc_id % 4 = 3) || '}]->(child)' AS statement FROM documents WHERE doc_id % 4 > 0".replace("QQ", "\x27\x27"),
    "edge_linkage": f"""{EDGES}, g AS (SELECT target, coalesce(string_agg(CAST(source AS VARCHAR), ',' ORDER BY source) FILTER (type = 'follows'), '') AS followed_by, coalesce(string_agg(CAST(source AS VARCHAR), ',' ORDER BY source) FILTER (type = 'distinguishes'), '') AS distinguished_by, max(CASE WHEN type = 'overrules' THEN source END) AS overruled_by FROM e GROUP BY target)
SELECT target, followed_by, distinguished_by, overruled_by, CAST(CAST(DATE '1950-01-01' + CAST(overruled_by AS INT) AS DATE) AS VARCHAR) AS overruled_date, CASE WHEN overruled_by IS NOT NULL OR toxic = 1 THEN 'OVERRULED' ELSE 'GOOD_LAW' END AS current_validity FROM g JOIN documents d ON d.doc_id = target LEFT JOIN labels l ON l.doc_id = target""",
    "graph_statements": f"""{EDGES}, ld AS (SELECT doc_id, CASE WHEN doc_id % 5 >= 3 THEN 'StatuteNode' ELSE 'JudgmentNode' END AS label, CASE WHEN doc_id % 3 = 0 THEN 'AIR ' || doc_id ELSE '' END AS citation,
CASE doc_id % 4 WHEN 0 THEN 'Supreme Court' WHEN 1 THEN 'Bombay High Court' WHEN 2 THEN 'Delhi High Court' ELSE 'NCLT Principal Bench' END AS court, CAST(CAST(DATE '1950-01-01' + CAST(doc_id AS INT) AS DATE) AS VARCHAR) AS date FROM documents),
n AS (SELECT doc_id, alias, 'MERGE (' || alias || ':' || label || ' {{doc_id: QQ' || doc_id || 'QQ}})' || chr(10) || 'SET ' || alias || '.citation = QQ' || citation || 'QQ, ' || alias || '.court = QQ' || court || 'QQ, ' || alias || '.date = QQ' || date || 'QQ' AS node FROM ld, (SELECT unnest(['source', 'target']) AS alias))
SELECT source, target, s.node || chr(10) || t.node || chr(10) || 'MERGE (source)-[:CITES {{citation_type: QQ' || type || 'QQ}}]->(target)' AS statement FROM e JOIN n s ON s.doc_id = source AND s.alias = 'source' JOIN n t ON t.doc_id = target AND t.alias = 'target'""".replace("QQ", "\x27\x27"),
    "invoices": "SELECT o_custkey, o_orderkey, n, CAST(round(o_totalprice * 100, 0) AS BIGINT) AS amount_minor, CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS paid_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 20",
    "subscription_periods": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) AS z FROM o)
SELECT o_custkey, o_orderkey, CAST(CAST(day + 30 AS DATE) AS VARCHAR) AS period_end FROM r WHERE (o_custkey % 2 = 0 AND z = 1) OR (o_custkey % 2 = 1 AND a = 1)""",
    "upload_modes": "SELECT CAST(l_orderkey AS VARCHAR) AS path, CASE WHEN count(DISTINCT l_returnflag = 'R') > 1 THEN 'mixed' WHEN max(l_returnflag = 'R') THEN 'typed' ELSE 'scanned' END AS mode FROM lineitem GROUP BY l_orderkey",
    "answer_sources": "WITH x AS (SELECT l_orderkey AS answer_id, l_suppkey % 3 AS doc_id, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY position, doc_id) AS rank FROM x",
    "rouge_scores": f"""WITH RECURSIVE {ROUGE} SELECT item_id, round(coalesce(CASE WHEN lcs > 0 THEN 2.0 * lcs / (len(a) + len(b)) END, 0), 6) AS rouge_l, round(CASE WHEN sa = sb AND len(sa) > 0 THEN 1 WHEN m IS NULL THEN 0 ELSE 10 * (m / len(a)) * (m / len(b)) / (m / len(b) + 9 * (m / len(a))) * (1 - 0.5 * pow(runs / m, 3)) END, 6) AS meteor FROM sc""",
    "quality_summary": f"""WITH RECURSIVE {ROUGE}, {SUPPORT},
ms AS (SELECT *, CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN 0 WHEN sa = sb THEN 1 WHEN m IS NULL THEN 0 ELSE 10 * (m / len(a)) * (m / len(b)) / greatest(m / len(b) + 9 * (m / len(a)), 1e-9) * (1 - 0.5 * pow(runs / m, 3)) END AS meteor FROM sc JOIN su USING (item_id))
SELECT count(*) AS n_cases, round(avg(alike), 4) AS bert_score_f1, round(avg(coalesce(CASE WHEN lcs > 0 THEN 2.0 * lcs / (len(a) + len(b)) END, 0)), 4) AS rouge_l, round(avg(meteor), 4) AS meteor, round(avg(faith), 4) AS faithfulness, round(avg(relevant), 4) AS answer_relevancy,
round(avg(helpful), 4) AS context_precision, round(avg(recalled), 4) AS context_recall, round(avg(recall), 4) AS context_entity_recall, round(1 - avg(faith), 4) AS hallucination_score, round(avg(helpful), 4) AS contextual_precision, round(avg(recalled), 4) AS contextual_recall,
round(avg(0.6 * alike + 0.4 * named), 4) AS g_eval_legal_accuracy, round(avg(robust), 4) AS noise_robustness FROM ms""",
    "report_windows": r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ps FROM documents),
w AS (SELECT doc_id, list_transform(ps, lambda x: len(list_filter(regexp_split_to_array(trim(x), '\s+'), lambda y: y <> ''))) AS ws FROM p WHERE len(ps) > 0),
r AS (SELECT doc_id, ws, 0 AS chunk_index, 0 AS first, greatest(1, len(list_filter(range(1, len(ws) + 1), lambda k: k = 1 OR list_sum(ws[1:k]) <= 220))) AS e FROM w
UNION ALL SELECT doc_id, ws, chunk_index + 1, greatest(first + 1, e - 1), greatest(first + 1, e - 1) + greatest(1, len(list_filter(range(1, len(ws) - greatest(first + 1, e - 1) + 1), lambda k: k = 1 OR list_sum(ws[greatest(first + 1, e - 1) + 1:greatest(first + 1, e - 1) + k]) <= 220))) FROM r WHERE e < len(ws))
SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(first AS INT) AS first, CAST(e AS INT) AS end FROM r""",
    "answer_graph": """WITH a AS (SELECT * FROM lineitem), c AS (SELECT 0 AS level, count(DISTINCT l_orderkey) AS n FROM a UNION ALL SELECT 1, count(DISTINCT (l_orderkey, l_returnflag)) FROM a UNION ALL SELECT 2, count(DISTINCT l_suppkey) FROM a)
SELECT level, n, round(n / 2, 4) AS y FROM c""",
}
