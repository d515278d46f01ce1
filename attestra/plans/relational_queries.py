"""Published queries: graph, state, quotas, verification, evaluation, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import collections as V_
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import listings as L
from ..operators import state as S
from ..operators import verify as V
from ..streaming import events as X
from .domain import Domain


def appeal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains doc_id to doc_id + 1 within blocks of 100: final authority and length of the path; one block in ten runs in a circle."""
    n = Domain(spark, sf_dir).table("documents").select("doc_id")
    i = F.col("doc_id")
    onward = F.when(i % 100 < 99, i + 1).when(F.floor(i / 100) % 10 == 3, i - 50)
    links = n.select(i.alias("node"), onward.alias("next")).where("next is not null").join(n.select(i.alias("next")), "next", "left_semi")
    return G.chains(links.select("node", "next"))


def appeal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Domain(spark, sf_dir).table("documents").select((F.col("doc_id") / 4).cast("long").alias("chain"), "doc_id", F.element_at(F.array(*map(F.lit, OUTCOMES)), (F.col("doc_id") % 5 + 1).cast("int")).alias("outcome"))
    a = o.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "outcome"))), lambda x: x["outcome"]).alias("outcomes"))
    return a.select("chain", G.effective_outcome(F.col("outcomes")).alias("outcome"))


OUTCOMES = ["UPHELD", "REVERSED", "MODIFIED", "REMANDED", "DISMISSED"]


def court_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir).legal_documents()
    return d.groupBy("court").agg(F.count("*").alias("n")).select("court", "n", G.court_level(F.col("court")).alias("level"))


def validity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates to every tenth document, by the next one."""
    d = Domain(spark, sf_dir)
    u = d.table("documents").where("doc_id % 10 = 1").select(F.col("doc_id").alias("target"), F.lit("OVERRULED").alias("new_validity"), (F.col("doc_id") + 1).alias("authority"), F.to_date(F.lit("2024-01-01")).alias("authority_date"))
    out = S.judgment_updates(d.legal_documents().select("doc_id", "current_validity"), u, d.edges())
    return out.select("doc_id", "current_validity", "overruled_by", "stale", "stale_reason")


def statute_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Domain(spark, sf_dir).table("part").select(F.col("p_partkey").alias("statute_id"), F.col("p_size").alias("section"), F.col("p_name").alias("text"), F.lit(True).alias("in_force"))
    u = p.where("statute_id % 3 = 0").select("statute_id", "section", F.when(F.col("statute_id") % 2 == 0, F.upper("text")).otherwise(F.col("text")).alias("new_text"), F.when(F.col("statute_id") % 9 == 0, False).otherwise(True).alias("new_in_force"))
    return S.statute_updates(p, u).select("statute_id", "section", "text", "in_force", "validity", "stale", "reembed")


def code_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to sections by number of part, before and after the cutover."""
    d = Domain(spark, sf_dir).table("part").select("p_partkey", "p_size")
    m = d.where("p_partkey <= 30").select(F.lit("IPC").alias("legacy_code"), F.col("p_partkey").cast("string").alias("legacy_section"), F.lit("BNS").alias("new_code"), (F.col("p_partkey") + 100).cast("string").alias("new_section"), (F.col("p_partkey") % 7 != 0).alias("is_active"))
    r = d.select(F.concat(F.lit("Section "), (F.col("p_partkey") % 50).cast("string"), F.lit(" IPC")).alias("reference"), F.when(F.col("p_size") % 2 == 0, F.to_date(F.lit("2024-08-01"))).otherwise(F.to_date(F.lit("2023-08-01"))).alias("reference_date")).distinct()
    return S.mapped_references(r, m).select("reference", "section", "preferred", "equivalent", "mapped", F.year("reference_date").alias("year"))


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.daily_counts(Domain(spark, sf_dir).table("events")).select("user_id", F.col("day").cast("string").alias("day"), "used")


def subscriptions(d: Domain) -> DataFrame:
    """The latest order of every customer as the subscription of the user of that number."""
    o = S.latest(d.table("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    plan = F.when(F.col("o_orderstatus") == "F", "FREE").when(F.col("o_orderkey") % 2 == 0, "ADVOCATE_PRO").otherwise("CHAMBER_PRO")
    return o.select(F.col("o_custkey").alias("user_id"), plan.alias("plan"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "P", "PAST_DUE").otherwise("FREE").alias("status"))


def query_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every user and day, every third in a workspace: limits by plan, none for paid ones."""
    d = Domain(spark, sf_dir)
    r = S.daily_counts(d.table("events")).withColumn("workspace_id", F.when(F.col("used") % 3 == 0, F.lit("w")))
    return S.allowance(r, subscriptions(d)).withColumn("day", F.col("day").cast("string"))


def plan_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkout for every customer's latest plan."""
    r = subscriptions(Domain(spark, sf_dir)).withColumn("requested_at", F.lit("2024-07-01"))
    return S.checkouts(r).select("user_id", "plan", "status", "provider_subscription_id", "seats", "daily_limit", "max_workspaces")


def charged_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Domain(spark, sf_dir).table("orders")
    c = o.select(F.col("o_orderkey").alias("user_id"), F.round(F.col("o_totalprice") * 100, 0).cast("long").alias("amount_minor"), F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("OPEN").alias("status"), F.col("o_orderpriority").alias("description"), F.to_date("o_orderdate").alias("issued_at"))
    i = S.invoices(c)
    return i.select(F.col("user_id").alias("o_orderkey"), "amount_minor", "currency", "status", F.col("issued_at").cast("string").alias("issued_at"), F.col("paid_at").cast("string").alias("paid_at"))


def latest_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.latest(Domain(spark, sf_dir).table("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return o.select("o_custkey", "o_orderkey", "o_orderstatus")


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 events of every user."""
    e = Domain(spark, sf_dir).table("events").select(F.col("event_id").alias("query_id"), "user_id", "event_type", F.col("ts").alias("created_at"))
    return L.queries_of_users(e).select(F.col("query_id").alias("event_id"), "user_id", "event_type", F.col("rank").alias("n"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the last event's type; its value unless null, else the last value."""
    e = Domain(spark, sf_dir).table("events")
    key = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.max_by("event_type", key).alias("status"), F.max_by("value", key).alias("value"), F.count("*").alias("n"))


def reembedding_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Domain(spark, sf_dir).table("embeddings").select("vec_id", (F.col("vec_id") % 5 != 0).alias("embedded"), F.when(F.col("vec_id") % 2 == 0, "m1").alias("model"), F.when(F.col("vec_id") % 3 == 0, "v2").otherwise("v1").alias("version"))
    return e.select("vec_id", S.needs_reembedding(F.col("embedded"), F.col("model"), F.col("version"), "m1", "v2").alias("flag"))


def upserted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Domain(spark, sf_dir).table("embeddings").select("vec_id", "label")
    changes = e.where("vec_id % 4 = 0").select((F.col("vec_id") + 2).alias("vec_id"), F.lit(99).cast("int").alias("label"))
    return S.upserted(e, changes, ["vec_id"])


def citation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Domain(spark, sf_dir).table("lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, "judgment").otherwise("statute").alias("kind"), (F.col("l_quantity") > 5).alias("exists"), F.when(F.col("l_tax") > 0.02, F.col("l_discount") < 0.05).alias("supports_claim"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")).alias("surfaced_doc_id"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") + F.when(F.col("l_linenumber") == 4, 1).otherwise(0)).alias("final_authority_doc_id"),
        F.col("l_returnflag").alias("claimed_authority_label"), F.when(F.col("l_linestatus") == "F", "R").otherwise("N").alias("expected_authority_label"), F.when(F.col("l_tax") < 0.05, F.col("l_linestatus") == "O").alias("statute_in_force"), F.when(F.col("l_tax") > 0.03, F.col("l_returnflag") == "N").alias("uses_current_text"),
    )
    return E.citation_rates(r)


def multi_hop_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Domain(spark, sf_dir).table("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("expected"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_suppkey"))).alias("surfaced"))
    return o.select("l_orderkey", F.round(E.completeness(F.col("expected"), F.col("surfaced")), 6).alias("completeness"))


def latest_public_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Domain(spark, sf_dir).table("orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "completed").otherwise("queued").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("is_public"), F.col("o_orderdate").alias("completed_at"), "o_custkey")
    return L.latest_public_run(runs).select(F.col("run_id").alias("o_orderkey"), "o_custkey")


def created_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one priority as runs that are there, those of another as new ones."""
    o = Domain(spark, sf_dir).table("orders")
    run = lambda p: o.where(F.col("o_orderpriority") == p).select(F.col("o_orderkey").cast("string").alias("suite"), F.lit("2024-07-01").alias("started_at"), F.lit("{}").alias("metrics"))
    there = run("1-URGENT").select(F.concat(F.lit("r"), "suite").alias("run_id"), "suite", F.lit("completed").alias("status"), F.lit(True).alias("is_public"), "started_at", F.lit(None).cast("timestamp").alias("completed_at"), "metrics")
    return L.run_created(there, run("5-LOW")).select("run_id", "suite", "status", "is_public")


def chunk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as hits of chunks in collections, each chunk once by its best."""
    h = Domain(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 3).alias("chunk_id"), F.col("l_returnflag").alias("collection"), F.col("l_quantity").cast("double").alias("score"))
    return V_.deduped(h)


def token_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asymmetric containment of each benchmark item's tokens in the next one's."""
    b = Domain(spark, sf_dir).table("benchmark").select("item_id", T.tokens(F.col("text")).alias("t"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return b.join(n, "item_id").select("item_id", F.round(T.overlap(F.col("t"), F.col("u")), 6).alias("overlap"))


def entailment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against the document of their number."""
    d = Domain(spark, sf_dir)
    b = d.table("benchmark").select("item_id", F.col("text").alias("claim"))
    p = d.table("documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("passage"))
    return b.join(p, "item_id").select("item_id", V.entailment(F.col("passage"), F.col("claim")).alias("label"))


def claim_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Domain(spark, sf_dir).table("lineitem").select("l_orderkey", F.when(F.col("l_quantity") < 3, "UNSUPPORTED").when(F.col("l_quantity") < 20, "UNCERTAIN").otherwise("VERIFIED").alias("status"))
    return V.worst_status(c, "l_orderkey")


def amendment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sections as of their date; their lines' ship dates as amendments."""
    d = Domain(spark, sf_dir)
    s = d.table("orders").select(F.col("o_orderkey").alias("section_id"), F.date_add(F.to_date("o_orderdate"), 60).alias("as_of"))
    a = d.table("lineitem").select(F.col("l_orderkey").alias("section_id"), F.to_date("l_shipdate").alias("effective"))
    return V.amended_since(s, a).select("section_id", "outdated")


def corrective_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Domain(spark, sf_dir).table("orders").select("o_orderkey", ((F.col("o_orderkey") % 11) / 10.0).alias("relevance"), ((F.col("o_custkey") % 5) / 4.0).alias("entities"), (F.col("o_orderkey") % 4).alias("n"), F.col("o_orderstatus").alias("s"))
    cover = V.coverage(F.when(F.col("s") == "F", "statutory_lookup").when(F.col("s") == "O", "case_specific").otherwise("general_legal"), F.col("n"), F.col("n") > 1, F.col("n") == 2, F.col("n") == 3, F.col("n"))
    score, action = V.corrective_action(F.col("relevance"), F.col("entities"), cover, F.col("n"))
    return o.select("o_orderkey", F.round(score, 6).alias("score"), action.alias("action"))


def stream_events(d: Domain) -> DataFrame:
    """Turns of conversations as events of their query."""
    c = d.table("conversations")
    kind = F.when(F.col("role") == "system", "STEP_START").when(F.col("role") == "user", "TOKEN").when(F.col("turn") % 4 == 1, "STEP_COMPLETE").otherwise("AGENT_LOG")
    return c.select(F.col("conv_id").cast("string").alias("query_id"), F.col("turn").cast("int").alias("sequence"), kind.alias("type"), F.concat(F.lit("s"), (F.col("turn") % 2).cast("string")).alias("step"), F.lit("").alias("data"), F.lit(None).cast("string").alias("error"), F.col("text").alias("token"), F.lit(None).cast("double").alias("confidence"))


def reduced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reduced(stream_events(Domain(spark, sf_dir))).select("query_id", "output", "n_events")


def joined_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream_events(Domain(spark, sf_dir)).where("type = 'TOKEN'")
    a = e.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "token"))), lambda x: x["token"]), "").alias("t"))
    return a.select("query_id", F.substr(F.trim("t"), F.lit(1), F.lit(320)).alias("preview"))


def trust_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates as rows of key and text, percentages with one decimal."""
    r = citation_rates(spark, sf_dir)
    rows = r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("v")) for c in r.columns])).alias("x")).select("x.*")
    return rows.select("key", F.replace("key", F.lit("_"), F.lit(" ")).alias("label"), F.format_string("%.1f%%", F.col("v") * 100).alias("value"))


EDGES = """e AS (SELECT DISTINCT source, target, (['follows','distinguishes','explains','refers_to','affirms','overrules','follows','refers_to','explains'])[source % 9 + 1] AS type
FROM (SELECT doc_id AS source, unnest([doc_id // 2, doc_id // 3]) AS target FROM documents) WHERE source <> target)"""
RATES = """r AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'judgment' ELSE 'statute' END AS kind, l_quantity > 5 AS ex, CASE WHEN l_tax > 0.02 THEN l_discount < 0.05 END AS sup,
CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS shown, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey + CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END END AS final, l_returnflag AS cl, CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END AS el,
CASE WHEN l_tax < 0.05 THEN l_linestatus = 'O' END AS sif, CASE WHEN l_tax > 0.03 THEN l_returnflag = 'N' END AS cur FROM lineitem),
rates AS (SELECT round(avg(CASE WHEN kind = 'judgment' THEN CAST(ex AS INT) END), 6) AS citation_existence, round(avg(CASE WHEN kind = 'judgment' AND sup IS NOT NULL THEN CAST(sup AS INT) END), 6) AS citation_accuracy,
round(avg(CASE WHEN kind = 'judgment' AND (shown IS NOT NULL OR final IS NOT NULL) THEN CAST(coalesce(final IS NULL OR shown = final, FALSE) AS INT) END), 6) AS appeal_chain_accuracy, round(avg(CASE WHEN cl IS NOT NULL AND el IS NOT NULL THEN CAST(cl = el AS INT) END), 6) AS jurisdiction_accuracy,
round(avg(CASE WHEN kind = 'statute' AND sif IS NOT NULL THEN CAST(sif AS INT) END), 6) AS temporal_validity, round(avg(CASE WHEN kind = 'statute' AND cur IS NOT NULL THEN CAST(cur AS INT) END), 6) AS amendment_awareness FROM r)"""
STREAM = "s AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, turn, CASE WHEN role = 'user' THEN text ELSE '' END AS token FROM conversations)"
LATEST = "lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1)"
SUBS = "su AS (SELECT o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'FREE' WHEN o_orderkey % 2 = 0 THEN 'ADVOCATE_PRO' ELSE 'CHAMBER_PRO' END AS plan, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'PAST_DUE' ELSE 'FREE' END AS status FROM lo)"
from .retrieval_queries import TOKENS  # noqa: E402

QUERIES = {f.__name__: f for f in [
    appeal_chains, appeal_outcomes, court_levels, validity_changes, statute_changes, code_mappings, daily_counts, query_allowance, plan_checkouts, charged_invoices, latest_subscription,
    recent_history, latest_state, reembedding_flags, upserted_points, citation_rates, multi_hop_completeness, latest_public_run, created_runs, chunk_hits, token_overlaps, entailment_labels, claim_lattice, amendment_checks, corrective_actions, reduced_events, joined_output, trust_metrics,
]}
ORACLE_SQL = {
    "appeal_chains": "WITH m AS (SELECT max(doc_id) AS m FROM documents), e AS (SELECT doc_id, doc_id - doc_id % 100 + 99 AS top, doc_id // 100 % 10 = 3 AND doc_id - doc_id % 100 + 99 <= m AS circle, m FROM documents, m) SELECT doc_id AS node, CASE WHEN NOT circle THEN least(top, m) END AS last, CASE WHEN NOT circle THEN least(top, m) - doc_id END AS steps FROM e WHERE circle OR doc_id < least(top, m)",
    "appeal_outcomes": """WITH o AS (SELECT doc_id // 4 AS chain, list((['UPHELD','REVERSED','MODIFIED','REMANDED','DISMISSED'])[doc_id % 5 + 1] ORDER BY doc_id) AS os FROM documents GROUP BY 1),
f AS (SELECT chain, os, list_reduce(list_prepend('UPHELD', os), lambda s, x: CASE WHEN x = 'REVERSED' THEN CASE WHEN s = 'REVERSED' THEN 'UPHELD' ELSE 'REVERSED' END WHEN x IN ('UPHELD', 'DISMISSED') THEN s ELSE x END) AS st FROM o)
SELECT chain, CASE WHEN st = 'UPHELD' AND list_contains(os, 'DISMISSED') THEN 'DISMISSED' ELSE st END AS outcome FROM f""",
    "court_levels": "SELECT court, count(*) AS n, CASE court WHEN 'Supreme Court' THEN 4 WHEN 'NCLT Principal Bench' THEN 1 ELSE 3 END AS level FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'Supreme Court' WHEN 1 THEN 'Bombay High Court' WHEN 2 THEN 'Delhi High Court' ELSE 'NCLT Principal Bench' END AS court FROM documents) GROUP BY court",
    "validity_changes": f"""WITH {EDGES}, c AS (SELECT DISTINCT source AS citing FROM e WHERE target % 10 = 1)
SELECT doc_id, CASE WHEN doc_id % 10 = 1 OR toxic = 1 THEN 'OVERRULED' ELSE 'GOOD_LAW' END AS current_validity, CASE WHEN doc_id % 10 = 1 THEN doc_id + 1 END AS overruled_by, doc_id % 10 = 1 OR citing IS NOT NULL AS stale,
CASE WHEN doc_id % 10 = 1 THEN 'validity_changed' WHEN citing IS NOT NULL THEN 'cites_changed_authority' END AS stale_reason FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN c ON citing = doc_id""",
    "statute_changes": """SELECT p_partkey AS statute_id, p_size AS section, CASE WHEN p_partkey % 6 = 0 THEN upper(p_name) ELSE p_name END AS text, p_partkey % 9 <> 0 AS in_force,
CASE WHEN p_partkey % 9 = 0 THEN 'REPEALED' WHEN p_partkey % 6 = 0 AND upper(p_name) <> p_name THEN 'AMENDED' ELSE 'GOOD_LAW' END AS validity, p_partkey % 9 = 0 OR (p_partkey % 6 = 0 AND upper(p_name) <> p_name) AS stale, p_partkey % 9 <> 0 AND p_partkey % 6 = 0 AND upper(p_name) <> p_name AS reembed FROM part""",
    "code_mappings": """WITH r AS (SELECT DISTINCT CAST(p_partkey % 50 AS INT) AS n, p_size % 2 = 0 AS post FROM part), x AS (SELECT *, n BETWEEN 1 AND 30 AND n % 7 <> 0 AS mapped FROM r)
SELECT 'Section ' || n || ' IPC' AS reference, CAST(n AS VARCHAR) AS section, CASE WHEN mapped AND post THEN 'BNS ' || (n + 100) ELSE 'IPC ' || n END AS preferred, CASE WHEN mapped THEN CASE WHEN post THEN 'IPC ' || n ELSE 'BNS ' || (n + 100) END END AS equivalent, mapped, CASE WHEN post THEN 2024 ELSE 2023 END AS year FROM x""",
    "daily_counts": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS used FROM events GROUP BY 1, 2",
    "query_allowance": f"""WITH {LATEST}, {SUBS}, c AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS used FROM events GROUP BY 1, 2),
x AS (SELECT c.user_id, day, used, coalesce(plan, 'FREE') AS plan, CASE WHEN coalesce(plan, 'FREE') = 'FREE' THEN 20 END AS daily_limit, coalesce(plan <> 'FREE' AND status = 'ACTIVE', FALSE) AS paid FROM c LEFT JOIN su USING (user_id)),
y AS (SELECT *, CASE WHEN user_id IS NULL THEN NULL WHEN used % 3 = 0 AND NOT paid THEN 'plan_upgrade_required' WHEN used >= daily_limit THEN 'free_tier_limit_reached' END AS code FROM x)
SELECT user_id, day, used, plan, CAST(daily_limit AS BIGINT) AS daily_limit, greatest(daily_limit - used, 0) AS remaining, code IS NULL AS allowed, code FROM y""".replace("greatest(daily_limit - used, 0)", "CASE WHEN daily_limit IS NOT NULL THEN greatest(daily_limit - used, 0) END"),
    "plan_checkouts": f"WITH {LATEST}, {SUBS} SELECT user_id, plan, 'CHECKOUT_PENDING' AS status, 'rzp_sub_preview_' || substr(sha1(user_id || '|' || plan || '|2024-07-01'), 1, 12) AS provider_subscription_id, CAST(CASE plan WHEN 'CHAMBER_PRO' THEN 5 ELSE 1 END AS BIGINT) AS seats, CAST(NULL AS BIGINT) AS daily_limit, CAST(CASE plan WHEN 'CHAMBER_PRO' THEN 25 ELSE 5 END AS BIGINT) AS max_workspaces FROM su WHERE plan <> 'FREE'",
    "charged_invoices": "SELECT o_orderkey, CAST(round(o_totalprice * 100, 0) AS BIGINT) AS amount_minor, 'INR' AS currency, CASE o_orderstatus WHEN 'F' THEN 'PAID' ELSE 'OPEN' END AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS issued_at, CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS paid_at FROM orders",
    "latest_subscription": f"WITH {LATEST} SELECT o_custkey, o_orderkey, o_orderstatus FROM lo",
    "recent_history": "SELECT event_id, user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20",
    "latest_state": "SELECT user_id, status, value, n FROM (SELECT user_id, event_type AS status, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1",
    "reembedding_flags": "SELECT vec_id, vec_id % 5 <> 0 AND NOT (vec_id % 2 = 0 AND vec_id % 3 = 0) AS flag FROM embeddings",
    "upserted_points": "WITH c AS (SELECT vec_id + 2 AS vec_id, 99 AS label FROM embeddings WHERE vec_id % 4 = 0) SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM c) UNION ALL SELECT * FROM c",
    "citation_rates": f"WITH {RATES} SELECT * FROM rates",
    "multi_hop_completeness": "SELECT l_orderkey, round(count(DISTINCT CASE WHEN l_quantity > 20 THEN l_suppkey END) / count(DISTINCT l_suppkey), 6) AS completeness FROM lineitem GROUP BY l_orderkey",
    "created_runs": "SELECT 'r' || o_orderkey AS run_id, CAST(o_orderkey AS VARCHAR) AS suite, 'completed' AS status, TRUE AS is_public FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT substr(sha1(o_orderkey || '|2024-07-01'), 1, 32), CAST(o_orderkey AS VARCHAR), 'queued', FALSE FROM orders WHERE o_orderpriority = '5-LOW'",
    "chunk_hits": "SELECT l_orderkey AS query_id, l_suppkey % 3 AS chunk_id, max(l_returnflag) FILTER (l_quantity = m) AS collection, max(m)::DOUBLE AS score FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey, l_suppkey % 3) AS m FROM lineitem) GROUP BY 1, 2",
    "latest_public_run": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "token_overlaps": f"WITH b AS (SELECT item_id, {TOKENS} AS t FROM benchmark) SELECT a.item_id, round(len(list_intersect(a.t, n.t)) / len(a.t), 6) AS overlap FROM b a JOIN b n ON n.item_id = a.item_id + 1",
    "entailment_labels": f"""WITH st AS (SELECT {T.GROUNDING_STOPWORDS!r} AS s, {T.NEGATIONS!r} AS g), b AS (SELECT item_id, {TOKENS} AS t FROM benchmark), d AS (SELECT doc_id AS item_id, {TOKENS} AS t FROM documents),
x AS (SELECT b.item_id, list_filter(b.t, lambda x: NOT list_contains(s, x)) AS h, list_filter(d.t, lambda x: NOT list_contains(s, x)) AS p, len(list_intersect(b.t, g)) > 0 AS hn, len(list_intersect(d.t, g)) > 0 AS pn FROM b JOIN d USING (item_id), st),
y AS (SELECT *, len(list_intersect(h, p)) AS k FROM x)
SELECT item_id, CASE WHEN k >= 2 AND hn <> pn THEN 'CONTRADICTION' WHEN k / len(h) >= 0.65 THEN 'ENTAILMENT' WHEN k / len(h) >= 0.35 THEN 'NEUTRAL' ELSE 'CONTRADICTION' END AS label FROM y""",
    "claim_lattice": "SELECT l_orderkey, count(*) FILTER (l_quantity >= 20) AS n_verified, count(*) FILTER (l_quantity >= 3 AND l_quantity < 20) AS n_uncertain, count(*) FILTER (l_quantity < 3) AS n_unsupported, CASE WHEN count(*) FILTER (l_quantity < 3) > 0 THEN 'UNSUPPORTED' WHEN count(*) FILTER (l_quantity < 20) > 0 THEN 'UNCERTAIN' ELSE 'VERIFIED' END AS overall FROM lineitem GROUP BY l_orderkey",
    "amendment_checks": "SELECT o_orderkey AS section_id, coalesce(max(CAST(l_shipdate AS DATE)) > max(CAST(o_orderdate AS DATE) + 60), FALSE) AS outdated FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "corrective_actions": """WITH x AS (SELECT o_orderkey, (o_orderkey % 11) / 10.0::DOUBLE AS r, (o_custkey % 5) / 4.0::DOUBLE AS e, o_orderkey % 4 AS n, o_orderstatus AS s FROM orders),
y AS (SELECT *, 0.4::DOUBLE * r + 0.25::DOUBLE * e + 0.35::DOUBLE * (CASE WHEN n = 0 THEN 0 WHEN s = 'F' THEN CASE WHEN n > 1 THEN 0.5 ELSE 0 END + CASE WHEN n = 3 THEN 0 ELSE 0.5 END WHEN s = 'O' THEN CASE WHEN n = 2 THEN 1 ELSE 0 END ELSE 0.5 END)::DOUBLE AS score FROM x)
SELECT o_orderkey, round(score, 6) AS score, CASE WHEN score > 0.7 AND n > 0 THEN 'PROCEED' WHEN score > 0.4 THEN 'REFINED' ELSE 'INSUFFICIENT' END AS action FROM y""",
    "reduced_events": f"WITH {STREAM} SELECT query_id, string_agg(token, '' ORDER BY turn) AS output, CAST(count(*) AS INT) AS n_events FROM s GROUP BY query_id",
    "joined_output": f"WITH {STREAM} SELECT query_id, substr(trim(string_agg(token, '' ORDER BY turn)), 1, 320) AS preview FROM s WHERE token <> '' GROUP BY query_id",
    "trust_metrics": f"WITH {RATES}, u AS (UNPIVOT rates ON COLUMNS(*) INTO NAME key VALUE v) SELECT key, replace(key, '_', ' ') AS label, printf('%.1f', v * 100) || '%' AS value FROM u",
}
