"""Published queries: anchors, walk, pruning and timelines of the citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..tables import stored
from .domain import Domain
from .retrieval_queries import LEXICAL, TOKENS, lexical


def documents(d: Domain) -> DataFrame:
    return d.legal_documents().withColumn("case_name", F.concat(F.lit("Party "), F.col("doc_id").cast("string"), F.lit(" v. State")))


def starts(d: Domain) -> DataFrame:
    """One document in fifty as the anchor of a query of its own."""
    return d.table("documents").where("doc_id % 50 = 7").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("node"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))


def walk(d: Domain) -> DataFrame:
    return G.traversed(starts(d), d.edges(), documents(d))


def edge_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(Domain(spark, sf_dir).edges().where(F.col("type").isin(*G.RELATIONS)))


def citation_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk of four steps and fifty nodes reaches."""
    return walk(Domain(spark, sf_dir)).select("query_id", "node", F.col("at").cast("long").alias("place"))


def graph_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk(Domain(spark, sf_dir)).select("query_id", "node", "depth", "score", "relation", "is_anchor")


def graph_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return G.without_overruled(walk(d), d.edges(), documents(d)).select("query_id", "node", "depth", "score")


def graph_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    nodes = G.without_overruled(walk(d), d.edges(), documents(d)).join(documents(d).select(F.col("doc_id").alias("node"), "date"), "node")
    return G.timeline(nodes).select("query_id", "node", "index", "phase")


def case_queries(d: Domain) -> DataFrame:
    """Every tenth query names the case of the document of three times its number."""
    return d.benchmark_queries().where("query_id % 10 = 0").select("query_id", F.concat(F.lit("party "), (F.col("query_id") * 3).cast("string"), F.lit(" vs state")).alias("case_name"))


def graph_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return G.anchors(lexical(d, 12), documents(d), d.edges(), case_queries(d)).select("query_id", "node", "score", "reason", "rank")


def graph_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, walk, pruning, timeline and best chunks (the halves of a document) for every benchmark query; lexical results where there is no anchor."""
    d = Domain(spark, sf_dir)
    hits = lexical(d, 12)
    text = d.table("documents").select("doc_id", "text", F.floor(F.char_length("text") / 2).cast("int").alias("half"))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("chunk_index"), F.expr("substr(text, 1, half)").alias("part")), F.struct(F.lit(1).alias("chunk_index"), F.expr("substr(text, half + 1)").alias("part"))))
    chunks = lambda of: text.join(stored(of), "doc_id").select("doc_id", halves.alias("c")).select("doc_id", (F.col("doc_id") * 2 + F.col("c.chunk_index")).alias("chunk_id"), "c.chunk_index", T.tokens(F.col("c.part")).alias("tokens"))
    queries = d.benchmark_queries().select("query_id", T.tokens(F.col("text")).alias("tokens"))
    fallback = hits.select("query_id", "doc_id", (F.col("doc_id") * 2).alias("chunk_id"), "rank")
    return G.retrieved(hits, documents(d), d.edges(), chunks, queries, fallback, case_queries(d)).select("query_id", "node", F.col("index").cast("int").alias("index"), "phase", "depth", "chunk_id")


EDGES = """e AS (SELECT DISTINCT source, target, (['follows','distinguishes','explains','refers_to','affirms','overrules','follows','refers_to','explains'])[source % 9 + 1] AS type
FROM (SELECT doc_id AS source, unnest([doc_id // 2, doc_id // 3]) AS target FROM documents) WHERE source <> target)"""
FOLLOWED = ", ".join(f"'{r}'" for r in G.RELATIONS)
LD = """ld AS (SELECT doc_id, doc_id % 5 < 3 AS judgment, doc_id % 4 = 0 AS apex, doc_id % 4 IN (1, 2) AS high, 1 + doc_id % 9 AS coram, CAST(DATE '1950-01-01' + CAST(doc_id AS INT) AS DATE) AS date,
CASE WHEN toxic = 1 THEN 'OVERRULED' ELSE 'GOOD_LAW' END AS validity FROM documents LEFT JOIN labels USING (doc_id))"""
BONUS = "CASE relation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.RELATIONS.items()) + f" ELSE {G.OTHER_RELATION} END"
AROUND = f"""ar AS (SELECT node, other, relation, direction, turn, {BONUS}::DOUBLE + CASE WHEN apex THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END + least(greatest(year(date) - 1950, 0) / 250.0::DOUBLE, 0.25) AS worth
FROM (SELECT target AS node, source AS other, type AS relation, 'forward' AS direction, 0 AS turn FROM e UNION ALL SELECT source, target, type, 'backward', 1 FROM e) JOIN ld ON ld.doc_id = other WHERE relation IN ({FOLLOWED}))"""


def _walk(anchors: str, depth: int = G.MAX_DEPTH, limit: int = G.MAX_NODES) -> str:
    """The walk in SQL, one level after the other. anchors: a table of (query_id, node, pos, score)."""
    out = [f"f0 AS (SELECT query_id, node, pos FROM {anchors})", "s0 AS (SELECT query_id, node, 0 AS lvl, pos FROM f0)"]
    for d in range(1, depth + 1):
        p = d - 1
        out += [
            f"x{d} AS (SELECT f.query_id, f.pos, other, relation, direction, turn, worth FROM f{p} f JOIN ar USING (node))",
            f"n{d} AS (SELECT query_id, other, min(pos * 2 + turn) AS k FROM x{d} x WHERE NOT EXISTS (SELECT 1 FROM s{p} s WHERE s.query_id = x.query_id AND s.node = x.other) GROUP BY ALL)",
            f"c{d} AS (SELECT query_id, k // 2 AS pos, count(*) AS c FROM n{d} GROUP BY ALL)",
            f"t{d} AS (SELECT query_id, count(*) AS found FROM s{p} GROUP BY query_id)",
            f"b{d} AS (SELECT f.query_id, f.pos, found + coalesce(sum(coalesce(c, 0)) OVER (PARTITION BY f.query_id ORDER BY f.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS found FROM f{p} f JOIN t{d} USING (query_id) LEFT JOIN c{d} c ON c.query_id = f.query_id AND c.pos = f.pos)",
            f"q{d} AS (SELECT query_id, pos FROM b{d} WHERE found < {limit})",
            f"f{d} AS (SELECT n.query_id, other AS node, row_number() OVER (PARTITION BY n.query_id ORDER BY k, other) AS pos FROM n{d} n JOIN q{d} q ON q.query_id = n.query_id AND q.pos = n.k // 2)",
            f"s{d} AS (SELECT * FROM s{p} UNION ALL SELECT query_id, node, {d}, pos FROM f{d})",
        ]
    offers = " UNION ALL ".join([f"SELECT query_id, node, round(score, 6) AS score, 0 AS depth, NULL AS relation, TRUE AS is_anchor, 0 AS lvl, pos, 0 AS turn FROM {anchors}"] + [f"SELECT x.query_id, other, round(1.0::DOUBLE / {d + 1} + worth, 6), {d}, relation, FALSE, {d}, x.pos, turn FROM x{d} x JOIN q{d} q ON q.query_id = x.query_id AND q.pos = x.pos" for d in range(1, depth + 1)])
    out += [
        f"offers AS ({offers})",
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY score DESC, lvl, pos, turn, relation) AS n FROM offers) WHERE n = 1)",
        f"walked AS (SELECT s.query_id, s.node, row_number() OVER (PARTITION BY s.query_id ORDER BY s.lvl, s.pos) AS place, depth, score, relation, is_anchor FROM s{depth} s JOIN best USING (query_id, node))",
    ]
    return ",\n".join(out)


PRUNED = """st AS (SELECT w.*, validity <> 'GOOD_LAW' AS invalid, validity <> 'GOOD_LAW' OR EXISTS (SELECT 1 FROM e WHERE e.target = w.node AND type = 'overrules') AS gone FROM walked w JOIN ld ON ld.doc_id = node),
hp AS (SELECT a.query_id, source AS node, a.place, a.depth, a.score FROM st a JOIN e ON e.target = a.node AND type = 'overrules' JOIN ld ON ld.doc_id = source LEFT JOIN st o ON o.query_id = a.query_id AND o.node = e.source WHERE NOT a.invalid AND (o.place IS NULL OR (o.place < a.place AND o.gone))),
pruned AS (SELECT query_id, node, depth, score FROM st WHERE NOT gone UNION ALL SELECT query_id, node, arg_min(depth, place), round(arg_min(score, place) + 0.25, 6) FROM hp GROUP BY query_id, node)"""
TIMELINE = """tl AS (SELECT p.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY date, depth, score, node) - 1 AS INT) AS index FROM pruned p JOIN ld ON ld.doc_id = node),
tc AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM tl WHERE index < 15),
timeline AS (SELECT query_id, node, depth, index, CASE WHEN n = 1 THEN 'current' WHEN index < greatest(1, n // 3) THEN 'foundational' WHEN index >= greatest(n - 2, greatest(1, n // 3) + 1) THEN 'current' ELSE 'development' END AS phase FROM tc)"""
STARTS = "starts AS (SELECT doc_id AS query_id, doc_id AS node, 1 AS pos, 1.0::DOUBLE AS score FROM documents WHERE doc_id % 50 = 7)"
WALK = f"WITH {EDGES}, {LD}, {AROUND}, {STARTS}, {_walk('starts')}"
ANCHORS = f"""{LEXICAL}, {EDGES}, {LD},
au AS (SELECT *, CASE WHEN apex THEN 0.5 + least(coram, 9) * 0.03 WHEN high THEN 0.2 + least(coram, 5) * 0.02 ELSE 0.05 END::DOUBLE AS authority FROM ld WHERE judgment),
lk AS (SELECT doc_id, least(count(*) * 0.03::DOUBLE, 0.4) AS links FROM (SELECT source AS doc_id FROM e UNION ALL SELECT target FROM e WHERE type IN ('follows', 'distinguishes')) GROUP BY doc_id),
ex AS (SELECT item_id AS query_id, doc_id AS node, round(2.0 + authority, 6) AS score, 'exact_case_match' AS reason FROM benchmark JOIN au ON doc_id = item_id * 3 WHERE item_id % 10 = 0),
lx AS (SELECT query_id, doc_id AS node, round(score + authority + coalesce(links, 0), 6) AS score, 'lexical_landmark' AS reason FROM lexical JOIN au USING (doc_id) LEFT JOIN lk USING (doc_id) WHERE rank <= 12 AND validity = 'GOOD_LAW' AND query_id NOT IN (SELECT query_id FROM ex)),
anchors AS (SELECT query_id, node, pos, score, reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS pos FROM (SELECT * FROM ex UNION ALL SELECT * FROM lx)) WHERE pos <= 3)"""

QUERIES = {f.__name__: f for f in [edge_neighbours, citation_reach, graph_ranked, graph_pruned, graph_timeline, graph_anchors, graph_retrieval]}
ORACLE_SQL = {
    "edge_neighbours": f"WITH {EDGES} SELECT target AS node, source AS other, type AS relation, 'forward' AS direction FROM e WHERE type IN ({FOLLOWED}) UNION ALL SELECT source, target, type, 'backward' FROM e WHERE type IN ({FOLLOWED})",
    "citation_reach": f"{WALK} SELECT query_id, node, place FROM walked",
    "graph_ranked": f"{WALK} SELECT query_id, node, depth, score, relation, is_anchor FROM walked",
    "graph_pruned": f"{WALK}, {PRUNED} SELECT query_id, node, depth, score FROM pruned",
    "graph_timeline": f"{WALK}, {PRUNED}, {TIMELINE} SELECT query_id, node, index, phase FROM timeline",
    "graph_anchors": f"WITH {ANCHORS} SELECT query_id, node, score, reason, pos AS rank FROM anchors",
    "graph_retrieval": f"""WITH {ANCHORS}, {AROUND}, {_walk('anchors')}, {PRUNED}, {TIMELINE},
hv AS (SELECT doc_id, doc_id * 2 + i AS chunk_id, i, CASE i WHEN 0 THEN substr(text, 1, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END AS text FROM documents, range(2) r(i) WHERE doc_id IN (SELECT node FROM timeline)),
ht AS (SELECT doc_id, chunk_id, i, {TOKENS} AS tokens FROM hv), qt AS (SELECT item_id AS query_id, {TOKENS} AS asked FROM benchmark),
bc AS (SELECT *, row_number() OVER (PARTITION BY t.query_id, node ORDER BY len(list_intersect(asked, tokens)) DESC, i) AS n FROM timeline t JOIN qt USING (query_id) JOIN ht ON ht.doc_id = node)
SELECT query_id, node, index, phase, depth, chunk_id FROM bc WHERE n = 1
UNION ALL SELECT query_id, doc_id, CAST(rank - 1 AS INT), NULL, NULL, doc_id * 2 FROM lexical WHERE rank <= 12 AND query_id NOT IN (SELECT query_id FROM anchors)""",
}
