"""Citation graph: anchors, bounded breadth-first search, pruning, timelines, appeal chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import case_name_key, overlap_count
from ..tables import stored

MAX_DEPTH, MAX_NODES = 4, 50
# The relations that are followed, what each adds to a node's score, validities that end an authority.
RELATIONS = {"overrules": 0.35, "follows": 0.25, "approves": 0.22, "affirms": 0.20, "explains": 0.18}
OTHER_RELATION = 0.1
INVALID = ["OVERRULED", "REVERSED_ON_APPEAL"]


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other, relation, direction) of every edge (source, target, type), from either end: forward to what cites the node, backward to what it cites."""
    forward = edges.select(F.col("target").alias("node"), F.col("source").alias("other"), F.col("type").alias("relation"), F.lit("forward").alias("direction"))
    backward = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.col("type").alias("relation"), F.lit("backward").alias("direction"))
    return forward.unionByName(backward)


def relation_bonus(relation: Column) -> Column:
    out = F.lit(OTHER_RELATION)
    for k, v in RELATIONS.items():
        out = F.when(relation == k, v).otherwise(out)
    return out


def court_bonus(court: Column) -> Column:
    return F.when(F.startswith(F.lower(F.coalesce(court, F.lit(""))), F.lit("supreme court")), 0.3).otherwise(0.1)


def node_score(relation: Column, depth: Column, court: Column, date: Column) -> Column:
    age = F.coalesce(F.least(F.greatest(F.year(date) - 1950, F.lit(0)) / 250.0, F.lit(0.25)), F.lit(0.0))
    return 1.0 / (depth + 1) + relation_bonus(relation) + court_bonus(court) + age


def authority_bonus(court: Column, bench: Column) -> Column:
    c, n = F.lower(F.coalesce(court, F.lit(""))), F.coalesce(bench, F.lit(0))
    apex = c.isin("supreme court", "supreme court of india")
    return F.when(apex, 0.5 + F.least(n, F.lit(9)) * 0.03).when(F.contains(c, F.lit("high court")), 0.2 + F.least(n, F.lit(5)) * 0.02).otherwise(0.05)


def link_bonus(edges: DataFrame) -> DataFrame:
    """(doc_id, links): 0.03 for each citation made and each document that follows or distinguishes this one, 0.4 at most."""
    made = edges.select(F.col("source").alias("doc_id"))
    treated = edges.where("type in ('follows', 'distinguishes')").select(F.col("target").alias("doc_id"))
    return made.unionByName(treated).groupBy("doc_id").agg(F.least(F.count("*") * 0.03, F.lit(0.4)).alias("links"))


def anchors(results: DataFrame, documents: DataFrame, edges: DataFrame, cases: DataFrame | None = None, top_k: int = 3) -> DataFrame:
    """(query_id, node, score, reason, rank): where the walk of a query starts.

    cases: (query_id, case_name) that the query names; judgments of just that name (documents: doc_id, doc_type, court, coram, current_validity, case_name)
    are its anchors if there are any. Else the lexical results (query_id, doc_id, score) that are judgments and good law, by score, court, bench and links.
    """
    judgments = documents.where("doc_type = 'judgment'").withColumn("authority", authority_bonus(F.col("court"), F.col("coram")))
    good = results.join(judgments.where("current_validity = 'GOOD_LAW'").select("doc_id", "authority"), "doc_id").join(link_bonus(edges), "doc_id", "left")
    score = F.round(F.col("score") + F.col("authority") + F.coalesce("links", F.lit(0.0)), 6)
    found = good.groupBy("query_id", F.col("doc_id").alias("node")).agg(F.max(score).alias("score")).withColumn("reason", F.lit("lexical_landmark"))
    if cases is not None:
        named = cases.select("query_id", case_name_key(F.col("case_name")).alias("key")).join(judgments.select(F.col("doc_id").alias("node"), "authority", case_name_key(F.col("case_name")).alias("key")), "key")
        exact = named.select("query_id", "node", F.round(2.0 + F.col("authority"), 6).alias("score"), F.lit("exact_case_match").alias("reason")).distinct()
        found = exact.unionByName(found.join(exact.select("query_id").distinct(), "query_id", "left_anti"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def traversed(anchors: DataFrame, edges: DataFrame, documents: DataFrame, depth: int = MAX_DEPTH, limit: int = MAX_NODES) -> DataFrame:
    """(query_id, node, at, depth, score, relation, direction, is_anchor) by breadth-first search of all queries at once, level by level.

    A node is expanded as long as fewer than `limit` nodes of its query have been found before its turn; all its neighbours are then
    found, first those that cite it, then those it cites, each by id. at: place in that order. Of the ways by which a node is reached again,
    the best score holds, the earliest of equal ones. anchors: query_id, node, score, rank.
    """
    known = documents.select(F.col("doc_id").alias("other"), "court", "date")
    around = neighbours(edges.where(F.col("type").isin(*RELATIONS))).join(known, "other")
    # the share of a score that does not hang on the depth
    around = around.withColumn("worth", node_score(F.col("relation"), F.lit(0), F.col("court"), F.col("date")) - 1.0).withColumn("turn", (F.col("direction") == "backward").cast("int"))
    around = stored(around.select("node", "other", "relation", "direction", "turn", "worth"))
    start = anchors.join(known.select(F.col("other").alias("node")), "node")
    front = stored(start.select("query_id", "node", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "node")).cast("long").alias("pos"), "score"))
    seen = front.select("query_id", "node", F.lit(0).alias("level"), "pos")
    none = lambda t: F.lit(None).cast(t)
    offers = front.select("query_id", "node", "score", F.lit(0).alias("depth"), none("string").alias("relation"), none("string").alias("direction"), F.lit(True).alias("is_anchor"), F.lit(0).alias("level"), "pos", F.lit(0).alias("turn"))
    front = front.drop("score")
    for d in range(1, depth + 1):
        steps = front.join(around, "node").drop("node")
        new = steps.join(seen.select("query_id", F.col("node").alias("other")), ["query_id", "other"], "left_anti")
        new = new.groupBy("query_id", "other").agg(F.min(F.struct("pos", "turn")).alias("by"))
        gained = new.groupBy("query_id", F.col("by.pos").alias("pos")).agg(F.count("*").alias("gained"))
        before = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        turns = front.join(gained, ["query_id", "pos"], "left").join(seen.groupBy("query_id").agg(F.count("*").alias("found")), "query_id")
        turns = turns.withColumn("found", F.col("found") + F.coalesce(F.sum(F.coalesce("gained", F.lit(0))).over(before), F.lit(0))).where(F.col("found") < limit).select("query_id", "pos")
        turns = stored(turns)
        reached = steps.join(turns, ["query_id", "pos"], "left_semi")
        offers = offers.unionByName(
            reached.select("query_id", F.col("other").alias("node"), (1.0 / (d + 1) + F.col("worth")).alias("score"), F.lit(d).alias("depth"), "relation", "direction", F.lit(False).alias("is_anchor"), F.lit(d).alias("level"), "pos", "turn")
        )
        new = new.withColumn("pos", F.col("by.pos")).join(turns, ["query_id", "pos"], "left_semi")
        front = stored(new.select("query_id", F.col("other").alias("node"), F.row_number().over(Window.partitionBy("query_id").orderBy("by", "other")).cast("long").alias("pos")))
        seen = seen.unionByName(front.select("query_id", "node", F.lit(d).alias("level"), "pos"))
    rounded = offers.withColumn("score", F.round("score", 6))
    best = rounded.groupBy("query_id", "node").agg(F.min(F.struct((-F.col("score")).alias("worst"), "level", "pos", "turn", "relation", "depth", "direction", "is_anchor", "score")).alias("b"))
    at = Window.partitionBy("query_id").orderBy("level", "pos")
    return seen.join(best, ["query_id", "node"]).select("query_id", "node", F.row_number().over(at).alias("at"), "b.depth", "b.score", "b.relation", "b.direction", "b.is_anchor")


def without_overruled(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Nodes in the order of the walk (at), less those that are overruled or reversed and those that an edge overrules.

    What overrules a node takes its place, with its depth and 0.25 more, unless it stands among the nodes at that moment: a later node,
    or an earlier one that stayed.
    """
    n = nodes.join(documents.select(F.col("doc_id").alias("node"), "current_validity"), "node").withColumn("invalid", F.col("current_validity").isin(*INVALID)).drop("current_validity")
    over = edges.where("type = 'overrules'").select(F.col("target").alias("node"), F.col("source").alias("heir")).distinct()
    lost = over.select("node").distinct().withColumn("lost", F.lit(True))
    n = n.join(lost, "node", "left").withColumn("gone", F.col("invalid") | F.coalesce("lost", F.lit(False)))
    own = n.select("query_id", F.col("node").alias("heir"), F.col("at").alias("heir_at"), F.col("gone").alias("heir_gone"))
    put = n.where("not invalid").join(over, "node").join(own, ["query_id", "heir"], "left").join(documents.select(F.col("doc_id").alias("heir")), "heir")
    put = put.where("heir_at is null or (heir_at < at and heir_gone)")
    put = put.groupBy("query_id", F.col("heir").alias("node")).agg(F.min(F.struct("at", "node", "depth", "score")).alias("b"))
    put = put.select("query_id", "node", "b.depth", F.round(F.col("b.score") + 0.25, 6).alias("score"), F.lit("overrules").alias("relation"), F.lit(False).alias("is_anchor"))
    return n.where("not gone").select("query_id", "node", "depth", "score", "relation", "is_anchor").unionByName(put)


def best_chunks(nodes: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """nodes (query_id, node, ..) with the chunk (doc_id, chunk_id, chunk_index, tokens) of their document that shares most tokens with the query (query_id, tokens), the first of equal ones."""
    c = nodes.select("query_id", "node").join(queries.select("query_id", F.col("tokens").alias("asked")), "query_id").join(chunks.select(F.col("doc_id").alias("node"), "chunk_id", "chunk_index", "tokens"), "node")
    c = c.withColumn("shared", overlap_count(F.col("asked"), F.col("tokens")))
    best = c.groupBy("query_id", "node").agg(F.max(F.struct("shared", (-F.col("chunk_index")).alias("first"), "chunk_id")).alias("b")).select("query_id", "node", "b.chunk_id", "b.shared")
    return nodes.join(best, ["query_id", "node"])


def phase(index: Column, total: Column) -> Column:
    """foundational for the first third (one at least), current for the last two, else development."""
    f = F.greatest(F.lit(1), F.floor(total / 3).cast("int"))
    return F.when(total == 1, "current").when(index < f, "foundational").when(index >= F.greatest(total - 2, f + 1), "current").otherwise("development")


def timeline(nodes: DataFrame, limit: int = 15) -> DataFrame:
    """The earliest nodes of a query (query_id, node, date, depth, score) with their phase."""
    by = Window.partitionBy("query_id")
    t = nodes.withColumn("index", F.row_number().over(by.orderBy("date", "depth", "score", "node")) - 1).where(F.col("index") < limit)
    return t.withColumn("phase", phase(F.col("index"), F.count("*").over(by)))


def retrieved(results: DataFrame, documents: DataFrame, edges: DataFrame, chunks: DataFrame | Callable[[DataFrame], DataFrame], queries: DataFrame, fallback: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Graph retrieval: (query_id, node, index, phase, depth, chunk_id); queries without anchors get their fallback (query_id, doc_id, chunk_id, rank) as it stands.

    chunks: those of all documents, or a function that makes those of the documents of a table (doc_id), so that no others are taken apart.
    """
    start = stored(anchors(results, documents, edges, cases))
    nodes = without_overruled(traversed(start, edges, documents), edges, documents).join(documents.select(F.col("doc_id").alias("node"), "date"), "node")
    nodes = stored(timeline(nodes))
    if callable(chunks):
        chunks = chunks(nodes.select(F.col("node").alias("doc_id")).distinct())
    found = best_chunks(nodes, chunks, queries).select("query_id", "node", "index", "phase", "depth", "chunk_id")
    rest = fallback.join(start.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(rest.select("query_id", F.col("doc_id").alias("node"), (F.col("rank") - 1).alias("index"), F.lit(None).cast("string").alias("phase"), F.lit(None).cast("int").alias("depth"), "chunk_id"))


def chains(links: DataFrame) -> DataFrame:
    """(node, last, steps) by following (node, next) to the end; last and steps are null for what runs in a circle.

    Pointers are doubled, so a chain of n links takes log2(n) joins, each of them a table of its own; nodes at their end leave the loop. As long as a chain with an end is
    left, each round ends some of its nodes: where a round ends none, all that is left runs in a circle.
    """
    at = stored(links.select("node", F.col("next").alias("last"), F.lit(1).cast("long").alias("steps")))
    n = at.count()
    done: list[DataFrame] = []
    while True:
        on = at.select(F.col("node").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more"))
        # what is done is looked up, too: it ends the chains that lead to it
        for d in done:
            on = on.unionByName(d.select(F.col("node").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more")))
        moved = stored(at.join(on, "last", "left").select("node", F.coalesce("further", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNull().alias("ended")))
        ended = moved.where("ended").drop("ended")
        done.append(ended)
        at = moved.where("not ended").drop("ended")
        left, least = at.agg(F.count("*"), F.min("steps")).first()
        if not left:
            break
        if least > n or ended.isEmpty():
            done.append(at.select("node", F.lit(None).cast(at.schema["last"].dataType).alias("last"), F.lit(None).cast("long").alias("steps")))
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def effective_outcome(outcomes: Column) -> Column:
    """Outcomes in order: reversed turns upheld and reversed into each other, upheld and dismissed change nothing but a start, others set."""
    first = F.struct(F.lit("UPHELD").alias("status"), F.lit(False).alias("dismissed"))

    def step(s: Column, o: Column) -> Column:
        flipped = F.when(s["status"] == "REVERSED", "UPHELD").otherwise("REVERSED")
        status = F.when(o == "REVERSED", flipped).when(o.isin("UPHELD", "DISMISSED"), s["status"]).otherwise(o)
        return F.struct(status.alias("status"), (s["dismissed"] | (o == "DISMISSED")).alias("dismissed"))

    return F.when(F.size(outcomes) > 0, F.aggregate(outcomes, first, step, lambda s: F.when((s["status"] == "UPHELD") & s["dismissed"], "DISMISSED").otherwise(s["status"])))


def court_level(court: Column) -> Column:
    c = F.lower(court)
    has = lambda *xs: F.greatest(*[F.contains(c, F.lit(x)) for x in xs]) if len(xs) > 1 else F.contains(c, F.lit(xs[0]))
    return F.when(court.isNull(), 0).when(has("supreme court"), 4).when(has("high court"), 3).when(has("sessions", "district", "tribunal"), 2).otherwise(1)


# Phrases by which a passage tells how it cites, in the order in which they are tried.
EDGE_RULES = [
    ("overrules", [" overruled ", " overrule ", " reversed ", " reverses "]),
    ("distinguishes", [" distinguished ", " distinguish ", " distinguished from "]),
    ("disapproves", [" disapproved ", " disapproves "]),
    ("doubts", [" doubted ", " doubts "]),
    ("approves", [" approved ", " approves "]),
    ("affirms", [" affirmed ", " affirms "]),
    ("follows", [" followed ", " follows ", " relied on ", " relies on ", " applied "]),
    ("explains", [" explained ", " explains ", " clarified ", " clarifies "]),
]


def edge_type(explicit: Column, text: Column, rules: list[tuple[str, list[str]]] = EDGE_RULES) -> Column:
    """The stated type if supported and not plain reference, else the first of rules (type, phrases) that fits, else refers_to."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    stated = F.trim(F.lower(explicit))
    out = F.lit("refers_to")
    for kind, phrases in reversed(rules):
        out = F.when(F.greatest(*[F.contains(padded, F.lit(p)) for p in (phrases * 2)]), kind).otherwise(out)
    return F.when(stated.isin([k for k, _ in rules]), stated).otherwise(out)


def projected(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citations (source, reference, explicit, text) with the target that the reference names and the kind of edge; without a target, or where that is the source itself, it is unresolved."""
    found = resolved_targets(citations.select("reference").distinct(), documents).select("reference", F.col("doc_id").alias("target"))
    return citations.join(found, "reference", "left").select("source", "reference", F.when(F.col("target") != F.col("source"), F.col("target")).alias("target"), edge_type(F.col("explicit"), F.col("text")).alias("type"))


def linkage(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """target, followed_by, distinguished_by (arrays), overruled_by, overruled_date, current_validity of every document (doc_id, date, current_validity) that edges (source, target, type) reach; the last source that overrules it holds."""
    e = edges.where("target is not null").select("source", "target", "type").distinct()
    by = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("source"))))
    linked = e.groupBy("target").agg(by("follows").alias("followed_by"), by("distinguishes").alias("distinguished_by"), F.max(F.when(F.col("type") == "overrules", F.col("source"))).alias("overruled_by"))
    day = documents.select(F.col("doc_id").alias("overruled_by"), F.col("date").alias("overruled_date"))
    own = documents.select(F.col("doc_id").alias("target"), "current_validity")
    out = linked.join(day, "overruled_by", "left").join(own, "target")
    return out.select("target", "followed_by", "distinguished_by", "overruled_by", "overruled_date", F.when(F.col("overruled_by").isNotNull(), "OVERRULED").otherwise(F.col("current_validity")).alias("current_validity"))


def resolved_targets(references: DataFrame, documents: DataFrame) -> DataFrame:
    """(reference, doc_id): by citation, neutral citation, source reference, then case name, in this order; one equi-join on an alias table."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), F.col(c).alias("reference")) for i, c in enumerate(["citation", "neutral_citation", "source_document_ref", "case_key"])]))
    alias = documents.select("doc_id", keys.alias("k")).select("doc_id", "k.*").where("reference is not null")
    best = F.min(F.struct("priority", "doc_id")).alias("b")
    return references.join(alias, "reference").groupBy("reference").agg(best).select("reference", "b.doc_id", "b.priority")
