"""Appeals: histories of judgments, their final authority, what a citation of an appealed judgment is worth.

nodes: owner, parent, child, court_level, judged_on, outcome, is_final: an appeal from parent, decided by child (null: by the owner itself).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from .graph import court_level, effective_outcome

OUTCOMES = ["UPHELD", "REVERSED", "MODIFIED", "REMANDED", "DISMISSED"]
HISTORY = "array<struct<parent:bigint,child:bigint,court_level:int,judged_on:date,outcome:string,is_final:boolean,place:int>>"


def outcome_of(outcome: Column, relation: Column) -> Column:
    """A known outcome, else null: `appeal_from` alone tells none."""
    raw = F.upper(F.trim(F.coalesce(outcome, relation)))
    return F.when(raw.isin(*OUTCOMES), raw)


def resolved_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """links (source, reference, relation, outcome, is_final, court, judged_on) with their parent, by citation, neutral citation or source reference of
    documents (doc_id, citation, neutral_citation, source_ref, court, date); the smallest id of several. parent is null where a reference fits none."""
    keys = documents.select("doc_id", F.explode(F.array("citation", "neutral_citation", "source_ref")).alias("reference")).where("reference is not null")
    parents = keys.groupBy("reference").agg(F.min("doc_id").alias("parent"))
    own = documents.select(F.col("doc_id").alias("source"), F.col("court").alias("own_court"), F.col("date").alias("own_date"))
    r = links.join(own, "source").join(parents, "reference", "left")
    return r.select(
        "source", "reference", "parent", outcome_of(F.col("outcome"), F.col("relation")).alias("outcome"), F.coalesce("is_final", F.lit(True)).alias("is_final"), court_level(F.coalesce("court", "own_court")).alias("court_level"), F.coalesce("judged_on", "own_date").alias("judged_on"),
    )


def appeal_nodes(resolved: DataFrame) -> DataFrame:
    """The nodes that resolved links add: one for the deciding judgment, one for the parent and each judgment the parent was an appeal from.

    Links count in the order of their days. Only the last node of an owner can be final. Ancestors are found by following links upward, a table at a time.
    """
    links = stored(resolved.where("parent is not null and outcome is not null and parent <> source").dropDuplicates(["source", "parent", "outcome", "court_level"]))
    up = links.select(F.col("source").alias("child"), F.col("parent").alias("owner")).distinct()
    reach = front = stored(up)
    while not front.isEmpty():
        onward = front.join(up.select(F.col("child").alias("owner"), F.col("owner").alias("above")), "owner").select("child", F.col("above").alias("owner")).where("child <> owner").distinct()
        front = stored(onward.join(reach, ["child", "owner"], "left_anti"))
        reach = reach.unionByName(front)
    facts = ["court_level", "judged_on", "outcome", "is_final", "source"]
    own = links.select(F.col("source").alias("owner"), "parent", F.lit(None).cast("long").alias("child"), *facts)
    direct = links.select(F.col("parent").alias("owner"), "parent", F.col("source").alias("child"), *facts)
    above = links.join(reach.select(F.col("child").alias("parent"), "owner"), "parent").select("owner", "parent", F.col("source").alias("child"), *facts)
    nodes = own.unionByName(direct).unionByName(above).distinct()
    order = Window.partitionBy("owner").orderBy(F.asc_nulls_first("judged_on"), "source", "parent", F.asc_nulls_first("child"), "outcome")
    nodes = nodes.withColumn("place", F.row_number().over(order)).withColumn("last", F.max("place").over(Window.partitionBy("owner")))
    return nodes.select("owner", "parent", "child", "court_level", "judged_on", "outcome", (F.col("is_final") & (F.col("place") == F.col("last"))).alias("is_final"), "place")


def parent_validity(documents: DataFrame, resolved: DataFrame) -> DataFrame:
    """(doc_id, current_validity) after the links: a reversal ends a judgment, a later affirmation brings back one that was reversed."""
    per = resolved.where("parent is not null and outcome is not null").groupBy(F.col("parent").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("judged_on", "source", "outcome"))).alias("told"))
    step = lambda s, x: F.when(x["outcome"] == "REVERSED", "REVERSED_ON_APPEAL").when((x["outcome"] == "UPHELD") & (s == "REVERSED_ON_APPEAL"), "GOOD_LAW").otherwise(s)
    return documents.select("doc_id", "current_validity").join(per, "doc_id", "left").select("doc_id", F.when(F.col("told").isNull(), F.col("current_validity")).otherwise(F.aggregate("told", F.col("current_validity"), step)).alias("current_validity"))


def _best(nodes: Column, final_first: bool) -> Column:
    """The node of the highest court, then the latest day, then the first: final ones before others if asked."""
    rank = lambda n: F.struct(n["is_final"] if final_first else F.lit(True), n["court_level"], F.coalesce(n["judged_on"], F.to_date(F.lit("0001-01-01"))), -n["place"], n.alias("node"))
    return F.array_max(F.transform(nodes, rank))["node"]


def path(doc_id: Column, history: Column) -> Column:
    """The nodes from a judgment upward: at each step the best appeal from where the path stands; ends at a judgment seen before."""
    start = F.struct(doc_id.alias("at"), F.array().cast(HISTORY).alias("path"), F.array(doc_id).alias("seen"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        going = F.filter(history, lambda n: (n["parent"] == s["at"]) & n["child"].isNotNull())
        best = _best(going, True)
        stop = s["done"] | (F.size(going) == 0)
        again = F.coalesce(F.array_contains(s["seen"], best["child"]), F.lit(False))
        return F.struct(
            F.when(stop, s["at"]).otherwise(best["child"]).alias("at"), F.when(stop, s["path"]).otherwise(F.concat(s["path"], F.array(best))).alias("path"),
            F.when(stop, s["seen"]).otherwise(F.concat(s["seen"], F.array(best["child"]))).alias("seen"), (stop | again).alias("done"),
        )

    return F.aggregate(history, start, step, lambda s: s["path"])


def warning_of(outcome: Column, use: Column, doc_id: Column) -> Column:
    moved = use != doc_id
    name = use.cast("string")
    return (
        F.when((outcome == "REVERSED") & moved, F.concat(F.lit("This judgment was reversed on appeal. Use final authority: "), name, F.lit(".")))
        .when((outcome == "MODIFIED") & moved, F.concat(F.lit("This judgment was modified on appeal. Use final authority: "), name, F.lit(".")))
        .when(outcome == "REMANDED", "This matter was remanded on appeal.").when((outcome == "DISMISSED") & moved, F.concat(F.lit("The appeal was dismissed. Final authority remains: "), name, F.lit(".")))
    )


def final_authorities(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per document (doc_id): use_doc_id, outcome, is_final, pending, warning, path of ids. Without a history a document is its own authority."""
    held = nodes.groupBy(F.col("owner").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("place", F.struct("parent", "child", "court_level", "judged_on", "outcome", "is_final", "place").alias("n")))).alias("h"))
    held = held.select("doc_id", F.transform("h", lambda x: x["n"]).cast(HISTORY).alias("history"))
    d = documents.select("doc_id").join(held, "doc_id", "left").withColumn("path", F.when(F.col("history").isNotNull(), path(F.col("doc_id"), F.col("history"))))
    last = F.try_element_at("path", F.lit(-1))
    finals = F.filter("history", lambda n: n["is_final"])
    d = d.withColumn("final", F.when(F.coalesce(last["is_final"], F.lit(False)), last).when(F.size(finals) > 0, _best(finals, False)))
    use = F.coalesce("final.child", "doc_id")
    outcomes = F.transform(F.when(F.size("path") > 0, F.col("path")).otherwise(F.array("final")), lambda n: n["outcome"])
    d = d.withColumn("use_doc_id", use).withColumn("outcome", F.when(F.col("final").isNotNull(), effective_outcome(outcomes)))
    unresolved = F.col("history").isNotNull() & F.col("final").isNull()
    steps = F.concat(F.array("doc_id"), F.when(F.col("final").isNotNull(), F.array_compact(F.transform("path", lambda n: n["child"]))).otherwise(F.array().cast("array<long>")))
    ids = F.when(F.array_contains(steps, F.col("use_doc_id")), steps).otherwise(F.concat(steps, F.array("use_doc_id")))
    return d.select(
        "doc_id", "use_doc_id", "outcome", (F.col("history").isNull() | (F.col("final").isNotNull() & (F.col("use_doc_id") == F.col("doc_id")))).alias("is_final"), unresolved.alias("pending"),
        F.when(unresolved, F.lit("Appeal history exists but final authority could not be resolved.")).otherwise(warning_of(F.col("outcome"), F.col("use_doc_id"), F.col("doc_id"))).alias("warning"), ids.alias("path"),
    )


def validated_citations(citations: DataFrame, authorities: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations (citation_id, doc_id, verified) with status, severity, warning, banner, the document to use in their place and its first chunk (chunks: doc_id, chunk_id, chunk_index).

    What is not verified, or of no known document, is left as it stands.
    """
    a = authorities.select("doc_id", "use_doc_id", "outcome", "pending", F.col("warning").alias("told"), "path")
    c = citations.join(a, "doc_id", "left").withColumn("known", F.col("verified") & F.col("use_doc_id").isNotNull())
    moved = F.col("use_doc_id") != F.col("doc_id")
    kind = F.when(~F.col("known"), "VALID").when(F.col("pending"), "PENDING").when((F.col("outcome") == "REVERSED") & moved, "REDIRECTED").when(F.col("outcome").isin("MODIFIED", "REMANDED"), F.col("outcome")).when((F.col("outcome") == "DISMISSED") & F.col("told").isNotNull(), "DISMISSED").otherwise("VALID")
    c = c.withColumn("status", kind)
    severity = F.when(F.col("status") == "REDIRECTED", "CRITICAL").when(F.col("status").isin("PENDING", "MODIFIED", "REMANDED"), "WARNING").otherwise("INFO")
    modified = F.concat(F.lit("This judgment was modified on appeal. Use final authority: "), F.col("use_doc_id").cast("string"), F.lit("."))
    warning = F.when(~F.col("known"), F.lit(None)).when(F.col("status") == "PENDING", "Appeal pending — this may not be the final judgment.").when(F.col("status") == "MODIFIED", F.coalesce("told", modified)).otherwise(F.col("told"))
    first = chunks.groupBy(F.col("doc_id").alias("instead")).agg(F.min(F.struct("chunk_index", "chunk_id")).chunk_id.alias("chunk_id"))
    c = c.withColumn("instead", F.when(F.col("known") & ~F.col("pending") & moved, F.col("use_doc_id"))).join(first, "instead", "left")
    return c.select("citation_id", "doc_id", "status", severity.alias("severity"), warning.alias("warning"), (F.col("status") == "REDIRECTED").alias("banner"), F.col("instead").alias("use_doc_id"), "chunk_id", F.when(F.col("known"), F.col("path")).alias("path"))
