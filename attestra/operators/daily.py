"""The daily run over statutes and judgments: what changes, what is stale by it, and what nobody knows.

documents: doc_id, doc_type, current_validity, overruled_by, overruled_date, replaced_by, stale, stale_reason, reembed. sections: doc_id, section, text, original_text, in_force, cases (array of doc_ids that
interpret it). edges: source, target. Updates: statutes (position, doc_id, valid, replaced_by), changes (position, doc_id, section, text, in_force, label), judgments (position, doc_id, validity, authority, authority_date, note).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import Ledger
from .state import latest


def unknown(tables: dict[str, DataFrame], statutes: DataFrame, changes: DataFrame, judgments: DataFrame) -> DataFrame:
    """message of every update of something that is not there, in the order in which updates are applied (turn, position, place)."""
    d = tables["documents"]
    law = d.where("doc_type in ('statute', 'constitution')").select("doc_id")
    s = statutes.join(law, "doc_id", "left_anti").select(F.lit(0).alias("turn"), "position", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("Unknown statute document: "), F.col("doc_id").cast("string")).alias("message"))
    order = statutes.select("doc_id", F.col("position").alias("at"))
    c = changes.join(law, "doc_id", "left_semi").join(order, "doc_id").join(tables["sections"].select("doc_id", "section"), ["doc_id", "section"], "left_anti")
    c = c.select(F.lit(0).alias("turn"), F.col("at").alias("position"), F.col("position").cast("long").alias("place"), F.format_string("Unknown section %s for statute %s", "section", F.col("doc_id").cast("string")).alias("message"))
    j = judgments.join(d.select("doc_id"), "doc_id", "left_anti").select(F.lit(1).alias("turn"), "position", F.lit(0).cast("long").alias("place"), F.concat(F.lit("Unknown judgment document: "), F.col("doc_id").cast("string")).alias("message"))
    return s.unionByName(c).unionByName(j)


def sections_after(sections: DataFrame, changes: DataFrame) -> DataFrame:
    """sections with the last change of each, the text before the first change, and changed: text or force differ, or an amendment is named."""
    u = latest(changes, ["doc_id", "section"], [F.desc("position")]).select("doc_id", "section", F.col("position").alias("position"), F.col("text").alias("new_text"), F.col("in_force").alias("new_in_force"), "label")
    s = sections.join(u, ["doc_id", "section"], "left")
    text = F.col("new_text").isNotNull() & ~F.col("new_text").eqNullSafe(F.col("text"))
    force = F.col("new_in_force").isNotNull() & (F.col("new_in_force") != F.col("in_force"))
    return s.select(
        "doc_id", "section", F.when(text, F.col("new_text")).otherwise(F.col("text")).alias("text"), F.coalesce("original_text", F.when(text, F.col("text"))).alias("original_text"), F.coalesce("new_in_force", "in_force").alias("in_force"), "cases", "position",
        F.coalesce(text | force | F.col("label").isNotNull(), F.lit(False)).alias("changed"),
    )


def applied(tables: dict[str, DataFrame], statutes: DataFrame, changes: DataFrame, judgments: DataFrame) -> dict[str, DataFrame]:
    """documents and sections after all updates. Of several reasons why a document is stale the one given last holds: a statute's repeal, its sections in order and the cases that interpret them, then judgments and what cites them."""
    documents, edges = tables["documents"], tables["edges"]
    st = latest(statutes, ["doc_id"], [F.desc("position")])
    order = st.select("doc_id", F.col("position").alias("at"))
    after = sections_after(tables["sections"], changes.join(order.select("doc_id"), "doc_id", "left_semi"))
    touched = after.where("changed").join(order, "doc_id")
    at = lambda turn, *rest: F.struct(F.lit(turn).alias("turn"), *[r.cast("long").alias(f"k{i}") for i, r in enumerate(rest)])
    why = [
        st.where("not valid").select("doc_id", at(0, F.col("position"), F.lit(-1), F.lit(0)).alias("at"), F.concat(F.lit("Statute repealed. Replacement: "), F.coalesce("replaced_by", F.lit("not specified"))).alias("reason"), F.lit(False).alias("anew")),
        touched.select("doc_id", at(0, F.col("at"), F.col("position"), F.lit(0)).alias("at"), F.format_string("Section %s amended.", "section").alias("reason"), F.lit(True).alias("anew")),
        touched.select(F.explode("cases").alias("doc_id"), at(0, F.col("at"), F.col("position"), F.lit(1)).alias("at"), F.format_string("Interpreted statute text changed for section %s.", "section").alias("reason"), F.lit(True).alias("anew")),
    ]
    j = judgments.select("position", "doc_id", "validity", "authority", "authority_date", "note")
    why.append(j.select("doc_id", at(1, F.col("position"), F.lit(0), F.lit(0)).alias("at"), F.coalesce("note", F.concat(F.lit("Judgment validity updated to "), "validity", F.lit("."))).alias("reason"), F.lit(False).alias("anew")))
    cited = edges.join(j.select(F.col("doc_id").alias("target"), "position", "validity"), "target")
    text = F.format_string("Cites judgment %s whose validity changed to %s.", F.col("target").cast("string"), "validity")
    why.append(cited.select(F.col("source").alias("doc_id"), at(1, F.col("position"), F.lit(0), F.lit(1)).alias("at"), text.alias("reason"), F.lit(False).alias("anew")))
    reasons = why[0]
    for w in why[1:]:
        reasons = reasons.unionByName(w)
    reasons = reasons.groupBy("doc_id").agg(F.max(F.struct("at", "reason")).reason.alias("reason"), F.max("anew").alias("anew"))
    amended = touched.select("doc_id").distinct().withColumn("amended", F.lit(True))
    new = latest(j, ["doc_id"], [F.desc("position")]).withColumnRenamed("position", "judged")
    own = st.select("doc_id", "valid", F.col("replaced_by").alias("new_replaced_by"))
    d = documents.join(own, "doc_id", "left").join(amended, "doc_id", "left").join(new, "doc_id", "left").join(reasons, "doc_id", "left")
    law = F.when(~F.col("valid"), "REPEALED").when(F.col("valid") & F.col("amended"), "AMENDED").when(F.col("valid") & (F.col("current_validity") == "REPEALED"), "GOOD_LAW").otherwise(F.col("current_validity"))
    judged = F.col("judged").isNotNull()
    d = d.select(
        "doc_id", "doc_type", F.coalesce("validity", law).alias("current_validity"), F.when(judged, F.col("authority")).otherwise(F.col("overruled_by")).alias("overruled_by"), F.when(judged, F.col("authority_date")).otherwise(F.col("overruled_date")).alias("overruled_date"),
        F.when(F.col("valid").isNotNull(), F.col("new_replaced_by")).otherwise(F.col("replaced_by")).alias("replaced_by"), (F.col("stale") | F.col("reason").isNotNull()).alias("stale"), F.coalesce("reason", "stale_reason").alias("stale_reason"), (F.col("reembed") | F.coalesce("anew", F.lit(False))).alias("reembed"),
    )
    return {"documents": d, "sections": after.drop("position", "changed")}


def run(ledger: Ledger, batch_id: str, statutes: DataFrame, changes: DataFrame, judgments: DataFrame) -> dict[str, int]:
    """One day's updates, once for each batch_id. An update of something unknown fails the run, by the first such message, and changes nothing."""

    def change(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        first = unknown(tables, statutes, changes, judgments).orderBy("turn", "position", "place").select("message").head(1)
        if first:
            raise ValueError(first[0]["message"])
        return applied(tables, statutes, changes, judgments)

    return ledger.run(batch_id, change)
