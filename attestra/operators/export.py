"""Graph statements as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def node_label(doc_type: Column) -> Column:
    return F.when(doc_type.isin("statute", "constitution", "amendment"), "StatuteNode").otherwise("JudgmentNode")


def edge_statements(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """source, target, statement: both nodes with citation, court and date, and a CITES relation with the edge's type, for each edge (source, target, type) between documents (doc_id, doc_type, citation, court, date)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def nodes(alias: str) -> DataFrame:
        name = F.concat(F.lit(f"MERGE ({alias}:"), node_label(F.col("doc_type")), F.lit(" {doc_id: "), quoted(F.col("doc_id")), F.lit("})"))
        facts = F.concat(*[x for i, c in enumerate(["citation", "court", "date"]) for x in (F.lit(f"{', ' if i else 'SET '}{alias}.{c} = "), quoted(text(c)))])
        return documents.select(F.col("doc_id").alias(alias), F.concat_ws("\n", name, facts).alias(f"{alias}_node"))

    e = edges.join(nodes("source"), "source").join(nodes("target"), "target")
    relation = F.concat(F.lit("MERGE (source)-[:CITES {citation_type: "), quoted(F.col("type")), F.lit("}]->(target)"))
    return e.select("source", "target", F.concat_ws("\n", "source_node", "target_node", relation).alias("statement"))


def appeal_statements(nodes: DataFrame) -> DataFrame:
    """A statement for each appeal (parent, child, outcome, is_final) that has a parent."""
    node = lambda c: F.concat(F.lit(f"MERGE ({c}:JudgmentNode {{doc_id: "), quoted(F.col(c)), F.lit("})"))
    relation = F.concat(F.lit("MERGE (parent)-[:APPEALED_TO {outcome: "), quoted(F.col("outcome")), F.lit(", is_final_authority: "), F.col("is_final").cast("string"), F.lit("}]->(child)"))
    return nodes.where("parent is not null").select("parent", "child", F.concat_ws("\n", node("parent"), node("child"), relation).alias("statement"))
