"""Line-structured text: header lines open sections, other lines join the open one (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Header lines of statutes and of the constitution.
SECTION = r"(?i)^Section\s+([0-9A-Z()]+)\s*[:.-]\s*(.+)$"
ARTICLE = r"^Article\s+([0-9A-Z]+)\s*[:.-]\s*(.+)$"


def sections(docs: DataFrame, header: str = SECTION) -> DataFrame:
    """doc_id, section_index, number, heading, text of docs (doc_id, text); lines before the first header are left out."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).where("line <> ''")
    rows = rows.withColumn("is_header", F.col("line").rlike(header))
    rows = rows.withColumn("section_index", F.sum(F.col("is_header").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))).where("section_index > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("pos", "line")))), lambda x: x["line"]), " ")
    head = F.max(F.when(F.col("is_header"), F.col("line")))
    out = rows.groupBy("doc_id", "section_index").agg(head.alias("head"), body.alias("text"))
    return out.select("doc_id", "section_index", F.regexp_extract("head", header, 1).alias("number"), F.regexp_extract("head", header, 2).alias("heading"), "text")
