"""The domain's tables as arithmetic views over plain input tables, so that SQL can derive the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def legal_documents(self, only: DataFrame | None = None) -> DataFrame:
        """All documents, or those that only (doc_id) names: they are picked where texts are read, before anything is joined."""
        t = self.table("documents")
        t = t if only is None else t.join(only, "doc_id", "left_semi")
        d = t.join(self.table("labels").select("doc_id", "toxic"), "doc_id", "left")
        doc_type = F.when(F.col("doc_id") % 5 == 3, "statute").when(F.col("doc_id") % 5 == 4, "constitution").otherwise("judgment")
        court = F.when(F.col("doc_id") % 4 == 0, "Supreme Court").when(F.col("doc_id") % 4 == 1, "Bombay High Court").when(F.col("doc_id") % 4 == 2, "Delhi High Court").otherwise("NCLT Principal Bench")
        return d.select(
            "doc_id", "text", "lang", "source", doc_type.alias("doc_type"), court.alias("court"), (1 + F.col("doc_id") % 9).cast("int").alias("coram"),
            F.date_add(F.to_date(F.lit("1950-01-01")), F.col("doc_id").cast("int")).alias("date"), F.when(F.col("toxic") == 1, "OVERRULED").otherwise("GOOD_LAW").alias("current_validity"),
        )

    def edges(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, ["follows", "distinguishes", "explains", "refers_to", "affirms", "overrules", "follows", "refers_to", "explains"])), (F.col("source") % 9 + 1).cast("int"))
        d = self.table("documents").select(F.col("doc_id").alias("source"))
        e = d.select("source", F.explode(F.array((F.col("source") / 2).cast("long"), (F.col("source") / 3).cast("long"))).alias("target")).where("source <> target").distinct()
        return e.withColumn("type", kind)

    def texts(self) -> DataFrame:
        """doc_id, text; dealt out anew only where the table's files give fewer tasks than there are cores."""
        t = self.table("documents").select("doc_id", "text")
        cores = self.spark.sparkContext.defaultParallelism
        return t if t.rdd.getNumPartitions() >= cores else t.repartition(cores)

    def document_tokens(self) -> DataFrame:
        return self.texts().select("doc_id", tokens(F.col("text")).alias("tokens"))

    def benchmark_queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
