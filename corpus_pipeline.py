"""From raw documents to packed training windows: five stages, each one of the operators in attestra.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's rows to the
shared folder and rereads them, so the next stage starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontam, neardup, packing, pii, toxicity
from attestra.llm.common import documents, split_for, written

#: A document is rejected from this probability on.
TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = split_for(docs, "_score")
    return toxicity.score(docs, model, score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; of rows that repeat its id, the one with the smallest text hash.

    Rows are told apart by id and text, so a text that no other is like stays although another text has its id.
    """
    found = written(neardup.near_duplicates(docs).select("doc_id", "text_key", "n_shingles", "component_id", "kept"), "found")
    gone = found.where(~F.col("kept")).select("doc_id", "text_key")
    repeated = found.where("kept and n_shingles > 0").groupBy("component_id", "doc_id").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most")).where("least <> most")
    second = found.where("kept and n_shingles > 0").join(repeated, ["component_id", "doc_id"]).where("text_key <> least").select("doc_id", "text_key")
    gone = gone.unionByName(second).distinct()
    key, id_ = split_for(docs, "_key"), split_for(docs, "_id")
    gone = gone.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    kept = keyed.join(gone, keyed[key].eqNullSafe(gone[key]) & keyed["doc_id"].eqNullSafe(gone[id_]), "left_anti").select(docs.columns)
    if found.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars, where there is one, is that of the new text."""
    out = pii.pseudonymised(docs, pii.key_of(spark))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("packing", pack),
]

#: Training, sketches and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
