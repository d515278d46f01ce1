"""Scores of rankings, of citation records and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ir_metrics(ranking: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per case: precision, recall and nDCG at ks, reciprocal rank, average precision.

    ranking: case_id, doc_id, rank; repeats count at their first rank. qrels: case_id, doc_id, relevant, grade.
    The ideal order takes relevant documents only. Cases without results score 0.
    """
    first = ranking.groupBy("case_id", "doc_id").agg(F.min("rank").alias("at"))
    by = Window.partitionBy("case_id")
    r = first.withColumn("i", F.row_number().over(by.orderBy("at", "doc_id")))
    r = r.join(qrels, ["case_id", "doc_id"], "left").withColumn("hit", F.coalesce(F.col("relevant"), F.lit(False)).cast("int")).withColumn("gain", (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("i") + 1))
    r = r.withColumn("hits", F.sum("hit").over(by.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda k, c: F.sum(F.when(F.col("i") <= k, F.col(c)).otherwise(0))
    found = r.groupBy("case_id").agg(
        *[at(k, "hit").alias(f"hits_{k}") for k in ks], *[at(k, "gain").alias(f"dcg_{k}") for k in ks],
        F.min(F.when(F.col("hit") == 1, F.col("i"))).alias("first_hit"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("i")).otherwise(0.0)).alias("precision_sum"),
    )
    ideal = qrels.where("relevant").withColumn("i", F.row_number().over(by.orderBy(F.desc("grade"), "doc_id"))).withColumn("gain", (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("i") + 1))
    wanted = ideal.groupBy("case_id").agg(F.count("*").alias("n_relevant"), *[at(k, "gain").alias(f"ideal_{k}") for k in ks])
    cases = qrels.select("case_id").distinct().join(wanted, "case_id", "left").join(found, "case_id", "left")
    n = F.greatest(F.coalesce("n_relevant", F.lit(0)), F.lit(1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = [F.col("case_id")]
    for k in ks:
        out += [F.round(zero(f"hits_{k}") / k, 6).alias(f"p_{k}"), F.round(zero(f"hits_{k}") / n, 6).alias(f"r_{k}")]
        out.append(F.round(F.when(zero(f"ideal_{k}") > 0, zero(f"dcg_{k}") / F.when(zero(f"ideal_{k}") > 0, F.col(f"ideal_{k}")).otherwise(1.0)).otherwise(0.0), 6).alias(f"ndcg_{k}"))
    out += [F.round(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)), 6).alias("rr"), F.round(zero("precision_sum") / n, 6).alias("ap")]
    return cases.select(*out)


def macro(metrics: DataFrame) -> DataFrame:
    """Means over cases; 0 without any."""
    return metrics.agg(F.count("*").alias("n_cases"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}") for c in metrics.columns if c != "case_id"])


def rate(flag: Column, among: Column) -> Column:
    """Share of rows with flag among some; 0 without any. Null flags count as false."""
    return F.round(F.coalesce(F.avg(F.when(among, F.coalesce(flag, F.lit(False)).cast("double"))), F.lit(0.0)), 6)


def citation_rates(records: DataFrame) -> DataFrame:
    """Six rates over citation records, each among the records that it concerns."""
    case, law = F.col("kind") == "judgment", F.col("kind") == "statute"
    shown, final = F.col("surfaced_doc_id"), F.col("final_authority_doc_id")
    return records.agg(
        rate(F.col("exists"), case).alias("citation_existence"),
        rate(F.col("supports_claim"), case & F.col("supports_claim").isNotNull()).alias("citation_accuracy"),
        rate(final.isNull() | (shown == final), case & (shown.isNotNull() | final.isNotNull())).alias("appeal_chain_accuracy"),
        rate(F.col("claimed_authority_label") == F.col("expected_authority_label"), F.col("claimed_authority_label").isNotNull() & F.col("expected_authority_label").isNotNull()).alias("jurisdiction_accuracy"),
        rate(F.col("statute_in_force"), law & F.col("statute_in_force").isNotNull()).alias("temporal_validity"),
        rate(F.col("uses_current_text"), law & F.col("uses_current_text").isNotNull()).alias("amendment_awareness"),
    )


def completeness(expected: Column, surfaced: Column) -> Column:
    """Share of the expected set that was surfaced; 0 if none is expected."""
    n = F.size(F.array_distinct(expected))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(expected, surfaced)) / F.greatest(n, F.lit(1)))
