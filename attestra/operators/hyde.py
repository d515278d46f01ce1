"""Hypothetical answers: a passage such as an answer might hold takes a plain question's place in dense search, and lifts results that share its words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap, tokens
from .routing import holds

# By practice area the words that call for a passage, its quality, anchors and text; least quality; weights.
PASSAGES = [
    (
        "property_dispossession", "property", ["landlord", "tenant", "rent", "locks", "locked", "evict", "possession"], 0.94, ["Section 6 Specific Relief Act", "illegal dispossession", "restoration of possession", "mandatory injunction"],
        "Where a tenant or person in settled possession is dispossessed otherwise than in due course of law, Section 6 of the Specific Relief Act, 1963 permits recovery of possession. Courts treat lock-outs, forcible eviction, and self-help dispossession by a landlord as illegal. The proper remedy includes restoration of possession, mandatory injunction, and proceedings grounded in due process rather than unilateral eviction.",
    ),
    (
        "criminal_bail", "criminal", ["bail", "anticipatory", "arrest", "fir", "charge sheet"], 0.89, ["BNSS 480", "BNSS 482", "bail is the rule", "non-bailable offence"],
        "In considering bail for a non-bailable offence, the Court must weigh liberty, flight risk, tampering with evidence, and the gravity of the accusation. BNSS 480 and BNSS 482 govern regular and anticipatory bail. Indian courts have repeatedly held that bail is the rule and jail is the exception, subject to the facts of the accusation and the stage of investigation.",
    ),
    (
        "labour_termination", "labour", ["dismiss", "termination", "salary", "workman", "suspension"], 0.83, ["Industrial Disputes Act", "domestic enquiry", "natural justice", "reinstatement"],
        "Termination of service without domestic enquiry, notice, or compliance with principles of natural justice may be set aside. Courts examine whether the employee was a workman, whether Industrial Disputes Act safeguards were followed, and whether back wages, reinstatement, or compensation are appropriate on the facts of the dismissal.",
    ),
]
GENERIC = ("generic_low_confidence", 0.38, "The Court considered the dispute in light of the applicable Indian ", " principles, but the fact pattern lacks enough legal anchors to safely synthesize a focused hypothetical judgment.")
LEAST_QUALITY = 0.6
LOW, NONE_FOUND = "HyDE fallback - low hypothetical confidence", "HyDE fallback - no dense candidates from hypothetical anchor"


def drafts(queries: DataFrame) -> DataFrame:
    """queries (query, practice_area, ..) with strategy, quality, anchors and passage."""
    low, area = F.lower("query"), F.col("practice_area")
    strategy, quality, before, after = GENERIC
    out = F.struct(F.lit(strategy).alias("strategy"), F.lit(quality).alias("quality"), F.array().cast("array<string>").alias("anchors"), F.concat(F.lit(before), F.replace(area, F.lit("_"), F.lit(" ")), F.lit(after)).alias("passage"))
    for name, kind, signals, q, anchors, text in reversed(PASSAGES):
        out = F.when((area == kind) & holds(low, signals), F.struct(F.lit(name).alias("strategy"), F.lit(q).alias("quality"), F.array(*map(F.lit, anchors)).alias("anchors"), F.lit(text).alias("passage"))).otherwise(out)
    return queries.withColumn("_draft", out).select(*queries.columns, "_draft.*")


def boosted(score: Column, text: Column, doc_type: Column, passage: Column, anchors: Column) -> Column:
    """A reranked score with 0.8 of the passage's words that a result shares, 0.06 for each anchor it holds, 0.04 for law; at most 1."""
    words = F.array_distinct(F.concat(tokens(passage), F.flatten(F.transform(anchors, tokens))))
    held = F.size(F.filter(anchors, lambda a: F.contains(F.lower(text), F.lower(a))))
    return F.least(score + 0.8 * overlap(words, tokens(text)) + 0.06 * held + F.when(doc_type.isin("statute", "constitution"), 0.04).otherwise(0.0), F.lit(1.0))


def retrieved(
    queries: DataFrame, lexical: Callable[[DataFrame], DataFrame], dense: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], baseline: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame] = drafts, least: float = LEAST_QUALITY
) -> tuple[DataFrame, DataFrame]:
    """(results, how each query was answered: strategy, quality, used, fallback_reason).

    generate(queries) adds drafts; lexical(queries) and dense(queries with the passage as query) give lists, combine(drafted, lexical, dense) fuses, reranks
    and lifts them; baseline(queries) answers where the draft is poor or dense search finds nothing.
    """
    d = generate(queries)
    fit = d.where(F.col("quality") >= least)
    hits = dense(fit.withColumn("query", F.col("passage")))
    used = fit.join(hits.select("query_id").distinct(), "query_id", "left_semi")
    told = d.join(used.select("query_id", F.lit(True).alias("used")), "query_id", "left").withColumn("used", F.coalesce("used", F.lit(False)))
    told = told.withColumn("fallback_reason", F.when(F.col("quality") < least, LOW).when(~F.col("used"), NONE_FOUND))
    rest = queries.join(told.where("not used").select("query_id"), "query_id", "left_semi")
    return combine(used, lexical(used), hits).unionByName(baseline(rest), allowMissingColumns=True), told.select("query_id", "strategy", "quality", "used", "fallback_reason")
