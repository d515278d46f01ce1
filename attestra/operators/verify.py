"""Grounding of claims, corrective validation of results, placeholders and their resolution, structured answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NEGATIONS, content_tokens, overlap, tokens
from ..functions.vectors import cosine, embedding

VERIFIED, UNCERTAIN = 0.82, 0.55
PROCEED, REFINE = 0.70, 0.40
CUTOVER = "2024-07-01"
LAW_TYPES = ["statute", "constitution"]


def entailment(premise: Column, hypothesis: Column) -> Column:
    """By shared content tokens; two of them and a negation on one side only contradict."""
    h, p = content_tokens(hypothesis), content_tokens(premise)
    negated = lambda t: F.arrays_overlap(tokens(t), F.array(*map(F.lit, NEGATIONS)))
    share = overlap(h, p)
    clash = (F.size(F.array_intersect(h, p)) >= 2) & (negated(hypothesis) != negated(premise))
    return F.when(clash, "CONTRADICTION").when(share >= 0.65, "ENTAILMENT").when(share >= 0.35, "NEUTRAL").otherwise("CONTRADICTION")


def semantic_similarity(claim: Column, passage: Column, claim_vector: Column, passage_vector: Column) -> Column:
    return F.greatest(cosine(claim_vector, passage_vector), overlap(content_tokens(claim), content_tokens(passage)))


def best_passages(claims: DataFrame, chunks: DataFrame, top_k: int = 3) -> DataFrame:
    """claims (claim_id, claim, doc_id, preferred_chunk) with the best chunks (doc_id, chunk_id, text, header) of their document. Each claim and each chunk that is met is embedded once."""
    own = chunks.join(claims.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("vector", embedding(F.col("text")))
    c = claims.withColumn("claim_vector", embedding(F.col("claim"))).join(own, "doc_id")
    sim = semantic_similarity(F.col("claim"), F.col("text"), F.col("claim_vector"), F.col("vector"))
    cover = lambda t: overlap(content_tokens(F.col("claim")), content_tokens(t))
    preferred = F.when(F.col("chunk_id").eqNullSafe(F.col("preferred_chunk")), 0.1).otherwise(0.0)
    score = F.least(0.55 * sim + 0.35 * cover(F.col("text")) + 0.1 * cover(F.coalesce("header", F.lit(""))) + preferred, F.lit(1.0))
    c = c.withColumn("similarity", F.round(sim, 6)).withColumn("score", F.round(score, 6)).drop("vector", "claim_vector")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= top_k)


def grounding(similarity: Column, label: Column) -> Column:
    return (
        F.when(label == "CONTRADICTION", "MISGROUNDED").when((similarity >= VERIFIED) & (label == "ENTAILMENT"), "VERIFIED")
        .when((similarity >= UNCERTAIN) | (label == "NEUTRAL"), "UNCERTAIN").otherwise("MISGROUNDED")
    )


def checked_claims(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each claim's best passage, label and status; without a passage it is misgrounded, without a document uncertain."""
    best = best_passages(claims.where("doc_id is not null"), chunks, 1)
    best = best.withColumn("label", entailment(F.col("text"), F.col("claim"))).withColumn("status", grounding(F.col("similarity"), F.col("label")))
    out = claims.select("claim_id", "doc_id").join(best.select("claim_id", "chunk_id", "similarity", "label", "status"), "claim_id", "left")
    return out.withColumn("status", F.coalesce("status", F.when(F.col("doc_id").isNull(), "UNCERTAIN").otherwise("MISGROUNDED")))


def worst_status(statuses: DataFrame, by: str) -> DataFrame:
    """Per key: any UNSUPPORTED, else any UNCERTAIN, else VERIFIED; with counts."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
    out = statuses.groupBy(by).agg(n("VERIFIED"), n("UNCERTAIN"), n("UNSUPPORTED"))
    return out.withColumn("overall", F.when((F.col("n_unsupported") > 0) | (F.col("n_verified") + F.col("n_uncertain") == 0), "UNSUPPORTED").when(F.col("n_uncertain") > 0, "UNCERTAIN").otherwise("VERIFIED"))


def claim_status(grounding_status: Column, pending: Column) -> Column:
    return F.when(grounding_status == "MISGROUNDED", "UNSUPPORTED").when(pending | (grounding_status == "UNCERTAIN"), "UNCERTAIN").otherwise("VERIFIED")


def coverage(kind: Column, n_results: Column, has_law: Column, has_case: Column, wants_interpretation: Column, n_entities: Column) -> Column:
    law = F.when(has_law, 0.5).otherwise(0.0) + F.when(wants_interpretation, F.when(has_case, 0.5).otherwise(0.0)).otherwise(0.5)
    return (
        F.when(n_results == 0, 0.0).when(kind == "statutory_lookup", law).when(kind == "case_specific", F.when(has_case, 1.0).otherwise(0.0))
        .when(kind == "vague_natural", 1.0).otherwise(F.when(n_entities > 0, 0.5).otherwise(0.0))
    )


def corrective_action(relevance: Column, entities: Column, cover: Column, n_results: Column) -> tuple[Column, Column]:
    score = 0.4 * relevance + 0.25 * entities + 0.35 * cover
    return score, F.when((score > PROCEED) & (n_results > 0), "PROCEED").when(score > REFINE, "REFINED").otherwise("INSUFFICIENT")


def amended_since(sections: DataFrame, amendments: DataFrame) -> DataFrame:
    """sections (section_id, as_of) whose latest amendment (section_id, effective) comes after the day their text is of."""
    last = amendments.groupBy("section_id").agg(F.max("effective").alias("latest"))
    return sections.join(last, "section_id", "left").withColumn("outdated", F.coalesce(F.col("latest") > F.col("as_of"), F.lit(False)))


#: A section is known by its name, number, header and so many characters of its text.
LEAD = 300


def section_tokens(act: Column, section: Column, header: Column, text: Column) -> Column:
    part = lambda c: F.when(c != "", c)
    return tokens(F.concat_ws(" ", part(act), part(section), part(header), part(F.substr(text, F.lit(1), F.lit(LEAD)))))


def statute_match(query_tokens: Column, description: Column, act: Column, section: Column, section_tokens_: Column, doc_type: Column) -> Column:
    """Shared tokens, 0.35 if the act is named, 0.45 if the section is, 0.15 for the constitution; at most 1."""
    d = F.lower(description)
    has = lambda c, x: F.coalesce((x != "") & F.contains(d, F.concat(F.lit(c), F.lower(x))), F.lit(False))
    s = overlap(query_tokens, section_tokens_)
    s = s + F.when(has("", act), 0.35).otherwise(0.0) + F.when(has("section ", section), 0.45).otherwise(0.0)
    s = s + F.when((doc_type == "constitution") & F.contains(d, F.lit("constitution")), 0.15).otherwise(0.0)
    return F.least(s, F.lit(1.0))


def section_kind(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.rlike("law|statute"), "APPLICABLE_LAW").when(t.rlike("authorit|case"), "KEY_CASES").otherwise("LEGAL_POSITION")
