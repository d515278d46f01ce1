"""Corrective validation of retrieved results: validity on a day, relevance, coverage, what to do next, queries taken apart.

results: query_id, rank, chunk_id, doc_id, text, header, act, section, citation, court, appellant, respondent, doc_type, practice_areas, authority, embedded_on,
amended_on, current_validity, overruled_by. queries: query_id, query, query_type, practice_area, jurisdiction, reference_date, sections, equivalents,
entities (array of kind, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap, squeeze, tokens
from ..tables import stored
from .graph import INVALID
from .routing import holds
from .state import CUTOVER
from .verify import corrective_action, coverage

# Acts that the new codes replace, words that ask for interpretation, weights.
LEGACY_ACTS = ["ipc", "crpc", "indian evidence act"]
INTERPRETING = ["interpret", "interpreted", "held", "courts", "case law"]
LAW = ["statute", "constitution"]
NO_ANSWER = "Insufficient information in corpus for this query. Please verify with primary sources."


def result_text() -> Column:
    parts = ["text", "header", "act", "section", "citation", "court", "appellant", "respondent"]
    return F.concat_ws(" ", *[F.when(F.col(p) != "", F.col(p)) for p in parts])


def reference_numbers(*references: Column) -> Column:
    """The last words of references that have more than one, in capitals."""
    every = F.concat(*[F.coalesce(r, F.array().cast("array<string>")) for r in references])
    return F.array_distinct(F.transform(F.filter(every, lambda r: F.contains(r, F.lit(" "))), lambda r: F.upper(F.substring_index(r, " ", -1))))


def named_cases(entities: Column) -> Column:
    return F.transform(F.filter(entities, lambda e: e["kind"] == "CASE_NAME"), lambda e: F.lower(e["text"]))


def temporal_findings(results: DataFrame, queries: DataFrame, statutes: DataFrame, sections: DataFrame, amendments: DataFrame) -> DataFrame:
    """results with valid, severity, reason, replacement, warning, current_text.

    statutes: doc_id, in_force, replaced_by; sections: doc_id, section, section_text, new_section; amendments: doc_id, section, effective_on, amended_on.
    Law out of force is critical; text older than its section's latest amendment is important; a section of an old code gets a warning
    from the day of the new one; of judgments, those overruled or reversed are critical.
    """
    latest = amendments.groupBy("doc_id", "section").agg(F.max(F.coalesce("effective_on", "amended_on")).alias("latest"))
    known = sections.join(latest, ["doc_id", "section"], "left").withColumn("listed", F.lit(True))
    r = results.join(statutes.withColumn("enacted", F.lit(True)), "doc_id", "left").join(known, ["doc_id", "section"], "left").join(queries.select("query_id", "reference_date"), "query_id")
    law = F.col("doc_type").isin(*LAW)
    repealed = law & F.coalesce(F.col("enacted") & ~F.col("in_force"), F.lit(False))
    in_section = law & F.coalesce(F.col("enacted") & F.col("listed"), F.lit(False))
    amended = in_section & F.coalesce(F.col("latest") > F.coalesce("embedded_on", "amended_on"), F.lit(False))
    old_code = in_section & (F.col("reference_date") >= F.to_date(F.lit(CUTOVER))) & F.coalesce(F.lower("act").isin(*LEGACY_ACTS), F.lit(False)) & (F.coalesce("new_section", F.lit("")) != "")
    ended = ~law & F.coalesce(F.col("current_validity").isin(*INVALID), F.lit(False))
    severity = F.when(repealed, "CRITICAL").when(amended, "IMPORTANT").when(old_code, "WARNING").when(ended, "CRITICAL")
    reason = (
        F.when(repealed, F.concat(F.lit("Act repealed. Replaced by: "), F.coalesce(F.col("replaced_by").cast("string"), F.lit("None"))))
        .when(amended, F.concat(F.lit("Section amended on "), F.date_format("latest", "yyyy-MM-dd"))).when(old_code, F.lit(None)).when(ended, F.concat(F.lit("Judgment validity is "), F.col("current_validity"), F.lit(".")))
    )
    warning = F.when(severity == "WARNING", F.concat(F.lit("New equivalent: "), F.col("new_section"), F.lit(". Use the new criminal code provision for post-July-2024 offences.")))
    found = r.withColumns({"severity": severity, "reason": reason, "warning": warning, "replacement": F.when(repealed, F.col("replaced_by")).when(ended, F.col("overruled_by")), "current_text": F.when(severity == "IMPORTANT", F.col("section_text"))})
    found = found.withColumn("valid", F.coalesce(~F.col("severity").isin("CRITICAL", "IMPORTANT"), F.lit(True)))
    return found.select(*results.columns, "valid", "severity", "reason", "replacement", "warning", "current_text")


def interprets(query: Column) -> Column:
    return holds(F.lower(query), INTERPRETING)


def relevance(results: DataFrame, queries: DataFrame) -> DataFrame:
    """results with relevance: shared tokens and what else speaks for a result; at most 1."""
    q = queries.select("query_id", "query", "query_type", "practice_area", "jurisdiction", tokens(F.col("query")).alias("asked"), reference_numbers(F.col("sections"), F.col("equivalents")).alias("numbers"), named_cases(F.col("entities")).alias("cases"))
    r = results.withColumn("whole", result_text()).join(q, "query_id")
    yes = lambda c: F.coalesce(c, F.lit(False))
    bonus = lambda c, x: F.when(yes(c), x).otherwise(0.0)
    case = F.col("doc_type") == "judgment"
    specific = F.col("query_type") == "case_specific"
    score = (
        0.35 * overlap(F.col("asked"), tokens(F.col("whole")))
        + bonus(F.array_contains("numbers", F.upper("section")), 0.25)
        + bonus(F.exists("cases", lambda c: F.contains(F.lower("whole"), c)), 0.25)
        + F.when((F.col("query_type") == "statutory_lookup") & F.col("doc_type").isin(*LAW), 0.20).when(specific & case, 0.15).otherwise(0.0)
        + F.when(case & specific, 0.10).when(case & interprets(F.col("query")), 0.18).otherwise(0.0)
        + bonus(F.array_contains("practice_areas", F.col("practice_area")), 0.05)
        + bonus((F.col("court") != "") & (F.col("court") == F.col("jurisdiction")), 0.05)
        + bonus(F.col("authority") == "binding", 0.05)
    )
    return r.withColumn("relevance", F.least(score, F.lit(1.0))).select(*results.columns, "relevance")


def entity_coverage(texts: Column, entities: Column) -> Column:
    """Share of entities that the results' texts hold; a section and an article also by number. 1 without entities."""

    def found(e: Column) -> Column:
        number = F.when(e["kind"] == "SECTION", F.lower(F.substring_index(e["text"], " ", -1))).when(e["kind"] == "ARTICLE", F.lower(F.replace(e["text"], F.lit("Article "), F.lit(""))))
        return F.contains(texts, F.lower(e["text"])) | F.coalesce(F.contains(texts, number), F.lit(False))

    return F.when(F.size(entities) == 0, 1.0).otherwise(F.size(F.filter(entities, found)) / F.greatest(F.size(entities), F.lit(1)))


def assessed(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: n_results, relevance, entities, coverage, score, action, warning, by the results that are valid (found: results with valid and warning)."""
    kept = relevance(found.where("valid"), queries).withColumn("whole", F.lower(result_text()))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "whole"))), lambda x: x["whole"]), " ")
    per = kept.groupBy("query_id").agg(F.count("*").alias("n_results"), F.avg("relevance").alias("relevance"), texts.alias("texts"), F.bool_or(F.col("doc_type").isin(*LAW)).alias("has_law"), F.bool_or(F.col("doc_type") == "judgment").alias("has_case"))
    warned = found.where("warning is not null").groupBy("query_id").agg(F.min(F.struct("rank", "chunk_id", "warning")).warning.alias("warning"))
    a = queries.join(per, "query_id", "left").join(warned, "query_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    a = a.withColumn("relevance", F.coalesce("relevance", F.lit(0.0))).withColumn("entity_coverage", entity_coverage(F.coalesce("texts", F.lit("")), F.col("entities")))
    flag = lambda c: F.coalesce(c, F.lit(False))
    cover = coverage(F.col("query_type"), F.col("n_results"), flag("has_law"), flag("has_case"), interprets(F.col("query")), F.size("entities"))
    score, action = corrective_action(F.col("relevance"), F.col("entity_coverage"), cover, F.col("n_results"))
    a = a.withColumn("coverage", cover).withColumn("score", score).withColumn("action", action)
    return a.select("query_id", "n_results", "relevance", "entity_coverage", "coverage", "score", "action", F.when(F.col("action") == "INSUFFICIENT", F.lit(NO_ANSWER)).otherwise(F.col("warning")).alias("warning"))


def decomposed(queries: DataFrame) -> DataFrame:
    """(query_id, part, refined): what to ask in place of a query: what its first reference says and how it was read, what was held in each case, else its halves at `and`."""
    first = F.coalesce(F.try_element_at("equivalents", F.lit(1)), F.try_element_at("sections", F.lit(1)))
    law = F.when((F.col("query_type") == "statutory_lookup") & first.isNotNull(), F.array(F.concat(F.lit("What does "), first, F.lit(" say?")), F.concat(F.lit("How have courts interpreted "), first, F.lit("?"))))
    cases = F.filter("entities", lambda e: e["kind"] == "CASE_NAME")
    held = F.when((F.col("query_type") == "case_specific") & (F.size(cases) > 0), F.transform(cases, lambda e: F.concat(F.lit("What was held in "), e["text"], F.lit("?"))))
    halves = F.filter(F.transform(F.split("query", " and "), lambda p: F.regexp_replace(F.trim(p), r"\?+$", "")), lambda p: p != "")
    both = F.when(F.contains(F.lower("query"), F.lit(" and ")), halves).otherwise(F.array().cast("array<string>"))
    asked = F.array_distinct(F.transform(F.coalesce(law, held, both), squeeze))
    return queries.select("query_id", F.posexplode(asked).alias("part", "refined"))


def corrected(
    queries: DataFrame, validity: Callable[[DataFrame, DataFrame], DataFrame], retrieve: Callable[[DataFrame], DataFrame], analyse: Callable[[DataFrame], DataFrame], supplement: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Retrieval with correction: (results that hold, assessment of every query).

    retrieve(queries) gives results, validity(results, queries) adds temporal findings, analyse(refined: query_id, query, reference_date)
    makes queries of the refined ones, supplement(queries) gives rows (query_id, ..) from elsewhere. Queries of middling score are taken apart and retrieved
    anew, a chunk found by several parts once, as the last has it; their new results are assessed for the query as a whole.
    """
    found = stored(validity(retrieve(queries), queries))
    first = stored(assessed(found, queries))
    again = decomposed(queries.join(first.where("action = 'REFINED'").select("query_id"), "query_id", "left_semi"))
    again = stored(again.join(queries.select("query_id", "reference_date"), "query_id").withColumn("sub_id", F.xxhash64("query_id", "part")))
    sub = analyse(again.select(F.col("sub_id").alias("query_id"), F.col("refined").alias("query"), "reference_date"))
    parts = retrieve(sub).withColumnRenamed("query_id", "sub_id").join(again.select("sub_id", "query_id", "part"), "sub_id")
    names = [c for c in parts.columns if c not in ("sub_id", "query_id", "part", "chunk_id")]
    merged = parts.groupBy("query_id", "chunk_id").agg(F.max_by(F.struct(*names), F.struct("part", -F.col("rank"))).alias("r")).select("query_id", "chunk_id", *[F.col(f"r.{c}").alias(c) for c in names])
    refined = queries.join(again.select("query_id").distinct(), "query_id", "left_semi")
    second = stored(validity(merged, refined))
    anew = assessed(second, refined).withColumn("action", F.lit("REFINED"))
    out = first.join(anew.select("query_id"), "query_id", "left_anti").unionByName(anew)
    results = found.where("valid").join(refined.select("query_id"), "query_id", "left_anti").unionByName(second.where("valid"), allowMissingColumns=True)
    if supplement is not None:
        helped = supplement(queries.join(out.where("action = 'INSUFFICIENT'").select("query_id"), "query_id", "left_semi")).select("query_id").distinct().withColumn("helped", F.lit(True))
        note = F.lit("Limited corpus coverage; supplemental web sources attached.")
        out = out.join(helped, "query_id", "left").withColumn("warning", F.when(F.col("helped"), note).otherwise(F.col("warning"))).withColumn("action", F.when(F.col("helped"), "WEB_SUPPLEMENTED").otherwise(F.col("action"))).drop("helped")
    return results, out
