"""Citations: placeholders found in the corpus, how a source is cited, sources and sections looked up.

documents: doc_id, doc_type, court, date, citation, appellant, respondent, practice_areas, current_validity, body. chunks: doc_id, chunk_id, chunk_index,
chunk_text, header, act, section, in_force, chunk_validity, chunk_citation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap, tokens
from ..tables import stored
from .similarity import alike, containing, frequencies, rarest_first, sharing
from .verify import LAW_TYPES, section_tokens, statute_match

# Words that tell nothing of an authority, thresholds, how much of a judgment's text is looked at.
GENERIC = ["authority", "binding", "court", "current", "development", "doctrinal", "fallback", "foundational", "high", "interpreting", "issue", "key", "on", "primary", "stage", "supreme", "the"]
STATUTE_LEAST, CITE_LEAST = 0.85, 0.80
LEAD = 220
DIRECT, SEARCHED = "Resolved directly from retrieved corpus context.", "Resolved from canonical corpus search."
MISSING, UNSUPPORTED = "Specific primary authority could not be located in the corpus.", "Legal proposition remains unsupported and requires primary-source verification."


def placeholder_kind(doc_type: Column) -> Column:
    return F.when(doc_type.isin(*LAW_TYPES), "STATUTE").otherwise("CITE")


def cite_tokens(text: Column) -> Column:
    return F.array_except(tokens(F.lower(text)), F.array(*map(F.lit, GENERIC)))


def cite_match(asked: Column, description: Column, own: Column, court: Column, areas: Column, header: Column) -> Column:
    """Shared tokens, 0.25 for the kind of court, 0.15 for a practice area that is named, 0.10 if the heading has most tokens; at most 1."""
    d, c = F.lower(description), F.lower(F.coalesce(court, F.lit("")))
    both = lambda w: F.contains(d, F.lit(w)) & F.contains(c, F.lit(w))
    s = overlap(asked, own)
    for kind in ("supreme court", "high court"):
        s = s + F.when(both(kind), 0.25).otherwise(0.0)
    s = s + F.when(F.coalesce(F.exists(areas, lambda a: F.contains(d, F.lower(a))), F.lit(False)), 0.15).otherwise(0.0)
    s = s + F.when(overlap(asked, tokens(F.lower(F.coalesce(header, F.lit(""))))) > 0.5, 0.10).otherwise(0.0)
    return F.least(s, F.lit(1.0))


def case_name(appellant: Column, respondent: Column) -> Column:
    return F.when((appellant != "") & (respondent != ""), F.concat_ws(" v ", appellant, respondent))


def _filled(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def rendered_value(kind: Column) -> Column:
    """How a source is written in an answer, by its kind, from the columns of documents and chunks."""
    act = F.coalesce(_filled("act"), _filled("court"), F.lit("Unknown Act"))
    law = F.when(F.col("section").isNotNull(), F.concat_ws(", Section ", act, "section")).otherwise(F.coalesce(_filled("header"), act))
    name, cite = case_name(F.col("appellant"), F.col("respondent")), F.coalesce(_filled("citation"), _filled("chunk_citation"))
    case = F.coalesce(F.when(name.isNotNull() & cite.isNotNull(), F.concat_ws(", ", name, cite)), cite, name, _filled("court"), F.lit("Verified authority"))
    return F.when(kind == "STATUTE", law).otherwise(case)


def canonical_citation(kind: Column) -> Column:
    act = F.coalesce(_filled("act"), _filled("court"))
    law = F.when(act.isNotNull() & (F.col("section") != ""), F.concat_ws(", Section ", act, "section")).when(F.col("chunk_id").isNotNull(), F.coalesce(act, "header"))
    return F.when(kind == "STATUTE", law).otherwise(F.coalesce(_filled("citation"), F.col("chunk_citation")))


def source_title() -> Column:
    name = F.when(F.col("doc_type") == "judgment", case_name(F.col("appellant"), F.col("respondent")))
    section = F.when((F.col("act") != "") & (F.col("section") != ""), F.concat_ws(", Section ", "act", "section"))
    return F.coalesce(name, section, _filled("header"), _filled("citation"), _filled("court"), F.col("doc_type"))


def chosen_chunks(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests (.., doc_id, chunk_id) with chunk_id resolved and found: the chunk asked for if it is the document's, without one the document's first; found is false for a chunk of another document."""
    first = chunks.groupBy("doc_id").agg(F.min(F.struct("chunk_index", "chunk_id")).chunk_id.alias("first"))
    own = chunks.select("doc_id", F.col("chunk_id").alias("asked"), F.lit(True).alias("own"))
    r = requests.withColumnRenamed("chunk_id", "asked").join(first, "doc_id", "left").join(own, ["doc_id", "asked"], "left")
    found = F.col("asked").isNull() | F.coalesce("own", F.lit(False))
    return r.withColumn("found", found).withColumn("chunk_id", F.when(F.col("asked").isNull(), F.col("first")).when(F.col("own"), F.col("asked"))).drop("asked", "first", "own")


def sources(requests: DataFrame, documents: DataFrame, chunks: DataFrame, validated: DataFrame) -> DataFrame:
    """requests (request_id, doc_id, chunk_id) of known documents with their citation, and with what is to be used in their place: its citation, title and passage.

    validated: citation_id (the request's), use_doc_id, status, severity, warning, path from appeals.validated_citations.
    """
    r = chosen_chunks(requests, chunks).join(documents.select("doc_id"), "doc_id", "left_semi").where("found").drop("found")
    kind = placeholder_kind(F.col("doc_type"))
    own = r.join(documents, "doc_id").join(chunks.drop("doc_id"), "chunk_id", "left")
    own = own.select("request_id", "doc_id", "chunk_id", rendered_value(kind).alias("citation"), kind.alias("kind"))
    v = validated.select(F.col("citation_id").alias("request_id"), "use_doc_id", "status", "severity", "warning", "path")
    own = own.join(v, "request_id", "left").withColumn("effective_doc_id", F.coalesce("use_doc_id", "doc_id"))
    first = chunks.groupBy(F.col("doc_id").alias("use_doc_id")).agg(F.min(F.struct("chunk_index", "chunk_id")).chunk_id.alias("use_chunk"))
    own = own.join(first, "use_doc_id", "left").withColumn("effective_chunk_id", F.when(F.col("use_doc_id").isNull(), F.col("chunk_id")).otherwise(F.col("use_chunk")))
    kept = own.select("request_id", "kind", F.col("doc_id").alias("asked_doc_id"), F.col("chunk_id").alias("asked_chunk_id"), F.col("citation").alias("asked_citation"), F.col("effective_doc_id").alias("doc_id"), F.col("effective_chunk_id").alias("chunk_id"), "status", "severity", "warning", "path")
    e = kept.join(documents, "doc_id").join(chunks.drop("doc_id"), "chunk_id", "left")
    return e.select(
        "request_id", F.col("asked_doc_id").alias("doc_id"), F.col("doc_id").alias("effective_doc_id"), F.col("asked_chunk_id").alias("chunk_id"), F.col("chunk_id").alias("effective_chunk_id"), F.col("asked_citation").alias("citation"),
        rendered_value(F.col("kind")).alias("effective_citation"), source_title().alias("title"), "doc_type", "court", "date", "section", "current_validity", "in_force", F.coalesce(_filled("chunk_text"), F.col("body")).alias("passage"), "status", "severity", "warning", "path",
    )


def judgments(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """The judgments asked for; documents of other kinds are no answer."""
    return requests.select("doc_id").distinct().join(documents.where("doc_type = 'judgment'"), "doc_id")


def sections_found(requests: DataFrame, statutes: DataFrame, sections: DataFrame) -> DataFrame:
    """requests (act_id, section) with the act's name and the section's text, and what is missing: `statute`, `section`, or null."""
    r = requests.join(statutes.select(F.col("doc_id").alias("act_id"), "act_name"), "act_id", "left").join(sections.select(F.col("doc_id").alias("act_id"), "section", "section_text"), ["act_id", "section"], "left")
    return r.withColumn("missing", F.when(F.col("act_name").isNull(), "statute").when(F.col("section_text").isNull(), "section"))


def _best(met: DataFrame, score: Column) -> DataFrame:
    scored = met.withColumn("score", F.round(score, 6))
    return scored.groupBy("description").agg(F.min(F.struct((-F.col("score")).alias("worst"), "chunk_id", "doc_id")).alias("b")).select("description", (-F.col("b.worst")).alias("score"), "b.doc_id", "b.chunk_id")


def resolved_placeholders(placeholders: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """placeholders (placeholder_id, kind, description, doc_id, chunk_id) with status, rendered value, citation, doc_id, chunk_id, confidence, message.

    The source a placeholder came with holds if it is good law and in force. Else good law is searched: sections for statutes, judgments for citations;
    candidates meet a placeholder by the rare ones of the tokens of which they need some to reach the threshold, or by act and number; a common token meets nothing. Of equal scores the smallest chunk_id,
    so chunks that hold the same of all that is asked, and whatever else a score is made of, are one candidate.
    """
    good = documents.where("current_validity = 'GOOD_LAW'")
    p = placeholders.withColumnRenamed("doc_id", "given_doc").withColumnRenamed("chunk_id", "given_chunk")
    of_chunk = chunks.select(F.col("chunk_id").alias("given_chunk"), "chunk_validity", "in_force", F.lit(True).alias("has_chunk"))
    direct = p.where("kind <> 'UNSUPPORTED'").join(good.select(F.col("doc_id").alias("given_doc")), "given_doc", "left_semi").join(of_chunk, "given_chunk", "left")
    bad = F.coalesce(F.col("has_chunk"), F.lit(False)) & ((F.col("chunk_validity") != "GOOD_LAW") | ((F.col("kind") == "STATUTE") & F.coalesce(~F.col("in_force"), F.lit(False))))
    direct = direct.where(~bad).select("placeholder_id", F.lit(1.0).alias("score"), F.col("given_doc").alias("doc_id"), F.when(F.col("has_chunk"), F.col("given_chunk")).alias("chunk_id"), F.lit(DIRECT).alias("message"))
    rest = p.join(direct.select("placeholder_id"), "placeholder_id", "left_anti")
    pool = chunks.join(good.select("doc_id", "doc_type", "court", "practice_areas"), "doc_id")

    part = lambda c: F.when(c != "", c)

    def asked_of(kind: str, tokens_of: Callable[[Column], Column], candidates: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The placeholders of a kind; their descriptions, each once however many have it, with what is asked and the rarest of it first; and the candidates that differ for these."""
        own = rest.where(F.col("kind") == kind).select("placeholder_id", "description")
        asked = stored(own.select("description").distinct().withColumn("asked", tokens_of(F.col("description"))))
        some = alike(candidates.select(F.struct("chunk_id", "doc_id").alias("at"), "own", *by), asked, "at", by).select("at.*", "own", *by)
        return own, stored(asked.join(rarest_first(asked, frequencies(some), "description"), "description")), some

    def best(own: DataFrame, asked: DataFrame, pairs: DataFrame, candidates: DataFrame, score: Column, least: float) -> DataFrame:
        found = _best(pairs.distinct().join(asked.drop("rare"), "description").join(candidates, "chunk_id"), score)
        return own.join(found.where(F.col("score") >= least), "description").drop("description")

    # sections: what the act's name, the number and the constitution can add decides how many words must be shared at least
    law = pool.where(F.col("doc_type").isin(*LAW_TYPES) & F.coalesce("in_force", F.lit(True))).withColumn("own", section_tokens(F.col("act"), F.col("section"), F.col("header"), F.col("chunk_text")))
    own, asked, law = asked_of("STATUTE", lambda d: tokens(F.lower(d)), law, ("act", "section", "doc_type"))
    keyed = law.select("chunk_id", "own", F.lower("act").alias("act"), F.lower("section").alias("number"))
    low = asked.select("description", F.lower("description").alias("text"))
    acts = containing(low, keyed.select("act"), "text", "act").join(low, "text").select("description", "act")
    longest = keyed.agg(F.max(F.char_length("number"))).first()[0] or 1
    # a number may stand before further characters: all beginnings of what follows `section ` are looked up
    after = F.transform(F.slice(F.split("text", "section "), 2, 1_000_000), lambda t: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.substr(t, F.lit(1), n)))
    numbers = low.select("description", F.explode(F.array_distinct(F.flatten(after))).alias("number")).where("number <> ''")
    named = acts.join(numbers, "description").join(keyed.select("chunk_id", "act", "number"), ["act", "number"]).select("description", "chunk_id")
    by_number = sharing(asked.join(numbers, "description"), keyed, "description", "chunk_id", F.lit(STATUTE_LEAST - 0.45 - 0.15), ("number",))
    by_words = sharing(asked, keyed, "description", "chunk_id", F.lit(STATUTE_LEAST - 0.35 - 0.15))
    laws = best(own, asked, named.unionByName(by_number).unionByName(by_words), law, statute_match(F.col("asked"), F.col("description"), F.col("act"), F.col("section"), F.col("own"), F.col("doc_type")), STATUTE_LEAST)

    # judgments: court, practice area and heading add at most a half
    whole = F.concat_ws(" ", part(F.col("court")), part(F.col("header")), part(F.array_join("practice_areas", " ")), part(F.substr("chunk_text", F.lit(1), F.lit(LEAD))))
    own, asked, case = asked_of("CITE", cite_tokens, pool.where("doc_type = 'judgment'").withColumn("own", tokens(F.lower(whole))), ("court", "practice_areas", "header"))
    pairs = sharing(asked, case, "description", "chunk_id", F.lit(CITE_LEAST - 0.25 - 0.15 - 0.10))
    cases = best(own, asked, pairs, case, cite_match(F.col("asked"), F.col("description"), F.col("own"), F.col("court"), F.col("practice_areas"), F.col("header")), CITE_LEAST)
    found = direct.unionByName(laws.unionByName(cases).withColumn("message", F.lit(SEARCHED)))
    out = placeholders.select("placeholder_id", "kind", "description").join(found, "placeholder_id", "left").join(documents.drop("body"), "doc_id", "left").join(chunks.drop("doc_id", "chunk_text"), "chunk_id", "left")
    seen = F.col("score").isNotNull()
    return out.select(
        "placeholder_id", F.when(seen, "VERIFIED").otherwise("UNVERIFIED").alias("status"), F.when(seen, rendered_value(F.col("kind"))).otherwise(F.concat(F.lit("[UNVERIFIED: "), F.col("description"), F.lit("]"))).alias("rendered"),
        F.when(seen, canonical_citation(F.col("kind"))).alias("citation"), "doc_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("confidence"), F.when(seen, F.col("message")).when(F.col("kind") == "UNSUPPORTED", UNSUPPORTED).otherwise(F.lit(MISSING)).alias("message"),
    )
