"""Authorities of a case: the section that a charge refers to, and precedents for its stage and court.

cases: case_id, references (codes with a section, equivalents first), statutory (a finding), precedent (a finding), query, stage, court. laws: chunk_id, doc_id, act, section,
header, chunk_text of good law; judgments: chunk_id, doc_id, citation, appellant, respondent, court, header, chunk_text, binding (array of courts) of good law. Of equal scores the smallest chunk_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from .similarity import alike, containing, frequencies, rarest_first, sharing

# Names of acts by code, words of a stage, scores.
CODE_NAMES = {
    "IPC": ["ipc", "indian penal code"],
    "CRPC": ["crpc", "code of criminal procedure"],
    "BNS": ["bns", "bharatiya nyaya sanhita"],
    "BNSS": ["bnss", "bharatiya nagarik suraksha sanhita"],
    "BSA": ["bsa", "bharatiya sakshya adhiniyam"],
    "ARTICLE": ["article", "constitution"],
}
STAGE_WORDS = {"bail": ["bail", "anticipatory", "custody", "liberty"], "appeal": ["appeal", "reversal", "sentence"], "trial": ["trial", "evidence", "charge"]}
SAME_SECTION, SAME_ACT, MOST_OVERLAP, LAW_LEAST = 0.8, 0.75, 0.4, 1.0
BAIL_WORDS, APEX, OWN_COURT, ALL_INDIA, CASE_LEAST = 0.35, 0.3, 0.2, 0.1, 0.2
LAW_LEAD, CASE_LEAD, KEPT = 240, 320, 2
LAW_SAID, CASE_SAID = "Resolved from uploaded-case statutory grounding.", "Resolved from uploaded-case precedent grounding."
#: Of each query so many of its rarest words find the first precedents; what these reach bounds the search.
FIRST_WORDS = 3


def words(*parts: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *[F.when(p != "", p) for p in parts])), F.lit("[a-z0-9]+"), F.lit(0)))


def share(asked: Column, own: Column) -> Column:
    return F.when((F.size(asked) == 0) | (F.size(own) == 0), 0.0).otherwise(F.size(F.array_intersect(asked, own)) / F.size(asked))


def reference_parts(reference: Column) -> tuple[Column, Column]:
    """Code and section: the first and the last word in capitals; null of a single word."""
    parts = F.filter(F.split(F.trim(F.upper(reference)), r"\s+"), lambda w: w != "")
    two = F.size(parts) >= 2
    return F.when(two, F.element_at(parts, 1)), F.when(two, F.element_at(parts, -1))


def acts_of_codes(codes: DataFrame, acts: DataFrame) -> DataFrame:
    """(code, act): acts (act) whose lower-case name holds one of the code's names."""
    known = F.create_map(*[x for k, v in CODE_NAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    named = codes.select("code", F.explode(F.coalesce(F.try_element_at(known, F.col("code")), F.array(F.lower("code")))).alias("name")).distinct()
    lower = acts.select("act", F.lower("act").alias("lower")).where("act is not null").distinct()
    return named.join(containing(lower, named, "lower", "name"), "name").join(lower, "lower").select("code", "act").distinct()


def law_label(act: Column, section: Column, header: Column, chunk_id: Column) -> Column:
    parts = F.filter(F.split(act, r"\s+"), lambda w: w != "")
    both = (act != "") & (section != "")
    return F.when(both, F.concat_ws(" ", F.array_join(F.slice(parts, F.lit(1), F.least(F.size(parts), F.lit(2))), " "), section)).otherwise(F.coalesce(F.when(act != "", act), F.when(header != "", header), chunk_id.cast("string")))


def statute_authorities(cases: DataFrame, laws: DataFrame) -> DataFrame:
    """case_id, rank, doc_id, chunk_id, label, citation, passage, message: the best section of each reference, in the order of references, two at most a case.

    A section scores by its number, its act and shared words, of which 0.4 counts at most; below 1.0 nothing is an authority, so number or act must agree.
    Where both do, nothing else can be better; else it takes a fifth or a quarter of the query's words, and candidates are met by rare ones. Sections of one number and act that
    hold the same of the queries' words are one candidate, the smallest chunk_id.
    """
    asked = cases.select("case_id", F.posexplode("references").alias("position", "reference"), "statutory").where("reference is not null")
    code, section = reference_parts(F.col("reference"))
    asked = asked.withColumn("query", F.concat_ws(" ", "reference", F.coalesce("statutory", F.lit("")))).withColumns({"code": code, "section": section})
    q = stored(asked.where("code is not null").select("query", "code", "section").distinct().withColumn("asked", words(F.col("query"))))
    own = words(F.col("act"), F.col("section"), F.col("header"), F.substr("chunk_text", F.lit(1), F.lit(LAW_LEAD)))
    c = alike(laws.select("chunk_id", "act", F.upper("section").alias("section"), own.alias("own")), q, "chunk_id", ("act", "section"))
    ways = acts_of_codes(q.select("code").distinct(), c.select("act").distinct())
    q = stored(q.join(rarest_first(q, frequencies(c), "query"), "query", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>"))))

    def scored(pairs: DataFrame) -> DataFrame:
        """query, chunk_id, score of candidates (query, chunk_id) and the best of each query."""
        rows = pairs.join(q.select("query", "code", F.col("section").alias("wanted"), "asked"), "query").join(c, "chunk_id")
        rows = rows.join(ways.withColumn("fits", F.lit(True)), ["code", "act"], "left")
        score = F.when(F.col("section") == F.col("wanted"), SAME_SECTION).otherwise(0.0) + F.when(F.col("fits"), SAME_ACT).otherwise(0.0) + F.least(share(F.col("asked"), F.col("own")), F.lit(MOST_OVERLAP))
        rows = rows.withColumn("score", F.round(score, 9)).where(F.col("score") >= LAW_LEAST)
        return rows.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("worst"), "chunk_id")).alias("b")).select("query", "b.chunk_id")

    both = q.select("query", "code", "section").join(ways, "code").join(c.select("chunk_id", "act", "section"), ["act", "section"])
    best = stored(scored(both.select("query", "chunk_id").distinct()))
    rest = q.join(best.select("query"), "query", "left_anti")
    by_section = sharing(rest, c, "query", "chunk_id", F.lit(LAW_LEAST - SAME_SECTION), ("section",))
    of_act = rest.join(ways, "code").select("query", "act", "asked", "rare")
    by_act = sharing(of_act, c, "query", "chunk_id", F.lit(LAW_LEAST - SAME_ACT), ("act",))
    best = best.unionByName(scored(by_section.unionByName(by_act).distinct()))
    label = law_label(F.col("act"), F.col("section"), F.col("header"), F.col("chunk_id"))
    cited = F.when((F.col("act") != "") & (F.col("section") != ""), F.concat_ws(", Section ", "act", "section")).otherwise(F.col("header"))
    # authorities of distinct queries, which meet cases where these are read
    named = stored(best.join(laws, "chunk_id").select("query", "doc_id", "chunk_id", label.alias("label"), cited.alias("citation"), F.col("chunk_text").alias("passage")))
    return first_ones(asked.join(named, "query").select("case_id", "position", "doc_id", "chunk_id", "label", "citation", "passage", F.lit(LAW_SAID).alias("message")))


def first_ones(found: DataFrame, limit: int = KEPT) -> DataFrame:
    """found (case_id, position, doc_id, chunk_id, ..), each chunk where it stands first, the first of a case with their rank."""
    once = found.repartition("case_id").withColumn("_n", F.row_number().over(Window.partitionBy("case_id", "doc_id", "chunk_id").orderBy("position"))).where("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("position"))).where(F.col("rank") <= limit).drop("position")


def judgment_label(appellant: Column, respondent: Column, citation: Column, doc_id: Column) -> Column:
    return F.when((appellant != "") & (respondent != ""), F.concat_ws(" v ", appellant, respondent)).otherwise(F.coalesce(F.when(citation != "", citation), doc_id.cast("string")))


def precedent_authorities(cases: DataFrame, judgments: DataFrame) -> DataFrame:
    """case_id, rank, score, doc_id, chunk_id, label, citation, passage, message: the two best precedents of a case of a score of 0.2 and more.

    A precedent's score is the share of the query's words that it has, and what court and stage add. Its part without words takes few values, by which
    precedents fall into classes. The two best of the highest classes and what a query's rarest words find give a score that the second place has at least; a further
    precedent of a class needs so many words that it reaches it, and is met by the rare ones among them. Of precedents that courts bind alike and that hold the same of the queries'
    words, the two smallest chunk_ids are candidates.
    """
    stage = F.lower(F.coalesce("stage", F.lit("")))
    extra = F.create_map(*[x for k, v in STAGE_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    q = cases.select("case_id", stage.alias("stage"), F.coalesce("court", F.lit("")).alias("court"), F.array_sort(F.array_union(words(F.col("query"), F.col("precedent"), F.col("stage"), F.col("court")), F.coalesce(F.try_element_at(extra, stage), none))).alias("asked"))
    q = stored(q.withColumn("query", F.sha2(F.concat_ws("|", F.array_join("asked", " "), "stage", "court"), 256)))
    label = judgment_label(F.col("appellant"), F.col("respondent"), F.col("citation"), F.col("doc_id"))
    own = words(F.col("citation"), label, F.col("header"), F.substr("chunk_text", F.lit(1), F.lit(CASE_LEAD)), F.col("court"))
    c = judgments.select("chunk_id", own.alias("own"), F.startswith(F.lower(F.coalesce("court", F.lit(""))), F.lit("supreme court")).alias("apex"), F.coalesce("binding", none).alias("binding"))
    c = c.withColumn("bail", F.arrays_overlap("own", F.array(*map(F.lit, STAGE_WORDS["bail"]))))
    asking = stored(q.select("query", "asked", "stage", "court").distinct())
    c = alike(c, asking, "chunk_id", ("apex", "binding", "bail"), KEPT)
    # a candidate's classes: what each can add at most for a query that asks for the class
    of_court = F.explode(F.when(F.col("apex"), F.array(F.lit("apex"))).otherwise(F.array_union(F.array(F.lit("any")), F.transform("binding", lambda b: F.concat(F.lit("court:"), b)))))
    classed = stored(c.withColumn("class", of_court))
    ways = [F.struct(F.lit("apex").alias("class"), F.lit(APEX).alias("adds")), F.struct(F.lit("court:All India").alias("class"), F.lit(ALL_INDIA).alias("adds")), F.struct(F.lit("any").alias("class"), F.lit(0.0).alias("adds"))]
    own_court = F.when(F.col("court") != "", F.array(F.struct(F.concat(F.lit("court:"), F.col("court")).alias("class"), F.lit(OWN_COURT).alias("adds"))))
    ways = F.concat(F.array(*ways), F.coalesce(own_court, F.array().cast("array<struct<class:string,adds:double>>")))
    asking = stored(asking.join(rarest_first(asking, frequencies(c), "query"), "query", "left").withColumn("rare", F.coalesce("rare", none)).withColumn("ways", ways))

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.distinct().join(asking.select("query", "asked", "stage", "court"), "query").join(c, "chunk_id")
        court = F.when(F.col("apex"), APEX).when((F.col("court") != "") & F.array_contains("binding", F.col("court")), OWN_COURT).when(F.array_contains("binding", "All India"), ALL_INDIA).otherwise(0.0)
        score = share(F.col("asked"), F.col("own")) + F.when((F.col("stage") == "bail") & F.col("bail"), BAIL_WORDS).otherwise(0.0) + court
        return rows.select("query", "chunk_id", F.round(score, 9).alias("score")).where(F.col("score") >= CASE_LEAST)

    # two of each class and kind are enough where no word is shared
    first = classed.withColumn("n", F.row_number().over(Window.partitionBy("class", "bail").orderBy("chunk_id"))).where(F.col("n") <= KEPT)
    classes = stored(asking.select("query", F.explode("ways").alias("w")).select("query", "w.class"))
    by_word = asking.select("query", F.explode(F.slice("rare", 1, FIRST_WORDS)).alias("token")).join(c.select("chunk_id", F.explode("own").alias("token")), "token")
    early = stored(scored(classes.join(first.select("class", "chunk_id"), "class").select("query", "chunk_id").unionByName(by_word.select("query", "chunk_id"))))
    least = early.groupBy("query").agg(F.try_element_at(F.reverse(F.array_sort(F.collect_list("score"))), F.lit(KEPT)).alias("least"))
    bound = asking.join(least, "query", "left").withColumn("least", F.greatest(F.coalesce("least", F.lit(0.0)), F.lit(CASE_LEAST)))
    bail = F.explode(F.when(F.col("stage") == "bail", F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    wide = bound.withColumn("w", F.explode("ways")).withColumn("counts", bail).select("query", "asked", "rare", "w.class", "counts", (F.col("least") - F.col("w.adds") - F.when(F.col("counts"), BAIL_WORDS).otherwise(0.0)).alias("share"))
    kinds = classed.withColumn("counts", F.explode(F.when(F.col("bail"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    later = scored(sharing(wide, kinds, "query", "chunk_id", F.col("share"), ("class", "counts")))
    every = early.unionByName(later).distinct()
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= KEPT)
    named = stored(best.join(judgments.select("chunk_id", "doc_id", label.alias("label"), "citation", F.col("chunk_text").alias("passage")), "chunk_id"))
    found = q.select("case_id", "query").join(named, "query")
    return found.select("case_id", "rank", "score", "doc_id", "chunk_id", "label", "citation", "passage", F.lit(CASE_SAID).alias("message"))


# Why a claim of a case's answer is made.
REASONS = {
    "position": "Synthesized from uploaded documents, stage-specific planning, and contradiction review.",
    "contradiction": "The contradiction checker flagged a procedural caution that should be addressed in submissions.",
    "law": "Derived from uploaded-document statutory analysis and criminal-code mapping.",
    "case": "Derived from agentic precedent research aligned to the uploaded court context and stage.",
}


def overall_status(ratio: Column, issues: Column) -> Column:
    return F.when((ratio >= 0.95) & (issues == 0), "VERIFIED").when(ratio >= 0.75, "UNCERTAIN").otherwise("UNVERIFIED")


def grounded_status(preferred: Column, found: Column, fallback: Column | None = None) -> Column:
    """What is found makes an unverified claim uncertain; without it, the fallback, else nothing is verified."""
    without = F.when(preferred == "VERIFIED", "UNVERIFIED").otherwise(preferred)
    return F.when(found, F.when(preferred == "UNVERIFIED", "UNCERTAIN").otherwise(preferred)).otherwise(without if fallback is None else fallback)


def position_text(synthesis: Column) -> Column:
    """What stands between the first two headings; all of it without the first."""
    head, after = "Legal Position:", "Statutory Findings:"
    at = F.instr(synthesis, head)
    rest = F.substring_index(F.substr(synthesis, at + len(head), F.char_length(synthesis)), after, 1)
    return F.when(at > 0, F.trim(F.regexp_replace(rest, r"\s+", " "))).otherwise(F.trim(synthesis))


def grounded_claims(answers: DataFrame, laws: DataFrame, judgments: DataFrame) -> DataFrame:
    """case_id, section, position, text, status, reason, authorities (array of rank, doc_id, chunk_id, label, citation), citation: the claims of a case's answer with what grounds them.

    answers: case_id, query, stage, court, references, statutory, precedent, contradictions (arrays of findings), synthesis, ratio, issues. Every finding looks for authorities of its own; the legal
    position rests on the first authority of each finding, two at most.
    """
    a = stored(answers)
    finding = lambda c: a.select("case_id", "query", "stage", "court", "references", F.posexplode(c).alias("n", "finding"))
    keyed = lambda df: df.withColumn("case_id", F.struct("case_id", "n"))
    one = F.struct("rank", "doc_id", "chunk_id", "label", "citation")
    listed = lambda found: found.groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("authorities")).select("case_id.case_id", "case_id.n", "authorities")
    law = stored(listed(statute_authorities(keyed(finding("statutory")).withColumnRenamed("finding", "statutory"), laws)))
    case = stored(listed(precedent_authorities(keyed(finding("precedent")).withColumnRenamed("finding", "precedent"), judgments)))
    none = F.expr("array()").cast(law.schema["authorities"].dataType)
    found = F.size("authorities") > 0
    with_found = lambda df, by: df.join(by, ["case_id", "n"], "left").withColumn("authorities", F.coalesce("authorities", none))
    row = lambda section, position, text, status, reason: [F.lit(section).alias("section"), position.alias("position"), text.alias("text"), status.alias("status"), F.lit(REASONS[reason]).alias("reason"), "authorities"]
    laws_ = with_found(finding("statutory"), law).select("case_id", *row("APPLICABLE_LAW", F.col("n") + 1, F.col("finding"), grounded_status(F.lit("VERIFIED"), found), "law"))
    fallback = F.when(F.lower("stage") == "bail", "UNCERTAIN").otherwise("UNVERIFIED")
    cases_ = with_found(finding("precedent"), case).select("case_id", *row("KEY_CASES", F.col("n") + 1, F.col("finding"), grounded_status(F.lit("VERIFIED"), found, fallback), "case"))
    # the first authority of each finding, statutes before cases, each chunk once
    firsts = law.withColumn("turn", F.lit(0)).unionByName(case.withColumn("turn", F.lit(1))).select("case_id", F.struct("turn", "n").alias("position"), F.element_at("authorities", 1).alias("f")).select("case_id", "position", "f.doc_id", "f.chunk_id", "f.label", "f.citation")
    firsts = first_ones(firsts).groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("authorities"))
    p = a.withColumn("text", position_text(F.col("synthesis"))).where("text <> ''").join(firsts, "case_id", "left").withColumn("authorities", F.coalesce("authorities", none))
    p = p.select("case_id", *row("LEGAL_POSITION", F.lit(0), F.col("text"), grounded_status(overall_status(F.col("ratio"), F.col("issues")), found), "position"))
    c = a.select("case_id", F.posexplode("contradictions").alias("n", "finding")).withColumn("authorities", none)
    c = c.select("case_id", *row("LEGAL_POSITION", F.col("n") + 1, F.col("finding"), F.lit("UNCERTAIN"), "contradiction"))
    out = p.unionByName(c).unionByName(laws_).unionByName(cases_)
    cited = F.array_join(F.transform("authorities", lambda x: F.coalesce(x["citation"], x["label"])), "; ")
    return out.withColumn("citation", F.when(found, cited))
