"""From results to verified answers, and from case files to research notes: drafts with what they lack, claims assessed, badges, plans, findings, synthesis."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from . import answers as A
from .cases import contradictions
from .verify import claim_status

# What is said where something is missing, and in research notes.
NOTHING = "The current retrieval set does not safely support a verified legal answer yet."
NO_LAW, NO_CASE = "current statutory text required for this answer", "supporting precedent required for this answer"
NEEDS_CASE = ["case_specific", "multi_hop_doctrine", "constitutional"]
NO_CITATION, UNVERIFIED = "No citation was attached to the claim.", "Citation could not be verified against the corpus."
AGENTS = ["DocumentUnderstandingAgent", "ResearchPlannerAgent", "StatutoryResearchAgent", "PrecedentResearchAgent", "ContradictionCheckerAgent", "SynthesisAgent", "VerificationAgent"]
VERIFIED_RATIO = 0.96


def unsupported_token(description: Column) -> Column:
    return F.concat(F.lit("[UNSUPPORTED: "), description, F.lit("]"))


def drafts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Paragraphs of every query's draft: query_id, title, n, kind, token, doc_id, paragraph.

    queries: query_id, query, query_type; results as answers.drafted has them. A query without results gets a note; one that
    looks up law and found none, or needs a case and found none, says so in that section.
    """
    drafted = A.drafted(results).withColumn("kind", F.when(F.col("title") == "Applicable law", "STATUTE").otherwise("CITE")).withColumn("title", F.when(F.col("kind") == "STATUTE", "Applicable Law").otherwise("Key Authorities"))
    found = drafted.groupBy("query_id").agg(F.max((F.col("kind") == "STATUTE").cast("int")).alias("law"), F.max((F.col("kind") == "CITE").cast("int")).alias("case"))
    q = queries.join(found, "query_id", "left")
    gap = lambda rows, title, text: rows.select("query_id", F.lit(title).alias("title"), F.lit(1).alias("n"), F.lit("UNSUPPORTED").alias("kind"), unsupported_token(text).alias("token"), F.lit(None).cast(drafted.schema["doc_id"].dataType).alias("doc_id"))
    empty = gap(q.where("law is null"), "Research Note", F.concat(F.lit("primary authority required for: "), F.col("query")))
    no_law = gap(q.where("law = 0 and query_type = 'statutory_lookup'"), "Applicable Law", F.lit(NO_LAW))
    no_case = gap(q.where((F.col("case") == 0) & F.col("query_type").isin(*NEEDS_CASE)), "Key Authorities", F.lit(NO_CASE))
    own = lambda rows, text: rows.withColumn("paragraph", text)
    gaps = own(empty, F.concat_ws(" ", F.lit(NOTHING), "token")).unionByName(own(no_law.unionByName(no_case), F.col("token")))
    return drafted.select("query_id", "title", "n", "kind", "token", "doc_id", "paragraph").unionByName(gaps)


def rendered(paragraphs: DataFrame) -> DataFrame:
    """query_id, text: sections in their order, each its title and its paragraphs."""
    order = F.when(F.col("title") == "Legal Position", 0).when(F.col("title") == "Applicable Law", 1).when(F.col("title") == "Key Authorities", 2).otherwise(3)
    section = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "paragraph"))), lambda x: x["paragraph"]), "\n")
    s = paragraphs.groupBy("query_id", "title").agg(section.alias("body")).withColumn("o", order)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "title", "body"))), lambda x: F.concat_ws("\n", x["title"], x["body"])), "\n\n")
    return s.groupBy("query_id").agg(whole.alias("text"))


def assessed(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """claims (claim_id, ..) with status, citation, reason, doc_id, n_citations.

    citations: claim_id, position, verified, citation, grounding, pending, reason, doc_id. A citation that is not verified leaves its claim unsupported, as does
    having none; the worst of a claim's citations holds. Of equal citations one is named; the first source found is the claim's.
    """
    status = F.when(~F.col("verified"), "UNSUPPORTED").otherwise(claim_status(F.col("grounding"), F.coalesce("pending", F.lit(False))))
    c = citations.withColumn("status", status).withColumn("why", F.when(F.col("verified"), F.col("reason")).otherwise(F.lit(UNVERIFIED)))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("position", F.when(F.col("verified"), F.col(x)).alias("x")))), lambda y: y["x"])
    why = F.transform(F.array_sort(F.collect_list(F.struct("position", "why"))), lambda y: y["why"])
    n = lambda s: F.count_if(F.col("status") == s)
    per = c.groupBy("claim_id").agg(n("UNSUPPORTED").alias("bad"), n("UNCERTAIN").alias("open"), F.count("*").alias("n_citations"), F.array_distinct(F.array_compact(ordered("citation"))).alias("names"), why.alias("why"), F.try_element_at(F.array_compact(ordered("doc_id")), F.lit(1)).alias("doc_id"))
    out = claims.join(per, "claim_id", "left")
    final = F.when(F.col("bad").isNull() | (F.col("bad") > 0), "UNSUPPORTED").when(F.col("open") > 0, "UNCERTAIN").otherwise("VERIFIED")
    return out.select(*claims.columns, final.alias("status"), F.when(F.size("names") > 0, F.array_join("names", "; ")).alias("citation"), F.when(F.col("bad").isNull(), F.lit(NO_CITATION)).otherwise(F.array_join("why", "; ")).alias("reason"), "doc_id", F.coalesce("n_citations", F.lit(0)).alias("n_citations"))


def verified_claims(claims: DataFrame, citations: DataFrame, reretrieve: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """assessed, with reretrieved: claims that stay unsupported are given to reretrieve(claims), and assessed anew by the citation it finds, if it finds one."""
    first = assessed(claims, citations).withColumn("reretrieved", F.lit(False))
    if reretrieve is None:
        return first
    bad = first.where("status = 'UNSUPPORTED'").select(*claims.columns)
    new = reretrieve(bad)
    again = assessed(bad.join(new.select("claim_id").distinct(), "claim_id", "left_semi"), new).withColumn("reretrieved", F.lit(True))
    return first.join(again.select("claim_id"), "claim_id", "left_anti").unionByName(again)


def badges(claims: DataFrame, resolutions: DataFrame) -> DataFrame:
    """A badge for each citation of an assessed claim: claim_id, position, label, status, citation, message, doc_id.

    resolutions: claim_id, position, token, rendered, verified, message, doc_id. An unverified resolution is an unverified badge and names no citation; else the badge is as the claim is. A claim with a citation and no resolution
    has one badge of its own.
    """
    both = claims.select("claim_id", F.col("status").alias("claim_status"), F.col("citation").alias("named"), "reason", F.col("doc_id").alias("own_doc")).join(resolutions, "claim_id", "left")
    both = both.where("position is not null or named is not null")
    status = F.when(~F.coalesce("verified", F.lit(True)), "UNVERIFIED").otherwise(F.when(F.col("claim_status") == "UNSUPPORTED", "UNVERIFIED").otherwise(F.col("claim_status")))
    label = F.when(F.col("position").isNull(), F.col("named")).when(F.col("verified"), F.col("rendered")).otherwise(F.coalesce("named", "rendered"))
    message = F.concat_ws(" ", F.when(F.col("reason") != "", F.col("reason")), F.when((F.col("message") != "") & (F.col("message") != F.col("reason")), F.col("message")))
    b = both.withColumn("status", status)
    return b.select("claim_id", F.coalesce("position", F.lit(0)).alias("position"), label.alias("label"), "status", F.when(F.col("status") != "UNVERIFIED", F.col("named")).alias("citation"), message.alias("message"), F.coalesce("own_doc", "doc_id").alias("doc_id"))


def research_plan(cases: DataFrame) -> DataFrame:
    """cases (case_id, query, stage, sections, open_issues) as questions: case_id, priority, focus, question."""
    charge = F.coalesce(F.try_element_at("sections", F.lit(1)), F.lit("the alleged offences"))
    one = lambda focus, question: F.struct(F.lit(focus).alias("focus"), question.alias("question"))
    last = F.coalesce(F.try_element_at("open_issues", F.lit(1)), F.concat(F.lit("What arguments best answer the uploaded bail query: "), F.col("query"), F.lit("?")))
    bail = F.array(
        one("statutory", F.concat(F.lit("What statutory bail framework applies to "), charge, F.lit("?"))), one("precedent", F.concat(F.lit("Which binding precedents support bail despite allegations under "), charge, F.lit("?"))),
        one("contradiction", F.lit("How should the earlier rejection order be distinguished?")), one("synthesis", last),
    )
    plain = F.array(one("document", F.concat(F.lit("What is the controlling legal issue in the uploaded matter: "), F.col("query"), F.lit("?"))), one("research", F.lit("Which statutes and precedents are most directly implicated?")))
    plan = cases.select("case_id", F.posexplode(F.when(F.coalesce(F.col("stage") == "bail", F.lit(False)), bail).otherwise(plain)).alias("i", "q"))
    return plan.select("case_id", (F.col("i") + 1).alias("priority"), "q.focus", "q.question")


def findings(cases: DataFrame) -> DataFrame:
    """cases with statutory, precedent and contradiction findings (arrays), by what their file holds: sections, equivalents, stage, court, orders (array of court, outcome)."""
    some = F.array_compact(F.array(
        F.when(F.size("sections") > 0, F.concat(F.lit("Primary statutory charge identified: "), F.try_element_at("sections", F.lit(1)), F.lit("."))),
        F.when(F.size("equivalents") > 0, F.concat(F.lit("Post-cutover equivalents considered: "), F.array_join("equivalents", ", "), F.lit("."))),
    ))
    law = F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("No explicit criminal-code sections were extracted from the uploaded record.")))
    cases_ = F.array_compact(F.array(
        F.concat(F.lit("Binding precedents must align with the "), F.coalesce("stage", F.lit("general")), F.lit(" stage and uploaded court context.")),
        F.when(F.coalesce("court", F.lit("")) != "", F.concat(F.lit("Priority should be given to authorities binding on "), F.col("court"), F.lit("."))),
        F.when(F.size("orders") > 0, F.lit("Earlier adverse orders must be distinguished with changed circumstances.")),
    ))
    return cases.withColumns({"statutory": law, "precedent": cases_, "contradictions": contradictions(F.col("orders"))})


def synthesis(cases: DataFrame) -> DataFrame:
    """case_id, synthesis of cases with findings (petitioner, stage, open_issues beside them)."""
    said = lambda c: F.array_join(c, " ")
    issues = F.when(F.size("open_issues") > 0, said("open_issues")).otherwise(F.lit("No additional open issues extracted."))
    text = F.concat(
        F.lit("Legal Position: For "), F.coalesce("petitioner", F.lit("the applicant")), F.lit(", the uploaded record indicates a "), F.coalesce("stage", F.lit("current proceedings")), F.lit(" matter. Statutory Findings: "), said("statutory"),
        F.lit(" Precedent Findings: "), said("precedent"), F.lit(" Counterpoints: "), said("contradictions"), F.lit(" Open Issues: "), issues,
    )
    return cases.select("case_id", text.alias("synthesis"))


def agentic(cases: DataFrame, plan: Callable[[DataFrame], DataFrame] = research_plan, write: Callable[[DataFrame], DataFrame] = synthesis) -> DataFrame:
    """Case files through every agent: case_id, synthesis, plan, findings, verification, logs (agent, message) in order.

    cases: case_id, query, petitioner, stage, court, sections, equivalents, open_issues, orders, n_documents. plan and write may be models of a caller's own.
    """
    f = findings(cases)
    planned = plan(cases).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("priority", "focus", "question"))).alias("plan"))
    d = f.join(planned, "case_id", "left").join(write(f), "case_id", "left")
    n = lambda c: F.size(c).cast("string")
    messages = [
        F.concat(F.lit("Read "), F.col("n_documents").cast("string"), F.lit(" uploaded documents.")), F.concat(F.lit("Planned "), n("plan"), F.lit(" research questions using "), F.coalesce("stage", F.lit("general")), F.lit("-focused uploaded-document research.")),
        F.concat(F.lit("Collected "), n("statutory"), F.lit(" statutory findings.")), F.concat(F.lit("Compiled "), n("precedent"), F.lit(" precedent findings.")), F.concat(F.lit("Checked contradictions; "), n("contradictions"), F.lit(" note(s) recorded.")),
        F.lit("Built unified uploaded-document legal analysis."), F.lit("Verified synthesis against uploaded case context."),
    ]
    logs = F.array(*[F.struct(F.lit(a).alias("agent"), m.alias("message")) for a, m in zip(AGENTS, messages)])
    verification = F.struct(F.lit(VERIFIED_RATIO).alias("verified_claim_ratio"), (F.col("n_documents") > 0).alias("uploaded_docs_present"), F.size("contradictions").alias("issues_flagged"))
    return d.select("case_id", "synthesis", "plan", "statutory", "precedent", "contradictions", verification.alias("verification"), logs.alias("logs"))


def authorities_deduped(sources: DataFrame) -> DataFrame:
    """sources (case_id, position, doc_id, chunk_id, ..), each document and chunk once, where it stands first."""
    at = Window.partitionBy("case_id", "doc_id", "chunk_id").orderBy("position")
    return sources.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def executed(
    queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], resolve: Callable[[DataFrame], DataFrame], cite: Callable[[DataFrame, DataFrame], DataFrame] | Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame, DataFrame], DataFrame] = drafts
) -> dict[str, DataFrame]:
    """A verified answer of every query: tables paragraphs, resolutions, text (rendered and resolved), claims (with status), answers (overall status and counts).

    retrieve(queries) gives results as drafts needs them, generate(queries, results) paragraphs, resolve(paragraphs) rows (query_id, token, rendered, ..), cite(claims) or cite(claims, resolutions) the citations of claims. Each may be a
    caller's own model or store. Paragraphs, resolutions and claims are tables, so each is made once and all that follows sees the same.
    """
    paragraphs = stored(generate(queries, retrieve(queries)))
    values = stored(resolve(paragraphs))
    tokens = values.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("token", F.col("rendered").alias("value")))).alias("values"))
    text = rendered(paragraphs).join(tokens, "query_id", "left").select("query_id", F.when(F.col("values").isNull(), F.col("text")).otherwise(A.substituted(F.col("text"), F.col("values"))).alias("text"))
    per = paragraphs.groupBy(F.col("query_id").alias("answer_id"), F.col("title").alias("section"), F.col("paragraph")).agg(F.collect_list("token").alias("tokens"), F.min("n").alias("n"))
    numbered = stored(A.claims(per).withColumn("claim_id", F.concat_ws("|", F.col("answer_id").cast("string"), F.col("claim_id").cast("string"))))
    claims = stored(verified_claims(numbered, cite(numbered, values) if len(signature(cite).parameters) > 1 else cite(numbered)))
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    counts = claims.groupBy("answer_id").agg(n("VERIFIED"), n("UNCERTAIN"), n("UNSUPPORTED"))
    overall = F.when((F.col("unsupported") > 0) | (F.col("verified") + F.col("uncertain") == 0), "UNSUPPORTED").when(F.col("uncertain") > 0, "UNCERTAIN").otherwise("VERIFIED")
    return {"paragraphs": paragraphs, "resolutions": values, "text": text, "claims": claims, "answers": counts.withColumn("overall_status", overall)}


def verification_items(answers: DataFrame, resolutions: DataFrame) -> DataFrame:
    """What an answer's verification section lists: answer_id, place, label, value, status, from its claims (verified, uncertain, unsupported) and its resolutions (answer_id, verified)."""
    r = resolutions.groupBy("answer_id").agg(F.count_if("verified").alias("found"), F.count_if(~F.col("verified")).alias("missing"))
    a = answers.join(r, "answer_id", "left").fillna(0, ["found", "missing"])
    item = lambda label, n, bad: F.struct(F.lit(label).alias("label"), F.col(n).cast("string").alias("value"), (F.when(F.col(n) > 0, bad).otherwise("VERIFIED") if bad else F.lit("VERIFIED")).alias("status"))
    items = F.array(item("Verified Claims", "verified", None), item("Claims Requiring Review", "uncertain", "UNCERTAIN"), item("Unverified Claims", "unsupported", "UNVERIFIED"), item("Resolved Citations", "found", None), item("Unresolved Citations", "missing", "UNVERIFIED"))
    return a.select("answer_id", F.posexplode(items).alias("place", "i")).select("answer_id", "place", "i.*")
