"""Events of a query's execution, in the order in which a client reads them. One row an execution comes in, one row an event goes out; the order is the place in an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sliced

FIELDS = ["type", "step", "data", "error", "agent", "message", "placeholder", "citation", "status", "token", "answer", "confidence", "metrics"]


def event(kind: str, **values) -> Column:
    """An event of a kind; what it doesn't tell is null."""
    of = lambda f: values[f] if isinstance(values.get(f), Column) else F.lit(values.get(f))
    return F.struct(F.lit(kind).alias("type"), *[of(f).cast("double" if f == "confidence" else "string").alias(f) for f in FIELDS[1:]])


def step(before: str, after: str, data: Column, between: Column | None = None) -> list[Column]:
    """A step that starts and completes; what it emits stands between."""
    return [F.array(event("STEP_START", step=before)), *([between] if between is not None else []), F.array(event("STEP_COMPLETE", step=after, data=data))]


def told(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def numbered(executions: DataFrame, events: list[Column]) -> DataFrame:
    e = executions.select("query_id", F.posexplode(F.concat(*events)).alias("place", "e"))
    return e.select("query_id", (F.col("place") + 1).alias("sequence"), *[F.col(f"e.{f}").alias(f) for f in FIELDS])


def verified_events(executions: DataFrame) -> DataFrame:
    """executions: query_id, query, pipeline, query_type, practice_area, action, n_results, n_findings, n_placeholders, n_sections, resolutions (array of placeholder, rendered, status), verified, uncertain, unsupported, n_claims, overall_status, answer, text.

    query_preview holds the first 80 characters. Confidence is the share of claims that are verified.
    """
    c = F.col
    of = lambda s: F.size(F.filter("resolutions", lambda r: r["status"] == s))
    cites = F.transform("resolutions", lambda r: event("CITATION_RESOLVED", placeholder=r["placeholder"], citation=r["rendered"], status=r["status"]))
    tokens = F.transform(sliced(c("text")), lambda t: event("TOKEN", token=t))
    confidence = c("verified") / F.greatest(c("n_claims"), F.lit(1))
    counts = {"verified_claims": c("verified"), "uncertain_claims": c("uncertain"), "unsupported_claims": c("unsupported"), "overall_status": c("overall_status")}
    n_events = 12 + F.size("resolutions") + F.size(sliced(c("text")))
    metrics = told(mode=F.lit("verified_query_execution"), pipeline=c("pipeline"), query_type=c("query_type"), crag_action=c("action"), result_count=c("n_results"), **counts, structured_answer_ready=F.lit(True), event_count=n_events)
    return numbered(executions, [
        *step("Analyzing query...", "Query analyzed", told(pipeline=c("pipeline"), query_type=c("query_type"), practice_area=c("practice_area"), query_preview=F.substr("query", F.lit(1), F.lit(80)))),
        *step("Retrieving authorities...", "Authorities retrieved", told(pipeline=c("pipeline"), crag_action=c("action"), result_count=c("n_results"), temporal_findings=c("n_findings"))),
        *step("Building placeholder draft...", "Placeholder draft built", told(placeholder_count=c("n_placeholders"), section_count=c("n_sections"))),
        *step("Resolving citations...", "Citations resolved", told(verified=of("VERIFIED"), unverified=of("UNVERIFIED")), cites),
        *step("Verifying claims...", "Claims verified", told(**counts)),
        F.array(event("ANSWER_READY", answer=c("answer"))), tokens, F.array(event("COMPLETE", confidence=confidence, metrics=metrics)),
    ])


def agentic_events(executions: DataFrame) -> DataFrame:
    """executions: query_id, workspace_id, reason, logs (array of agent, message), n_questions, n_authorities, confidence, answer, text."""
    c = F.col
    logs = F.transform("logs", lambda x: event("AGENT_LOG", agent=x["agent"], message=x["message"]))
    tokens = F.transform(sliced(c("text")), lambda t: event("TOKEN", token=t))
    n_events = 6 + F.size("logs") + F.size(sliced(c("text")))
    return numbered(executions, [
        *step("Analyzing uploaded-document query...", "Query analyzed", told(pipeline=F.lit("agentic_rag"), workspace_id=c("workspace_id"), reason=c("reason"))),
        *step("Running agentic workflow...", "Agentic workflow completed", told(research_question_count=c("n_questions"), authority_count=c("n_authorities")), logs),
        F.array(event("ANSWER_READY", answer=c("answer"))), tokens, F.array(event("COMPLETE", confidence=c("confidence"), metrics=told(mode=F.lit("agentic_rag"), event_count=n_events))),
    ])


def failed_events(failures: DataFrame) -> DataFrame:
    """failures: query_id, step, error, mode. An error and an end, with no confidence."""
    c = F.col
    return numbered(failures, [F.array(event("STEP_ERROR", step=c("step"), error=c("error")), event("COMPLETE", confidence=F.lit(0.0), metrics=told(mode=c("mode"), event_count=F.lit(2))))])


def accepted(requests: DataFrame) -> DataFrame:
    """requests (user_id, query, workspace_id, asked_at) as rows of the history: accepted, under an id that follows from what was asked, when and by whom."""
    key = F.sha1(F.concat_ws("|", F.coalesce(F.col("user_id").cast("string"), F.lit("")), "query", F.coalesce("workspace_id", F.lit("")), F.col("asked_at").cast("string")))
    return requests.select(key.alias("query_id"), "user_id", "workspace_id", F.col("query").alias("query_text"), F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("pipeline"), F.lit(None).cast("string").alias("answer_preview"), F.col("asked_at").alias("created_at"))


def streamed(queries: DataFrame, workspaces: DataFrame, verified: DataFrame, agentic: DataFrame) -> DataFrame:
    """The events of every query (query_id, workspace_id): agentic ones where its workspace (case_id) is known and it was run so, an error where the workspace is unknown, else verified ones."""
    q = queries.join(workspaces.select(F.col("case_id").alias("workspace_id"), F.lit(True).alias("known")), "workspace_id", "left")
    lost = q.where("workspace_id is not null and known is null")
    error = F.concat(F.lit("Workspace '"), F.col("workspace_id"), F.lit("' was not found."))
    errors = failed_events(lost.select("query_id", F.lit("Loading workspace").alias("step"), error.alias("error"), F.lit("workspace_error").alias("mode")))
    rest = q.join(lost.select("query_id"), "query_id", "left_anti")
    by_agents = agentic.join(rest.where("known").select("query_id"), "query_id", "left_semi")
    plain = verified.join(rest.select("query_id"), "query_id", "left_semi").join(by_agents.select("query_id"), "query_id", "left_anti")
    return verified_events(plain).unionByName(agentic_events(by_agents)).unionByName(errors)
