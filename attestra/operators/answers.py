"""Drafts with placeholders, their resolution, structured answers, answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REPORTER, claim_text, first_sentence, sentences
from ..tables import stored

def statute_token(act: Column, section: Column) -> Column:
    return F.concat(F.lit("[STATUTE: "), act, F.lit(", Section "), section, F.lit("]"))


def case_token(court: Column, issue: Column) -> Column:
    return F.concat(F.lit("[CITE: "), court, F.lit(" "), issue, F.lit("]"))


def excerpt(text: Column) -> Column:
    """First sentence without reporter citations, punctuation tidied."""
    return claim_text(F.regexp_replace(first_sentence(text), REPORTER, ""))


def drafted(results: DataFrame, statutes: int = 2, judgments: int = 3) -> DataFrame:
    """Per query the first statutes and judgments (query_id, rank, doc_type, act, section, court, issue, text, doc_id) as draft paragraphs with their placeholder.

    Queries without any get one unsupported paragraph each when they are left-joined by the caller.
    """
    kind = F.when(F.col("doc_type").isin("statute", "constitution"), "law").otherwise("case")
    r = results.withColumn("kind", kind).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank")))
    r = r.where(F.when(F.col("kind") == "law", F.col("n") <= statutes).otherwise(F.col("n") <= judgments))
    token = F.when(F.col("kind") == "law", statute_token(F.col("act"), F.col("section"))).otherwise(case_token(F.col("court"), F.col("issue")))
    title = F.when(F.col("kind") == "law", "Applicable law").otherwise("Key authorities")
    return r.select("query_id", "doc_id", title.alias("title"), "n", token.alias("token"), F.concat_ws(" ", excerpt(F.col("text")), token).alias("paragraph"))


def substituted(text: Column, resolutions: Column) -> Column:
    """Every token replaced by its value; resolutions: array of (token, value)."""
    return F.aggregate(resolutions, text, lambda t, r: F.replace(t, r["token"], r["value"]))


def claims(paragraphs: DataFrame) -> DataFrame:
    """Sentences of paragraphs (answer_id, section, paragraph, tokens) without placeholders, numbered by section, place of the paragraph there (n, if there is one), paragraph and sentence."""
    place = ["n"] if "n" in paragraphs.columns else []
    bare = F.aggregate("tokens", F.col("paragraph"), lambda t, k: F.replace(t, k, F.lit("")))
    c = paragraphs.select("answer_id", "section", "tokens", "paragraph", *place, F.posexplode(sentences(claim_text(bare))).alias("i", "claim"))
    return c.withColumn("claim_id", F.row_number().over(Window.partitionBy("answer_id").orderBy("section", *place, "paragraph", "i"))).drop("paragraph", *place)


def structured(claims_: DataFrame) -> DataFrame:
    """Per answer and section: claims in order with their status, counts, and the worst status."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "claim", "status"))), lambda x: F.struct(x["claim"].alias("claim"), x["status"].alias("status")))
    n = lambda s: F.count_if(F.col("status") == s)
    out = claims_.groupBy("answer_id", "section").agg(rows.alias("claims"), n("VERIFIED").alias("verified"), n("UNCERTAIN").alias("uncertain"), n("UNSUPPORTED").alias("unsupported"))
    return out.withColumn("status", F.when(F.col("unsupported") > 0, "UNSUPPORTED").when(F.col("uncertain") > 0, "UNCERTAIN").otherwise("VERIFIED"))


def sources(answers: DataFrame) -> DataFrame:
    """Distinct sources (doc_id, chunk_id, citation) of an answer in the order of first mention."""
    at = Window.partitionBy("answer_id", "doc_id", "chunk_id", "citation").orderBy("position")
    first = answers.withColumn("n", F.row_number().over(at)).where("n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("answer_id").orderBy("position", "doc_id", "chunk_id"))).drop("n")


def answer_graph(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges query -> section -> source of (query_id, section, doc_id, status)."""
    q = answers.select(F.concat(F.lit("query:"), F.col("query_id")).alias("id"), F.lit(0).alias("level"))
    s = answers.select(F.concat_ws(":", F.lit("section"), "query_id", "section").alias("id"), F.lit(1).alias("level"))
    d = answers.select(F.concat(F.lit("source:"), F.col("doc_id").cast("string")).alias("id"), F.lit(2).alias("level"))
    nodes = q.union(s).union(d).distinct()
    # places by ranges of ids: a level may hold nearly all nodes, and no task may hold a level
    ranges = stored(nodes.repartitionByRange("level", "id").withColumn("range", F.spark_partition_id()))
    by, before = Window.partitionBy("level"), Window.partitionBy("level").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("level", "range").agg(F.count("*").alias("n"))
    sizes = stored(sizes.select("level", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(by).alias("of")))
    at = F.row_number().over(Window.partitionBy("level", "range").orderBy("id")) - 1
    nodes = ranges.withColumn("at", at).join(F.broadcast(sizes), ["level", "range"]).select("id", "level", ((F.col("before") + F.col("at") + 0.5) / F.col("of")).alias("y"))
    e1 = answers.select(F.concat(F.lit("query:"), F.col("query_id")).alias("source"), F.concat_ws(":", F.lit("section"), "query_id", "section").alias("target"))
    e2 = answers.select(F.concat_ws(":", F.lit("section"), "query_id", "section").alias("source"), F.concat(F.lit("source:"), F.col("doc_id").cast("string")).alias("target"))
    return nodes, e1.union(e2).distinct()


#: What an answer is read as: keys in either spelling.
CLAIMS = "array<struct<text:string,status:string,citation:string,reason:string,sourcePassage:string,source_passage:string>>"
ITEMS = "array<struct<label:string,value:string,status:string>>"
SECTIONS = f"array<struct<kind:string,title:string,claims:{CLAIMS},statusItems:{ITEMS},status_items:{ITEMS}>>"
ANSWER = f"query string, overallStatus string, overall_status string, sections {SECTIONS}"
KINDS = ["LEGAL_POSITION", "APPLICABLE_LAW", "KEY_CASES", "VERIFICATION_STATUS"]
STATUSES = ["VERIFIED", "UNCERTAIN", "UNSUPPORTED"]


def normalised(answer: Column) -> Column:
    """An answer in JSON, keys in camel or snake case, as overall_status, query, sections (kind, title, claims, items); null for what is no answer. Unknown kinds are the verification's, unknown statuses uncertain."""
    a = F.from_json(answer, ANSWER)
    text = lambda c: F.coalesce(c, F.lit(""))
    status = lambda s: F.when(s.isin(*STATUSES), s).otherwise("UNCERTAIN")
    claim = lambda c: F.struct(text(c["text"]).alias("text"), status(c["status"]).alias("status"), c["citation"].alias("citation"), text(c["reason"]).alias("reason"), F.coalesce(c["sourcePassage"], c["source_passage"]).alias("source_passage"))
    item = lambda i: F.struct(text(i["label"]).alias("label"), text(i["value"]).alias("value"), status(i["status"]).alias("status"))
    each = lambda f, xs, kind: F.transform(F.filter(F.coalesce(xs, F.from_json(F.lit("[]"), kind)), lambda x: x.isNotNull()), f)
    section = lambda s: F.struct(
        F.when(s["kind"].isin(*KINDS), s["kind"]).otherwise("VERIFICATION_STATUS").alias("kind"), text(s["title"]).alias("title"), each(claim, s["claims"], CLAIMS).alias("claims"), each(item, F.coalesce(s["statusItems"], s["status_items"]), ITEMS).alias("items"),
    )
    whole = F.struct(status(F.coalesce(a["overallStatus"], a["overall_status"])).alias("overall_status"), text(a["query"]).alias("query"), each(section, a["sections"], SECTIONS).alias("sections"))
    return F.when(a.isNotNull() & F.startswith(F.ltrim(answer), F.lit("{")), whole)


def markdown(answer: Column, untitled: str = "Structured Answer") -> Column:
    """A normalised answer as Markdown."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  - {name}: "), c))
    claim = lambda c: F.concat_ws("\n", F.concat(F.lit("- "), c["text"]), F.concat(F.lit("  - Status: "), c["status"]), line("Citation", c["citation"]), line("Note", c["reason"]), line("Source passage", c["source_passage"]))
    item = lambda i: F.concat(F.lit("- "), i["label"], F.lit(": "), i["value"], F.lit(" ("), i["status"], F.lit(")"))
    body = lambda xs, f: F.when(F.size(xs) > 0, F.array_join(F.transform(xs, f), "\n"))
    checks = lambda s: F.when(F.size(s["items"]) > 0, F.concat(F.lit("\n### Verification\n\n"), body(s["items"], item)))
    section = lambda s: F.concat_ws("\n", F.concat(F.lit("## "), s["title"], F.lit("\n")), body(s["claims"], claim), checks(s), F.lit(""))
    title = F.when(answer["query"] != "", answer["query"]).otherwise(untitled)
    head = F.concat(F.lit("# "), title, F.lit("\n\nOverall status: "), answer["overall_status"], F.lit("\n"))
    return F.when(answer.isNotNull(), F.regexp_replace(F.concat_ws("\n", head, body(answer["sections"], section)), r"^\s+|\s+$", ""))
