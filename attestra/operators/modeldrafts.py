"""Drafts that a model wrote, held against what they may say: JSON of the right shape, tokens that the query has, no citations of their own. What fails falls back, query by query.

responses: query_id, response (text; null: no model answered). fallback: query_id, title, n, token, paragraph, as execution.drafts gives it; its tokens are those that a draft may use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REPORTER, let

# What is wrong with a draft, and the form of tokens.
NO_MODEL = "No configured model client is available."
NOT_JSON = "Model response was not valid JSON."
NO_SECTIONS = "Model response omitted the sections array."
NO_OBJECT = "Model section entries must be objects."
NO_PARTS = "Model section entries must include title and paragraphs."
EMPTY = "Model response did not produce any usable sections."
INVENTED = "Model response used placeholder tokens outside the allowed set."
UNUSED = "Model response did not use any allowed placeholder tokens."
CITED = "Model response emitted a raw reporter citation."
UNTITLED = "Research Note"
TOKEN = r"\[[A-Z]+: [^\]]+\]"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column) -> Column:
    """A string of JSON; null for other kinds."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def sections_of(response: Column) -> Column:
    """(error, sections) of a response: error says what is wrong with its shape; sections (title, paragraphs) without blank paragraphs and empty sections."""

    def one(s: Column) -> Column:
        title, paragraphs = _text(F.try_variant_get(s, "$.title", "variant")), F.try_variant_get(s, "$.paragraphs", "array<variant>")
        error = F.when(~F.startswith(_kind(s), F.lit("OBJECT")), NO_OBJECT).when(title.isNull() | paragraphs.isNull(), NO_PARTS)
        kept = F.filter(F.transform(paragraphs, _text), lambda p: p.isNotNull() & p.rlike(r"\S"))
        named = F.regexp_replace(title, r"^\s+|\s+$", "")
        return F.struct(error.alias("error"), F.when(named == "", UNTITLED).otherwise(named).alias("title"), kept.alias("paragraphs"))

    def of(v: Column) -> Column:
        every = F.transform(F.try_variant_get(v, "$.sections", "array<variant>"), one)
        return let(
            every,
            lambda x: F.struct(
                F.when(response.isNull(), NO_MODEL).when(v.isNull(), NOT_JSON).when(x.isNull(), NO_SECTIONS).otherwise(F.try_element_at(F.filter(F.transform(x, lambda s: s["error"]), lambda e: e.isNotNull()), F.lit(1))).alias("error"),
                F.filter(x, lambda s: F.size(s["paragraphs"]) > 0).alias("sections"),
            ),
        )

    return let(F.try_parse_json(response), of)


def accepted(responses: DataFrame, fallback: DataFrame) -> DataFrame:
    """query_id, error (null: the draft holds), sections, used (the tokens that the draft uses, in the order of the fallback's)."""
    order = F.array_sort(F.collect_list(F.struct("title", "n", "token")))
    allowed = fallback.groupBy("query_id").agg(F.array_distinct(F.transform(order, lambda x: x["token"])).alias("allowed"))
    r = responses.select("query_id", sections_of(F.col("response")).alias("d")).join(allowed, "query_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    r = r.select("query_id", "allowed", F.col("d.error").alias("shape"), F.col("d.sections").alias("sections"), F.array_join(F.flatten(F.transform("d.sections", lambda s: s["paragraphs"])), "\n").alias("text"))
    used = F.filter("allowed", lambda t: F.contains(F.col("text"), t))
    invented = F.size(F.array_except(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), F.col("allowed"))) > 0
    error = F.when(F.col("shape").isNotNull(), F.col("shape")).when(F.size("sections") == 0, EMPTY).when(invented, INVENTED).when(F.size(used) == 0, UNUSED).when(F.col("text").rlike(REPORTER), CITED)
    return r.select("query_id", error.alias("error"), "sections", used.alias("used"))


def model_drafts(responses: DataFrame, fallback: DataFrame) -> DataFrame:
    """query_id, origin (model or fallback), error, section (its place), title, n, paragraph: the model's draft where it holds, else the query's fallback."""
    a = accepted(responses, fallback)
    own = a.where("error is null").select("query_id", F.lit("model").alias("origin"), "error", F.posexplode("sections").alias("section", "s"))
    own = own.select("query_id", "origin", "error", (F.col("section") + 1).alias("section"), "s.title", F.posexplode("s.paragraphs").alias("n", "paragraph")).withColumn("n", F.col("n") + 1)
    places = F.when(F.col("title") == "Legal Position", 1).when(F.col("title") == "Applicable Law", 2).when(F.col("title") == "Key Authorities", 3).otherwise(4)
    rest = fallback.join(a.where("error is not null").select("query_id", "error"), "query_id").select("query_id", F.lit("fallback").alias("origin"), "error", places.alias("section"), "title", F.col("n").cast("int").alias("n"), "paragraph")
    return own.unionByName(rest)
