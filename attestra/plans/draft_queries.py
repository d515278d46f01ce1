"""Published queries: drafts that models write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import modeldrafts as M
from .citation_queries import _word, word
from .domain import Domain

#: Responses by number: {t} stands for the query's token, {w} for a word.
RESPONSES = [
    '{"sections": [{"title": " Position ", "paragraphs": ["On {w} {t}.", 7, " ", "More."]}, {"title": "", "paragraphs": ["{t} again"]}, {"title": "Empty", "paragraphs": []}]}', '{"sections": [{"title": "Position", "paragraphs": ["cut off', '{"answer": 1}',
    '{"sections": ["text"]}', '{"sections": [{"title": 3, "paragraphs": ["{t}"]}]}', '{"sections": [{"title": "a", "paragraphs": [" "]}]}', '{"sections": [{"title": "a", "paragraphs": ["{t} and [CITE: invented]"]}]}', '{"sections": [{"title": "a", "paragraphs": ["{w} alone"]}]}',
    '{"sections": [{"title": "a", "paragraphs": ["{t}", "AIR 1978 SC 597"]}]}', None,
]


def model_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries, a tenth answered well; every fallback has one token or two."""
    o = Domain(spark, sf_dir).table("orders")
    i = F.col("o_orderkey")
    token = F.concat(F.lit("[STATUTE: "), word(i), F.lit(" act, Section "), (i % 50).cast("string"), F.lit("]"))
    text = F.element_at(F.array(*map(F.lit, RESPONSES)), (i % len(RESPONSES) + 1).cast("int"))
    responses = o.select(i.alias("query_id"), F.replace(F.replace(text, F.lit("{t}"), token), F.lit("{w}"), word(i, 3)).alias("response"))
    law = o.select(i.alias("query_id"), F.lit("Applicable Law").alias("title"), F.lit(1).alias("n"), token.alias("token"), F.concat_ws(" ", F.lit("Rule."), token).alias("paragraph"))
    case = o.where("o_orderkey % 3 = 0").select(i.alias("query_id"), F.lit("Key Authorities").alias("title"), F.lit(1).alias("n"), F.lit("[CITE: court on it]").alias("token"), F.lit("Held. [CITE: court on it]").alias("paragraph"))
    return M.model_drafts(responses, law.unionByName(case))


ERRORS = [None, M.NOT_JSON, M.NO_SECTIONS, M.NO_OBJECT, M.NO_PARTS, M.EMPTY, M.INVENTED, M.UNUSED, M.CITED, M.NO_MODEL]
QUERIES = {"model_drafts": model_drafts}
ORACLE_SQL = {
    "model_drafts": f"""WITH q AS (SELECT o_orderkey AS i, '[STATUTE: ' || {_word('o_orderkey')} || ' act, Section ' || o_orderkey % 50 || ']' AS t, {_word('o_orderkey', 3)} AS w, ([{', '.join('NULL' if e is None else f"'{e}'" for e in ERRORS)}])[o_orderkey % 10 + 1] AS error FROM orders)
SELECT i AS query_id, 'model' AS origin, NULL AS error, section, title, n, paragraph FROM q, LATERAL (SELECT * FROM (VALUES (1, 'Position', 1, 'On ' || w || ' ' || t || '.'), (1, 'Position', 2, 'More.'), (2, 'Research Note', 1, t || ' again')) v(section, title, n, paragraph)) WHERE error IS NULL
UNION ALL SELECT i, 'fallback', error, 2, 'Applicable Law', 1, 'Rule. ' || t FROM q WHERE error IS NOT NULL UNION ALL SELECT i, 'fallback', error, 3, 'Key Authorities', 1, 'Held. [CITE: court on it]' FROM q WHERE error IS NOT NULL AND i % 3 = 0""",
}
