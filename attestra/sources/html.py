"""HTML pages to normalised lines, paragraphs, metadata, citations and appeal links. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import unescaped
from ..functions.text import parsed_date, parties

# Patterns of the page format.
BREAK = r"(?i)<(?:/p|/div|/h1|/h2|/h3|br\s*/?)>"
TAG = r"<[^>]+>"
TITLE = r"(?is)<h1[^>]*>(.*?)</h1>"
HEADING = r"(?is)<h[23][^>]*>(.*?)</h[23]>"
PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"
DATE = r"(?i)(\d{4}-\d{2}-\d{2}|[A-Z][a-z]+ \d{1,2}, \d{4})"
CITATION = r"(\(\d{4}\)\s*\d+\s*SCC\s*\d+|AIR\s+\d{4}\s+SC\s+\d+)"
NEUTRAL = r"(?i)(\d{4}\s+INSC\s+\d+)"
CASE = r"([A-Z][A-Za-z0-9 .,&'-]+?\s+v(?:s\.?|\.?)\s+[A-Z][A-Za-z0-9 .,&'-]+)"
BENCH = r"(?i)(?:Coram|Bench)\s*:\s*([^\n]+)"
APPEAL = r"(?i)Appeal from ([^.]+)\."


def squeeze(c: Column) -> Column:
    """White space of any kind collapsed and trimmed, that of references included."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def clean(c: Column) -> Column:
    return squeeze(unescaped(F.regexp_replace(c, TAG, " ")))


def lines(html: Column) -> Column:
    t = unescaped(F.regexp_replace(F.regexp_replace(html, BREAK, "\n"), TAG, " "))
    return F.filter(F.transform(F.split(t, "\n"), squeeze), lambda x: x != "")


def _all(html: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), clean), lambda x: x != "")


def _first(text: Column, pattern: str) -> Column:
    m = F.regexp_extract(text, pattern, 1)
    return F.when(m != "", F.trim(m))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, title, paragraphs, headers, body, source_ref, checksum of pages (page_id, url, html)."""
    ls = lines(F.col("html"))
    p = pages.select("page_id", "url", "html", ls.alias("lines"))
    title = F.coalesce(F.when(_first(F.col("html"), TITLE).isNotNull(), clean(F.regexp_extract("html", TITLE, 1))), F.try_element_at("lines", F.lit(1)))
    found = _all(F.col("html"), PARAGRAPH)
    paragraphs = F.when(F.size(found) > 0, found).otherwise(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))))
    p = p.select("page_id", "url", title.alias("title"), paragraphs.alias("paragraphs"), _all(F.col("html"), HEADING).alias("headers"), F.sha2("html", 256).alias("checksum"))
    ref = F.element_at(F.split(F.rtrim(F.col("url"), F.lit("/")), "/"), -1)
    return p.withColumn("body", F.array_join("paragraphs", "\n")).withColumn("source_ref", ref)


def metadata(parsed_: DataFrame, court: str = "Supreme Court", binding: str = "All India", practice: str = "general") -> DataFrame:
    b = F.col("body")
    return parsed_.select(
        "page_id", "title", _first(b, CITATION).alias("citation"), _first(b, NEUTRAL).alias("neutral_citation"), parsed_date(_first(b, DATE)).alias("date"),
        _first(b, BENCH).alias("bench"), parties(F.col("title")).alias("parties"), F.lit(court).alias("court"), F.array(F.lit(binding)).alias("binding"), F.array(F.lit(practice)).alias("practice_areas"),
    )


def citations(parsed_: DataFrame) -> DataFrame:
    """First citation and case name of each paragraph, once per page."""
    c = parsed_.select("page_id", F.posexplode("paragraphs").alias("pos", "text")).select("page_id", "pos", _first(F.col("text"), CITATION).alias("citation"), _first(F.col("text"), CASE).alias("case_name"))
    c = c.where("citation is not null or case_name is not null")
    return c.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "citation", "case_name").orderBy("pos"))).where("n = 1").drop("n").withColumn("type", F.lit("refers_to"))


def appeal_links(parsed_: DataFrame) -> DataFrame:
    a = parsed_.select("page_id", F.posexplode("paragraphs").alias("pos", "text")).select("page_id", "pos", _first(F.col("text"), APPEAL).alias("origin"))
    return a.where("origin is not null").withColumn("relation", F.lit("appeal_from"))


def projections(parsed_: DataFrame, meta: DataFrame, cites: DataFrame) -> dict[str, DataFrame]:
    """What one ingest writes: documents, chunks (a paragraph each), edges."""
    chunks = parsed_.select("page_id", F.posexplode("paragraphs").alias("chunk_index", "text")).withColumn("total_chunks", F.count("*").over(Window.partitionBy("page_id")))
    return {"documents": meta, "chunks": chunks, "edges": cites}
