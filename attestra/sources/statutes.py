"""Acts as line-structured text: header lines, sections, and the rows they become. Constitutions likewise, by articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parsed_date
from .ingest import uuid5
from .lines import ARTICLE, SECTION, sections

# Header lines, and what stands where an act tells nothing; kinds of source with the practice areas of their acts.
HEADERS = {"Act": "act", "Short Title": "short_title", "Jurisdiction": "jurisdiction", "Enforcement Date": "enforcement_date"}
HEADER = "^(" + "|".join(HEADERS) + "):"
JURISDICTION, COMMENCEMENT, COURT, CONSTITUTION_REF = "Central", "1950-01-26", "Parliament of India", "constitution-of-india"
SOURCES = {"india_code": ["corporate", "civil"], "bns_bundle": ["criminal", "procedure"]}


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(x)), lambda x: x != "")


def header(lines: Column, name: str) -> Column:
    """The value of the last header line of that name; null without one."""
    own = F.filter(lines, lambda x: F.startswith(x, F.lit(f"{name}:")))
    return F.trim(F.substr(F.try_element_at(own, F.lit(-1)), F.lit(len(name) + 2)))


def acts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, external_id) as acts: act_name, short_title, jurisdiction, enforcement_date, source_ref, numbers of the sections in order."""
    d = docs.withColumn("lines", _lines(F.col("text")))
    for name, c in HEADERS.items():
        d = d.withColumn(c, header(F.col("lines"), name))
    title = F.coalesce("act", F.try_element_at("lines", F.lit(1)))
    found = act_sections(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_index", "number"))), lambda x: x["number"]).alias("in_force"))
    d = d.select("doc_id", title.alias("act_name"), "short_title", F.coalesce("jurisdiction", F.lit(JURISDICTION)).alias("jurisdiction"), "enforcement_date", F.coalesce("external_id", F.replace(F.lower(title), F.lit(" "), F.lit("-"))).alias("source_ref"))
    return d.join(found, "doc_id", "left").withColumn("in_force", F.coalesce("in_force", F.array().cast("array<string>")))


def act_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_index, number, heading, header, text; header lines are no text wherever they stand."""
    kept = F.array_join(F.filter(_lines(F.col("text")), lambda x: ~x.rlike(HEADER)), "\n")
    s = sections(docs.select("doc_id", kept.alias("text")), SECTION)
    return s.select("doc_id", "section_index", "number", "heading", F.concat(F.lit("Section "), F.col("number"), F.lit(" - "), F.col("heading")).alias("header"), "text")


def articles(docs: DataFrame) -> DataFrame:
    """The articles of a constitution, like sections; its title line and `Effective Date:` are no text."""
    lines = _lines(F.col("text"))
    kept = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~F.startswith(x, F.lit("Effective Date:")))
    s = sections(docs.select("doc_id", F.array_join(kept, "\n").alias("text")), ARTICLE)
    return s.select("doc_id", "section_index", "number", "heading", F.concat(F.lit("Article "), F.col("number"), F.lit(" - "), F.col("heading")).alias("header"), "text")


def metadata(acts_: DataFrame, practice_areas: list[str]) -> DataFrame:
    """What is known of an act as a document: kind, court, date, citation, where it binds, its practice areas."""
    array = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    filled = F.when(F.col("enforcement_date") != "", F.col("enforcement_date"))
    return acts_.select(
        "doc_id", F.lit("statute").alias("doc_type"), F.lit(COURT).alias("court"), parsed_date(F.coalesce(filled, F.lit(COMMENCEMENT))).alias("date"), F.col("act_name").alias("citation"), F.lit("en").alias("language"), "source_ref",
        F.array(F.lit("All India")).alias("jurisdiction_binding"), array(practice_areas).alias("practice_areas"),
    )


def statute_rows(acts_: DataFrame, sections_: DataFrame, amendments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables statutes, sections and amendments under ids that follow from the document's.

    sections_ may carry original_text, in_force, new_section; amendments: doc_id, number, label, amended_on, effective_on, summary, previous_text, updated_text.
    """
    id_of = lambda *parts: uuid5(F.concat_ws("|", *parts))
    own = lambda c, default: F.coalesce(F.col(c), default) if c in sections_.columns else default
    statutes = acts_.select("doc_id", "act_name", "short_title", "jurisdiction", parsed_date(F.col("enforcement_date")).alias("enforcement_date"), "in_force", F.lit(True).alias("current_validity"))
    section_id = id_of(F.col("doc_id").cast("string"), F.lit("section"), F.col("number"))
    rows = sections_.select(section_id.alias("section_id"), "doc_id", "number", "heading", "text", own("original_text", F.col("text")).alias("original_text"), own("in_force", F.lit(True)).alias("in_force"), own("new_section", F.lit(None).cast("string")).alias("new_section"))
    tables = {"statutes": statutes, "sections": rows}
    if amendments is not None:
        changed = amendments.select(section_id.alias("section_id"), "label", "amended_on", "effective_on", "summary", "previous_text", "updated_text")
        tables["amendments"] = changed.select(id_of(F.col("section_id"), F.lit("amendment"), F.col("label")).alias("amendment_id"), "*")
    return tables
