"""Case files from uploaded documents: dates, facts, orders, bail, type, stage, open issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, squeeze
from .routing import holds, practice_area
from .routing import sections as routed_sections

# Dates, words of orders, signals of type and stage.
LONG_DATE = r"(?i)\b(\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b"
SLASH_DATE = r"\b(\d{1,2}/\d{1,2}/\d{4})\b"
ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
COURT = r"(?i)\b(Supreme Court(?: of India)?|(?:Bombay|Delhi|Madras|Calcutta|Karnataka|Kerala|Allahabad|Patna|Rajasthan|Punjab and Haryana) High Court|Sessions Court|District Court)\b"
ORDER = ["order", "rejected", "dismissed", "allowed", "granted"]
CRIMINAL_CODES = "^(IPC|CrPC|BNS|BNSS|BSA) "
TYPES = [
    ("property", ["landlord", "specific relief act"]), ("family", ["divorce", "maintenance"]), ("constitutional", ["fundamental right", "article 21"]), ("tax", ["income tax", "gst"]),
    ("corporate", ["company", "insolvency", "nclt"]), ("labour", ["labour", "wages"]), ("arbitration", ["arbitration", "arbitral"]), ("consumer", ["consumer"]),
]
STAGES = [
    ("bail", ["bail"]), ("charges", ["charge sheet", "chargesheet"]), ("appeal", ["appeal"]), ("revision", ["revision"]), ("trial", ["trial"]), ("execution", ["execution"]), ("investigation", ["fir", "investigation"]),
]
ROUTED_TYPES = ["criminal", "civil", "constitutional", "family", "corporate", "tax", "labour", "property", "consumer", "arbitration"]
#: A text without a signal is routed by so many characters of its beginning.
ROUTED_LENGTH = 4000


def text_date(text: Column) -> Column:
    """The first date by form: `4 July 2024`, `4/7/2024`, ISO; null if the calendar has no such day."""
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    day = lambda c, f: F.to_date(F.try_to_timestamp(c, F.lit(f)))
    return F.coalesce(day(F.initcap(squeeze(found(LONG_DATE))), "d MMMM yyyy"), day(found(SLASH_DATE), "d/M/yyyy"), day(found(ISO_DATE), "yyyy-MM-dd"))


def first_of(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    out = F.lit(None).cast("string")
    low = F.lower(text)
    for name, signals in reversed(rules):
        out = F.when(holds(low, signals), name).otherwise(out)
    return out


def statements(documents: DataFrame) -> DataFrame:
    """Sentences of documents (case_id, doc_index, text) with their date."""
    s = documents.select("case_id", "doc_index", F.posexplode(sentences(F.col("text"))).alias("i", "sentence"))
    return s.withColumn("date", text_date(F.col("sentence")))


def canonical_section(section: Column) -> Column:
    """`Section 302 IPC` as `IPC 302`; null for other forms."""
    pattern = r"^Section\s+([0-9A-Z]+)\s+(.+)$"
    number, act = F.upper(F.regexp_extract(section, pattern, 1)), F.trim(F.regexp_extract(section, pattern, 2))
    low = F.lower(act)
    name = F.when(low == "crpc", "CrPC").when(low.isin("ipc", "bns", "bnss", "bsa"), F.upper(act)).when(low == "indian evidence act", "Indian Evidence Act").otherwise(act)
    return F.when(number != "", F.concat_ws(" ", name, number))


def statute_names(sections: Column) -> Column:
    """Distinct names before the last space, in order."""
    return F.array_distinct(F.transform(sections, lambda s: F.when(F.contains(s, F.lit(" ")), F.regexp_replace(s, r" [^ ]*$", "")).otherwise(s)))


def court_name(text: Column) -> Column:
    """The first court of text under its usual name."""
    c = F.nullif(F.regexp_extract(text, COURT, 1), F.lit(""))
    return F.when(F.contains(F.lower(c), F.lit("supreme court")), "Supreme Court of India").otherwise(F.initcap(c))


def key_facts(documents: DataFrame) -> DataFrame:
    """(case_id, date, sentence, rank): dated sentences of documents, each once, by date, then as they stand."""
    first = statements(documents).where("date is not null").groupBy("case_id", "date", "sentence").agg(F.min(F.struct("doc_index", "i")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("date", "at"))).drop("at")


def outcome(text: Column) -> Column:
    low = F.lower(text)
    return F.when(holds(low, ["rejected"]), "rejected").when(holds(low, ["dismissed"]), "dismissed").when(holds(low, ["granted", "allowed"]), "granted")


def previous_orders(documents: DataFrame) -> DataFrame:
    """(case_id, doc_index, i, sentence, date, outcome, court): sentences that speak of an order; outcome null where none is told."""
    s = statements(documents).where(holds(F.lower("sentence"), ORDER))
    return s.select("case_id", "doc_index", "i", "sentence", "date", outcome(F.col("sentence")).alias("outcome"), court_name(F.col("sentence")).alias("court"))


def bail_history(documents: DataFrame) -> DataFrame:
    """(case_id, doc_index, i, date, status, summary): orders that speak of bail, pending where they tell no outcome; a case without any, one of whose documents speaks of bail, has one pending entry for the first of these."""
    told = previous_orders(documents).where(holds(F.lower("sentence"), ["bail", "ba/"]))
    told = told.select("case_id", "doc_index", "i", "date", F.coalesce("outcome", F.lit("pending")).alias("status"), F.col("sentence").alias("summary"))
    silent = documents.where(F.contains(F.lower("text"), F.lit("bail"))).join(told.select("case_id").distinct(), "case_id", "left_anti")
    silent = silent.groupBy("case_id").agg(F.min(F.struct("doc_index", "file_name")).alias("d"))
    note = F.concat(F.lit("Bail proceedings referenced in "), F.col("d.file_name"), F.lit("."))
    return told.unionByName(silent.select("case_id", "d.doc_index", F.lit(0).alias("i"), F.lit(None).cast("date").alias("date"), F.lit("pending").alias("status"), note.alias("summary")))


def contradictions(orders: Column) -> Column:
    """A note for each rejected or dismissed order, or one that there is none. orders: array of (court, outcome)."""
    bad = F.filter(orders, lambda o: F.coalesce(o["outcome"].isin("rejected", "dismissed"), F.lit(False)))
    notes = F.transform(bad, lambda o: F.concat(F.lit("Prior order from "), F.coalesce(o["court"], F.lit("earlier court")), F.lit(" was "), o["outcome"], F.lit(".")))
    return F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit("No internal contradiction detected in uploaded procedural history.")))


def case_type(text: Column, sections: Column) -> Column:
    """Criminal by the sections charged, else by the first signal in text, else by the practice area of its beginning; null for areas that are no type."""
    lead = F.substr(text, F.lit(1), F.lit(ROUTED_LENGTH))
    area = practice_area(lead, routed_sections(lead))
    routed = F.when(area.isin(*ROUTED_TYPES), area)
    return F.when(F.exists(sections, lambda s: s.rlike(CRIMINAL_CODES)), "criminal").otherwise(F.coalesce(first_of(text, TYPES), routed))


def open_issues(stage: Column, kind: Column, sections: Column, orders: Column, statutes: Column) -> Column:
    """The questions that a case leaves open. orders: array of (.., outcome)."""
    charged = F.when(F.size(sections) > 0, F.array_join(F.slice(sections, 1, 2), ", ")).otherwise("the alleged offences")
    refused = F.exists(orders, lambda o: F.coalesce(o["outcome"] == "rejected", F.lit(False)))
    bail = F.array_compact(F.array(F.concat(F.lit("Whether bail should be granted for "), charged, F.lit(".")), F.when(refused, F.lit("Whether changed circumstances justify bail after the earlier rejection order."))))
    relief = F.exists(statutes, lambda s: F.startswith(s, F.lit("Specific Relief Act")))
    return (
        F.when(stage == "bail", bail).when((kind == "property") & relief, F.array(F.lit("Whether possession must be restored under the Specific Relief Act.")))
        .when(F.size(sections) > 0, F.array(F.concat(F.lit("What relief is available under "), F.try_element_at(sections, F.lit(1)), F.lit("?")))).otherwise(F.array().cast("array<string>"))
    )


def case_files(documents: DataFrame) -> DataFrame:
    """One row for each case of documents (case_id, doc_index, file_name, text, confidence, sections): type, stage, court, sections, statutes, confidence, facts, orders, bail history, open issues."""
    parts = F.array_sort(F.collect_list(F.struct("doc_index", "file_name", "text", "sections")))
    c = documents.groupBy("case_id").agg(parts.alias("parts"), F.count("*").alias("n_documents"), F.round(F.avg("confidence"), 3).alias("confidence"))
    c = c.withColumn("text", F.array_join(F.transform("parts", lambda x: x["text"]), "\n")).withColumn("names", F.lower(F.array_join(F.transform("parts", lambda x: x["file_name"]), " ")))
    found = F.flatten(F.transform("parts", lambda x: F.coalesce(x["sections"], F.array().cast("array<string>"))))
    c = c.withColumn("sections", F.array_distinct(F.array_compact(F.transform(found, canonical_section)))).withColumn("statutes", statute_names(F.col("sections")))
    c = c.withColumn("case_type", case_type(F.col("text"), F.col("sections"))).withColumn("stage", first_of(F.concat_ws(" ", "text", "names"), STAGES)).withColumn("court", court_name(F.col("text")))
    facts = key_facts(documents).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "date", "sentence"))).alias("key_facts"))
    orders = previous_orders(documents).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("doc_index", "i", "court", "outcome"))).alias("orders"))
    bail = bail_history(documents).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("doc_index", "i", "date", "status", "summary"))).alias("bail_history"))
    out = c.drop("text", "names", "parts").join(facts, "case_id", "left").join(orders, "case_id", "left").join(bail, "case_id", "left")
    out = out.withColumn("orders", F.coalesce("orders", F.array().cast(orders.schema["orders"].dataType)))
    return out.withColumn("open_issues", open_issues(F.col("stage"), F.col("case_type"), F.col("sections"), F.col("orders"), F.col("statutes")))


# What stands before parties, advocates and case numbers; words of those who answer.
PETITIONER = r"(?i)\b(?:petitioner|appellant|applicant|accused)\b\s*[:.-]\s*([A-Za-z0-9&.,' -]{2,100}?)(?=(?:\s+\b(?:petitioner|respondent|appellant|applicant|accused|complainant)\b\s*[:.-])|[.!?]|$)"
RESPONDENT = r"(?i)\b(?:respondent|opposite party|complainant)\b\s*[:.-]\s*([A-Za-z0-9&.,' -]{2,100}?)(?=(?:\s+\b(?:petitioner|respondent|appellant|applicant|accused|complainant)\b\s*[:.-])|[.!?]|$)"
ADVOCATE = r"(?i)\b(?:adv\.?|advocate)\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}?)(?=(?:\s+for\b)|[.!?,]|$)"
CASE_NUMBER = r"(?i)\b(?:[A-Z]{1,5}|BA|CRA|CRL\.?M\.?|WP|SLP|FA|MA)/\d{1,6}/\d{4}\b"
ANSWERING = ["state of", "union of india", "pcit", "commissioner", "respondent", "complainant"]


def merged_parties(clusters: DataFrame) -> DataFrame:
    """clusters (case_id, place, canonical, aliases) with those of one name, whatever its signs and case, made one: the longest canonical name, all aliases in order, the first place."""
    key = F.regexp_replace(F.lower("canonical"), "[^a-z0-9]+", "")
    c = clusters.withColumn("key", key)
    alias = c.select("case_id", "key", "place", F.posexplode("aliases").alias("i", "alias")).groupBy("case_id", "key", "alias").agg(F.min(F.struct("place", "i")).alias("at"))
    names = alias.groupBy("case_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))
    own = c.groupBy("case_id", "key").agg(F.min("place").alias("place"), F.max(F.struct(F.char_length("canonical").alias("n"), "canonical")).canonical.alias("canonical"))
    return own.join(names, ["case_id", "key"], "left").select("case_id", "place", "canonical", "aliases")


def case_sides(documents: DataFrame, parties: DataFrame) -> DataFrame:
    """Per case of documents (case_id, doc_index, text): petitioner, respondent, advocates, case_number.

    A side that a document labels is that; else, among parties (case_id, place, canonical), the first that does not look like one who answers, and the first other that does, or the first other.
    """
    bare = lambda c: F.nullif(F.regexp_replace(c, r"^[ .]+|[ .]+$", ""), F.lit(""))
    first = lambda p, g: F.min(F.when(F.col("text").rlike(p), F.struct("doc_index", F.regexp_extract("text", p, g).alias("x")))).x
    advocates = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_index", F.regexp_extract_all("text", F.lit(ADVOCATE), F.lit(1)).alias("a")))), lambda x: F.transform(x["a"], lambda n: F.regexp_replace(n, r"^[ .]+|[ .]+$", "")))))
    c = documents.groupBy("case_id").agg(bare(first(PETITIONER, 1)).alias("asks"), bare(first(RESPONDENT, 1)).alias("answers"), advocates.alias("advocates"), F.replace(first(CASE_NUMBER, 0), F.lit(" "), F.lit("")).alias("case_number"))
    listed = parties.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "canonical"))), lambda x: x["canonical"]).alias("names"))
    c = c.join(listed, "case_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    looks = lambda n: holds(F.lower(n), ANSWERING)
    key = lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]+", "")
    c = c.withColumn("petitioner", F.coalesce("asks", F.try_element_at(F.filter("names", lambda n: ~looks(n)), F.lit(1)), F.try_element_at("names", F.lit(1))))
    others = F.filter("names", lambda n: F.coalesce(key(n) != key(F.col("petitioner")), F.lit(True)))
    c = c.withColumn("respondent", F.coalesce("answers", F.try_element_at(F.filter(others, looks), F.lit(1)), F.try_element_at(others, F.lit(1))))
    return c.select("case_id", "petitioner", "respondent", "advocates", "case_number")
