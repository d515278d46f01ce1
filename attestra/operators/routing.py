"""Query analysis as columns: references, entities, jurisdiction, practice area, query type, pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REPORTER, squeeze
from .state import CUTOVER, references_expanded

# Signals and their order, courts, pipelines.
AREAS = [
    ("constitutional", ["article ", "fundamental right", "constitutional", "privacy", "due process", "article 14", "article 19", "article 21"]),
    ("criminal", ["bail", "fir", "charge sheet", "anticipatory bail", "murder", "rape", "criminal", "custody"]),
    ("property", ["landlord", "tenant", "eviction", "possession", "specific relief", "land record"]),
    ("family", ["divorce", "custody", "maintenance", "matrimonial", "alimony", "domestic violence"]),
    ("tax", ["income tax", "gst", "pcit", "itat", "tax"]),
    ("corporate", ["company", "ibc", "insolvency", "nclt", "nclat", "sebi", "shareholder"]),
    ("labour", ["labour", "industrial dispute", "wages", "gratuity", "pf", "employment"]),
    ("arbitration", ["arbitration", "arbitral", "award", "section 34"]),
    ("consumer", ["consumer", "deficiency in service", "consumer commission"]),
    ("procedure", ["cpc", "maintainability", "jurisdiction"]),
    ("civil", ["civil"]),
]
CODE_PREFIXES = ["IPC ", "CrPC ", "BNS ", "BNSS ", "BSA "]
COMPARISONS = [" vs ", " versus ", " compare ", " difference between ", " how does ", " compared to "]
MULTI_HOP = ["how has", "how did", "developed", "evolved", "evolution", "current law on", "landmark cases", "doctrine", "line of cases", "traced"]
VAGUE = ["what can i do", "can i", "my landlord", "my employer", "my husband", "my wife", "without notice", "they arrested", "police took"]
CONSTITUTIONAL = ["constitutional validity", "constitutionally valid", "fundamental right", "part iii", "article 14", "article 19", "article 21", "constitutional challenge"]
TEMPORAL = ["today", "current law", "currently", "latest", "as of", "now", "post july 2024", "after july 1 2024"]
TYPES = {
    "document_specific": (0.99, "agentic_rag"), "comparative": (0.96, "graph_hybrid"), "multi_hop_doctrine": (0.93, "graph_rag"), "constitutional": (0.94, "graph_rag"),
    "case_specific": (0.95, "hybrid_crag"), "statutory_lookup": (0.94, "hybrid_crag"), "vague_natural": (0.84, "hyde_hybrid"), "general_legal": (0.65, "hybrid_rag"),
}
# Courts in the order in which a query is held against them, with what names them. The first that fits sets the jurisdiction.
COURTS = [
    ("Supreme Court of India", r"\bsupreme court(?: of india)?\b|\bsc\b"),
    ("Allahabad High Court", r"\ballahabad(?: high court| hc)\b"),
    ("Andhra Pradesh High Court", r"\bandhra pradesh(?: high court| hc)\b"),
    ("Bombay High Court", r"\bbombay(?: high court| hc)\b"),
    ("Calcutta High Court", r"\bcalcutta(?: high court| hc)\b"),
    ("Chhattisgarh High Court", r"\bchhattisgarh(?: high court| hc)\b"),
    ("Delhi High Court", r"\bdelhi(?: high court| hc)\b"),
    ("Gauhati High Court", r"\bgauhati(?: high court| hc)\b"),
    ("Gujarat High Court", r"\bgujarat(?: high court| hc)\b"),
    ("Himachal Pradesh High Court", r"\bhimachal pradesh(?: high court| hc)\b"),
    ("High Court of Jammu and Kashmir and Ladakh", r"\bjammu(?: and)? kashmir(?: and ladakh)?(?: high court| hc)\b|\bladakh(?: high court| hc)\b"),
    ("Jharkhand High Court", r"\bjharkhand(?: high court| hc)\b"),
    ("Karnataka High Court", r"\bkarnataka(?: high court| hc)\b"),
    ("Kerala High Court", r"\bkerala(?: high court| hc)\b"),
    ("Madras High Court", r"\bmadras(?: high court| hc)\b"),
    ("Madhya Pradesh High Court", r"\bmadhya pradesh(?: high court| hc)\b"),
    ("Manipur High Court", r"\bmanipur(?: high court| hc)\b"),
    ("Meghalaya High Court", r"\bmeghalaya(?: high court| hc)\b"),
    ("Orissa High Court", r"\borissa(?: high court| hc)\b|\bodisha(?: high court| hc)\b"),
    ("Patna High Court", r"\bpatna(?: high court| hc)\b"),
    ("Punjab and Haryana High Court", r"\bpunjab and haryana(?: high court| hc)\b"),
    ("Rajasthan High Court", r"\brajasthan(?: high court| hc)\b"),
    ("Sikkim High Court", r"\bsikkim(?: high court| hc)\b"),
    ("Telangana High Court", r"\btelangana(?: high court| hc)\b"),
    ("Tripura High Court", r"\btripura(?: high court| hc)\b"),
    ("Uttarakhand High Court", r"\buttarakhand(?: high court| hc)\b"),
    ("National Company Law Tribunal", r"\bnclt\b|\bnational company law tribunal\b"),
    ("National Company Law Appellate Tribunal", r"\bnclat\b|\bnational company law appellate tribunal\b"),
    ("Income Tax Appellate Tribunal", r"\bitat\b|\bincome tax appellate tribunal\b"),
    ("National Green Tribunal", r"\bngt\b|\bnational green tribunal\b"),
    ("Central Administrative Tribunal", r"\bcat\b|\bcentral administrative tribunal\b"),
    ("Telecom Disputes Settlement and Appellate Tribunal", r"\btdsat\b|\btelecom disputes settlement and appellate tribunal\b"),
]
NAME_PART = r"[A-Z][A-Za-z0-9.&'()/,-]*(?:\s+(?:[A-Z][A-Za-z0-9.&'()/,-]*|of|and|the|an|for|in))*"
CASE_NAME = rf"({NAME_PART}\s+v(?:\.|s\.?|ersus)?\s+{NAME_PART})"
CODE_REF = r"(?i)\b(?:section\s+)?(\d+[A-Z]?)\s*(IPC|CRPC|BNS|BNSS|BSA)\b"
CODE_FIRST = r"(?i)\b(IPC|CRPC|BNS|BNSS|BSA)\s+(\d+[A-Z]?)\b"
ARTICLE_REF = r"(?i)\barticle\s+(\d+[A-Z]?)\b"
ACT_REF = r"(?i)\b(?:section\s+)?(\d+[A-Z]?)\s+((?:[A-Z][A-Za-z.&]*(?:\s+[A-Z][A-Za-z.&]*)*)\s+Act)\b"


ACT_NAME = r"(?i)\b(?:Constitution of India|[A-Z][A-Za-z.&]*(?:\s+[A-Z][A-Za-z.&]*)*\s+(?:Act|Code|Sanhita))\b"


def holds(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def normalized_query(q: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(q), r"(?U)[^\w\s./-]", " "))


def act_name(name: Column) -> Column:
    """Words capitalised; short capitals stay, small words are lower case."""
    word = lambda w: (
        F.when((w == F.upper(w)) & (F.char_length(w) <= 5), w).when(F.lower(w).isin("of", "and", "the"), F.lower(w))
        .otherwise(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2), F.char_length(w)))))
    )
    return F.array_join(F.transform(F.split(squeeze(name), " "), word), " ")


def sections(q: Column) -> Column:
    """Canonical references, distinct in order: code after section, code before it, articles, acts."""
    code = lambda c: F.when(F.upper(c) == "CRPC", "CrPC").otherwise(F.upper(c))
    each = lambda p, f: F.transform(F.regexp_extract_all(q, F.lit(p), F.lit(0)), f)
    g = F.regexp_extract
    return F.array_distinct(F.concat(
        each(CODE_REF, lambda m: F.concat_ws(" ", code(g(m, CODE_REF, 2)), F.upper(g(m, CODE_REF, 1)))),
        each(CODE_FIRST, lambda m: F.concat_ws(" ", code(g(m, CODE_FIRST, 1)), F.upper(g(m, CODE_FIRST, 2)))),
        each(ARTICLE_REF, lambda m: F.concat(F.lit("Article "), F.upper(g(m, ARTICLE_REF, 1)))),
        each(ACT_REF, lambda m: F.concat_ws(" ", act_name(g(m, ACT_REF, 2)), F.upper(g(m, ACT_REF, 1)))),
    ))


def case_names(q: Column) -> Column:
    clean = lambda n: F.trim(F.regexp_replace(n, r"(?i)^(?:What|How|Whether|Explain|Summari[sz]e|Tell me about)\b.*?\bin\s+", ""))
    return F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(CASE_NAME), F.lit(1)), clean))


def courts(q: Column) -> Column:
    """Names of the courts that a query mentions, in the order of the list."""
    return F.array_compact(F.array(*[F.when(F.lower(q).rlike(p), F.lit(n)) for n, p in COURTS]))


def entities(q: Column) -> Column:
    """(kind, text) of what a query names, each once: cases, courts, sections and articles, acts."""
    of = lambda kind, xs: F.transform(xs, lambda t: F.struct((kind(t) if callable(kind) else F.lit(kind)).alias("kind"), t.alias("text")))
    reference = lambda t: F.when(F.startswith(t, F.lit("Article ")), "ARTICLE").otherwise("SECTION")
    acts = F.transform(F.regexp_extract_all(q, F.lit(ACT_NAME), F.lit(0)), act_name)
    return F.filter(F.array_distinct(F.concat(of("CASE_NAME", case_names(q)), of("COURT", courts(q)), of(reference, sections(q)), of("ACT", acts))), lambda e: e["text"] != "")


def practice_area(q: Column, refs: Column) -> Column:
    low = F.lower(q)
    coded = F.lit(False)
    for p in CODE_PREFIXES:
        coded = coded | F.coalesce(F.try_element_at(refs, F.lit(1)).startswith(p), F.lit(False))
    out = F.lit("general")
    for area, signals in reversed(AREAS):
        hit = holds(low, signals)
        out = F.when(hit | coded if area == "criminal" else hit, area).otherwise(out)
    return out


def query_type(q: Column, norm: Column, refs: Column, names: Column, court_names: Column, uploaded: Column) -> Column:
    low = F.lower(q)
    vague = (F.size(refs) == 0) & (F.size(names) == 0) & (F.size(court_names) == 0) & holds(low, VAGUE)
    article = F.exists(refs, lambda r: r.startswith("Article "))
    return (
        F.when(uploaded, "document_specific").when(holds(norm, COMPARISONS) & (F.size(court_names) >= 2), "comparative").when(holds(norm, MULTI_HOP), "multi_hop_doctrine")
        .when(holds(norm, CONSTITUTIONAL) | article, "constitutional").when(q.rlike(REPORTER) | (F.size(names) > 0), "case_specific").when(F.size(refs) > 0, "statutory_lookup")
        .when(vague, "vague_natural").otherwise("general_legal")
    )


CRIMINAL = "^(IPC|CrPC|Indian Evidence Act|BNS|BNSS|BSA) "


def equivalents(queries: DataFrame, mappings: DataFrame) -> DataFrame:
    """query_id, equivalents: what the criminal-code references of queries (query_id, sections, reference_date) are called in the new codes, less what the query says itself."""
    r = queries.select("query_id", "reference_date", F.posexplode("sections").alias("position", "reference")).where(F.col("reference").rlike(CRIMINAL))
    own = r.groupBy("query_id").agg(F.collect_set("reference").alias("own"))
    found = references_expanded(r, mappings).join(own, "query_id")
    return found.select("query_id", F.filter(F.array_except("references", "own"), lambda x: x.rlike("^(BNS|BNSS|BSA) ")).alias("equivalents"))


def analyzed(queries: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """queries (query_id, query, uploaded, and reference_date, else the day of the cutover) with the whole analysis; mappings (of codes) give the references' equivalents, which make a query time-sensitive, too."""
    q = queries.withColumn("normalized", normalized_query(F.col("query"))).withColumn("sections", sections(F.col("query"))).withColumn("case_names", case_names(F.col("query"))).withColumn("courts", courts(F.col("query")))
    q = q.withColumn("practice_area", practice_area(F.col("query"), F.col("sections")))
    q = q.withColumn("query_type", query_type(F.col("query"), F.col("normalized"), F.col("sections"), F.col("case_names"), F.col("courts"), F.col("uploaded")))
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (k, v[i])]), F.col("query_type"))
    none = F.array().cast("array<string>")
    if mappings is None:
        q = q.withColumn("equivalents", none)
    else:
        dated = q if "reference_date" in q.columns else q.withColumn("reference_date", F.to_date(F.lit(CUTOVER)))
        q = q.join(equivalents(dated, mappings), "query_id", "left").withColumn("equivalents", F.coalesce("equivalents", none))
    timely = holds(F.col("normalized"), TEMPORAL) | (F.size("equivalents") > 0) | F.exists("sections", lambda r: r.rlike("^(IPC|CrPC|BNS|BNSS|BSA) "))
    return q.withColumn("confidence", pick(0)).withColumn("pipeline", pick(1)).withColumn("time_sensitive", timely).withColumn("jurisdiction", F.coalesce(F.try_element_at("courts", F.lit(1)), F.lit("All India")))
