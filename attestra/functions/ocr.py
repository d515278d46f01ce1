"""Clean-up of recognised legal text: spellings, sections, citations, parties."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import has_any, let, numeric_token, squeeze

# Corrections with their labels, names of codes, citation forms.
CORRECTIONS = [
    (r"(?i)\bsectl[o0]n\b", "Section", "section_spelling"),
    (r"(?i)\bsecti[o0]n\b", "Section", "section_spelling"),
    (r"(?i)\bsecfion\b", "Section", "section_spelling"),
    (r"(?i)\bartlcle\b", "Article", "article_spelling"),
    (r"(?i)\bpetltloner\b", "petitioner", "party_label_spelling"),
    (r"(?i)\brespondent\b", "respondent", "party_label_spelling"),
    (r"(?i)\bappeliant\b", "appellant", "party_label_spelling"),
    (r"(?i)\bcomplalnant\b", "complainant", "party_label_spelling"),
    (r"\bA1R\b", "AIR", "air_reporter"),
    (r"(?i)\b0nLine\b", "OnLine", "online_reporter"),
]
#: What a text must hold in lower case, before any correction, for each of them.
HELD = ["sect", "sect", "secfion", "artlcle", "petltloner", "respondent", "appeliant", "complalnant", "a1r", "0nline"]
CODES = [
    ("code of criminal procedure", "CrPC"),
    ("constitution of india", "Constitution of India"),
    ("specific relief act", "Specific Relief Act"),
    ("indian penal code", "IPC"),
    ("crpc", "CrPC"),
    ("bnss", "BNSS"),
    ("ipc", "IPC"),
    ("lpc", "IPC"),
    ("bns", "BNS"),
    ("bsa", "BSA"),
]
AIR = r"\bAIR\s+([0-9OIl]{4})\s+([A-Za-z]{2,5})\s+([0-9OIl]{1,5})\b"
SCC = r"\(([0-9OIl]{4})\)\s*([0-9OIl]{1,3})\s*SCC\s+([0-9OIl]{1,5})\b"
ONLINE = r"(?i)\b([0-9OIl]{4})\s*SCC\s*OnLine\s*([A-Za-z]{1,5})\s*([0-9OIl]{1,6})\b"
CASE_STYLE = r"([A-Z][A-Za-z0-9&.,' -]{1,80}?)\s+(?:v\.|vs\.?|versus)\s+([A-Z][A-Za-z0-9&.,' -]{1,80}?)(?=[.,]|$)"
PARTY_LABEL = r"(?i)\b(?:petitioner|respondent|appellant|complainant)\b\s*[:.-]\s*([A-Za-z0-9&.,' -]{2,100}?)(?=(?:\s+\b(?:petitioner|respondent|appellant|complainant)\b\s*[:.-])|$)"
SUFFIX = r"\b(private limited|pvt\.?\s*ltd\.?|limited|ltd\.?)\b"
SAME = 0.84
MARK = "\x01"


def rewritten(text: Column, pattern: str, build) -> Column:
    """text with build(match) in place of every match."""
    cut = F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("")), pattern, f"{MARK}$0{MARK}"), MARK)
    return F.array_join(F.transform(cut, lambda p, i: F.when(i % 2 == 1, build(p)).otherwise(p)), "")


def matches(text: Column, pattern: str, build) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)


def _start(text: Column) -> Column:
    return F.struct(text.alias("text"), F.array().cast("array<string>").alias("found"))


def _fold(text: Column, steps: list) -> Column:
    """(text, found) after every step (fits: text -> whether there is anything to do, step: text -> new text, what is found in it); each step's text is made once, and none where nothing fits."""
    state = _start(text)
    for fits, step in steps:
        state = let(state, _taken(fits, step))
    return state


def _taken(fits, step):
    def run(s: Column) -> Column:
        new, found = step(s["text"])
        return F.when(fits(s["text"]), F.struct(new.alias("text"), F.concat(s["found"], found).alias("found"))).otherwise(s)

    return run


def _rewriting(pattern: str, build):
    return lambda t: (rewritten(t, pattern, build), matches(t, pattern, build))


def _parts(state: Column) -> tuple[Column, Column]:
    return state["text"], F.array_distinct(state["found"])


def corrections(text: Column) -> Column:
    """(text, found): text with spellings corrected, and the labels of the corrections that fitted. A pattern is tried only on texts that hold what it needs."""

    def of(low: Column) -> Column:
        fits = lambda p, held: lambda t: F.contains(low, F.lit(held)) & t.rlike(p)
        labelled = lambda p, to, label: lambda t: (F.regexp_replace(t, p, to), F.array(F.lit(label)))
        return _fold(text, [(fits(p, held), labelled(p, to, label)) for (p, to, label), held in zip(CORRECTIONS, HELD)])

    return let(F.lower(text), of)


def corrected(text: Column) -> tuple[Column, Column]:
    """Text with spellings corrected, and the labels of the corrections that fitted, each once."""
    return _parts(corrections(text))


def _section(name: str, code: str) -> tuple:
    pattern = rf"(?i)\b(?:u/s|u\.s\.|section|sec\.?)\s*([0-9OIl]{{1,4}}[A-Z]?)\s*{name}\b"
    return pattern, lambda m: F.concat(F.lit("Section "), F.upper(numeric_token(F.regexp_extract(m, pattern, 1))), F.lit(f" {code}"))


def sections(text: Column) -> Column:
    """(text, found) of with_sections. Texts without a word for section stay as they are."""
    some = lambda low: has_any(low, ["u/s", "u.s.", "sec"])
    # a code's section may be written by its long name in an earlier step
    held = lambda low, code: lambda t: has_any(low, [n for n, c in CODES if c == code] + [MARK])
    steps = lambda low: [(held(low, code), _rewriting(*_section(name, code))) for name, code in CODES]
    return let(F.lower(text), lambda low: F.when(some(low), _fold(text, steps(low))).otherwise(_start(text)))


def with_sections(text: Column) -> tuple[Column, Column]:
    """Text with `u/s 302 ipc` and its kin as `Section 302 IPC`, letters taken for digits put right; and these sections, by code, each once."""
    return _parts(sections(text))


def citations(text: Column) -> Column:
    """(text, found) of with_citations."""
    g = lambda m, p, i: numeric_token(F.regexp_extract(m, p, i))
    kinds = [
        (AIR, lambda m: F.concat_ws(" ", F.lit("AIR"), g(m, AIR, 1), F.upper(F.regexp_extract(m, AIR, 2)), g(m, AIR, 3))),
        (SCC, lambda m: F.concat(F.lit("("), g(m, SCC, 1), F.lit(") "), g(m, SCC, 2), F.lit(" SCC "), g(m, SCC, 3))),
        (ONLINE, lambda m: F.concat_ws(" ", g(m, ONLINE, 1), F.lit("SCC OnLine"), F.upper(F.regexp_extract(m, ONLINE, 2)), g(m, ONLINE, 3))),
    ]
    fits = [lambda t: has_any(t, ["AIR", MARK]), lambda t: has_any(t, ["SCC", MARK]), lambda t: t.rlike(f"(?i)scc|{MARK}")]
    return _fold(text, [(f, _rewriting(*k)) for f, k in zip(fits, kinds)])


def with_citations(text: Column) -> tuple[Column, Column]:
    """Text with AIR, SCC and SCC OnLine citations, in their usual form, digits put right; and these citations, by kind, each once."""
    return _parts(citations(text))


def parties_found(text: Column) -> Column:
    """Sides of case names in order, then what stands behind labels, tidied; empty ones left out."""
    none = F.array().cast("array<string>")
    sides = F.flatten(matches(text, CASE_STYLE, lambda m: F.array(F.regexp_extract(F.concat(m, F.lit(",")), CASE_STYLE, 1), F.regexp_extract(F.concat(m, F.lit(",")), CASE_STYLE, 2))))
    sides = F.when(has_any(text, ["v.", "vs", "versus"]) & text.rlike(r"\s(?:v\.|vs|versus)"), sides).otherwise(none)
    labelled = F.when(text.rlike(r"(?i)(?:petitioner|respondent|appellant|complainant)\s*[:.-]"), F.regexp_extract_all(text, F.lit(PARTY_LABEL), F.lit(1))).otherwise(none)
    tidy = lambda p: F.regexp_replace(squeeze(F.replace(p, F.lit(" ,"), F.lit(","))), r"^[ ,.-]+|[ ,.-]+$", "")
    return F.filter(F.transform(F.concat(sides, labelled), tidy), lambda p: p != "")


def normalised(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with normalized_text, citations, sections, parties (clusters), corrections of their recognised text."""
    d = documents.withColumn("_s", corrections(squeeze(F.col(text)))).withColumn("corrections", F.array_distinct("_s.found"))
    d = d.withColumn("_v", F.regexp_replace("_s.text", r"(?i)\b(vs\.?|versus)\b", "v.")).withColumn("_s", sections(F.col("_v"))).withColumn("sections", F.array_distinct("_s.found"))
    d = d.withColumn("_s", citations(F.col("_s.text"))).withColumn("citations", F.array_distinct("_s.found")).withColumn("normalized_text", F.col("_s.text"))
    return d.withColumn("parties", party_clusters(parties_found(F.col("normalized_text")))).drop("_s", "_v")


def compare_key(value: str) -> str:
    """Lower case, letters and digits alike made one, no company forms, letters and digits only."""
    alike = value.lower().translate(str.maketrans("01v", "olu"))
    return re.sub(r"[^a-z0-9]+", "", SUFFIX_RE.sub("", alike))


SUFFIX_RE = re.compile(SUFFIX, re.I)


def clusters(names: list[str]) -> list[dict]:
    """Names in order join the first cluster whose first name is the same or nearly so."""
    found: list[list[str]] = []
    for name in names:
        key = compare_key(name)
        home = next((c for c in found if (k := compare_key(c[0])) == key or difflib.SequenceMatcher(None, k, key).ratio() >= SAME), None)
        if home is None:
            found.append([name])
        elif name not in home:
            home.append(name)
    return [{"canonical": max(c, key=lambda x: (len(x), x)), "aliases": c} for c in found]


CLUSTERS = ArrayType(StructType([StructField("canonical", StringType()), StructField("aliases", ArrayType(StringType()))]))


@F.pandas_udf(CLUSTERS)
def party_clusters(names: pd.Series) -> pd.Series:
    """Order decides the clusters and difflib their likeness, which native functions cannot express."""
    return names.map(lambda n: clusters(list(n)) if n is not None else [])
