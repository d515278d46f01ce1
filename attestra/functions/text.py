"""Text functions over columns: normalising, tokens, references, sentences, claims. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, aliases and synonyms that results depend on.
CODES = "ipc|crpc|bns|bnss|bsa"
SECTION_CODE = rf"(?i)\b(?:section|s\.)\s*([0-9]+[a-z]?)\s*({CODES})\b"
CODE_SECTION = rf"(?i)\b({CODES})\s*([0-9]+[a-z]?)\b"
ARTICLE = r"(?i)\barticle\s*([0-9]+[a-z]?)\b"
CITATIONS = [r"(?i)\bair\s+\d{4}\s+sc\s+\d+\b", r"(?i)\(\d{4}\)\s*\d+\s*scc\s*\d+", r"(?i)\b\d{4}\s+insc\s+\d+\b"]
WORD = r"[a-z]+[a-z0-9]*|\d+[a-z]?"
ACT_ALIASES = {
    "indian penal code": ["ipc", "indian penal code"],
    "bharatiya nyaya sanhita": ["bns", "bharatiya nyaya sanhita"],
    "code of criminal procedure": ["crpc", "code of criminal procedure"],
    "bharatiya nagarik suraksha sanhita": ["bnss", "bharatiya nagarik suraksha sanhita"],
    "indian evidence act": ["indian evidence act", "evidence act"],
    "bharatiya sakshya adhiniyam": ["bsa", "bharatiya sakshya adhiniyam"],
    "bharatiya sakshya": ["bsa"],
    "constitution of india": ["constitution", "constitution of india"],
}
SYNONYMS = {
    "murder": ["culpable homicide", "ipc 302", "bns 101"],
    "bail": ["anticipatory bail", "crpc 437", "bnss 480"],
    "privacy": ["article 21", "fundamental right"],
}
REPORTER = r"\b(?:AIR\s+\d{4}\s+[A-Z]{1,4}\s+\d+|\(\d{4}\)\s+\d+\s+[A-Z]{2,10}\s+\d+)\b"
SENTENCE_END = r"(?<=[.!?])\s+"
GROUNDING_STOPWORDS = ["a", "an", "and", "any", "as", "at", "by", "for", "from", "held", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "was", "were"]
NEGATIONS = ["cannot", "denied", "fails", "never", "no", "none", "not", "without"]


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_any(text: Column, parts: list[str]) -> Column:
    """Whether text holds one of the parts: a cheap guard before a pattern."""
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def prepared(text: Column) -> Column:
    """Lower case, initials joined, `vs` as `v`."""
    initials = lambda t: F.when(t.rlike(r"[a-z]\.[a-z]\."), F.regexp_replace(t, r"(?:\G(?!^)|\b(?=(?:[a-z]\.){2}))([a-z])\.", "$1")).otherwise(t)
    versus = lambda t: F.when(t.rlike(r"\bv"), F.regexp_replace(t, r"\bvs?\.?\b", " v ")).otherwise(t)
    return let(let(F.lower(text), initials), versus)


def spaced(text: Column) -> Column:
    """All but letters, digits and brackets as single spaces."""
    # what is a single space already is passed over
    return F.trim(F.regexp_replace(text, r"[^a-z0-9() ][^a-z0-9()]*| [^a-z0-9()]+", " "))


def normalized(text: Column) -> Column:
    """Lower case, initials joined, `vs` as `v`, all but letters, digits and brackets as single spaces."""
    return spaced(prepared(text))


def section_reference_tokens(code: Column, section: Column) -> Column:
    c, s = F.lower(code), F.lower(section)
    return F.array(c, s, F.concat_ws("_", c, s), F.concat(F.lit("section_"), s))


def article_reference_tokens(article: Column) -> Column:
    a = F.lower(article)
    return F.array(a, F.concat(F.lit("article_"), a))


def _matches(text: Column, pattern: str, build) -> Column:
    """build(match) for each whole match, flattened."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build))


def reference_tokens(norm: Column) -> Column:
    """Tokens of statute references. Section-first forms yield their parts in the order in which they stand."""
    first = lambda m: section_reference_tokens(F.regexp_extract(m, SECTION_CODE, 1), F.regexp_extract(m, SECTION_CODE, 2))
    second = lambda m: section_reference_tokens(F.regexp_extract(m, CODE_SECTION, 1), F.regexp_extract(m, CODE_SECTION, 2))
    third = lambda m: article_reference_tokens(F.regexp_extract(m, ARTICLE, 1))
    none = F.array().cast("array<string>")
    coded = F.when(has_any(norm, ["ipc", "crpc", "bns", "bsa"]), F.concat(_matches(norm, SECTION_CODE, first), _matches(norm, CODE_SECTION, second))).otherwise(none)
    return F.concat(coded, F.when(F.contains(norm, F.lit("article")), _matches(norm, ARTICLE, third)).otherwise(none))


def citation_tokens(norm: Column) -> Column:
    one = lambda m: F.array(F.regexp_replace(squeeze(F.regexp_replace(m, r"[()]", "")), " ", "_"))
    found = lambda t: F.concat(*[_matches(t, p, one) for p in CITATIONS])
    return F.when(has_any(norm, ["air ", "scc", "insc"]), found(norm)).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Distinct tokens in order: references, citations, words. Words are read from the text as it stands; it is spaced anew only where it may hold references."""

    def of(p: Column) -> Column:
        referring = has_any(p, ["ipc", "crpc", "bns", "bsa", "article"]) & p.rlike(r"(?:\b|\d[a-z]?)(?:ipc|crpc|bns|bsa)|\barticle")
        citing = has_any(p, ["air", "scc", "insc"]) & p.rlike(r"\bair[^a-z]|scc|insc")
        named = let(spaced(p), lambda n: F.concat(reference_tokens(n), citation_tokens(n)))
        return tokens_of(F.when(referring | citing, named).otherwise(F.array().cast("array<string>")), p)

    return let(prepared(text), of)


def tokens_of(named: Column, prepared_: Column) -> Column:
    """Tokens of a prepared text, given those of its references and citations."""
    return F.filter(F.array_distinct(F.concat(named, F.regexp_extract_all(prepared_, F.lit(WORD), F.lit(0)))), lambda t: t != "")


def aliases(act_name: Column) -> Column:
    """Other names of the acts that a name holds."""
    n = squeeze(F.regexp_replace(F.lower(act_name), r"[^a-z0-9 ]+", " "))
    parts = [F.when(F.contains(n, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in ACT_ALIASES.items()]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def synonyms(query: Column) -> Column:
    q = squeeze(F.lower(query))
    parts = [F.when(F.contains(q, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in SYNONYMS.items()]
    return F.array_distinct(F.concat(*parts))


def combined_text(*parts: Column) -> Column:
    """Non-empty parts joined by spaces."""
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def document_tokens(text: Column, act_name: Column, section: Column) -> Column:
    """Tokens of a document, its act's other names, and its section under each of them."""
    empty = F.array().cast("array<string>")
    of_alias = lambda a: F.concat(
        tokens(a),
        F.when(section.isNull(), empty).when(F.contains(a, F.lit(" ")), tokens(F.concat(a, F.lit(" section "), section))).otherwise(section_reference_tokens(a, section)),
    )
    own = F.when(section.isNotNull(), F.array(F.concat(F.lit("section_"), F.lower(section)))).otherwise(empty)
    return F.array_distinct(F.concat(tokens(text), F.flatten(F.transform(aliases(act_name), of_alias)), own))


def query_tokens(query: Column, expansions: Column | None = None) -> Column:
    """Tokens of a query and of its expansions; what repeats among them counts again."""
    more = F.flatten(F.transform(F.concat(synonyms(query), expansions) if expansions is not None else synonyms(query), tokens))
    return F.concat(tokens(query), more)


def code_references(query: Column) -> Column:
    """`CODE n` for every criminal-code reference, distinct in order."""
    q = squeeze(query)
    first = lambda m: F.concat_ws(" ", F.upper(F.regexp_extract(m, SECTION_CODE, 2)), F.upper(F.regexp_extract(m, SECTION_CODE, 1)))
    second = lambda m: F.concat_ws(" ", F.upper(F.regexp_extract(m, CODE_SECTION, 1)), F.upper(F.regexp_extract(m, CODE_SECTION, 2)))
    return F.array_distinct(F.concat(F.transform(F.regexp_extract_all(q, F.lit(SECTION_CODE), F.lit(0)), first), F.transform(F.regexp_extract_all(q, F.lit(CODE_SECTION), F.lit(0)), second)))


def overlap(left: Column, right: Column) -> Column:
    """Share of left's distinct elements that right holds; 0 if either is empty."""
    n = F.size(F.array_distinct(left))
    return F.when((n == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / F.greatest(n, F.lit(1)))


def overlap_count(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def content_tokens(text: Column) -> Column:
    return F.array_except(tokens(text), F.array(*map(F.lit, GROUNDING_STOPWORDS)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def first_sentence(text: Column, limit: int = 220) -> Column:
    """Up to the first full stop, else the first exclamation mark, else the first question mark; else cut."""
    t = squeeze(text)
    out = F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substr(t, F.lit(1), F.lit(limit))), F.lit("...")))
    for d in ("?", "!", "."):
        out = F.when(F.contains(t, F.lit(d)), F.concat(F.trim(F.substring_index(t, d, 1)), F.lit(d))).otherwise(out)
    return out


def claim_text(paragraph: Column) -> Column:
    """White space collapsed, none before punctuation."""
    return F.regexp_replace(squeeze(paragraph), r"\s+([.,;:!?])", "$1")


def packed_sentences(text: Column, max_words: int) -> Column:
    """Sentences packed in order into chunks of at most max_words words; a sentence is never cut."""
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        n = words(s)
        over = (acc["n"] > 0) & (acc["n"] + n > max_words)
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(over | (acc["cur"] == ""), s).otherwise(F.concat_ws(" ", acc["cur"], s)).alias("cur"),
            F.when(over, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(sentences(text), start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def sliced(text: Column, size: int = 48) -> Column:
    """Slices of fixed length."""
    n = F.char_length(text)
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(at, lambda i: F.substr(text, i + 1, F.lit(size))))


def parties(title: Column) -> Column:
    """(appellant, respondent) of `A v B`, by the first of ` v `, ` vs `, ` vs. ` that stands in it."""
    out = F.lit(None).cast("struct<appellant:string,respondent:string>")
    for d in (" vs. ", " vs ", " v "):
        at = F.instr(title, d)
        both = F.struct(F.trim(F.substr(title, F.lit(1), at - 1)).alias("appellant"), F.trim(F.substr(title, at + len(d), F.char_length(title))).alias("respondent"))
        out = F.when(at > 0, both).otherwise(out)
    return out


def parsed_date(value: Column) -> Column:
    """ISO dates and `Month d, yyyy`; else null."""
    return F.coalesce(F.to_date(F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(value, F.lit("MMMM d, yyyy"))))


def numeric_token(value: Column) -> Column:
    """Digits that character recognition took for letters."""
    return F.translate(value, "OoIl", "0011")


def case_name_key(name: Column) -> Column:
    """Lower case, `vs.` and `vs` as `v`, no stops and commas, single spaces."""
    n = F.regexp_replace(F.regexp_replace(F.lower(name), r"vs\.", "v"), "vs", "v")
    return F.trim(F.replace(F.regexp_replace(n, "[.,]", " "), F.lit("  "), F.lit(" ")))


def party_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")
