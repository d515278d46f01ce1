"""Published queries: functions of text over the tables. Every text is whole; references, names and the like are added by number, so that all branches occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks, ocr
from ..functions import text as T
from ..operators import answers as A
from ..operators import cases as K
from ..operators import citations as C
from ..operators import collections as L
from ..operators import graph as G
from ..operators import hyde as H
from ..operators import routing as R
from ..operators import state as S
from ..operators import verify as V
from ..sources import html, uploads
from ..sources.ingest import collection
from .document_queries import UNESCAPED
from .domain import Domain
from .retrieval_queries import COURT

#: What is added to a text by its number: strings as they stand, (m, a) as the number modulo m plus a.
Form = list[str | tuple[int, int]]
REFERENCES: list[Form] = [
    ["Section ", (511, 1), " IPC"], ["s. ", (438, 1), "A CrPC and BNS ", (358, 1)], ["Article ", (395, 1), "A and article ", (51, 1)], ["AIR ", (70, 1950), " SC ", (1000, 1)], ["(", (70, 1950), ") ", (12, 1), " SCC ", (900, 1)],
    ["K.S. Puttaswamy vs. Union ", (20, 2000), " INSC ", (999, 1)], [""], ["Section ", (200, 1), " alone"],
]
RECOGNISED: list[Form] = [
    ["u/s ", (500, 1), "O crpc, A1R ", (70, 1950)], ["Sectlon ", (90, 10), " indian penal code and section 1", (90, 10), " bns"], ["(2O1", (9, 0), ") 1O SCC ", (99, 1)], ["AIR 19l", (9, 0), " sc ", (99, 1)], ["202", (9, 0), " scc online del ", (99, 1)],
    ["artlcle ", (99, 1), " and the petltloner"], ["plain"], ["Sec. 3l", (9, 0), " lpc, 0nLine, Respondent"],
]
NAMED: list[Form] = [
    ["What was held in Maneka Gandhi v Union of India?"], ["Section ", (511, 1), " IPC in the Delhi HC"], ["jammu and kashmir high court on article ", (395, 1)], ["A. K. Roy vs. State of Goa, ", (90, 1), " Specific Relief Act"], ["Indian Contract Act before the Supreme Court"],
    ["no names"], ["odisha hc and madras high court"],
]
ASKED: list[Form] = [["my landlord changed the locks"], ["anticipatory relief after an arrest"], ["murder trial"], ["no salary since May"], ["privacy and bail"], ["pay"]]
CITING: list[Form] = [["it was followed here"], ["this overruled that"], ["distinguished from the case"], ["doubted and approved"], ["relied on it"], ["reverses the order"], ["it clarifies much"], ["affirmed"], ["disapproved"], ["seen"]]

#: What a case is about, and the stage it is at.
STATED: list[Form] = [
    ["the landlord in a revision"], ["a charge sheet on bail"], ["a chargesheet in a trial"], ["divorce and appeal"], ["gst execution"], ["the company in trial"], ["wages under investigation"], ["an arbitral award"], ["a consumer case"], ["a fundamental right"], ["nothing of note"],
    ["the civil suit"], ["maintainability alone"], ["specific relief act, consumer"], ["Section ", (511, 1), " IPC"],
]


def form(forms: list[Form], i: Column) -> Column:
    part = lambda p: F.lit(p) if isinstance(p, str) else (i % p[0] + p[1]).cast("string")
    out = F.lit("")
    for k, f in enumerate(forms):
        out = F.when(i % len(forms) == k, F.concat(*map(part, f))).otherwise(out)
    return out


def form_sql(forms: list[Form], i: str) -> str:
    part = lambda p: f"'{p}'" if isinstance(p, str) else f"CAST({i} % {p[0]} + {p[1]} AS VARCHAR)"
    return f"CASE {i} % {len(forms)} " + " ".join(f"WHEN {k} THEN " + " || ".join(map(part, f)) for k, f in enumerate(forms)) + " END"


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def digest(c: Column) -> Column:
    return F.md5(joined(F.sort_array(c)))


def added(d: Domain, table: str, key: str, forms: list[Form], first: bool = False) -> DataFrame:
    """i (the number) and x: the table's texts with what is added."""
    i = F.col(key)
    parts = [form(forms, i), F.coalesce("text", F.lit(""))]
    return d.table(table).select(i.alias("i"), F.concat_ws(" ", *(parts if first else reversed(parts))).alias("x"), "*")


def of_documents(name: str, forms: list[Form], build, first: bool = False):
    """A query over documents: doc_id and the columns that build gives of the text x."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = added(Domain(spark, sf_dir), "documents", "doc_id", forms, first)
        return d.select("doc_id", *[c.alias(n) for n, c in build(F.col("x"), F.col("i")).items()])

    run.__name__ = name
    return run


def of_turns(name: str, forms: list[Form], build):
    """A query over the turns of conversations."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Domain(spark, sf_dir).table("conversations")
        i = F.col("conv_id") + F.col("turn")
        d = t.select("conv_id", "turn", i.alias("i"), F.concat_ws(" ", form(forms, i), F.coalesce("text", F.lit(""))).alias("x"))
        return d.select("conv_id", "turn", *[c.alias(n) for n, c in build(F.col("x"), F.col("i")).items()])

    run.__name__ = name
    return run


def of_rows(name: str, table: str, keys: list[str], build):
    """A query over another table: its keys and the columns that build gives."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Domain(spark, sf_dir).table(table)
        return d.select(*keys, *[c.alias(n) for n, c in build().items()])

    run.__name__ = name
    return run


def pick(values: list[str | None], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def pick_sql(values: list[str | None], i: str) -> str:
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"])[{i} % {len(values)} + 1]"


ACTS = ["Indian Penal Code, 1860", "Bharatiya Nyaya Sanhita", "Code of Criminal Procedure", "BHARATIYA Nagarik-Suraksha Sanhita", "Indian Evidence Act", "Bharatiya Sakshya Adhiniyam", "Constitution of India", "Companies Act", "Lease rules"]
HEADERS = ["Headnote", "Issue one", None, "Observations", "Holding", "", "Facts"]
TITLES = ["Applicable Law", "Key Authorities", "Legal Position", "Statutes", "Cases", "Remedies"]
SHORT = ["IPC", "crpc", "Indian Evidence Act", "BNSS", "Specific Relief Act", "iea", "lease"]


def _section_form(i: Column) -> Column:
    number, act = (i % 400 + 1).cast("string"), pick(SHORT, F.floor(i / 4))
    return F.when(i % 4 == 0, F.concat_ws(" ", F.lit("Section"), number, act)).when(i % 4 == 1, F.concat_ws(" ", act, number)).when(i % 4 == 2, F.concat_ws(" ", F.lit("Section"), F.concat(number, F.lit("A")), act)).otherwise(F.concat_ws(" ", F.lit("Article"), number))


def _section_sql(i: str) -> str:
    act = pick_sql(SHORT, f"({i} // 4)")
    return f"CASE {i} % 4 WHEN 0 THEN 'Section ' || ({i} % 400 + 1) || ' ' || {act} WHEN 1 THEN {act} || ' ' || ({i} % 400 + 1) WHEN 2 THEN 'Section ' || ({i} % 400 + 1) || 'A ' || {act} ELSE 'Article ' || ({i} % 400 + 1) END"


def _words_of_part() -> Column:
    i = F.col("p_partkey")
    return F.concat_ws(" ", F.when(i % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")), pick(["of the", "AND", "and  relief"], i), F.lit("act"))


def _marked(text: Column) -> Column:
    """Every fifth word behind a mark such as (1) or (b)."""
    w = F.split(text, " ")
    return F.array_join(F.transform(w, lambda x, n: F.when(n % 5 == 2, F.concat(F.lit("("), F.when(n % 2 == 0, (n / 5).cast("int").cast("string")).otherwise("b"), F.lit(") "), x)).otherwise(x)), " ")


def statute_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Domain(spark, sf_dir).table("benchmark")
    text = F.when(F.col("item_id") % 7 == 0, F.col("text")).otherwise(_marked(F.col("text")))
    return b.select("item_id", F.posexplode(chunks.statute_parts(text)).alias("n", "part"))


def party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against suppliers' nations, as case names, behind labels, or not at all."""
    c = Domain(spark, sf_dir).table("customer")
    i, a, b = F.col("c_custkey"), F.concat(F.lit("Buyer "), F.col("c_custkey").cast("string")), F.concat(F.lit("State No "), F.col("c_nationkey").cast("string"))
    text = F.when(i % 3 == 0, F.concat(a, F.lit(" v. "), b, F.lit(", in appeal"))).when(i % 3 == 1, F.concat(F.lit("Petitioner: "), a, F.lit(" Respondent: "), b)).otherwise(F.lit("nobody"))
    return c.select("c_custkey", joined(ocr.parties_found(text)).alias("result"))


def edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cites two others by number, by passages that say how or not; some cite nothing that is there, some state the kind."""
    d = Domain(spark, sf_dir)
    t = added(d, "documents", "doc_id", CITING)
    i = F.col("doc_id")
    cites = F.explode(F.array(F.concat(F.lit("AIR "), F.floor(i / 2).cast("string")), F.concat(F.lit("AIR "), (i * 2).cast("string")))).alias("reference")
    c = t.select(i.alias("source"), cites, pick([None, "refers_to", "Overrules ", "cites", None], F.floor(i / 3)).alias("explicit"), F.col("x").alias("text"))
    none = F.lit(None).cast("string")
    known = d.legal_documents().where("doc_id % 3 > 0").select("doc_id", F.concat(F.lit("AIR "), i.cast("string")).alias("citation"), none.alias("neutral_citation"), none.alias("source_document_ref"), none.alias("case_key"))
    return G.projected(c, known)


def indexed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per collection that documents fall into: how many, its dimension and distance, and the fields it indexes."""
    d = Domain(spark, sf_dir).legal_documents().select(collection(F.col("doc_type"), F.col("court")).alias("name"))
    fields = F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"], f["is_array"].cast("string"))), ",")
    return d.groupBy("name").agg(F.count("*").alias("n")).join(L.specs(spark).select("name", "dimension", "distance", fields.alias("fields")), "name")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).table("pages").select("page_id", F.try_element_at(html.lines(F.col("html")), F.lit(1)).alias("title"))


def placeholder_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).legal_documents().select("doc_id", C.placeholder_kind(F.col("doc_type")).alias("result"))


def hypothetical_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Domain(spark, sf_dir).table("conversations")
    i = F.col("conv_id") + F.col("turn")
    q = t.select("conv_id", "turn", F.concat_ws(" ", form(ASKED, i), "text").alias("query"), pick(["property", "criminal", "labour", "civil_law"], F.floor(i / 5)).alias("practice_area"))
    return H.drafts(q).select("conv_id", "turn", "strategy", "quality", F.size("anchors").alias("n_anchors"), F.md5("passage").alias("passage"))


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, citations and tokens of documents; a text is prepared and spaced once for all three."""
    p = added(Domain(spark, sf_dir), "documents", "doc_id", REFERENCES).select("doc_id", T.prepared(F.col("x")).alias("p"))
    n = p.withColumn("n", T.spaced(F.col("p"))).withColumns({"r": T.reference_tokens(F.col("n")), "c": T.citation_tokens(F.col("n"))})
    return n.select("doc_id", joined(F.col("r")).alias("references"), joined(F.col("c")).alias("citations"), digest(T.tokens_of(F.concat("r", "c"), F.col("p"))).alias("tokens"))


def _document_tokens(x: Column, i: Column) -> dict[str, Column]:
    section = F.when(i % 4 > 0, F.concat((i % 300 + 1).cast("string"), F.when(i % 3 == 0, "A").otherwise("")))
    return {"tokens": digest(T.document_tokens(x, pick(ACTS, i), section))}


def ocr_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised texts corrected, and the labels of the corrections; a text is corrected once for both."""
    s = added(Domain(spark, sf_dir), "documents", "doc_id", RECOGNISED).select("doc_id", ocr.corrections(F.col("x")).alias("s"))
    return s.select("doc_id", F.md5("s.text").alias("text"), joined(F.sort_array(F.array_distinct("s.found"))).alias("labels"))


def page_files(d: Domain) -> DataFrame:
    """Documents as pages of files, seven of them each: typed where a page has text enough, else recognised."""
    x = added(d, "documents", "doc_id", RECOGNISED)
    text = F.when(F.col("i") % 5 == 0, form(RECOGNISED, F.col("i"))).otherwise(F.col("x"))
    p = x.select(F.floor(F.col("i") / 7).cast("string").alias("path"), (F.col("i") % 7 + 1).cast("int").alias("page"), text.alias("text"), F.lit(0.5).alias("base"))
    return p.withColumn("kind", F.when(F.char_length(T.squeeze(F.col("text"))) >= uploads.TYPED, "typed_pdf").otherwise("scanned_pdf"))


def processed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of pages: mode, confidence, text, and the citations and sections of all pages in order."""
    f = uploads.files_merged(uploads.cleaned_pages(page_files(Domain(spark, sf_dir))))
    return f.select("path", "mode", "extraction_method", "page_count", "confidence", F.md5("raw_extracted_text").alias("raw_digest"), joined(F.col("citations")).alias("citations"), joined(F.col("sections")).alias("sections"))


def _case_kinds(x: Column, i: Column) -> dict[str, Column]:
    """Type and stage of a text; every seventh is charged with a section."""
    charged = F.when(i % 7 == 0, F.array(F.concat(F.lit("BNS "), number(i)))).otherwise(F.array().cast("array<string>"))
    return {"case_type": K.case_type(x, charged), "stage": K.first_of(x, K.STAGES)}


def _entities(x: Column, i: Column) -> dict[str, Column]:
    return {"result": joined(F.array_sort(F.transform(R.entities(x), lambda e: F.concat_ws(":", e["kind"], e["text"]))))}


p, o = (lambda: F.col("p_partkey")), (lambda: F.col("o_orderkey"))
number = lambda i: F.concat((i % 395 + 1).cast("string"), F.when(i % 3 == 0, "A").otherwise(""))
written = lambda: F.when(o() % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(o() % 3 == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.col("o_orderstatus"))
moment = lambda: F.when(o() % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(o() % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'10:30:00")).otherwise(F.lit("soon"))
QUERIES = {
    f.__name__: f
    for f in [
        token_lists,
        of_rows("section_tokens", "part", ["p_partkey"], lambda: {"result": joined(T.section_reference_tokens(pick(["BNS", "CrPC", "IPC"], p()), number(p())))}),
        of_rows("article_tokens", "part", ["p_partkey"], lambda: {"result": joined(T.article_reference_tokens(number(p())))}),
        of_rows("act_aliases", "part", ["p_partkey"], lambda: {"result": joined(F.array_sort(T.aliases(F.concat_ws(" ", pick(ACTS, p()), "p_name"))))}),
        of_turns("query_synonyms", ASKED, lambda x, i: {"result": joined(F.array_sort(T.synonyms(x)))}),
        of_turns("code_references", REFERENCES, lambda x, i: {"result": joined(F.array_sort(T.code_references(x)))}),
        of_documents("combined_texts", [[""]], lambda x, i: {"result": F.md5(T.combined_text(pick(HEADERS, i), F.col("text"), pick(ACTS + [None, ""], i)))}),
        of_documents("document_token_lists", REFERENCES, _document_tokens),
        of_rows("act_names", "part", ["p_partkey"], lambda: {"result": R.act_name(_words_of_part())}),
        of_turns("case_names", NAMED, lambda x, i: {"result": joined(F.array_sort(R.case_names(x)))}),
        of_turns("courts_named", NAMED, lambda x, i: {"result": joined(R.courts(x))}),
        of_turns("query_entities", NAMED, _entities),
        of_turns("case_types", STATED, _case_kinds),
        statute_parts,
        of_documents("judgment_kinds", [[""]], lambda x, i: {"result": chunks.judgment_kind(pick(HEADERS, i), F.col("text"))}),
        of_rows("numeric_tokens", "part", ["p_partkey"], lambda: {"result": T.numeric_token(F.concat_ws(" ", "p_name", "p_brand"))}),
        party_names,
        of_documents("ocr_sections", RECOGNISED, lambda x, i: {"result": joined(F.array_sort(ocr.with_sections(x)[1]))}),
        of_documents("ocr_citations", RECOGNISED, lambda x, i: {"result": joined(F.array_sort(ocr.with_citations(x)[1]))}),
        ocr_corrections,
        of_turns("claim_texts", [["Bail  was granted ."], [" a , b ;c"], ["x"]], lambda x, i: {"result": F.md5(T.claim_text(x))}),
        of_rows("statute_placeholders", "part", ["p_partkey"], lambda: {"result": A.statute_token(F.initcap("p_name"), number(p()))}),
        of_rows("case_placeholders", "supplier", ["s_suppkey"], lambda: {"result": A.case_token(pick(["Supreme Court", "Delhi High Court"], F.col("s_suppkey")), F.concat(F.lit("on "), F.col("s_name")))}),
        of_documents("resolved_texts", [["See [A] and [A] or [B]."], ["Nothing."], ["[B][A]"]], lambda x, i: {"result": F.md5(A.substituted(x, F.array(F.struct(F.lit("[A]").alias("token"), F.concat(F.lit("IPC, Section "), number(i)).alias("value")), F.struct(F.lit("[B]").alias("token"), F.lit("[C]").alias("value")))))}),
        of_rows("section_kinds", "part", ["p_partkey"], lambda: {"result": V.section_kind(F.concat_ws(" ", pick(TITLES, p()), "p_name"))}),
        of_rows("claim_statuses", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], lambda: {"result": V.claim_status(pick(["MISGROUNDED", "UNCERTAIN", "VERIFIED"], F.col("l_partkey")), F.col("l_suppkey") % 2 == 0)}),
        of_rows("grounding_statuses", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], lambda: {"result": V.grounding(F.col("l_partkey") % 101 / 100, pick(["ENTAILMENT", "NEUTRAL", "CONTRADICTION"], F.col("l_suppkey")))}),
        of_rows("canonical_sections", "part", ["p_partkey"], lambda: {"result": K.canonical_section(_section_form(p()))}),
        of_rows("statutes_involved", "orders", ["o_orderkey"], lambda: {"result": joined(F.array_sort(K.statute_names(F.array(*[F.concat_ws(" ", pick(SHORT, o() + k), number(o())) for k in (0, 3, 7)], F.lit("alone")))))}),
        of_rows("formatted_references", "part", ["p_partkey"], lambda: {"result": T.let(_section_form(p()), lambda r: T.let(S.code_reference(r), lambda c: F.concat_ws(" ", c["code"], c["section"])))}),
        edge_types,
        of_rows("case_keys", "customer", ["c_custkey"], lambda: {"result": T.case_name_key(F.concat("c_name", pick([" vs. ", " v ", " VS "], F.col("c_custkey")), "c_mktsegment", F.lit(", Goa.")))}),
        of_rows("title_parties", "customer", ["c_custkey"], lambda: {"result": F.concat_ws("|", *[T.parties(F.concat("c_name", pick([" vs. ", " v ", " vs ", " and "], F.col("c_custkey")), "c_mktsegment"))[k] for k in ("appellant", "respondent")])}),
        of_rows("written_dates", "orders", ["o_orderkey"], lambda: {"result": T.parsed_date(written()).cast("string")}),
        placeholder_kinds,
        of_rows("comparable_values", "orders", ["o_orderkey"], lambda: {"day": F.coalesce(F.date_format(L.comparable(moment(), "datetime"), "yyyy-MM-dd HH:mm"), F.lit("none")), "amount": L.comparable(F.when(o() % 4 == 0, F.col("o_totalprice").cast("string")).otherwise("n/a"), "integer").cast("double")}),
        of_documents("excerpts", REFERENCES, lambda x, i: {"result": F.md5(A.excerpt(x))}, first=True),
        page_titles,
        processed_uploads,
        hypothetical_drafts,
        indexed_fields,
    ]
}

# The same in SQL.
DOCS = lambda forms, first=False: "(SELECT doc_id, doc_id AS i, text, " + (f"{form_sql(forms, 'doc_id')} || ' ' || coalesce(text, '')" if first else f"coalesce(text, '') || ' ' || {form_sql(forms, 'doc_id')}") + " AS x FROM documents)"
TURNS = lambda forms: f"(SELECT conv_id, turn, conv_id + turn AS i, {form_sql(forms, '(conv_id + turn)')} || ' ' || coalesce(text, '') AS x FROM conversations)"
SORTED = "array_to_string(list_sort(list_distinct({0})), '|')"
INITIALS = r"list_reduce(list_prepend(lower({0}), list_distinct(regexp_extract_all(lower({0}), '\b(?:[a-z]\.){{2,}}'))), lambda t, r: replace(t, r, replace(r, '.', '')))"
NORM = rf"trim(regexp_replace(regexp_replace({INITIALS}, '\bvs?\.?\b', ' v ', 'g'), '[^a-z0-9()]+', ' ', 'g'))"
WORDS = r"regexp_extract_all({0}, '[a-z]+[a-z0-9]*|\d+[a-z]?')"
PAIR = "list_transform(list_zip(regexp_extract_all({0}, '{1}', {2}), regexp_extract_all({0}, '{1}', {3})), lambda z: {4})"
SECTION_PARTS = "[z[1], z[2], z[1] || '_' || z[2], 'section_' || z[2]]"
SC, CS = r"\b(?:section|s\.)\s*([0-9]+[a-z]?)\s*(ipc|crpc|bns|bnss|bsa)\b", r"\b(ipc|crpc|bns|bnss|bsa)\s*([0-9]+[a-z]?)\b"
REFS = "flatten(list_concat(" + PAIR.format("{0}", SC, 1, 2, SECTION_PARTS) + ", " + PAIR.format("{0}", CS, 1, 2, SECTION_PARTS) + r", list_transform(regexp_extract_all({0}, '\barticle\s*([0-9]+[a-z]?)\b', 1), lambda z: [z, 'article_' || z])))"
CITES = "list_transform(list_concat(" + ", ".join("regexp_extract_all({0}, '" + c + "')" for c in [r"\bair\s+\d{{4}}\s+sc\s+\d+\b", r"\(\d{{4}}\)\s*\d+\s*scc\s*\d+", r"\b\d{{4}}\s+insc\s+\d+\b"]) + r"), lambda c: replace(trim(regexp_replace(regexp_replace(c, '[()]', '', 'g'), '\s+', ' ', 'g')), ' ', '_'))"
ALL_TOKENS = f"list_concat({REFS}, {CITES}, {WORDS})"
ALIASES = "flatten([" + ", ".join(f"CASE WHEN contains({{0}}, '{k}') THEN {v!r} ELSE [] END" for k, v in T.ACT_ALIASES.items()) + "])"
ALIAS_NAME = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
CODED = lambda text, c, n: f"list_transform(list_zip(regexp_extract_all({text}, '{c}', {n}), regexp_extract_all({text}, '{c}', {3 - n})), lambda z: upper(z[1]) || ' ' || upper(z[2]))"
ACT_NAME = r"array_to_string(list_transform(string_split(" + SQUEEZE + r", ' '), lambda w: CASE WHEN w = upper(w) AND length(w) <= 5 THEN w WHEN lower(w) IN ('of', 'and', 'the') THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ')"
quoted = lambda p: p.replace("'", "''")
CASE_NAMES = rf"list_transform(regexp_extract_all(x, '{quoted(R.CASE_NAME)}', 1), lambda n: trim(regexp_replace(n, '(?i)^(?:What|How|Whether|Explain|Summari[sz]e|Tell me about)\b.*?\bin\s+', '')))"
COURTS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(x), '{quoted(p_)}') THEN '{n}' END" for n, p_ in R.COURTS) + "], lambda c: c IS NOT NULL)"
CASED = "CASE WHEN upper(z[1]) = 'CRPC' THEN 'CrPC' ELSE upper(z[1]) END || ' ' || upper(z[2])"
SECTIONS_SQL = (
    "list_concat(" + PAIR.format("x", R.CODE_REF, 2, 1, CASED) + ", " + PAIR.format("x", R.CODE_FIRST, 1, 2, CASED) + f", list_transform(regexp_extract_all(x, '{R.ARTICLE_REF}', 1), lambda z: 'Article ' || upper(z)), "
    + PAIR.format("x", R.ACT_REF, 2, 1, ACT_NAME.format("z[1]") + " || ' ' || upper(z[2])") + ")"
)
ACTS_SQL = f"list_transform(regexp_extract_all(x, '{R.ACT_NAME}'), lambda n: {ACT_NAME.format('n')})"
OCR_NUMBER = "translate({0}, 'OoIl', '0011')"
OCR_SECTIONS = "list_concat(" + ", ".join(rf"list_transform(regexp_extract_all(x, '(?i)\b(?:u/s|u\.s\.|section|sec\.?)\s*([0-9OIl]{{1,4}}[A-Z]?)\s*{name}\b', 1), lambda n: 'Section ' || upper({OCR_NUMBER.format('n')}) || ' {code}')" for name, code in ocr.CODES) + ")"


def _three(pattern: str, build: str) -> str:
    return f"list_transform(list_zip(regexp_extract_all(x, '{pattern}', 1), regexp_extract_all(x, '{pattern}', 2), regexp_extract_all(x, '{pattern}', 3)), lambda z: {build})"


N1, N2, N3 = (OCR_NUMBER.format(f"z[{k}]") for k in (1, 2, 3))
OCR_CITATIONS = "list_concat(" + ", ".join([_three(ocr.AIR, f"'AIR ' || {N1} || ' ' || upper(z[2]) || ' ' || {N3}"), _three(ocr.SCC, f"'(' || {N1} || ') ' || {N2} || ' SCC ' || {N3}"), _three(ocr.ONLINE, f"{N1} || ' SCC OnLine ' || upper(z[2]) || ' ' || {N3}")]) + ")"


def _corrected() -> str:
    """One correction after the other, with its label where it fits."""
    sql = f"(SELECT doc_id, x, CAST([] AS VARCHAR[]) AS labels FROM {DOCS(RECOGNISED)})"
    for pattern, to, label in ocr.CORRECTIONS:
        sql = f"(SELECT doc_id, regexp_replace(x, '{pattern}', '{to}', 'g') AS x, CASE WHEN regexp_matches(x, '{pattern}') THEN list_append(labels, '{label}') ELSE labels END AS labels FROM {sql})"
    return sql


def _page_corrections(x: str) -> str:
    for pattern, to, _ in ocr.CORRECTIONS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def _thousandths(x: str) -> str:
    """A double as it is written, rounded to three places, halves up."""
    return f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(20, 18)), 3)"


#: Typed pages are those with 24 characters; values stand where they first occur.
PAGE_FILES = f"""pg AS (SELECT doc_id // 7 AS f, doc_id % 7 + 1 AS page, {SQUEEZE.format("CASE WHEN doc_id % 5 = 0 THEN " + form_sql(RECOGNISED, 'doc_id') + " ELSE x END")} AS raw FROM {DOCS(RECOGNISED)}),
px AS (SELECT f, page, raw, length(raw) >= {uploads.TYPED} AS typed, {_page_corrections('raw')} AS x FROM pg),
vs AS (SELECT f, page, 'c' AS kind, unnest(cs) AS v, generate_subscripts(cs, 1) AS i FROM (SELECT f, page, {OCR_CITATIONS} AS cs FROM px) UNION ALL SELECT f, page, 's', unnest(cs), generate_subscripts(cs, 1) FROM (SELECT f, page, {OCR_SECTIONS} AS cs FROM px)),
vf AS (SELECT f, kind, v, min(page * 1000000 + i) AS pos FROM vs GROUP BY ALL), vl AS (SELECT f, string_agg(v, '|' ORDER BY pos) FILTER (kind = 'c') AS citations, string_agg(v, '|' ORDER BY pos) FILTER (kind = 's') AS sections FROM vf GROUP BY f),
pf AS (SELECT f, count(*) AS page_count, bool_and(typed) AS all_typed, bool_or(typed) AS some_typed, md5(string_agg(nullif(raw, ''), chr(10) ORDER BY page)) AS raw_digest,
  round(sum(CAST(1000 * CASE WHEN raw = '' THEN 0.2 WHEN typed THEN {_thousandths('least(0.99, 0.72 + least(length(raw), 500) / 2000.0::DOUBLE)')} ELSE {_thousandths('least(0.98, 0.5 + least(length(raw), 300) / 1500.0::DOUBLE)')} END AS BIGINT)) / count(*)) / 1000 AS confidence FROM px GROUP BY f)"""


def _first_of(text: str, rules: list[tuple[str, list[str]]], coded: str = "FALSE") -> str:
    """The first rule of which the text holds a signal; criminal also if coded."""
    return "CASE " + " ".join("WHEN " + " OR ".join([f"contains(lower({text}), '{s}')" for s in signals] + ([coded] if name == "criminal" else [])) + f" THEN '{name}'" for name, signals in rules) + " END"


CODED_FIRST = " OR ".join(f"starts_with(coalesce(({SECTIONS_SQL})[1], ''), '{p_}')" for p_ in R.CODE_PREFIXES)
CASE_KINDS = f"""SELECT conv_id, turn, CASE WHEN i % 7 = 0 THEN 'criminal' ELSE coalesce({_first_of('whole', K.TYPES)}, CASE WHEN area IN ({', '.join(f"'{t}'" for t in K.ROUTED_TYPES)}) THEN area END) END AS case_type, {_first_of('whole', K.STAGES)} AS stage
FROM (SELECT *, {_first_of('x', R.AREAS, CODED_FIRST)} AS area FROM (SELECT conv_id, turn, i, x AS whole, left(x, {K.ROUTED_LENGTH}) AS x FROM {TURNS(STATED)}))"""
NUMBER = lambda i: f"({i} % 395 + 1) || CASE WHEN {i} % 3 = 0 THEN 'A' ELSE '' END"
FORMATTED = "CASE " + " ".join(f"WHEN starts_with(lower(r), '{a} ') THEN '{n} ' || upper(trim(r[{len(a) + 2}:])) WHEN ends_with(lower(r), ' {a}') THEN '{n} ' || upper(trim(r[:-{len(a) + 2}]))" for a, n in S.CODE_ALIASES) + " ELSE '' END"
FIRST_SENTENCE = "CASE WHEN contains(t, '.') THEN trim(split_part(t, '.', 1)) || '.' WHEN contains(t, '!') THEN trim(split_part(t, '!', 1)) || '!' WHEN contains(t, '?') THEN trim(split_part(t, '?', 1)) || '?' WHEN length(t) <= 220 THEN t ELSE rtrim(substr(t, 1, 220)) || '...' END"
CLAIM = r"regexp_replace(" + SQUEEZE + r", '\s+([.,;:!?])', '\1', 'g')"
EDGE_CASES = "CASE WHEN trim(lower(explicit)) IN (" + ", ".join(f"'{k}'" for k, _ in G.EDGE_RULES) + ") THEN trim(lower(explicit)) " + " ".join(f"WHEN {' OR '.join(f'''contains(' ' || lower(text) || ' ', '{w}')''' for w in ws)} THEN '{k}'" for k, ws in G.EDGE_RULES) + " ELSE 'refers_to' END"
DRAFTED = "CASE " + " ".join(f"WHEN area = '{kind}' AND (" + " OR ".join(f"contains(lower(q), '{s}')" for s in signals) + f") THEN {k}" for k, (_, kind, signals, *_) in enumerate(H.PASSAGES)) + f" ELSE {len(H.PASSAGES)} END"
PASSAGES = "(SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {q}::DOUBLE, {len(a)}, '{quoted(t)}')" for k, (n, _, _, q, a, t) in enumerate(H.PASSAGES)) + f", ({len(H.PASSAGES)}, '{H.GENERIC[0]}', {H.GENERIC[1]}::DOUBLE, 0, NULL)) t(k, strategy, quality, n_anchors, passage))"
SPECS = "(SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{','.join(':'.join([f.split()[0], f.split()[1].strip('[]'), str('[' in f).lower()]) for f in fs)}')" for n, _, fs in L.COLLECTIONS) + ") t(name, fields))"
LINES = r"""list_filter(list_transform(string_split(LEFT_, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> '')"""
UNTAGGED = UNESCAPED.format(r"regexp_replace(regexp_replace(html, '(?i)<(?:/p|/div|/h1|/h2|/h3|br\s*/?)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")
i_section = "CASE WHEN i % 4 > 0 THEN (i % 300 + 1) || CASE WHEN i % 3 = 0 THEN 'A' ELSE '' END END"
ORACLE_SQL = {
    "token_lists": f"SELECT doc_id, array_to_string({REFS.format('n')}, '|') AS \"references\", array_to_string({CITES.format('n')}, '|') AS citations, md5({SORTED.format(ALL_TOKENS.format('n'))}) AS tokens FROM (SELECT doc_id, {NORM.format('x')} AS n FROM {DOCS(REFERENCES)})",
    "section_tokens": f"SELECT p_partkey, c || '|' || s || '|' || c || '_' || s || '|section_' || s AS result FROM (SELECT p_partkey, lower({pick_sql(['BNS', 'CrPC', 'IPC'], 'p_partkey')}) AS c, lower({NUMBER('p_partkey')}) AS s FROM part)",
    "article_tokens": f"SELECT p_partkey, s || '|article_' || s AS result FROM (SELECT p_partkey, lower({NUMBER('p_partkey')}) AS s FROM part)",
    "act_aliases": f"SELECT p_partkey, {SORTED.format(ALIASES.format('n'))} AS result FROM (SELECT p_partkey, {ALIAS_NAME.format(pick_sql(ACTS, 'p_partkey') + ''' || ' ' || p_name''')} AS n FROM part)",
    "query_synonyms": "SELECT conv_id, turn, " + SORTED.format("flatten([" + ", ".join(f"CASE WHEN contains(q, '{k}') THEN {v!r} ELSE [] END" for k, v in T.SYNONYMS.items()) + "])") + f" AS result FROM (SELECT conv_id, turn, {SQUEEZE.format('lower(x)')} AS q FROM {TURNS(ASKED)})",
    "code_references": f"SELECT conv_id, turn, {SORTED.format('list_concat(' + CODED('q', T.SECTION_CODE, 2) + ', ' + CODED('q', T.CODE_SECTION, 1) + ')')} AS result FROM (SELECT conv_id, turn, {SQUEEZE.format('x')} AS q FROM {TURNS(REFERENCES)})",
    "combined_texts": f"SELECT doc_id, md5(concat_ws(' ', nullif({pick_sql(HEADERS, 'doc_id')}, ''), nullif(text, ''), nullif({pick_sql(ACTS + [None, ''], 'doc_id')}, ''))) AS result FROM documents",
    "document_token_lists": f"""WITH d AS (SELECT doc_id, {NORM.format('x')} AS n, {ALIASES.format(ALIAS_NAME.format(pick_sql(ACTS, 'i')))} AS al, lower({i_section}) AS s FROM {DOCS(REFERENCES)})
SELECT doc_id, md5({SORTED.format('list_concat(' + ALL_TOKENS.format('n') + ", flatten(list_transform(al, lambda a: list_concat(string_split(a, ' '), CASE WHEN s IS NULL THEN [] WHEN contains(a, ' ') THEN ['section', s] ELSE [a, s, a || '_' || s, 'section_' || s] END))), CASE WHEN s IS NULL THEN [] ELSE ['section_' || s] END)")}) AS tokens FROM d""",
    "act_names": f"SELECT p_partkey, {ACT_NAME.format('n')} AS result FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || ' ' || {pick_sql(['of the', 'AND', 'and  relief'], 'p_partkey')} || ' act' AS n FROM part)",
    "case_names": f"SELECT conv_id, turn, {SORTED.format(CASE_NAMES)} AS result FROM {TURNS(NAMED)}",
    "courts_named": f"SELECT conv_id, turn, array_to_string({COURTS_SQL}, '|') AS result FROM {TURNS(NAMED)}",
    "query_entities": f"""SELECT conv_id, turn, {SORTED.format('list_concat(' + f"list_transform(list_filter({CASE_NAMES}, lambda t: t <> ''), lambda t: 'CASE_NAME:' || t), list_transform({COURTS_SQL}, lambda t: 'COURT:' || t), list_transform({SECTIONS_SQL}, lambda t: CASE WHEN starts_with(t, 'Article ') THEN 'ARTICLE:' ELSE 'SECTION:' END || t), list_transform({ACTS_SQL}, lambda t: 'ACT:' || t)" + ')')} AS result FROM {TURNS(NAMED)}""",
    "statute_parts": r"""WITH w AS (SELECT item_id, text, string_split(text, ' ') AS ws FROM benchmark),
m AS (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN text ELSE array_to_string(list_transform(ws, lambda x, i: CASE WHEN (i - 1) % 5 = 2 THEN '(' || CASE WHEN (i - 1) % 2 = 0 THEN CAST((i - 1) // 5 AS VARCHAR) ELSE 'b' END || ') ' || x ELSE x END), ' ') END AS t FROM w),
q AS (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(t, '(\((?:\d+|[a-z])\)\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM m),
f AS (SELECT item_id, CASE WHEN len(parts) > 1 AND NOT starts_with(parts[1], '(') THEN list_transform(parts[2:], lambda x: parts[1] || ' ' || x) ELSE parts END AS parts FROM q)
SELECT item_id, CAST(unnest(range(len(parts))) AS INT) AS n, regexp_replace(unnest(parts), '([.!?])\s+', '\1 ', 'g') AS part FROM f""",
    "judgment_kinds": f"SELECT doc_id, CASE WHEN regexp_matches(t, 'headnote|issue|summary') THEN 'headnote' WHEN regexp_matches(t, 'obiter|observation|dicta') THEN 'obiter_dictum' WHEN regexp_matches(t, 'holding|ratio|decision') THEN 'ratio_decidendi' ELSE 'judgment_paragraph' END AS result FROM (SELECT doc_id, lower(concat_ws(' ', {pick_sql(HEADERS, 'doc_id')}, text)) AS t FROM documents)",
    "numeric_tokens": "SELECT p_partkey, " + OCR_NUMBER.format("p_name || ' ' || p_brand") + " AS result FROM part",
    "party_names": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'Buyer ' || c_custkey || '|State No ' || c_nationkey END AS result FROM customer",
    "case_types": CASE_KINDS,
    "processed_uploads": f"""WITH {PAGE_FILES} SELECT CAST(f AS VARCHAR) AS path, CASE WHEN all_typed THEN 'typed_pdf' WHEN some_typed THEN 'mixed_pdf' ELSE 'scanned_pdf' END AS mode, CASE WHEN all_typed THEN 'pdf_text' WHEN some_typed THEN 'hybrid_pdf' ELSE 'ocr_pdf' END AS extraction_method,
page_count, confidence, raw_digest, coalesce(citations, '') AS citations, coalesce(sections, '') AS sections FROM pf LEFT JOIN vl USING (f)""",
    "ocr_sections": f"SELECT doc_id, {SORTED.format(OCR_SECTIONS)} AS result FROM {DOCS(RECOGNISED)}",
    "ocr_citations": f"SELECT doc_id, {SORTED.format(OCR_CITATIONS)} AS result FROM {DOCS(RECOGNISED)}",
    "ocr_corrections": f"SELECT doc_id, md5(x) AS text, {SORTED.format('labels')} AS labels FROM {_corrected()}",
    "claim_texts": f"SELECT conv_id, turn, md5({CLAIM.format('x')}) AS result FROM {TURNS([['Bail  was granted .'], [' a , b ;c'], ['x']])}",
    "statute_placeholders": f"SELECT p_partkey, '[STATUTE: ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ', Section ' || {NUMBER('p_partkey')} || ']' AS result FROM part",
    "case_placeholders": f"SELECT s_suppkey, '[CITE: ' || {pick_sql(['Supreme Court', 'Delhi High Court'], 's_suppkey')} || ' on ' || s_name || ']' AS result FROM supplier",
    "resolved_texts": f"SELECT doc_id, md5(replace(replace(x, '[A]', 'IPC, Section ' || {NUMBER('i')}), '[B]', '[C]')) AS result FROM {DOCS([['See [A] and [A] or [B].'], ['Nothing.'], ['[B][A]']])}",
    "section_kinds": f"SELECT p_partkey, CASE WHEN regexp_matches(t, 'law|statute') THEN 'APPLICABLE_LAW' WHEN regexp_matches(t, 'authorit|case') THEN 'KEY_CASES' ELSE 'LEGAL_POSITION' END AS result FROM (SELECT p_partkey, lower({pick_sql(TITLES, 'p_partkey')} || ' ' || p_name) AS t FROM part)",
    "claim_statuses": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'UNSUPPORTED' WHEN l_suppkey % 2 = 0 OR l_partkey % 3 = 1 THEN 'UNCERTAIN' ELSE 'VERIFIED' END AS result FROM lineitem",
    "grounding_statuses": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 3 = 2 THEN 'MISGROUNDED' WHEN l_partkey % 101 >= 82 AND l_suppkey % 3 = 0 THEN 'VERIFIED' WHEN l_partkey % 101 >= 55 OR l_suppkey % 3 = 1 THEN 'UNCERTAIN' ELSE 'MISGROUNDED' END AS result FROM lineitem",
    "canonical_sections": f"SELECT p_partkey, CASE WHEN n <> '' THEN CASE WHEN lower(a) = 'crpc' THEN 'CrPC' WHEN lower(a) IN ('ipc', 'bns', 'bnss', 'bsa') THEN upper(a) WHEN lower(a) = 'indian evidence act' THEN 'Indian Evidence Act' ELSE a END || ' ' || upper(n) END AS result FROM (SELECT p_partkey, regexp_extract(r, '^Section\\s+([0-9A-Z]+)\\s+(.+)$', 1) AS n, trim(regexp_extract(r, '^Section\\s+([0-9A-Z]+)\\s+(.+)$', 2)) AS a FROM (SELECT p_partkey, {_section_sql('p_partkey')} AS r FROM part))",
    "statutes_involved": f"SELECT o_orderkey, {SORTED.format('[' + ', '.join(pick_sql(SHORT, f'(o_orderkey + {k})') for k in (0, 3, 7)) + ', ' + chr(39) + 'alone' + chr(39) + ']')} AS result FROM orders",
    "formatted_references": f"SELECT p_partkey, {FORMATTED} AS result FROM (SELECT p_partkey, {SQUEEZE.format(chr(114) + 'egexp_replace(r0, ' + chr(39) + r'(?i)\bsection\b' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS r FROM (SELECT p_partkey, {_section_sql('p_partkey')} AS r0 FROM part))",
    "edge_types": f"""WITH t AS (SELECT doc_id, x AS text, {pick_sql([None, 'refers_to', 'Overrules ', 'cites', None], '(doc_id // 3)')} AS explicit FROM {DOCS(CITING)}), c AS (SELECT doc_id AS source, unnest([doc_id // 2, doc_id * 2]) AS n, text, explicit FROM t)
SELECT source, 'AIR ' || n AS reference, CASE WHEN k.doc_id <> source THEN k.doc_id END AS target, {EDGE_CASES} AS type FROM c LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0) k ON k.doc_id = n""",
    "case_keys": f"SELECT c_custkey, trim(replace(regexp_replace(regexp_replace(regexp_replace(lower(c_name || {pick_sql([' vs. ', ' v ', ' VS '], 'c_custkey')} || c_mktsegment || ', Goa.'), 'vs\\.', 'v', 'g'), 'vs', 'v', 'g'), '[.,]', ' ', 'g'), '  ', ' ')) AS result FROM customer",
    "title_parties": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE c_name || '|' || c_mktsegment END AS result FROM customer",
    "written_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS result FROM orders",
    "placeholder_kinds": "SELECT doc_id, CASE WHEN doc_id % 5 >= 3 THEN 'STATUTE' ELSE 'CITE' END AS result FROM documents",
    "comparable_values": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d 00:00') WHEN 1 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d 10:30') ELSE 'none' END AS day, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_totalprice AS DOUBLE) END AS amount FROM orders",
    "excerpts": f"SELECT doc_id, md5({CLAIM.format(f'''regexp_replace({FIRST_SENTENCE}, '{T.REPORTER}', '', 'g')''')}) AS result FROM (SELECT doc_id, {SQUEEZE.format('x')} AS t FROM {DOCS(REFERENCES, True)})",
    "page_titles": "SELECT page_id, (" + LINES.replace("LEFT_", UNTAGGED) + ")[1] AS title FROM pages",
    "hypothetical_drafts": f"""WITH q AS (SELECT conv_id, turn, {form_sql(ASKED, '(conv_id + turn)')} || ' ' || text AS q, {pick_sql(['property', 'criminal', 'labour', 'civil_law'], '((conv_id + turn) // 5)')} AS area FROM conversations)
SELECT conv_id, turn, strategy, quality, n_anchors, md5(coalesce(passage, '{quoted(H.GENERIC[2])}' || replace(area, '_', ' ') || '{quoted(H.GENERIC[3])}')) AS passage FROM q JOIN {PASSAGES} p ON p.k = {DRAFTED}""",
    "indexed_fields": f"SELECT name, n, 24 AS dimension, 'cosine' AS distance, fields FROM (SELECT CASE doc_id % 5 WHEN 3 THEN 'statutes' WHEN 4 THEN 'constitution' ELSE CASE {COURT} WHEN 'Supreme Court' THEN 'sc_judgments' ELSE 'hc_judgments' END END AS name, count(*) AS n FROM documents GROUP BY ALL) JOIN {SPECS} USING (name)",
}
