"""Functions whose results are known by heart."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import chunks, ocr
from attestra.functions import text as T
from attestra.operators import answers as A
from attestra.operators import cases as K
from attestra.operators import citations as C
from attestra.operators import collections as L
from attestra.operators import graph as G
from attestra.operators import hyde as H
from attestra.operators import routing as R
from attestra.operators import state as S
from attestra.operators import verify as V
from attestra.sources import html

x, y, z = (lambda: F.col("x")), (lambda: F.col("y")), (lambda: F.col("z"))


def joined(c):
    return F.array_join(c, "|")


#: name: (result of the columns x, y, z; rows of x, y, z and what must come out).
TABLES = {
    "token_lists": (lambda: joined(T.tokens(x())), [
        ("Section 302 IPC", None, None, "302|ipc|302_ipc|section_ipc|section"), ("Article 21-A and Puttaswamy", None, None, "21|article_21|article|a|and|puttaswamy"), ("K.S. Puttaswamy vs. Union", None, None, "ks|puttaswamy|v|union"),
        ("AIR 1978 SC 597", None, None, "air_1978_sc_597|air|1978|sc|597"), ("(2017) 10 SCC 1", None, None, "2017_10_scc_1|2017|10|scc|1"), ("", None, None, ""),
    ]),
    "section_tokens": (lambda: joined(T.section_reference_tokens(x(), y())), [("BNS", "101", None, "bns|101|bns_101|section_101"), ("CrPC", "438A", None, "crpc|438a|crpc_438a|section_438a")]),
    "article_tokens": (lambda: joined(T.article_reference_tokens(x())), [("21", None, None, "21|article_21"), ("19A", None, None, "19a|article_19a")]),
    "act_aliases": (lambda: joined(T.aliases(x())), [("Indian Penal Code, 1860", None, None, "ipc|indian penal code"), ("Bharatiya Sakshya Adhiniyam", None, None, "bsa|bharatiya sakshya adhiniyam"), ("Companies Act", None, None, ""), ("Constitution of India", None, None, "constitution|constitution of india")]),
    "query_synonyms": (lambda: joined(T.synonyms(x())), [("Murder trial", None, None, "culpable homicide|ipc 302|bns 101"), ("bail and privacy", None, None, "anticipatory bail|crpc 437|bnss 480|article 21|fundamental right"), ("lease", None, None, "")]),
    "code_references": (lambda: joined(T.code_references(x())), [("Section 302 IPC and BNS 101", None, None, "IPC 302|BNS 101"), ("crpc 438 and s.438 CrPC", None, None, "CRPC 438"), ("nothing", None, None, "")]),
    "combined_texts": (lambda: T.combined_text(x(), y(), z()), [("a", "", "c", "a c"), ("", None, "c", "c"), (None, None, None, "")]),
    "document_token_lists": (lambda: joined(T.document_tokens(x(), y(), z())), [("Punishment", "Bharatiya Nyaya Sanhita", "101", "punishment|bns|101|bns_101|section_101|bharatiya|nyaya|sanhita|section"), ("Text", None, None, "text")]),
    "act_names": (lambda: R.act_name(x()), [("specific relief act", None, None, "Specific Relief Act"), ("INDIAN SUCCESSION ACT", None, None, "Indian Succession ACT"), ("prevention of corruption act", None, None, "Prevention of Corruption Act")]),
    "case_names": (lambda: joined(R.case_names(x())), [("What was held in Maneka Gandhi v Union of India", None, None, "Maneka Gandhi v Union of India"), ("no names here", None, None, "")]),
    "courts_named": (lambda: joined(R.courts(x())), [("the Delhi HC and the Supreme Court", None, None, "Supreme Court of India|Delhi High Court"), ("jammu and kashmir high court", None, None, "High Court of Jammu and Kashmir and Ladakh"), ("odisha hc, madras high court", None, None, "Madras High Court|Orissa High Court"), ("a district court", None, None, "")]),
    "query_entities": (lambda: joined(F.transform(R.entities(x()), lambda e: F.concat_ws(":", e["kind"], e["text"]))), [
        ("What was held in Maneka Gandhi v Union of India", None, None, "CASE_NAME:Maneka Gandhi v Union of India"), ("Section 302 IPC in the Delhi HC", None, None, "COURT:Delhi High Court|SECTION:IPC 302"), ("Article 21", None, None, "ARTICLE:Article 21"), ("hello", None, None, ""),
    ]),
    "statute_parts": (lambda: joined(chunks.statute_parts(x())), [("No person shall: (1) do one thing. (2) do another.", None, None, "No person shall: (1) do one thing.|No person shall: (2) do another."), ("One sentence. Two.", None, None, "One sentence. Two."), ("", None, None, "")]),
    "judgment_kinds": (lambda: chunks.judgment_kind(x(), y()), [("Headnote", "t", None, "headnote"), (None, "the issue is", None, "headnote"), ("Observations", "t", None, "obiter_dictum"), (None, "the holding", None, "ratio_decidendi"), ("Facts", "he went", None, "judgment_paragraph")]),
    "numeric_tokens": (lambda: T.numeric_token(x()), [("1O", None, None, "10"), ("I9l8", None, None, "1918"), ("o5", None, None, "05")]),
    "party_names": (lambda: joined(ocr.parties_found(x())), [("Buckeye Trust v. PCIT-1, Bangalore", None, None, "Buckeye Trust|PCIT-1"), ("Petitioner: A Kumar Respondent: State of Goa", None, None, "A Kumar|State of Goa"), ("nobody", None, None, "")]),
    "ocr_sections": (lambda: joined(ocr.with_sections(x())[1]), [("u/s 438 crpc", None, None, "Section 438 CrPC"), ("Sec. 3O2 indian penal code and section 101 bns", None, None, "Section 302 IPC|Section 101 BNS"), ("section 5", None, None, "")]),
    "ocr_citations": (lambda: joined(ocr.with_citations(x())[1]), [("(2017) 1O SCC 1, AIR 19l8 sc 5", None, None, "AIR 1918 SC 5|(2017) 10 SCC 1"), ("2020 scc online del 44", None, None, "2020 SCC OnLine DEL 44"), ("none", None, None, "")]),
    "ocr_corrections": (lambda: F.concat_ws("/", ocr.corrected(x())[0], joined(ocr.corrected(x())[1])), [("Sectlon 5 and artlcle 21", None, None, "Section 5 and Article 21/section_spelling|article_spelling"), ("the petltloner, A1R", None, None, "the petitioner, AIR/party_label_spelling|air_reporter")]),
    "claim_texts": (lambda: T.claim_text(x()), [("Bail  was granted .", None, None, "Bail was granted."), (" a , b ", None, None, "a, b")]),
    "statute_placeholders": (lambda: A.statute_token(x(), y()), [("Specific Relief Act", "6", None, "[STATUTE: Specific Relief Act, Section 6]")]),
    "case_placeholders": (lambda: A.case_token(x(), y()), [("Supreme Court", "on bail", None, "[CITE: Supreme Court on bail]")]),
    "resolved_texts": (lambda: A.substituted(x(), F.array(F.struct(y().alias("token"), z().alias("value")))), [("See [A] and [A].", "[A]", "IPC, Section 302", "See IPC, Section 302 and IPC, Section 302."), ("None.", "[A]", "v", "None.")]),
    "section_kinds": (lambda: V.section_kind(x()), [("Applicable Law", None, None, "APPLICABLE_LAW"), ("Key Authorities", None, None, "KEY_CASES"), ("Legal Position", None, None, "LEGAL_POSITION"), ("Statutes", None, None, "APPLICABLE_LAW")]),
    "claim_statuses": (lambda: V.claim_status(x(), y() == "pending"), [("MISGROUNDED", "", None, "UNSUPPORTED"), ("VERIFIED", "pending", None, "UNCERTAIN"), ("UNCERTAIN", "", None, "UNCERTAIN"), ("VERIFIED", "", None, "VERIFIED")]),
    "grounding_statuses": (lambda: V.grounding(x().cast("double"), y()), [("0.9", "ENTAILMENT", None, "VERIFIED"), ("0.9", "NEUTRAL", None, "UNCERTAIN"), ("0.6", "ENTAILMENT", None, "UNCERTAIN"), ("0.3", "NEUTRAL", None, "UNCERTAIN"), ("0.3", "ENTAILMENT", None, "MISGROUNDED"), ("0.99", "CONTRADICTION", None, "MISGROUNDED")]),
    "canonical_sections": (lambda: K.canonical_section(x()), [("Section 302 IPC", None, None, "IPC 302"), ("Section 438 crpc", None, None, "CrPC 438"), ("Section 6 Specific Relief Act", None, None, "Specific Relief Act 6"), ("Article 21", None, None, None)]),
    "statutes_involved": (lambda: joined(K.statute_names(F.split(x(), ";"))), [("IPC 302;IPC 34;Specific Relief Act 6", None, None, "IPC|Specific Relief Act")]),
    "formatted_references": (lambda: F.concat_ws(" ", S.code_reference(x())["code"], S.code_reference(x())["section"]), [("Section 302 IPC", None, None, "IPC 302"), ("indian evidence act 3", None, None, "Indian Evidence Act 3"), ("crpc 438a", None, None, "CrPC 438A")]),
    "edge_types": (lambda: G.edge_type(x(), y()), [(None, "It was followed here", None, "follows"), ("overrules", "followed", None, "overrules"), ("cites", "nothing", None, "refers_to")]),
    "case_keys": (lambda: T.case_name_key(x()), [("Maneka Gandhi vs. Union", None, None, "maneka gandhi v union"), ("A, B v C", None, None, "a b v c")]),
    "title_parties": (lambda: F.concat_ws("|", T.parties(x())["appellant"], T.parties(x())["respondent"]), [("A v B", None, None, "A|B"), ("A vs. B and C", None, None, "A|B and C"), ("A", None, None, "")]),
    "written_dates": (lambda: T.parsed_date(x()).cast("string"), [("2017-08-24", None, None, "2017-08-24"), ("August 24, 2017", None, None, "2017-08-24"), ("sometime", None, None, None)]),
    "placeholder_kinds": (lambda: C.placeholder_kind(x()), [("statute", None, None, "STATUTE"), ("constitution", None, None, "STATUTE"), ("judgment", None, None, "CITE")]),
    "comparable_values": (lambda: F.coalesce(F.date_format(L.comparable(x(), "datetime"), "yyyy-MM-dd HH:mm"), F.lit("none")), [("2024-07-01", None, None, "2024-07-01 00:00"), ("2024-07-01T10:30:00", None, None, "2024-07-01 10:30"), ("soon", None, None, "none")]),
    "excerpts": (lambda: A.excerpt(x()), [("Bail is the rule, AIR 1978 SC 597 . More.", None, None, "Bail is the rule,."), ("No end", None, None, "No end")]),
    "page_titles": (lambda: F.element_at(html.lines(x()), 1), [("<h1>A &amp; B</h1><p>text</p>", None, None, "A & B")]),
}


#: Text of a case, its type and its stage.
CASES = [
    ("the landlord in a revision", "property", "revision"), ("a charge sheet on bail", "criminal", "bail"), ("a chargesheet in a trial", None, "charges"), ("divorce and appeal", "family", "appeal"), ("gst execution", "tax", "execution"),
    ("the company in trial", "corporate", "trial"), ("wages under investigation", "labour", "investigation"), ("an arbitral award", "arbitration", None), ("a consumer case", "consumer", None), ("a fundamental right", "constitutional", None),
    ("nothing of note", None, None), ("the civil suit", "civil", None), ("maintainability alone", None, None), ("specific relief act, consumer", "property", None),
]


def test_case_types(spark):
    d = spark.createDataFrame([(t,) for t, _, _ in CASES], "x string")
    none = F.array().cast("array<string>")
    assert {tuple(r) for r in d.select("x", K.case_type(x(), none), K.first_of(x(), K.STAGES)).collect()} == set(CASES)
    assert d.select(K.case_type(x(), F.array(F.lit("BNS 103")))).distinct().collect() == [("criminal",)]


@pytest.mark.parametrize("name", sorted(TABLES))
def test_known_values(spark, name):
    build, rows = TABLES[name]
    d = spark.createDataFrame([(*r[:3], i) for i, r in enumerate(rows)], "x string, y string, z string, i int")
    assert [r["result"] for r in d.orderBy("i").select(build().alias("result")).collect()] == [r[3] for r in rows]


#: Query, area, and the strategy and quality that must come out.
DRAFTS = [
    ("my landlord changed the locks", "property", "property_dispossession", 0.94), ("my landlord changed the locks", "civil", "generic_low_confidence", 0.38), ("Anticipatory relief", "criminal", "criminal_bail", 0.89), ("after an arrest", "criminal", "criminal_bail", 0.89),
    ("murder", "criminal", "generic_low_confidence", 0.38), ("no salary since May", "labour", "labour_termination", 0.83), ("pay", "labour", "generic_low_confidence", 0.38),
]


def test_hypothetical_drafts(spark):
    q = spark.createDataFrame([(t, a) for t, a, _, _ in DRAFTS], "query string, practice_area string")
    assert sorted((r["query"], r["practice_area"], r["strategy"], r["quality"]) for r in H.drafts(q).collect()) == sorted(DRAFTS)
