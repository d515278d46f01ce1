"""Published queries: text functions, pages, chunks, uploads, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import routing
from ..sources import html, lines, statutes, uploads
from .domain import Domain


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Domain(spark, sf_dir).table("pages")
    ls = html.lines(F.col("html"))
    return p.select("page_id", F.size(ls).alias("n_lines"), F.md5(F.array_join(ls, "\n")).alias("digest"))


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html.parsed(Domain(spark, sf_dir).table("pages"))
    return p.select("page_id", "title", F.size("paragraphs").alias("n_paragraphs"), F.size("headers").alias("n_headers"), F.md5("body").alias("body_digest"), "source_ref", "checksum")


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = html.metadata(html.parsed(Domain(spark, sf_dir).table("pages")), court="Bombay High Court", binding="Bombay High Court", practice="criminal")
    return m.select("page_id", "title", "citation", "neutral_citation", F.col("date").cast("string").alias("date"), F.col("parties.appellant").alias("appellant"), "court")


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html.parsed(Domain(spark, sf_dir).table("pages"))
    c = html.projections(p, html.metadata(p), html.citations(p))["chunks"]
    return c.select("page_id", "chunk_index", F.col("total_chunks").cast("long").alias("total_chunks"), F.md5("text").alias("digest"))


def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents that one-word lines head, as statutes' header lines do."""
    d = Domain(spark, sf_dir).table("documents").select("doc_id", "text")
    s = lines.sections(d, r"^([A-Z])([a-z]+)\.$")
    return s.select("doc_id", F.col("section_index").cast("long").alias("section_index"), F.concat("number", "heading").alias("heading"), F.md5("text").alias("digest"))


def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).table("documents").select("doc_id", F.md5(T.first_sentence(F.col("text"))).alias("digest"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).table("documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-aware chunks of 140 words."""
    d = Domain(spark, sf_dir).table("documents").select("doc_id", F.posexplode(T.packed_sentences(F.col("text"), 140)).alias("chunk_index", "chunk"))
    return d.select("doc_id", "chunk_index", F.size(F.split("chunk", r"\s+")).alias("n_words"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir).table("benchmark").select("item_id", F.posexplode(T.sliced(F.col("text"))).alias("i", "slice"))
    return d.select("item_id", "i", "slice")


def upload_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir).table("documents")
    return d.select("doc_id", uploads.text_confidence(F.col("text"), 0.72).alias("typed"), uploads.ocr_confidence((F.col("doc_id") % 100) / 100, F.col("text")).alias("scanned"))


def party_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Domain(spark, sf_dir).table("customer")
    return c.select("c_custkey", T.party_key(F.col("c_name")).alias("key"), T.numeric_token(F.col("c_name")).alias("digits"), T.case_name_key(F.concat(F.col("c_name"), F.lit(" vs. "), F.col("c_mktsegment"))).alias("case_key"))


def routed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users, with phrases that reach every branch appended by turn and conversation."""
    c = Domain(spark, sf_dir).table("conversations").where("role = 'user'")
    q = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("conv_id") % len(PHRASES) + 1).cast("int")), "text")
    a = routing.analyzed(c.select("conv_id", "turn", q.alias("query"), (F.col("conv_id") % 29 == 0).alias("uploaded")))
    return a.select("conv_id", "turn", "query_type", "confidence", "pipeline", "practice_area", "jurisdiction", "time_sensitive", F.size("sections").alias("n_sections"))


def act_texts(d: Domain) -> DataFrame:
    """Benchmark items as acts: header lines here and there, a section for every third word."""
    i = F.col("item_id")
    words = F.slice(F.split("text", " "), 1, 9)
    body = F.array_join(F.transform(words, lambda w, n: F.concat(F.when(n % 3 == 0, F.concat(F.lit("Section "), (n + 1).cast("string"), F.lit(": heading "), (n / 3).cast("int").cast("string"), F.lit("\n"))).otherwise(F.lit("")), w)), "\n")
    head = F.concat(F.lit("The title line\n"), F.when(i % 2 == 0, F.concat(F.lit("Act: Act number "), i.cast("string"), F.lit("\n"))).otherwise(""), F.when(i % 3 == 0, F.lit("Enforcement Date: 2024-07-01\n")).otherwise(""))
    return d.table("benchmark").select(i.alias("doc_id"), F.concat(head, body, F.when(i % 5 == 0, F.lit("\nJurisdiction: Goa")).otherwise("")).alias("text"), F.when(i % 4 == 0, F.concat(F.lit("ref-"), i.cast("string"))).alias("external_id"))


def act_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = act_texts(Domain(spark, sf_dir))
    a = statutes.acts(d)
    m = statutes.metadata(a, statutes.SOURCES["bns_bundle"]).select("doc_id", "court", F.col("date").cast("string").alias("date"), F.array_join("practice_areas", ",").alias("practice_areas"))
    return a.select("doc_id", "act_name", "jurisdiction", "source_ref", F.array_join("in_force", ",").alias("in_force")).join(m, "doc_id")


def act_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = act_texts(Domain(spark, sf_dir))
    return statutes.statute_rows(statutes.acts(d), statutes.act_sections(d))["sections"].select("section_id", "doc_id", "number", "heading", "text", "in_force")


PHRASES = ["my landlord locked the house,", "Section 302 IPC punishment", "compare bail orders of", "how has the doctrine evolved", "is this a fundamental right", "company insolvency notice", "latest income tax rules", "maintenance after divorce", "consumer award", "plain words"]


#: The references that pages hold, with or without the closing sign; that of the sign itself last.
REFERENCES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")]
UNESCAPED = "{0}"
for _name, _sign in REFERENCES:
    UNESCAPED = f"regexp_replace({UNESCAPED}, '&{_name};?', '{_sign}', 'g')"
CLEAN = "trim(regexp_replace(" + UNESCAPED.format("regexp_replace({0}, '<[^>]+>', ' ', 'g')") + r", '\s+', ' ', 'g'))"
PARSED = f"""
l AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(html, '(?i)<(?:/p|/div|/h1|/h2|/h3|br\\s*/?)>', chr(10), 'g'), chr(10)), lambda x: {CLEAN.format('x')}), lambda x: x <> '') AS lines FROM pages),
b AS (SELECT page_id, url, html, list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {CLEAN.format('x')}), lambda x: x <> '') AS ps,
  list_filter(list_transform(regexp_extract_all(html, '(?is)<h[23][^>]*>(.*?)</h[23]>', 1), lambda x: {CLEAN.format('x')}), lambda x: x <> '') AS headers,
  regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages),
parsed AS (SELECT page_id, url, html, CASE WHEN trim(h1) <> '' THEN {CLEAN.format('h1')} ELSE lines[1] END AS title, CASE WHEN len(ps) > 0 THEN ps ELSE lines[2:] END AS paragraphs, headers FROM b JOIN l USING (page_id))
"""
SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
ROUTED = """WITH p AS (SELECT conv_id, turn, lower(ph || ' ' || text) AS q, conv_id % 29 = 0 AS uploaded FROM conversations, (SELECT unnest(range(10)) AS i, unnest([{phrases}]) AS ph) WHERE role = 'user' AND conv_id % 10 = i),
n AS (SELECT *, trim(regexp_replace(regexp_replace(q, '[^\\p{{L}}\\p{{N}}_\\s./-]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm, conv_id % 10 = 1 AS coded FROM p),
a AS (SELECT *, CASE {areas} ELSE 'general' END AS practice_area,
  CASE WHEN uploaded THEN 'document_specific' WHEN {hops} THEN 'multi_hop_doctrine' WHEN {consti} THEN 'constitutional' WHEN coded THEN 'statutory_lookup' WHEN {vague} THEN 'vague_natural' ELSE 'general_legal' END AS query_type FROM n)
SELECT conv_id, turn, query_type, CASE query_type {conf} END AS confidence, CASE query_type {pipe} END AS pipeline, practice_area, 'All India' AS jurisdiction, ({temporal}) OR coded AS time_sensitive, CASE WHEN coded THEN 1 ELSE 0 END AS n_sections FROM a"""


def _any(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


QUERIES = {
    "page_lines": page_lines,
    "parsed_pages": parsed_pages,
    "page_metadata": page_metadata,
    "page_chunks": page_chunks,
    "line_sections": line_sections,
    "first_sentences": first_sentences,
    "sentence_counts": sentence_counts,
    "packed_chunks": packed_chunks,
    "slices": slices,
    "upload_confidence": upload_confidence,
    "party_keys": party_keys,
    "routed_queries": routed_queries,
    "act_documents": act_documents,
    "act_sections": act_sections,
}
ORACLE_SQL = {
    "page_lines": f"WITH {PARSED} SELECT page_id, CAST(len(lines) AS INT) AS n_lines, md5(array_to_string(lines, chr(10))) AS digest FROM l",
    "parsed_pages": f"WITH {PARSED} SELECT page_id, title, CAST(len(paragraphs) AS INT) AS n_paragraphs, CAST(len(headers) AS INT) AS n_headers, md5(array_to_string(paragraphs, chr(10))) AS body_digest, string_split(rtrim(url, '/'), '/')[-1] AS source_ref, sha256(html) AS checksum FROM parsed",
    "page_metadata": f"""WITH {PARSED}, x AS (SELECT page_id, title, array_to_string(paragraphs, chr(10)) AS body FROM parsed)
SELECT page_id, title, nullif(regexp_extract(body, '(\\(\\d{{4}}\\)\\s*\\d+\\s*SCC\\s*\\d+|AIR\\s+\\d{{4}}\\s+SC\\s+\\d+)', 1), '') AS citation, nullif(regexp_extract(body, '(?i)(\\d{{4}}\\s+INSC\\s+\\d+)', 1), '') AS neutral_citation,
CAST(try_cast(nullif(regexp_extract(body, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS DATE) AS VARCHAR) AS date,
CASE WHEN contains(title, ' v ') THEN trim(split_part(title, ' v ', 1)) WHEN contains(title, ' vs ') THEN trim(split_part(title, ' vs ', 1)) WHEN contains(title, ' vs. ') THEN trim(split_part(title, ' vs. ', 1)) END AS appellant, 'Bombay High Court' AS court FROM x""",
    "page_chunks": f"WITH {PARSED} SELECT page_id, CAST(i - 1 AS INT) AS chunk_index, len(paragraphs) AS total_chunks, md5(paragraphs[i]) AS digest FROM parsed, unnest(range(1, len(paragraphs) + 1)) u(i)",
    "line_sections": r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM documents),
h AS (SELECT *, regexp_full_match(line, '[A-Z][a-z]+\.') AS head FROM l WHERE line <> ''), s AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section_index FROM h)
SELECT doc_id, CAST(section_index AS BIGINT) AS section_index, rtrim(max(CASE WHEN head THEN line END), '.') AS heading, md5(coalesce(string_agg(CASE WHEN NOT head THEN line END, ' ' ORDER BY pos), '')) AS digest FROM s WHERE section_index > 0 GROUP BY doc_id, section_index""",
    "first_sentences": f"""SELECT doc_id, md5(CASE WHEN contains(t, '.') THEN trim(split_part(t, '.', 1)) || '.' WHEN contains(t, '!') THEN trim(split_part(t, '!', 1)) || '!' WHEN contains(t, '?') THEN trim(split_part(t, '?', 1)) || '?' WHEN length(t) <= 220 THEN t ELSE rtrim(substr(t, 1, 220)) || '...' END) AS digest
FROM (SELECT doc_id, {SQUEEZED} AS t FROM documents)""",
    "sentence_counts": r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS INT) AS n_sentences FROM documents",
    "packed_chunks": r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(list_filter(regexp_split_to_array(trim(x), '\s+'), lambda y: y <> ''))), lambda n: n > 0) AS ws FROM documents),
r AS (SELECT doc_id, ws, 1 AS i, 0 AS chunk_index, ws[1] AS n FROM s WHERE len(ws) > 0 UNION ALL SELECT doc_id, ws, i + 1, CASE WHEN n > 0 AND n + ws[i + 1] > 140 THEN chunk_index + 1 ELSE chunk_index END, CASE WHEN n > 0 AND n + ws[i + 1] > 140 THEN ws[i + 1] ELSE n + ws[i + 1] END FROM r WHERE i < len(ws))
SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(max(n) AS INT) AS n_words FROM r GROUP BY doc_id, chunk_index""",
    "act_documents": r"""WITH w AS (SELECT item_id, len(string_split(text, ' ')[1:9]) AS n FROM benchmark)
SELECT item_id AS doc_id, CASE WHEN item_id % 2 = 0 THEN 'Act number ' || item_id ELSE 'The title line' END AS act_name, CASE WHEN item_id % 5 = 0 THEN 'Goa' ELSE 'Central' END AS jurisdiction, CASE WHEN item_id % 4 = 0 THEN 'ref-' || item_id WHEN item_id % 2 = 0 THEN 'act-number-' || item_id ELSE 'the-title-line' END AS source_ref,
array_to_string(list_transform(range(0, n, 3), lambda x: x + 1), ',') AS in_force, 'Parliament of India' AS court, CASE WHEN item_id % 3 = 0 THEN '2024-07-01' ELSE '1950-01-26' END AS date, 'criminal,procedure' AS practice_areas FROM w""",
    "act_sections": r"""WITH w AS (SELECT item_id, string_split(text, ' ')[1:9] AS ws FROM benchmark), s AS (SELECT item_id, k, trim(regexp_replace(array_to_string(ws[k + 1:k + 3], ' '), '\s+', ' ', 'g')) AS text, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(item_id || '|section|' || (k + 1))) AS h FROM w, unnest(range(0, len(ws), 3)) u(k))
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS section_id, item_id AS doc_id, CAST(k + 1 AS VARCHAR) AS number, 'heading ' || (k // 3) AS heading, text, TRUE AS in_force FROM s""",
    "slices": "SELECT item_id, CAST(i AS INT) AS i, substr(text, i * 48 + 1, 48) AS slice FROM benchmark, unnest(range((length(text) + 47) // 48)) u(i)",
    "upload_confidence": """SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE round(least(0.99, 0.72 + least(length(text), 500) / 2000.0::DOUBLE), 3) END AS typed,
CASE WHEN length(text) = 0 THEN round(least(greatest((doc_id % 100) / 100.0::DOUBLE, 0), 0.2), 3) ELSE round(least(0.98, greatest((doc_id % 100) / 100.0::DOUBLE, 0.45) + least(length(text), 300) / 1500.0::DOUBLE), 3) END AS scanned FROM documents""",
    "party_keys": "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS key, translate(c_name, 'OoIl', '0011') AS digits, trim(replace(regexp_replace(replace(replace(lower(c_name || ' vs. ' || c_mktsegment), 'vs.', 'v'), 'vs', 'v'), '[.,]', ' ', 'g'), '  ', ' ')) AS case_key FROM customer",
    "routed_queries": ROUTED.format(
        phrases=", ".join(f"'{p}'" for p in PHRASES),
        areas=" ".join(f"WHEN {_any('q', s)}{' OR coded' if a == 'criminal' else ''} THEN '{a}'" for a, s in routing.AREAS),
        hops=_any("norm", routing.MULTI_HOP), consti=_any("norm", routing.CONSTITUTIONAL), vague=_any("q", routing.VAGUE), temporal=_any("norm", routing.TEMPORAL),
        conf=" ".join(f"WHEN '{k}' THEN {v[0]}::DOUBLE" for k, v in routing.TYPES.items()), pipe=" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in routing.TYPES.items()),
    ),
}
