"""Chunk plans for judgments, statutes, constitutions and reports. Native folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import packed_sentences

# Word targets.
STATUTE_WORDS, TEXT_WORDS, REPORT_WORDS = 140, 220, 220
SUBSECTION = r"(?=\((?:\d+|[a-z])\)\s)"


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def statute_parts(text: Column, max_words: int = STATUTE_WORDS) -> Column:
    """A section cut before (1), (a) and so on, what comes before them prefixed to every part, then packed."""
    parts = F.filter(F.transform(F.split(text, SUBSECTION), lambda p: F.trim(p)), lambda p: p != "")
    lead = F.when((F.size(parts) > 1) & ~F.element_at(parts, 1).rlike(r"^\("), F.element_at(parts, 1))
    rest = F.when(lead.isNotNull(), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    full = F.transform(rest, lambda p: F.concat_ws(" ", lead, p))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(full, lambda p: packed_sentences(p, max_words))))


def report_windows(paragraphs: Column, max_words: int = REPORT_WORDS) -> Column:
    """(first, end) of greedy windows of paragraphs, each at least one long, the next starting at the last paragraph of the one before.

    One fold over the paragraphs: each is counted once, and its words stand in the state while its window is open. A window is
    closed where its next paragraph no longer fits; the one that opens then holds the last paragraph of the one before, and closes in
    turn if that alone leaves no room.
    """
    state = "struct<found:array<struct<first:int,end:int>>,first:int,words:int,last:int>"
    none = F.array().cast("array<struct<first:int,end:int>>")
    start = F.struct(none.alias("found"), F.lit(0).alias("first"), F.lit(0).alias("words"), F.lit(0).alias("last")).cast(state)
    window = lambda a, b: F.struct(a.alias("first"), b.alias("end"))
    as_state = lambda found, first, words, last: F.struct(found.alias("found"), first.alias("first"), words.alias("words"), last.alias("last"))

    def step(s: Column, x: Column) -> Column:
        i, n = x["i"], x["n"]
        fits = (s["words"] == 0) | (s["words"] + n <= max_words)
        # closed before i: the next window starts at i - 1 if it is longer than one, else at i
        closed = F.concat(s["found"], F.array(window(s["first"], i)))
        again = i - 1 > s["first"]
        joined = s["last"] + n <= max_words
        twice = F.concat(closed, F.array(window(i - 1, i)))
        return (
            F.when(fits, as_state(s["found"], s["first"], s["words"] + n, n)).when(again & (joined | (s["last"] == 0)), as_state(closed, i - 1, s["last"] + n, n)).when(again, as_state(twice, i, n, n)).otherwise(as_state(closed, i, n, n))
        )

    counted = F.transform(paragraphs, lambda p, i: F.struct(i.alias("i"), n_words(p).alias("n")))
    end = lambda s: F.concat(s["found"], F.array(window(s["first"], F.size(paragraphs))))
    return F.when(F.size(paragraphs) == 0, none).otherwise(F.aggregate(counted, start, step, end))


def judgment_kind(header: Column, text: Column) -> Column:
    """What a paragraph is, by words in its header or in itself."""
    t = F.lower(F.concat_ws(" ", header, text))
    has = lambda *words: t.rlike("|".join(words))
    return F.when(has("headnote", "issue", "summary"), "headnote").when(has("obiter", "observation", "dicta"), "obiter_dictum").when(has("holding", "ratio", "decision"), "ratio_decidendi").otherwise("judgment_paragraph")


def judgment_chunks(docs: DataFrame) -> DataFrame:
    """Headnotes whole, then ratio and obiter packed; where there is none of these paragraphs, packed, under the header of their place; the whole body where there are no paragraphs.

    docs: doc_id, headnotes, ratio, obiter, paragraphs, headers (arrays of strings), body.
    """
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    as_piece = lambda kind, header, text: F.struct(kind.alias("kind"), header.alias("header"), text.alias("text"))
    packed = lambda c, kind, header: F.flatten(F.transform(some(c), lambda t: F.transform(packed_sentences(t, TEXT_WORDS), lambda x: as_piece(F.lit(kind), F.lit(header), x))))
    notes = F.transform(some("headnotes"), lambda t: as_piece(F.lit("headnote"), F.lit("Headnote"), t))
    special = F.concat(notes, packed("ratio", "ratio_decidendi", "Ratio Decidendi"), packed("obiter", "obiter_dictum", "Obiter Dicta"))
    filled = F.filter(F.transform(some("paragraphs"), lambda t: F.trim(t)), lambda t: t != "")
    body = F.trim(F.coalesce("body", F.lit("")))
    paragraphs = F.when(F.size(filled) > 0, filled).when(body != "", F.array(body)).otherwise(filled)
    header = lambda i: F.try_element_at(some("headers"), F.least(i + 1, F.greatest(F.size(some("headers")), F.lit(1))))
    plain = F.flatten(F.transform(paragraphs, lambda t, i: F.transform(packed_sentences(t, TEXT_WORDS), lambda x: as_piece(judgment_kind(header(i), t), header(i), x))))
    return indexed(docs.select("doc_id", F.posexplode(F.when(F.size(special) > 0, special).otherwise(plain)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*"))


def chunked(judgments: DataFrame, sections: DataFrame, articles: DataFrame, reports: DataFrame) -> DataFrame:
    """Chunks of documents of every kind, each by its own plan: doc_id, chunk_index, total_chunks, kind, header, text. Orders and other kinds are cut as judgments are."""
    same = lambda d, kind, header: d.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "total_chunks", kind.alias("kind"), header.alias("header"), "text")
    none = F.lit(None).cast("string")
    out = same(judgment_chunks(judgments), F.col("kind"), F.col("header"))
    out = out.unionByName(same(statute_chunks(sections), F.lit("statute_section"), F.col("header"))).unionByName(same(article_chunks(articles), F.lit("constitution_article"), F.col("header")))
    return out.unionByName(same(report_chunks(reports), F.lit("lc_report_paragraphs"), none))


def statute_chunks(sections: DataFrame) -> DataFrame:
    """sections: doc_id, section_index, number, heading, text. Every part keeps its section's number and header."""
    parts = sections.select("doc_id", "section_index", "number", F.concat(F.lit("Section "), F.col("number"), F.lit(" - "), F.col("heading")).alias("header"), F.posexplode(statute_parts(F.col("text"))).alias("part", "text"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_index", "part")) - 1
    return indexed(parts.withColumn("chunk_index", at).drop("part", "section_index"))


def article_chunks(articles: DataFrame) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_index")) - 1
    return indexed(articles.select("doc_id", at.alias("chunk_index"), "number", F.concat(F.lit("Article "), F.col("number"), F.lit(" - "), F.col("heading")).alias("header"), "text"))


def report_chunks(docs: DataFrame) -> DataFrame:
    w = docs.select("doc_id", "paragraphs", F.posexplode(report_windows(F.col("paragraphs"))).alias("chunk_index", "w"))
    return indexed(w.select("doc_id", "chunk_index", F.col("w.first").alias("first"), F.col("w.end").alias("end"), F.array_join(F.slice("paragraphs", F.col("w.first") + 1, F.col("w.end") - F.col("w.first")), "\n").alias("text")))


def indexed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("total_chunks", F.count("*").over(Window.partitionBy("doc_id")))
