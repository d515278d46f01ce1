"""Uploaded files: text of PDF, DOCX and images by pluggable extractors, page by page, with confidences and what their pages name."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ocr import normalised
from ..functions.text import squeeze
from ..tables import stored

WORD_SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PAGES = "path string, page int, text string, kind string"
RANGES = "path string, first int, last int"
#: A page of a PDF with so many characters is typed; one with less is given to recognition.
TYPED = 24
#: How a file's text was found, by its mode.
METHODS = {"typed_pdf": "pdf_text", "scanned_pdf": "ocr_pdf", "mixed_pdf": "hybrid_pdf", "docx_text": "docx_xml", "image_ocr": "ocr"}


def text_confidence(text: Column, baseline: float) -> Column:
    n = F.char_length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.round(F.least(F.lit(0.99), baseline + F.least(n, F.lit(500)) / 2000.0), 3))


def ocr_confidence(base: Column, text: Column) -> Column:
    n = F.char_length(text)
    low = F.round(F.least(F.greatest(base, F.lit(0.0)), F.lit(0.2)), 3)
    return F.when(F.coalesce(n, F.lit(0)) == 0, low).otherwise(F.round(F.least(F.lit(0.98), F.greatest(base, F.lit(0.45)) + F.least(n, F.lit(300)) / 1500.0), 3))


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD_SPACE}t")) for p in root.iter(f"{WORD_SPACE}p")).strip()


def pages(files: DataFrame, pdf: Callable[[bytes], list[str]] | None = None, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """A row for each page of files (path, content), as the binaryFile source gives them. Without an extractor a page has no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                name, content = path.lower(), bytes(content)
                if name.endswith(".docx"):
                    rows.append((path, 1, docx_text(content), "docx"))
                elif name.endswith(".pdf"):
                    rows += [(path, i + 1, t, "typed_pdf" if len(t.strip()) >= 24 else "scanned_pdf") for i, t in enumerate(pdf(content) if pdf else [""])]
                else:
                    rows.append((path, 1, ocr(content) if ocr else "", "image"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "kind"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def document_modes(pages_: DataFrame) -> DataFrame:
    """typed, scanned or mixed, and the mean confidence of a file's pages."""
    conf = F.when(F.col("kind") == "typed_pdf", text_confidence(F.col("text"), 0.72)).when(F.col("kind") == "docx", text_confidence(F.col("text"), 0.75)).otherwise(ocr_confidence(F.lit(0.0), F.col("text")))
    kinds = F.collect_set(F.when(F.col("kind").isin("typed_pdf", "docx"), "typed").otherwise("scanned"))
    return pages_.groupBy("path").agg(kinds.alias("k"), F.round(F.avg(conf), 3).alias("confidence")).select("path", F.when(F.size("k") > 1, "mixed").otherwise(F.col("k")[0]).alias("mode"), "confidence")


def kind_of(path: Column) -> Column:
    """pdf, docx or image by the ending of a path, else null: such files are no uploads."""
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").when(low.rlike(r"\.(png|jpe?g|tiff?)$"), "image")


def page_ranges(files: DataFrame, load: Callable[[str], bytes], count: Callable[[bytes], int], per_range: int = 50) -> DataFrame:
    """path, first, last: the pages of files (path) in ranges of at most per_range. Files that are no PDF have one page, a PDF without pages has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind in zip(b["path"], b["kind"]):
                n = count(load(path)) if kind == "pdf" else 1
                rows += [(path, at, min(at + per_range - 1, n)) for at in range(1, n + 1, per_range)]
            yield pd.DataFrame(rows, columns=["path", "first", "last"])

    return files.select("path", kind_of(F.col("path")).alias("kind")).where("kind is not null").mapInPandas(run, RANGES)


def ranged_pages(
    ranges: DataFrame, load: Callable[[str], bytes], typed: Callable[[bytes, int], str] | None = None, recognised: Callable[[bytes, int], tuple[str, float]] | None = None, tasks: int | None = None
) -> DataFrame:
    """The pages of ranges (path, first, last): path, page, text, kind, base (confidence of recognition).

    Ranges are dealt to tasks by path and first page, so a long file is read by many. A task opens a file once for each of its ranges, and holds one file at a time. typed and recognised give the text of a page; without
    them it is empty. A typed page with less than 24 characters is recognised instead.
    """

    def one(path: str, kind: str, content: bytes, page: int) -> tuple:
        if kind == "docx":
            return path, page, " ".join(docx_text(content).split()), "docx", None
        text = " ".join((typed(content, page) if kind == "pdf" and typed else "").split())
        if len(text) >= TYPED:
            return path, page, text, "typed_pdf", None
        text, base = recognised(content, page) if recognised else ("", 0.0)
        return path, page, " ".join(text.split()), "scanned_pdf" if kind == "pdf" else "image", float(base)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, first, last, kind in zip(b["path"], b["first"], b["last"], b["kind"]):
                content = load(path)
                yield pd.DataFrame([one(path, kind, content, page) for page in range(first, last + 1)], columns=["path", "page", "text", "kind", "base"]).astype({"base": "float64"})

    n = tasks or max(ranges.sparkSession.sparkContext.defaultParallelism, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = ranges.withColumn("kind", kind_of(F.col("path"))).repartition(n, "path", "first")
    return dealt.mapInPandas(run, f"{PAGES}, base double")


def page_confidence() -> Column:
    """Of a page (kind, text, base)."""
    text, base = F.col("text"), F.coalesce("base", F.lit(0.0))
    return F.when(F.col("kind") == "typed_pdf", text_confidence(text, 0.72)).when(F.col("kind") == "docx", text_confidence(text, 0.75)).otherwise(ocr_confidence(base, text))


def cleaned_pages(pages_: DataFrame) -> DataFrame:
    """Pages (path, page, text, kind, base) with raw_text, normalized_text, confidence, citations, sections, parties, corrections."""
    p = pages_.withColumn("text", squeeze(F.coalesce("text", F.lit(""))))
    return normalised(p.withColumn("confidence", page_confidence())).withColumnRenamed("text", "raw_text")


def merged(cleaned: DataFrame, lists: str, value: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """path and a list's values over all pages of a file, in the order in which they first stand, each once.

    Values meet before they are brought together, so a file's row holds what differs, however many pages it has.
    """
    one = cleaned.select("path", "page", F.posexplode(lists).alias("i", "v"))
    first = one.groupBy("path", value(F.col("v")).alias("key")).agg(F.min(F.struct("page", "i")).alias("at"), F.min_by("v", F.struct("page", "i")).alias("v"))
    return first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "key", "v"))).alias("all")).select("path", F.transform("all", lambda x: x["v"]).alias(lists))


def files_merged(cleaned: DataFrame) -> DataFrame:
    """A row for each file of cleaned pages: mode, extraction_method, page_count, raw_extracted_text, extracted_text, confidence, citations, sections, parties.

    Texts of pages stand in their order, a line each, without empty ones. Parties are the same if their longest name is. Confidences are thousandths, so their mean
    is the same in any order of pages. Cleaned pages become a table, of which each list reads its column.
    """
    cleaned = stored(cleaned)
    kinds = F.collect_set("kind")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("page", c)), lambda x: x[c] != "")), lambda x: x[c]), "\n")
    of = cleaned.groupBy("path").agg(kinds.alias("kinds"), F.count("*").alias("page_count"), text("raw_text").alias("raw_extracted_text"), text("normalized_text").alias("extracted_text"), (F.round(F.sum(F.round(F.col("confidence") * 1000).cast("long")) / F.count("*")) / 1000).alias("confidence"))
    only = lambda k: F.col("kinds") == F.array(F.lit(k))
    mode = F.when(only("docx"), "docx_text").when(only("image"), "image_ocr").when(only("typed_pdf"), "typed_pdf").when(only("scanned_pdf"), "scanned_pdf").otherwise("mixed_pdf")
    method = F.element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), F.col("mode"))
    out = of.withColumn("mode", mode).withColumn("extraction_method", method).drop("kinds")
    for name, key in (("citations", lambda x: x), ("sections", lambda x: x), ("parties", lambda x: x["canonical"])):
        out = out.join(merged(cleaned, name, key), "path", "left").withColumn(name, F.coalesce(name, F.array().cast(cleaned.schema[name].dataType)))
    return out
