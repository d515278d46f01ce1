"""Ingest: stages in order, deterministic ids, canonical tables, a ledger. Tables are rewritten by key, never updated in place."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..operators.state import latest

#: Fixed value: the namespace of URL names.
URL_NAMESPACE = uuid.NAMESPACE_URL.hex
# The sources that are read.
CATALOG = [
    ("constitution_of_india", "Constitution of India Corpus", "STATUTE_PORTAL", "https://www.indiacode.nic.in", "www.indiacode.nic.in", ["All India"], "ad hoc", "structured_text", "constitution-text-v1", "APPROVED", "Canonical constitutional text and amendments."),
    ("india_code", "India Code Central Acts", "STATUTE_PORTAL", "https://www.indiacode.nic.in", "www.indiacode.nic.in", ["All India"], "daily", "structured_text", "indiacode-text-v1", "APPROVED", "Central bare acts and section text."),
    ("bns_bundle", "BNS / BNSS / BSA Corpus", "STATUTE_PORTAL", "https://www.indiacode.nic.in", "www.indiacode.nic.in", ["All India"], "ad hoc", "structured_text", "criminal-code-text-v1", "APPROVED", "New criminal codes effective July 1, 2024."),
    ("supreme_court", "Supreme Court of India", "COURT_PORTAL", "https://www.sci.gov.in", "www.sci.gov.in", ["All India"], "daily", "html_parser", "supreme-court-html-v1", "APPROVED", None),
    ("bombay_high_court", "Bombay High Court", "COURT_PORTAL", "https://bombayhighcourt.nic.in", "bombayhighcourt.nic.in", ["Maharashtra", "Goa"], "daily", "html_parser", "high-court-html-v1", "APPROVED", None),
    ("nclt", "National Company Law Tribunal", "TRIBUNAL_PORTAL", "https://nclt.gov.in", "nclt.gov.in", ["All India"], "weekly", "html_parser", "tribunal-html-v1", "APPROVED", None),
]
CATALOG_SCHEMA = "source_key string, display_name string, source_type string, base_url string, hostname string, jurisdictions array<string>, frequency string, access string, parser_version string, approval string, notes string"


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


def registry_merged(registry: DataFrame, used: DataFrame) -> DataFrame:
    """The registry after a run of sources (source_key, base_url, source_type, parser_version): listed ones as the catalogue has them (their kind and notes stay), new ones added, unlisted new ones under their own key, by hand, approved."""
    key = "source_key"
    listed = catalog(registry.sparkSession)
    runs = used.dropDuplicates([key])
    fresh = listed.join(runs.select(key), key, "left_semi").select(key, *[F.col(c).alias(f"new_{c}") for c in listed.columns if c not in (key, "source_type", "notes")], F.lit(True).alias("listed"))
    kept = registry.join(fresh, key, "left").select(*[F.when(F.col("listed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if f"new_{c}" in fresh.columns else F.col(c) for c in listed.columns])
    new = runs.join(registry.select(key), key, "left_anti")
    unlisted = new.join(listed.select(key), key, "left_anti").select(
        key, F.col(key).alias("display_name"), "source_type", "base_url", F.col("base_url").alias("hostname"), F.array(F.lit("All India")).alias("jurisdictions"), F.lit("unknown").alias("frequency"), F.lit("manual").alias("access"), "parser_version",
        F.lit("APPROVED").alias("approval"), F.lit(None).cast("string").alias("notes"),
    )
    return kept.unionByName(listed.join(new.select(key), key, "left_semi")).unionByName(unlisted)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID of version 5, from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def document_id(source: Column, reference: Column, checksum: Column) -> Column:
    return uuid5(F.concat_ws("|", source, reference, checksum))


def default_binding(court: Column, doc_type: Column) -> Column:
    everywhere = doc_type.isin("statute", "constitution") | (court == "Supreme Court") | court.isNull()
    return F.array(F.when(everywhere, F.lit("All India")).otherwise(court))


def collection(doc_type: Column, court: Column) -> Column:
    apex = F.coalesce(F.lower(F.trim(court)) == "supreme court", F.lit(False))
    return (
        F.when((doc_type == "judgment") & apex, "sc_judgments").when(doc_type == "judgment", "hc_judgments").when(doc_type == "statute", "statutes").when(doc_type == "constitution", "constitution")
        .when(doc_type == "order", "tribunal_orders").when(doc_type == "lc_report", "lc_reports").otherwise("doctrine_clusters")
    )


def staged(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Stages applied in order; their names stand in `stage_trace`."""
    for _, stage in stages:
        df = df.transform(stage)
    return df.withColumn("stage_trace", F.array(*[F.lit(n) for n, _ in stages]))


def canonical(documents: DataFrame) -> DataFrame:
    """The last fetch of every document id."""
    return latest(documents, ["doc_id"], [F.desc("fetched_at"), F.desc("checksum")])


def denormalised(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's attributes, ids and normalised text."""
    attributes = [c for c in ("court", "doc_type", "date", "current_validity", "practice_areas") if c in documents.columns]
    c = chunks.join(documents.select("doc_id", *attributes), "doc_id")
    return c.withColumn("chunk_id", uuid5(F.concat_ws("|", "doc_id", F.col("chunk_index").cast("string")))).withColumn("text_normalized", squeeze(F.col("text")))


def saved(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """One folder for each table and run: a run that is repeated replaces its own rows and no others."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run={run_id}")
