"""Vector collections: what they hold, which a query looks into, which of their points are open to it, and points made of chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import DIMENSION, embedding

# Collections, the payload fields they index (those in brackets hold lists), the fields of a payload.
COLLECTIONS = [
    ("sc_judgments", "Supreme Court judgment chunks", ["current_validity keyword", "date datetime", "jurisdiction_binding [keyword]", "bench_size integer", "court keyword", "practice_area [keyword]"]),
    ("hc_judgments", "High Court judgment chunks", ["current_validity keyword", "date datetime", "jurisdiction_binding [keyword]", "court keyword", "state keyword", "practice_area [keyword]"]),
    ("statutes", "Statutory section chunks", ["current_validity keyword", "act_name keyword", "section_number keyword", "is_in_force boolean", "amendment_date datetime", "jurisdiction keyword"]),
    ("constitution", "Constitution article chunks", ["section_number keyword", "act_name keyword", "current_validity keyword", "practice_area [keyword]"]),
    ("tribunal_orders", "Tribunal order chunks", ["current_validity keyword", "date datetime", "court keyword", "jurisdiction_binding [keyword]", "practice_area [keyword]"]),
    ("lc_reports", "Law Commission report chunks", ["report_num keyword", "topic keyword", "year integer", "practice_area [keyword]"]),
    ("doctrine_clusters", "Doctrine summary clusters", ["doctrine_name keyword", "area_of_law keyword", "current_validity keyword", "practice_area [keyword]"]),
]
PAYLOAD = [
    "doc_id", "chunk_id", "doc_type", "court", "date", "citation", "section_header", "jurisdiction_binding", "jurisdiction_persuasive", "jurisdiction", "current_validity", "practice_area", "act_name", "section_number", "is_in_force", "bench_size",
    "state", "amendment_date", "chunk_type", "doctrine_name", "area_of_law", "report_num", "topic", "year", "collection_name", "embedding_model", "embedding_version", "source_document_ref",
]
TARGETS = {
    "statutory_lookup": ["statutes", "constitution", "sc_judgments", "hc_judgments", "tribunal_orders"],
    "case_specific": ["sc_judgments", "hc_judgments", "tribunal_orders"],
}
OTHER_TARGETS = ["sc_judgments", "hc_judgments", "statutes", "constitution", "tribunal_orders", "lc_reports"]
GOOD_ONLY = ["sc_judgments", "hc_judgments", "statutes", "constitution", "tribunal_orders", "doctrine_clusters"]
RULINGS = ["sc_judgments", "hc_judgments", "tribunal_orders"]
BY_AREA = ["sc_judgments", "hc_judgments", "tribunal_orders", "constitution", "lc_reports", "doctrine_clusters"]
MODEL, VERSION = "BGE-M3-v1.5", "deterministic-v1"


def specs(spark: SparkSession, dimension: int = DIMENSION) -> DataFrame:
    """name, dimension, distance, description, fields (name, type, is_array) of every collection."""
    rows = [(n, dimension, "cosine", d, [(f.split()[0], f.split()[1].strip("[]"), "[" in f) for f in fields]) for n, d, fields in COLLECTIONS]
    return spark.createDataFrame(rows, "name string, dimension int, distance string, description string, fields array<struct<name:string,type:string,is_array:boolean>>")


def comparable(value: Column, kind: str) -> Column:
    """A payload value for range filters: days and times as timestamps, numbers as doubles, else null."""
    return F.try_to_timestamp(value.cast("string")) if kind == "datetime" else value.try_cast("double") if kind == "integer" else F.lit(None)


def sharing(points: list, queries: list) -> np.ndarray:
    """(points, queries): whether lists have an element in common. What queries ask for is numbered, lists become masks, and one matrix product meets all."""
    number: dict[str, int] = {}
    asked = [(j, number.setdefault(x, len(number))) for j, xs in enumerate(queries) for x in xs]
    held = [(i, number[x]) for i, xs in enumerate(points) if xs is not None for x in xs if x in number]
    p, q = np.zeros((len(points), len(number)), np.float32), np.zeros((len(queries), len(number)), np.float32)
    if asked:
        q[tuple(np.array(asked).T)] = 1
    if held:
        p[tuple(np.array(held).T)] = 1
    return p @ q.T > 0


def open_points(queries: pd.DataFrame, points: pd.DataFrame) -> np.ndarray:
    """(points, queries): whether a point is open to a query, for retrieval.dense.

    queries: query_type, practice_area, time_sensitive, reference_date, courts (own court and binding ones), numbers (sections named); points: collection, current_validity,
    is_in_force, section_number, date, jurisdiction_binding, practice_area. Good law only but for reports; statutes in force, and of the sections named if any
    are; rulings that bind the query's courts, and not later than its day if time counts; the query's practice area unless that is general.
    """
    at = lambda names: points["collection"].isin(names).to_numpy()
    good, statute, ruling, by_area = at(GOOD_ONLY), at(["statutes"]), at(RULINGS), at(BY_AREA)
    base = (~good | (points["current_validity"] == "GOOD_LAW").to_numpy()) & (~statute | (points["is_in_force"] == True).to_numpy())  # noqa: E712
    # a column for each kind of target that the queries have
    kinds, kind = np.unique(queries["query_type"].fillna("").to_numpy(), return_inverse=True)
    ok = np.stack([at(TARGETS.get(k, OTHER_TARGETS)) for k in kinds], 1)[:, kind] & base[:, None]
    numbers = [[] if x is None else list(x) for x in queries["numbers"]]
    any_number = np.array([not x for x in numbers])
    ok &= ~statute[:, None] | any_number | sharing([[x] for x in points["section_number"]], numbers)
    ok &= ~ruling[:, None] | sharing(list(points["jurisdiction_binding"]), [[*([] if x is None else x), "All India"] for x in queries["courts"]])
    timeless = ~(queries["time_sensitive"] == True).to_numpy()  # noqa: E712
    days, until = pd.to_datetime(points["date"]).to_numpy(), pd.to_datetime(queries["reference_date"]).to_numpy()
    ok &= ~ruling[:, None] | timeless | (days[:, None] <= until[None, :])
    general = (queries["practice_area"] == "general").to_numpy()
    ok &= ~by_area[:, None] | general | sharing(list(points["practice_area"]), [[x] for x in queries["practice_area"]])
    return ok


def deduped(hits: DataFrame) -> DataFrame:
    """hits (query_id, chunk_id, collection, score): a chunk found in several collections once, by its best score."""
    return hits.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", "collection")).alias("b")).select("query_id", "chunk_id", "b.collection", "b.score")


def embedded(tasks: DataFrame, model: str = MODEL, version: str = VERSION, embed=embedding) -> DataFrame:
    """tasks (chunk_key, text, model, version) with vector, its dimension and the text's checksum; a task's own model and version before the service's. embed: any function of a text column."""
    t = tasks.withColumn("vector", embed(F.col("text")))
    return t.select("chunk_key", F.coalesce("model", F.lit(model)).alias("model"), F.coalesce("version", F.lit(version)).alias("version"), F.size("vector").alias("dimension"), "vector", F.sha2("text", 256).alias("checksum"))


def payloads(chunks: DataFrame) -> Column:
    """A chunk's payload as JSON: the columns of PAYLOAD that chunks has, in that order; empty fields are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in PAYLOAD if c in chunks.columns]))


def points(chunks: DataFrame, vectors: DataFrame, collection: Column) -> DataFrame:
    """Points of chunks (chunk_id, doc_id, ..) and their vectors (chunk_key, ..): id, collection, vector, payload; chunks without a vector have none."""
    v = vectors.withColumnRenamed("chunk_key", "chunk_id")
    p = chunks.withColumn("collection_name", collection).join(v, "chunk_id").withColumnRenamed("model", "embedding_model").withColumnRenamed("version", "embedding_version")
    key = F.sha1(F.concat_ws("|", "collection_name", F.col("chunk_id").cast("string")))
    return p.select(key.alias("point_id"), F.col("collection_name").alias("collection"), "chunk_id", "doc_id", "vector", payloads(p).alias("payload"), F.col("embedding_model").alias("model"), F.col("embedding_version").alias("version"), "checksum")


def projected(chunks: DataFrame, stored: DataFrame, collection: Column, model: str = MODEL, version: str = VERSION, embed=embedding) -> DataFrame:
    """The points that chunks (chunk_id, doc_id, text, ..) add to what is stored (chunk_id, model, version, checksum): new chunks and changed ones; unchanged text under the same model is not embedded again."""
    wanted = chunks.withColumn("checksum", F.sha2("text", 256)).withColumn("model", F.lit(model)).withColumn("version", F.lit(version))
    fresh = wanted.join(stored.select("chunk_id", "model", "version", "checksum"), ["chunk_id", "model", "version", "checksum"], "left_anti").drop("checksum", "model", "version")
    tasks = fresh.select(F.col("chunk_id").alias("chunk_key"), "text", F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("version"))
    return points(fresh, embedded(tasks, model, version, embed), collection)
