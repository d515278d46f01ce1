"""WARC archives: written as text records, read back with boundary-chain verification.

Writing: one record for each page, an HTTP response with the page's HTML. Of equal
payloads of MIN_REVISIT bytes or more only the one with the smallest page_id is stored;
the others become revisit records that refer to it.

Reading: archives are read in splits, cut at every appearance of the magic line,
so large files are shared among tasks. A task emits for each appearance (a
candidate record) its offset and, by the Content-Length it declares, that of its successor.
Candidates are chained within their split first; pointer jumping over splits, from
offset 0 of every file, then finds the candidates that are reached. Only these are
records: a magic line inside a payload is never pointed at. A payload that holds
magic lines is put together again from the pieces it was cut into.

Cases: null html is an empty payload, null url an empty target; page_ids that repeat
with the same payload are all responses if theirs is the smallest; a file that
does not start with a record gives none; a record cut short by the file's end is not one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, tune, written

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 100
#: Marks of revisits: 8 MB of bits.
MARKS = 1 << 26
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _marked(keys: DataFrame, key: str) -> DataFrame:
    """Which of MARKS marks the hashes in key set: at most MARKS / 32768 rows (slot, bits) of 4 KB, whatever the number of keys."""
    mark = _mark(key)
    return keys.groupBy(F.bitmap_bucket_number(mark).alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("bits"))


def _mark(key: str):
    return F.pmod(F.col(key), F.lit(MARKS)) + 1


def _has_mark(key: str):
    """Whether bits of the key's slot hold its mark."""
    at = F.bitmap_bit_position(_mark(key))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, (at % 8).cast("int")) == 1, F.lit(False))


def write_warc(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Archives under path. The text writer ends every record with the format's two empty lines.

    Revisits are found among ids, digests and lengths. Payloads stay where they are read but for those whose (page_id, digest)
    has the mark of a revisit: these are joined with the revisits. The marks are a bitmap of fixed size; a payload that has a mark by
    chance only takes the longer way.
    """
    p = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha2("html", 256)).withColumn("key", F.xxhash64("page_id", "digest"))
    short = p.where(F.col("bytes") >= MIN_REVISIT).select("page_id", F.unhex("digest").alias("binary"))
    firsts = short.groupBy("binary").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("page_id").alias("ids"), F.count("*").alias("n")).where("first < last or ids < n and ids > 0")
    revisits = short.join(firsts.select("binary", "first"), "binary").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", F.lower(F.hex("binary")).alias("digest"), "first").distinct()
    revisits = written(revisits.withColumn("key", F.xxhash64("page_id", "digest")), "revisits")
    slot = F.bitmap_bucket_number(_mark("key"))
    p = p.withColumn("slot", slot).join(F.broadcast(_marked(revisits, "key")), "slot", "left").withColumn("marked", _has_mark("key")).drop("slot", "bits")
    direct = p.where(~F.col("marked")).withColumn("first", F.lit(None).cast("long"))
    again = revisits.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "first")
    joined = p.where("marked").join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left").drop("id", "d")
    p = direct.unionByName(joined)
    revisit = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name("first"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END), block,
    )
    p.select(record.alias("value")).write.option("lineSep", END).text(path)


def _field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _payload(block: bytes) -> tuple[int, bytes, bytes]:
    """Declared payload length, HTTP head, payload of a block."""
    head, _, payload = block.partition(END.encode())
    declared = _field(head, "Content-Length")
    return int(declared) if declared and declared.isdigit() else len(payload), head, payload


CHUNK = "file string, block long, local long, size long, length long, whole boolean, page_id long, refers_to long, record_type string, stated string, payload_bytes long, payload_digest string"
_CHUNK = pa.schema([("file", pa.string()), ("block", pa.int64()), ("local", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("whole", pa.bool_()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("record_type", pa.string()), ("stated", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _described(piece: bytes) -> list:
    """length (of the whole record, magic and end included; null if there is no valid head), whole, page_id, refers_to, record_type, stated digest, payload length and digest."""
    head, gap, rest = piece.partition(END.encode())
    size = _field(head, "Content-Length")
    kind = _field(head, "WARC-Type")
    if not gap or not size or not size.isdigit() or not kind:
        return [None, False, None, None, None, None, None, None]
    length = len(MAGIC) + len(head) + len(gap) + int(size) + len(END)
    whole = len(rest) == int(size) + len(END)
    stated = (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha256:") or None
    out = [length, whole, _page(_field(head, "WARC-Record-ID")), _page(_field(head, "WARC-Refers-To")), kind, stated]
    if not whole:
        return [*out, None, None]
    n, _, payload = _payload(rest[: int(size)])
    return [*out, n if kind == "revisit" else len(payload), stated if kind == "revisit" else hashlib.sha256(payload).hexdigest()]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magic lines: its place in its split, and what its head says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for b in batches:
            rows = []
            for file, block, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (file, block) != split:
                    split, at = (file, block), 0
                piece = piece.as_py()
                rows.append([file, block, at, len(piece) + len(MAGIC), *_described(piece)])
                at += len(piece) + len(MAGIC)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK)], schema=_CHUNK)

    return _pieces(spark, path).mapInArrow(run, CHUNK)


def _exits(part: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, where its chain leaves the split."""
    part = part.sort_values("pos", ascending=False)
    leaves: dict[int, int] = {}
    for pos, following in zip(part["pos"], part["following"]):
        leaves[pos] = leaves.get(following, following)
    return pd.DataFrame({"file": part["file"], "pos": part["pos"], "leaves": [leaves[p] for p in part["pos"]]})


def _walked(part: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that its entry leads to."""
    part = part.sort_values("pos")
    at, hit = part["entry"].iloc[0], []
    for pos, following in zip(part["pos"], part["following"]):
        hit.append(pos == at)
        if pos == at:
            at = following
    return part.loc[hit, ["file", "pos"]]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that its file's chain reaches."""
    tune(spark)
    chunks = written(_chunks(spark, path), "chunks")
    sizes = chunks.groupBy("file", "block").agg(F.sum("size").alias("total"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole_file = Window.partitionBy("file")
    bases = sizes.withColumn("base", F.coalesce(F.sum("total").over(in_file), F.lit(0)))
    bases = bases.withColumn("file_size", F.sum("total").over(whole_file) - len(MAGIC)).withColumn("splits", F.count("*").over(whole_file))
    # a piece starts after its magic line; the first piece of a file comes before any
    placed = chunks.join(bases, ["file", "block"]).withColumn("pos", F.col("base") + F.col("local") - len(MAGIC))
    placed = placed.where("pos >= 0")
    known = placed.where("length is not null and pos + length <= file_size").withColumn("following", F.col("pos") + F.col("length"))
    known = written(known.drop("base", "local", "total", "size", "length"), "candidates")

    jumps = known.select("file", "block", "pos", "following").groupBy("file", "block").applyInPandas(_exits, "file string, pos long, leaves long")
    targets = jumps.select("file", F.col("leaves").alias("pos")).distinct().unionByName(known.where("pos = 0").select("file", "pos")).distinct()
    jumps = written(jumps.join(targets, ["file", "pos"], "left_semi"), "jumps")
    reached = known.where("pos = 0").select("file", "pos")
    most = known.agg(F.max("splits")).first()[0] or 1
    for _ in range(max(0, most - 1).bit_length()):
        reached = written(reached.union(reached.join(jumps, ["file", "pos"]).select("file", F.col("leaves").alias("pos"))).distinct(), "reached")
        onward = jumps.select("file", F.col("pos").alias("leaves"), F.col("leaves").alias("onward"))
        jumps = written(jumps.join(onward, ["file", "leaves"], "left").select("file", "pos", F.coalesce("onward", "leaves").alias("leaves")), "jumps")
    entries = known.join(reached, ["file", "pos"]).groupBy("file", "block").agg(F.min("pos").alias("entry"))
    inside = known.select("file", "block", "pos", "following").join(entries, ["file", "block"])
    records = inside.groupBy("file", "block").applyInPandas(_walked, "file string, pos long")
    records = known.join(records, ["file", "pos"])

    whole = records.where("whole").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    cut = records.where(~F.col("whole")).select("file", F.col("pos").alias("start"), "following", "page_id", "record_type", "refers_to", "stated")
    if cut.isEmpty():
        return whole
    # payloads with magic lines: their pieces, read again
    reach = cut.join(bases.select("file", "block", "base", "total"), "file").where("base < following and base + total > start").drop("base", "total")
    spans = placed.select("file", "block", "local", "pos").join(reach, ["file", "block"]).where("pos >= start and pos < following")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for b in batches:
            local = []
            for file, block, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (file, block) != split:
                    split, at = (file, block), 0
                local.append(at)
                at += len(piece.as_py()) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], names=[*b.schema.names, "local"])

    again = _pieces(spark, path).mapInArrow(pieces, "file string, block long, piece binary, local long")

    def assembled(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        first = part.iloc[0]
        record = MAGIC.encode().join(bytes(p) for p in part["piece"])[: int(first["following"] - first["start"]) - len(MAGIC)]
        head, _, rest = record.partition(END.encode())
        n, _, payload = _payload(rest[: -len(END)])
        revisit = first["record_type"] == "revisit"
        return pd.DataFrame({"page_id": [first["page_id"]], "payload_bytes": [n if revisit else len(payload)], "payload_digest": [first["stated"] if revisit else hashlib.sha256(payload).hexdigest()], "record_type": [first["record_type"]], "refers_to": [first["refers_to"]]})

    joined = again.join(spans, ["file", "block", "local"]).groupBy("file", "start").applyInPandas(assembled, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return whole.unionByName(joined)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_warc(spark, path)


#: Of the written and reread records; each page's row follows from its html alone.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN first_id IS NOT NULL AND d.page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND d.page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
