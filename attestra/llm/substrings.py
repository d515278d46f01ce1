"""Exact substring dedup: windows of WINDOW words that start anywhere else are found by an FM-index per shard.

Which shard: a window's anchor is the smallest hash of the GRAM-word runs in it,
so equal windows have equal anchors wherever they stand. Neighbouring windows with
the same anchor make one segment. Anchors that occur once in the corpus are
dropped by counting, for their windows occur once; the segments of the others go to
shards by anchor, each distinct segment once with its number of copies. An anchor with more
than HOT distinct segments (a phrase common to many different contexts) is
dealt by window instead: each distinct window goes to a shard of its own hash.

Per shard an FM-index of its distinct segments (wavelet matrix over the
Burrows-Wheeler transform) is searched backward with those segments streamed
against it, which yields the intervals of windows with two occurrences or more.

All of a document's words covered by such windows are removed; windows are judged on the
input alone.

Cases: null and empty texts have no words; texts of fewer than WINDOW words lose
none; repeated rows are two documents, each the copy of the other; null ids are kept; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hashed_words, mix, tune, width, written
from .fmindex import FMIndex

WINDOW = 35
GRAM = 8
#: Distinct segments (of 50 words on average) that one anchor may put into a shard.
HOT = 2000
#: Words of a shard, about; and of a segment, at most.
SHARD_WORDS = 300_000
SEGMENT_WORDS = 256
#: Segments that a task remembers having sent.
SEEN = 400_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def eight_grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM = 8 elements from each on, by doubling."""
    with np.errstate(over="ignore"):
        for k, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
            h = h[:-k] * np.uint64(factor) + h[k:]
            h ^= h >> np.uint64(31)
    return mix(h)


def runs(h: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: (document, anchor, first word, end word, places of the anchor) of each run of neighbouring windows with one anchor."""
    none = np.empty(0, np.int64)
    if len(h) < window:
        return (none,) * 5
    grams = eight_grams(h)
    low = sliding_min(grams, window - GRAM + 1)
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    start = np.repeat(ends - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(start):
        return (none,) * 5
    low = low[start]
    at = np.concatenate([[0], np.flatnonzero((low[1:] != low[:-1]) | (owner[1:] != owner[:-1])) + 1])
    end = start[np.concatenate([at[1:], [len(low)]]) - 1] + window
    first, anchor, owner = start[at], low[at], owner[at]
    # how often the anchor stands in its run: twice only where words repeat
    n = end - first - GRAM + 1
    place = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    places = np.add.reduceat((grams[place] == np.repeat(anchor, n)).astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
    base = (ends - sizes)[owner]
    return owner, anchor.view(np.int64), first - base, end - base, places


def _keyed(docs: DataFrame) -> DataFrame:
    """text with a key: doc_id and a hash of the text, so rows that share an id stay apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("h"))


def anchor_runs(keyed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 100):
                b = whole.slice(i, 100)
                owner, anchor, lo, hi, places = runs(*hashed_words([t.as_py().encode() for t in b.column(2)]), window)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(anchor), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(places.astype(np.int32))],
                    names=["k", "h", "anchor", "lo", "hi", "places"],
                )

    return keyed.select("k", "h", "text").mapInArrow(run, "k long, h long, anchor long, lo int, hi int, places int")


def packed_texts(keyed: DataFrame) -> DataFrame:
    """Texts compressed, so that they take less room where they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([squeeze(t.as_py().encode()) for t in b.column(3)], pa.binary())], names=["doc_id", "k", "h", "text"])

    return keyed.select("doc_id", "k", "h", "text").mapInArrow(run, "doc_id long, k long, h long, text binary")


PARTS = "is_document boolean, doc_id long, k long, h long, n_words long, kept_sha256 string, text binary, sid binary, anchor long, lo int, n int, words binary"
_PARTS = pa.schema([("is_document", pa.bool_()), ("doc_id", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("sid", pa.binary()), ("anchor", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])


def _parts(window: int):
    """Documents without candidates are done; others keep their text, and yield segments. A segment's words go with its first mention in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                rows = []
                b = whole.slice(i, 250)
                doc_ids, texts, ks, hs = (b.column(j).to_pylist() for j in range(4))
                lists = b.column(4)
                offsets, flat = lists.offsets.to_pylist(), lists.values
                los, his, anchors = (flat.field(n).to_pylist() for n in ("lo", "hi", "anchor"))
                for j, (doc_id, packed, k, h) in enumerate(zip(doc_ids, texts, ks, hs)):
                    words = unpack(packed).split() if packed else []
                    found = range(offsets[j], offsets[j + 1]) if lists[j].is_valid else ()
                    if not found:
                        rows.append((True, doc_id, k, h, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), None, None, None, None, None, None))
                        continue
                    rows.append((True, doc_id, k, h, len(words), None, packed, None, None, None, None, None))
                    for f in found:
                        for lo in range(los[f], his[f] - window + 1, SEGMENT_WORDS - window + 1):
                            hi = min(lo + SEGMENT_WORDS, his[f])
                            joined = b" ".join(words[lo:hi])
                            sid = hashlib.blake2b(joined, digest_size=16).digest()
                            rows.append((False, doc_id, k, h, None, None, None, sid, anchors[f], lo, hi - lo, None if sid in seen else joined))
                            seen.add(sid)
                if len(seen) > SEEN:
                    seen.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS)], schema=_PARTS)

    return run


def _ranges(marks: np.ndarray) -> list[int]:
    """first, last, first, last, ... of the marked places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def _searched(window: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("sid")
        hashed, sizes = hashed_words([bytes(w) for w in shard["words"]])
        flat = np.zeros(sizes.sum() + len(sizes), np.int64)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        flat[inside] = np.unique(hashed, return_inverse=True)[1] + 1
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        copies = shard["copies"].to_numpy()
        alone = copies < 2
        marks = np.zeros(len(flat), bool)
        if len(sizes) > 1 or alone.any():
            marks = FMIndex(flat).repeated(flat, begin[alone], (begin + sizes)[alone], window)
        found = []
        for b, n, many in zip(begin, sizes, ~alone):
            found.append([0, int(n - window)] if many else _ranges(marks[b : b + n]))
        out = pd.DataFrame({"sid": shard["sid"], "ranges": found})
        return out[out["ranges"].map(len) > 0]

    return run


def _windows(window: int):
    """Each window of a segment by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for sid, copies, joined in zip(*(c.to_pylist() for c in b.columns)):
                words = joined.split()
                for i in range(len(words) - window + 1):
                    own = b" ".join(words[i : i + window])
                    out.append((sid, i, copies, hashlib.blake2b(own, digest_size=16).digest(), own))
            if out:
                a = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.binary()), pa.array(a[1], pa.int32()), pa.array(a[2], pa.int64()), pa.array(a[3], pa.binary()), pa.array(a[4], pa.binary())], names=["sid", "at", "copies", "wid", "words"])

    return run


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            ids, total, gone, sha = [], [], [], []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                words = unpack(text).split()
                cover = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    for first, last in zip(s["ranges"][::2], s["ranges"][1::2]):
                        cover[s["lo"] + first] += 1
                        cover[s["lo"] + last + window] -= 1
                keep = np.cumsum(cover[:-1]) == 0
                ids.append(doc_id)
                total.append(len(words))
                gone.append(int(len(words) - keep.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, k in zip(words, keep.tolist()) if k])).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by a space)."""
    spark = docs.sparkSession
    tune(spark)
    keyed = _keyed(docs)
    all_runs = anchor_runs(keyed, window)
    again = all_runs.groupBy("anchor").agg(F.sum("places").alias("n")).where("n > 1").select("anchor")
    candidates = all_runs.join(again, "anchor").groupBy("k", "h").agg(F.collect_set(F.struct("lo", "hi", "anchor")).alias("found"))
    parts = written(packed_texts(keyed).join(candidates, ["k", "h"], "left").select("doc_id", "text", "k", "h", "found").mapInArrow(_parts(window), PARTS), "parts")

    mentions = parts.where("not is_document")
    distinct = mentions.groupBy("sid").agg(F.count("*").alias("copies"), F.max("words").alias("words"), F.min("anchor").alias("anchor"), F.min("n").alias("n"))
    distinct = written(distinct, "segments")
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("of")).where(F.col("of") > HOT).select("anchor", F.lit(True).alias("hot"))
    dealt = distinct.join(hot, "anchor", "left")
    single = written(dealt.where("hot").select("sid", "copies", "words").mapInArrow(_windows(window), "sid binary, at int, copies long, wid binary, words binary"), "windows")
    units = dealt.where("hot is null").select("sid", "copies", "words", "n", F.xxhash64("anchor").alias("to"))
    units = units.unionByName(single.groupBy("wid").agg(F.sum("copies").alias("copies"), F.max("words").alias("words")).select(F.col("wid").alias("sid"), "copies", "words", F.lit(window).alias("n"), F.xxhash64("wid").alias("to")))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    shards = max(2 * width(spark), -(-total // SHARD_WORDS))
    found = units.select("sid", "copies", "words", F.pmod("to", F.lit(shards)).alias("shard")).groupBy("shard").applyInPandas(_searched(window), "sid binary, ranges array<int>")
    found = written(found, "repeats")
    by_window = single.select("sid", "at", "wid").join(found.select(F.col("sid").alias("wid")), "wid").select("sid", F.array("at", "at").alias("ranges"))
    found = found.unionByName(by_window)

    spans = mentions.select("sid", "k", "h", "lo").join(found, "sid").groupBy("k", "h").agg(F.collect_set(F.struct("lo", "ranges")).alias("spans"))
    own = parts.where("is_document")
    done = own.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    rest = own.where("text is not null").select("doc_id", "text", "k", "h").join(spans, ["k", "h"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(window), REMOVED)
    return done.unionByName(rest)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
