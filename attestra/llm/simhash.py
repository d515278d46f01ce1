"""SimHash near-duplicates by a Gray-order hierarchical index.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Fingerprints that differ in
few bits are linked, and a component is what links reach.

Only distinct fingerprints are searched. Each goes to tables by blocks of bits: of ``m`` blocks a pair that differs in at most ``d`` bits
has ``m - d`` in common, so for each choice of as many blocks there is a table, keyed by these blocks' bits. ``m`` grows with the number of
fingerprints, so buckets stay small; the result is the same for any. In a bucket fingerprints are sorted by Gray rank, in which neighbours
share long patterns. A node over each run of neighbours holds the bits on which all of them agree (a mask) and their pattern.
The bucket is joined with itself from the top: a pair of nodes differs by at least the bits in which the patterns differ under both masks, a number that only
grows on the way down; pairs of nodes for which it is too large are dropped with all below them, and so are those whose fingerprints are all of one component.
A bucket gives a spanning forest of its links, at most a row for each of its fingerprints, never all pairs.

Buckets of more than LARGE fingerprints are cut into chunks by hash, and every two chunks meet in a group of their own: exact, and no
group grows with the bucket. Tables between steps are written to the shared folder.

Cases: null or empty texts and texts without words have fingerprint zero, linked like any other; texts of fewer words than a shingle are one
shingle; rows with a null doc_id take part, and the component of a group without any doc_id is null; repeated rows each give a row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, documents, joined_evenly, tune, written
from .components import connected

SEED = 42
#: Differing bits up to which fingerprints are linked.
BITS = 4
#: Fingerprints of a bucket beyond which it is cut into chunks.
LARGE = 100_000
#: Fingerprints of a bucket that tables are chosen for.
BUCKET = 2_000
#: Node pairs that are looked at together.
BLOCK = 1 << 18


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of words, repeats included; of the whole sequence if it is shorter."""
    parts = (text or "").encode().translate(ASCII_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(parts) - words + 1)


def fingerprint(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > len(h)).tolist()))


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in the reflected Gray order."""
    out = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order: level 0 are the fingerprints, a node above covers two below."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.levels = [(self.fps, np.full(len(fps), ~np.uint64(0)))]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            if len(pattern) % 2:
                pattern, mask = np.append(pattern, pattern[-1]), np.append(mask, mask[-1])
            shared = mask[::2] & mask[1::2] & ~(pattern[::2] ^ pattern[1::2])
            self.levels.append((pattern[::2] & shared, shared))

    def forest(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that span the components of all links of up to so many bits, as two arrays of fingerprints."""
        n = len(self.fps)
        head = np.arange(n)
        links: list[tuple[int, int]] = []

        def find(i: int) -> int:
            while head[i] != i:
                head[i] = head[head[i]]
                i = head[i]
            return i

        def link(a: np.ndarray, b: np.ndarray) -> None:
            for x, y in zip(a.tolist(), b.tolist()):
                p, q = find(x), find(y)
                if p != q:
                    head[max(p, q)] = min(p, q)
                    links.append((x, y))

        def settled() -> np.ndarray:
            nonlocal head
            while True:
                up = head[head]
                if np.array_equal(up, head):
                    return head
                head = up

        near = np.flatnonzero(np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= bits)
        link(near, near + 1)
        # the smallest and largest component below each node; a pair of nodes with one component alone has nothing to add
        low: list[np.ndarray] = []
        high: list[np.ndarray] = []

        def components() -> None:
            root = settled()
            low[:], high[:] = [root], [root]
            for _ in self.levels[1:]:
                a, b = low[-1], high[-1]
                if len(a) % 2:
                    a, b = np.append(a, a[-1]), np.append(b, b[-1])
                low.append(np.minimum(a[::2], a[1::2]))
                high.append(np.maximum(b[::2], b[1::2]))

        components()
        seen = len(links)
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(links) > seen + seen // 8 + 64:
                components()
                seen = len(links)
            pattern, mask = self.levels[level]
            keep = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= bits
            a, b = a[keep], b[keep]
            keep = (low[level][a] != high[level][a]) | (low[level][b] != high[level][b]) | (low[level][a] != low[level][b])
            a, b = a[keep], b[keep]
            if not level:
                # one pair for each two components, however many have been found
                root = settled()
                ends = np.sort(np.column_stack([root[a], root[b]]), axis=1)
                first = np.unique(ends, axis=0, return_index=True)[1]
                first = first[root[a[first]] != root[b[first]]]
                link(a[first], b[first])
                continue
            size, same = len(self.levels[level - 1][0]), a == b
            x = np.concatenate([2 * a, 2 * a, 2 * a + 1, (2 * a + 1)[~same]])
            y = np.concatenate([2 * b, 2 * b + 1, 2 * b + 1, (2 * b)[~same]])
            keep = (x < size) & (y < size) & (x != y if level == 1 else True)
            x, y = x[keep], y[keep]
            stack += [(level - 1, x[i : i + BLOCK], y[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]
        if not links:
            return self.fps[:0], self.fps[:0]
        found = np.array(links)
        return self.fps[found[:, 0]], self.fps[found[:, 1]]


def tables(count: int, bits: int) -> list[int]:
    """Masks of the tables: of m blocks each choice of m - bits; the smallest m for which buckets of evenly spread fingerprints are small."""
    for m in range(bits + 1, 2 * bits + 3):
        edges = [64 * i // m for i in range(m + 1)]
        blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(blocks, m - bits)]
        if count >> min(x.bit_count() for x in masks) <= BUCKET:
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucketed(fps: DataFrame, count: int, bits: int, large: int) -> DataFrame:
    """grp, fp: every two fingerprints that differ in at most so many bits share a group."""
    masks = tables(count, bits)
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)])).alias("at")
    rows = fps.select("fp", one).select("fp", F.struct("at.table", "at.key").alias("at"))
    sizes = rows.groupBy("at").agg(F.count("*").alias("n"))
    large_ones = sizes.where(F.col("n") > large).withColumn("chunks", F.ceil(F.col("n") / (large / 2)).cast("int"))
    # each large bucket holds over large of count fingerprints in each of the tables
    cut = rows.join(F.broadcast(large_ones) if len(masks) * count // large <= 10_000 else large_ones, "at", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j")))
    )
    return cut.select("fp", "at.table", "at.key", F.explode(pairs).alias("chunk")).select(F.struct("table", "key", "chunk.i", "chunk.j").alias("grp"), "fp")


def links(fps: DataFrame, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """a, b: links between distinct fingerprints fp that span the components of all links."""
    count = fps.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; groups that end in a batch are joined, the last is carried over."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined(grp: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]).any(1), [True]]))
            found = [GrayIndex(fp[i:j]).forest(bits) for i, j in zip(edges.tolist(), edges[1:].tolist()) if j - i > 1]
            found = [x for x in found if len(x[0])]
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            fp = batch.column(4).to_numpy().view(np.uint64)
            grp = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            if not len(fp):
                continue
            last = int(np.flatnonzero((grp != grp[-1]).any(1))[-1]) + 1 if (grp != grp[-1]).any() else 0
            if last or held and (held[-1][0][0] != grp[0]).any():
                held.append((grp[:last], fp[:last]))
                yield from joined(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append((grp[last:], fp[last:]))
        if held:
            yield from joined(*(np.concatenate(x) for x in zip(*held)))

    rows = bucketed(fps, count, bits, large).select("grp.*", "fp").repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j", "fp")
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints that differ in up to so many bits."""
    rows = written(fingerprints(docs, words), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = connected(written(links(classes.select("fp"), bits, large), "links"))
    grouped = written(classes.join(found.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "first_id"), "grouped")
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(grouped.join(least, "component").select("fp", "component_id"), "fp", "left")
    alone = F.when(F.col("component_id").isNull(), F.col("first_id")).otherwise(F.col("component_id"))
    named = written(named.select("fp", alone.alias("component_id")), "named")
    return joined_evenly(rows, named, "fp").select("doc_id", "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), words=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
