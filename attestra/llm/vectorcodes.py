"""Compression of vectors to codes by parts, with exact nearest entries from vantage-point trees.

Components become integers, vectors are cut into parts, and each part position has a codebook. A few rounds assign every part to the nearest entry of its
codebook (squared Euclidean distance, ties to the lower index) and move each entry to the floor of its parts' mean.

Nearest entries are found by branch and bound in a vantage-point tree of each codebook: a node's vantage entry splits the others into
an inner and an outer half, with the least and the largest distance of each half. A half is left out where the triangle inequality
shows that all of it is farther than the best so far. Radii and bounds are rounded so that they only err towards a visit, a half that could tie is visited, and the best is always chosen
by the integer squared distance and the index; so the result is that of comparing with every entry.

Vectors stay where they are read. A round sends back a sum and a count for each entry and component, added up before the shuffle; only codebooks (at most
entries x dimensions integers) reach the driver. A row for each label is joined to the rows; labels that many rows have are broadcast, of which there are few.

Cases: null vectors and vectors with a null, infinite or not-a-number component are dropped; the dimension is the most frequent length of the others (ties: the longer);
vectors of another length keep their row, without code and error; where the dimension is no multiple of the parts, the first parts are one longer;
rows with equal or null vec_ids are rows of their own, the first entries being those of the smallest vec_ids, then the smallest vectors, nulls last; fewer rows than
entries give as many entries; null labels are one label; an error that a long cannot hold stops the query; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_evenly, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Entries that a leaf of a tree holds.
LEAF = 8
#: Vectors that are searched together.
TOGETHER = 16_384
#: Relative slack of radii and bounds, far above what rounding can change.
SLACK = 2.0**-48


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as exact integers: float64 where squares of differences stay exact in it, else Python's."""
    x = np.floor(flat.astype(np.float64) * SCALE)
    if not len(x) or np.abs(x).max() < 2.0**20:
        return x
    return np.array([int(v) for v in x.tolist()], object)


def exact(queries: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 if no squared distance can exceed what float64 holds exactly, else as Python integers."""
    if queries.dtype != object and entries.dtype != object:
        most = max((float(np.abs(a).max()) for a in (queries, entries) if a.size), default=0.0)
        if 4 * most * most * max(1, entries.shape[1]) < 2.0**53:
            return queries.astype(np.float64), entries.astype(np.float64)
    return tuple(np.array([[int(v) for v in row] for row in a.tolist()], object).reshape(a.shape) for a in (queries, entries))


class VantageTree:
    """Entries below a vantage entry, in halves by their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries))) if len(entries) else None

    def _node(self, at: np.ndarray) -> tuple:
        if len(at) <= LEAF:
            return (at,)
        # the entry farthest from the first one spreads the distances most
        apart = self.squared(self.entries[at], int(at[0]))
        vantage = int(at[int(np.argmax(apart))])
        rest = at[at != vantage]
        radius = np.sqrt(self.squared(self.entries[rest], vantage).astype(np.float64))
        order = np.argsort(radius, kind="stable")
        half = len(rest) // 2
        sides = []
        for side in (order[:half], order[half:]):
            sides.append((self._node(np.sort(rest[side])), radius[side].min() * (1 - SLACK), radius[side].max() * (1 + SLACK)))
        return (vantage, *sides)

    def squared(self, rows: np.ndarray, entry: int) -> np.ndarray:
        apart = rows - self.entries[entry]
        return (apart * apart).sum(1) if apart.shape[1] else np.zeros(len(rows))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lower one of ties, and its squared distance."""
        index = np.full(len(rows), -1)
        best = np.full(len(rows), np.inf if rows.dtype != object else 1 << 400, rows.dtype)

        def offer(at: np.ndarray, entry: int) -> np.ndarray:
            d = self.squared(rows[at], entry)
            better = (d < best[at]) | ((d == best[at]) & (entry < index[at]))
            best[at[better]], index[at[better]] = d[better], entry
            return np.sqrt(d.astype(np.float64))

        def descend(node: tuple, at: np.ndarray) -> None:
            """A good first answer: the nearer half alone."""
            if not len(at):
                return
            if len(node) == 1:
                for entry in node[0].tolist():
                    offer(at, entry)
                return
            vantage, (inner, _, edge), (outer, start, _) = node
            near = offer(at, vantage) <= (edge + start) / 2
            descend(inner, at[near])
            descend(outer, at[~near])

        def search(node: tuple, at: np.ndarray) -> None:
            if not len(at):
                return
            if len(node) == 1:
                for entry in node[0].tolist():
                    offer(at, entry)
                return
            d = offer(at, node[0])
            for below, least, most in node[1:]:
                reach = np.sqrt(best[at].astype(np.float64)) * (1 + SLACK)
                visit = (d * (1 - SLACK) - most <= reach) & (least - d * (1 + SLACK) <= reach)
                search(below, at[visit])

        if self.root is not None and len(rows):
            everything = np.arange(len(rows))
            descend(self.root, everything)
            search(self.root, everything)
        return index, best


def edges_of(dimension: int, parts: int) -> list[int]:
    return np.cumsum([0, *(dimension // parts + (k < dimension % parts) for k in range(parts))]).tolist()


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dimension)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _assigned(matrix: np.ndarray, codebooks: list[np.ndarray], edges: list[int], trees: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for p, book in enumerate(codebooks):
        rows, entries = exact(matrix[:, edges[p] : edges[p + 1]], book)
        if (p, entries.dtype) not in trees:
            trees[p, entries.dtype] = VantageTree(entries)
        yield trees[p, entries.dtype].nearest(rows)


def kept(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has finite components alone."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & sound)


def first_codebooks(rows: DataFrame, edges: list[int], entries: int) -> list[np.ndarray]:
    first = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    whole = integers(np.array([r["embedding"] for r in first], np.float64).ravel()).reshape(len(first), edges[-1])
    return [whole[:, a:b] for a, b in zip(edges, edges[1:])]


def moved(rows: DataFrame, codebooks: list[np.ndarray], edges: list[int]) -> list[np.ndarray]:
    """Each entry replaced by the floor of the mean of its parts; entries without parts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        sums = [np.zeros(b.shape, object) for b in codebooks]
        counts = [np.zeros(len(b), np.int64) for b in codebooks]
        for t in _gathered(batches):
            matrix = _matrix(t.column(0).chunk(0), edges[-1])
            for p, (index, _) in enumerate(_assigned(matrix, codebooks, edges, trees)):
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                order = np.argsort(index, kind="stable")
                used, at = np.unique(index[order], return_index=True)
                part = matrix[:, edges[p] : edges[p + 1]][order]
                if part.shape[1]:
                    sums[p][used] += np.add.reduceat(part, at, axis=0).astype(object)
        rows_out = [(p, e, k, int(sums[p][e, k]), int(counts[p][e])) for p in range(len(counts)) for e in np.flatnonzero(counts[p]).tolist() for k in range(sums[p].shape[1])]
        if rows_out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows_out)], names=["part", "entry", "at", "total", "n"])

    per_task = rows.select("embedding").mapInArrow(run, "part long, entry long, at long, total long, n long")
    out = [b.astype(object) for b in codebooks]
    for p, e, k, total, n in per_task.groupBy("part", "entry", "at").agg(F.sum("total"), F.sum("n")).collect():
        out[p][e, k] = total // n
    return [np.array([[int(v) for v in row] for row in b.tolist()], object).reshape(b.shape) for b in out]


def narrowed(book: np.ndarray) -> np.ndarray:
    """float64 where that holds the integers."""
    return book.astype(np.float64) if all(abs(v) < 2**20 for v in book.ravel().tolist()) else book


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) and the codebooks. code: an index for each part, two hex digits each."""
    rows = kept(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    edges = edges_of(sizes[0]["size"] if sizes else 0, parts)
    fit = rows.where(F.size("embedding") == edges[-1])
    codebooks = first_codebooks(fit, edges, entries)
    for _ in range(rounds):
        codebooks = [narrowed(b) for b in moved(fit, codebooks, edges)]
    digits = max(2, len(f"{max(0, entries - 1):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        for t in _gathered(batches):
            codes, error = [""] * t.num_rows, np.zeros(t.num_rows, object)
            for index, best in _assigned(_matrix(t.column(1).chunk(0), edges[-1]), codebooks, edges, trees):
                codes = [c + f"{i:0{digits}x}" for c, i in zip(codes, index.tolist())]
                error += np.array([int(v) for v in best.tolist()], object)
            yield pa.RecordBatch.from_arrays([*(t.column(k).chunk(0) for k in (0, 2)), pa.array(codes, pa.string()), pa.array(error.tolist(), pa.int64())], names=["vec_id", "label", "code", "error"])

    types = dict(rows.dtypes)
    out = fit.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")
    odd = rows.where(F.size("embedding") != edges[-1]).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return out.unionByName(odd), codebooks


def with_label_errors(codes: DataFrame) -> DataFrame:
    """label_error: the errors of a row's label added up."""
    codes = written(codes, "codes")
    return joined_evenly(codes, codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label")


def codebooks_text(codebooks: list[np.ndarray]) -> str:
    return ",".join(str(int(v)) for b in codebooks for v in b.ravel().tolist())


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(k: int) -> str:
    return f"""
, a{k} AS (SELECT vec_id, part, min(d * 256 + entry) AS best FROM (
    SELECT c.vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM comps c JOIN b{k} b ON c.part = b.part AND c.pos = b.pos GROUP BY ALL) GROUP BY ALL)
"""


def _moved(k: int) -> str:
    return f"""
, m{k} AS (SELECT c.part, CAST(a.best % 256 AS BIGINT) AS entry, c.pos, CAST(sum(c.v) AS BIGINT) AS s, count(*) AS n FROM comps c JOIN a{k} a ON a.vec_id = c.vec_id AND a.part = c.part GROUP BY ALL)
, b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CASE WHEN m.n IS NULL THEN b.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS v
    FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)
"""


ORACLE = (
    f"""
WITH kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
, flat AS (SELECT vec_id, place, len(embedding) // {PARTS} AS size, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM kept)
, comps AS MATERIALIZED (SELECT vec_id, place, i // size AS part, i % size AS pos, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM flat)
, b0 AS MATERIALIZED (SELECT part, place AS entry, pos, v FROM comps WHERE place < {ENTRIES})
"""
    + "".join(_round(k) + _moved(k) for k in range(ROUNDS))
    + _round(ROUNDS)
    + f"""
, coded AS (SELECT vec_id, string_agg(format('{{:02x}}', CAST(best % 256 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept k JOIN coded c USING (vec_id)
"""
)
