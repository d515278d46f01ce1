"""MinHash near-duplicate detection by min-max hashing, confirmed on full shingle sets.

Each of HASHES hash functions is evaluated once per shingle and gives two
signature values, its minimum and its maximum over the set: half the
evaluations of plain MinHash, with lower variance. BANDS bands of ROWS values
are the buckets: a pair of similarity 0.8 shares none with probability
(1 - 0.8**3)**24 = 3e-8.

Documents with equal shingle sets are one class, found by grouping; only classes
go on. In a bucket each class is compared with one leader, never with all others; leaders
come first in one order of all classes, so a class that shares many buckets of a group has few of them.
What comes close by its signature is confirmed on full sets, first one edge a class, then those
edges whose ends are not yet connected. What is then still apart is compared pair by pair in buckets
of up to HOT classes, and by rare shingles in larger ones (see _hot): both are exact, so no link of
a bucket is lost, whatever its size. Tables between steps are written to the shared folder.

Shingles are 64-bit hashes: of sets of n shingles, two unequal ones have the same hash somewhere with
probability n * n / 2**64, which can move a similarity by one shingle.

Cases: null or empty texts and texts without words have no shingles and link
with nothing; rows with a null doc_id link with nothing unless a row of equal
shingles has an id (they are its copies, and not kept); repeated rows are copies of each other, and kept if their id is; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, documents, gram_hashes, hashed_words, mix, tune, written
from .components import connected

HASHES = 36
BANDS = 24
ROWS = 3
#: Buckets of more classes are not paired but searched by rare shingles.
HOT = 12
#: A shingle that more classes of hot buckets have is a common one.
RARE = 64
#: Signature values of 2 * HASHES that must agree before sets are compared; a pair of similarity 0.8 agrees in 58 of 72 on average, in fewer than 38 once in ten million.
AGREE = 38


def functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of n hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)


FACTORS, SHIFTS = functions(HASHES, 20_11)


def shingle_set(h: np.ndarray, words: int) -> np.ndarray:
    """Distinct shingles, sorted; the whole sequence is one if it has fewer words."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(h, min(words, len(h)))) if len(h) >= words else gram_hashes(h, len(h)) ^ np.uint64(len(h))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Per set its minimum under each hash function, then its maximum under each. Sets must not be empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * HASHES), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            x = (flat ^ SHIFTS[i]) * FACTORS[i]
            x ^= x >> np.uint64(32)
            x *= FACTORS[-1 - i]
            out[:, i] = np.minimum.reduceat(x, at)
            out[:, HASHES + i] = np.maximum.reduceat(x, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Bands of ROWS values, minima and maxima mixed."""
    keys = np.empty((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            k = np.full(len(sig), b + 1, np.uint64)
            for r in range(ROWS):
                k = mix(k * np.uint64(31) + sig[:, (b + r * BANDS) % (2 * HASHES)])
            keys[:, b] = k
    return keys


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The shingle set of each text, words in lower case."""
    h, sizes = hashed_words([(t or "").encode().translate(ASCII_LOWER) for t in texts])
    return [shingle_set(x, words) for x in np.split(h, np.cumsum(sizes)[:-1])] if texts else []


SKETCH = "doc_id long, text_key long, sid binary, n long, bands array<long>, sig binary"


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, sid (digest of the shingle set; null if empty), n (its size), bands, sig (a byte of each signature value)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                b = whole.slice(i, 250)
                sets = shingle_sets([t.as_py() for t in b.column(1)], words)
                full = [k for k, s in enumerate(sets) if len(s)]
                sid, bands, sig = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    values = signatures([sets[k] for k in full])
                    low = values >> np.uint64(20)
                    for k, keys, v in zip(full, band_keys(values).view(np.int64), low.astype(np.uint8)):
                        sid[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                        bands[k], sig[k] = keys, v.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(sid, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["doc_id", "text_key", "sid", "n", "bands", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                sets = [s for s in shingle_sets([t.as_py() for t in whole.slice(i, 250).column(0)], words) if len(s)]
                sid = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "shingles"])

    return docs.select("text").mapInArrow(run, "sid binary, shingles array<long>")


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose signatures come close to it."""
    of = lambda c: classes.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    p = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # bytes as text: Latin-1 keeps one character a byte
    chars = lambda c: F.split(F.decode(c, "ISO-8859-1"), "")
    agree = F.aggregate(F.zip_with(chars("sig_a"), chars("sig_b"), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return p.withColumn("agree", agree).where(F.col("agree") >= AGREE).select("a", "b", "n_a", "n_b", "agree")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, n_a, n_b) that reach the similarity, by their whole sets."""
    of = lambda c: sets.select(F.col("sid").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"), common.alias("common")).where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b")


class Links:
    """Components of classes (sid), joined by more and more confirmed pairs."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int):
        self.docs, self.classes, self.words, self.percent = docs, classes, words, percent
        self.label: DataFrame | None = None
        self.sets: DataFrame | None = None

    def fetch(self, sids: DataFrame) -> None:
        """Have the full sets of these classes, too."""
        more = sids.select("sid").distinct()
        if self.sets is not None:
            more = written(more.join(self.sets.select("sid"), "sid", "left_anti"), "needed")
            if more.isEmpty():
                return
        ids = self.classes.join(more, "sid", "left_semi").select("doc_id").distinct()
        found = full_sets(self.docs.join(ids, "doc_id", "left_semi"), self.words).join(more, "sid", "left_semi").dropDuplicates(["sid"])
        found = written(found, "sets")
        self.sets = found if self.sets is None else self.sets.unionByName(found)

    def component(self, of: str = "sid") -> DataFrame:
        """of, c_of: what has no row is a component of its own."""
        if self.label is None:
            return self.classes.where("false").select(F.col("sid").alias(of), F.col("sid").alias(f"c_{of}"))
        return self.label.select(F.col("node").alias(of), F.col("component").alias(f"c_{of}"))

    def with_component(self, rows: DataFrame, of: str = "sid") -> DataFrame:
        return rows.join(self.component(of), of, "left").withColumn(f"c_{of}", F.coalesce(f"c_{of}", of))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose ends are in different components so far, with c_a and c_b."""
        return self.with_component(self.with_component(pairs, "a"), "b").where("c_a <> c_b")

    def confirm(self, pairs: DataFrame) -> None:
        """Join the components of those pairs (a, b, n_a, n_b) that reach the similarity by their whole sets."""
        found = written(_confirmed(pairs, self.sets, self.percent), "links")
        if found.isEmpty():
            return
        if self.label is None:
            self.label = connected(found)
            return
        # only components are connected, their nodes follow
        moved = connected(self.apart(found).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
        both = self.label.unionByName(moved.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
        self.label = written(both.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")

    def compare(self, pairs: DataFrame) -> None:
        """Confirm those of pairs (a, b) that are apart and come close by signature."""
        close = written(_agreeing(self.apart(pairs).select("a", "b").distinct(), self.classes, self.percent), "close")
        if close.isEmpty():
            return
        self.fetch(close.select(F.col("a").alias("sid")).union(close.select("b")))
        self.confirm(close)

    def split(self, rows: DataFrame) -> DataFrame:
        """Those of rows (key, sid, ..) whose bucket still holds more than one component, with c_sid."""
        rows = self.with_component(rows)
        keys = rows.groupBy("key").agg(F.min("c_sid").alias("low"), F.max("c_sid").alias("high")).where("low <> high").select("key")
        return written(rows.join(keys, "key", "left_semi"), "split")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _weighed(links: Links, rows: DataFrame) -> DataFrame:
    """sid, n, common, prefix of the classes of rows. A shingle is common if more than RARE of these classes have it, else rare.

    With the rare ones first, in one order for all classes, prefix holds (place, shingle) of the rare shingles at the
    places where a pair that reaches the similarity must have its first shingle in common, if that is a rare one.
    """
    sids = rows.select("sid").distinct()
    tokens = links.sets.join(sids, "sid", "left_semi").select("sid", F.explode("shingles").alias("shingle"))
    held = tokens.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    df = F.coalesce("df", F.lit(1))
    per = tokens.join(held, "shingle", "left").groupBy("sid").agg(F.count_if(df > RARE).alias("common"), F.collect_list(F.when(df <= RARE, F.struct(df.alias("df"), "shingle"))).alias("rare"))
    per = per.join(links.classes.select("sid", "n"), "sid")
    places = (F.col("n") - F.ceil(F.col("n") * links.percent / 100 - 1e-9) + 1).cast("int")
    first = F.transform(F.slice(F.array_sort("rare"), F.lit(1), places), lambda x, i: F.struct(i.alias("place"), x.df.alias("df"), x.shingle.alias("shingle")))
    return written(per.select("sid", "n", "common", F.filter(first, lambda x: x.df > 1).alias("prefix")), "weighed")


def _hot(links: Links, hot: DataFrame) -> None:
    """Link what shares a bucket of many classes, without pairing the bucket.

    Take a pair that reaches the similarity. Its first common shingle in the order of _weighed stands in both prefixes.
    Either it is a rare one: then the pair is found by that shingle, which no more than RARE classes have. Or
    the two share common shingles only, and each must have enough of them: a class with many rare shingles can't
    be one of the two, and has no pairs here. The rest is held against the class of its bucket with the smallest share of rare
    shingles, the nearest to a common origin; pairs still apart are compared where their sizes allow it.
    """
    percent = links.percent
    inside = links.split(hot.select("key", "sid"))
    if inside.isEmpty():
        return
    weighed = _weighed(links, inside)
    listed = links.with_component(weighed).select("sid", "n", "c_sid", F.inline("prefix")).drop("df")
    one = listed.select("shingle", F.col("sid").alias("x"), F.col("n").alias("n_x"), F.col("c_sid").alias("c_x"), F.col("place").alias("at_x"))
    two = listed.select("shingle", F.col("sid").alias("y"), F.col("n").alias("n_y"), F.col("c_sid").alias("c_y"), F.col("place").alias("at_y"))
    needed = percent * (F.col("n_x") + F.col("n_y"))
    room = ((100 + percent) * (F.col("n_x") - F.col("at_x")) >= needed) & ((100 + percent) * (F.col("n_y") - F.col("at_y")) >= needed)
    links.compare(one.join(two, "shingle").where((F.col("x") < F.col("y")) & (F.col("c_x") != F.col("c_y")) & room).select(*_ordered("x", "y")))

    # most: the largest class that this one can reach the similarity with by common shingles alone
    most = F.floor(F.col("common") * (100 + percent) / percent + 1e-9) - F.col("n")
    core = weighed.where(F.col("common") * 100 >= percent * F.col("n")).select("sid", "n", most.alias("most"), ((F.col("n") - F.col("common")) / F.col("n")).alias("rare"))
    members = links.split(inside.select("key", "sid").join(core, "sid"))
    if members.isEmpty():
        return
    lead = members.groupBy("key").agg(F.min(F.struct("rare", "sid", "n", "most", "c_sid")).alias("lead"))
    held = members.join(lead, "key").where("c_sid <> lead.c_sid and n <= lead.most and lead.n <= most")
    links.compare(held.select(*_ordered("sid", "lead.sid")))
    members = links.split(members.drop("c_sid"))
    if members.isEmpty():
        return
    # every pair of different components has an end outside the bucket's largest component
    largest = members.groupBy("key", "c_sid").count().groupBy("key").agg(F.max(F.struct("count", "c_sid")).c_sid.alias("largest"))
    outside = members.join(largest, "key").where("c_sid <> largest").select("key", F.col("sid").alias("x"), F.col("n").alias("n_x"), F.col("most").alias("most_x"), F.col("c_sid").alias("c_x"))
    sizes = members.groupBy("key", F.col("n").alias("n_y")).agg(F.max("most").alias("reach"))
    fitting = outside.join(sizes, "key").where("n_y <= most_x and n_x <= reach").drop("reach")
    others = members.select("key", F.col("sid").alias("y"), F.col("n").alias("n_y"), F.col("most").alias("most_y"), F.col("c_sid").alias("c_y"))
    links.compare(fitting.join(others, ["key", "n_y"]).where("n_x <= most_y and c_x <> c_y").select(*_ordered("x", "y")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id (the smallest doc_id of its group), kept."""
    t = written(sketches(docs, words), "sketches")
    classes = written(t.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    buckets = classes.select(F.explode("bands").alias("key"), "sid")
    # one order for all buckets: a class has few different leaders, however many buckets it shares
    leading = buckets.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("sid").alias("order"), "sid")).sid.alias("first")).where("members > 1")
    buckets = written(buckets.join(leading, "key"), "buckets")
    star = written(_agreeing(buckets.where("sid <> first").select(*_ordered("sid", "first")).distinct(), classes, percent), "star")

    links = Links(docs, classes, words, percent)
    hot = buckets.where(F.col("members") > HOT)
    links.fetch(star.select(F.col("a").alias("sid")).union(star.select("b")).union(hot.select("sid")))
    ends = star.select(F.col("a").alias("node"), "a", "b", "n_a", "n_b", "agree").union(star.select(F.col("b"), "a", "b", "n_a", "n_b", "agree"))
    best = written(ends.groupBy("node").agg(F.max(F.struct("agree", "a", "b", "n_a", "n_b")).alias("e")).select("e.*").distinct(), "best")
    links.confirm(best)
    links.confirm(links.apart(star).join(best.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "n_a", "n_b"))

    # small buckets: what is still apart is compared pair by pair; two alone have been, as member and leader
    inside = links.split(buckets.where(F.col("members").between(3, HOT)).select("key", "sid"))
    other = inside.select("key", F.col("sid").alias("y"), F.col("c_sid").alias("c_y"))
    pairs = inside.join(other, "key").where("c_sid <> c_y and sid < y").select(*_ordered("sid", "y")).distinct()
    links.compare(pairs.join(star.select("a", "b"), ["a", "b"], "left_anti"))
    _hot(links, hot)

    grouped = links.with_component(classes.select("sid", F.col("doc_id").alias("first_id")))
    smallest = grouped.groupBy("c_sid").agg(F.min("first_id").alias("component_id"))
    named = written(grouped.join(smallest, "c_sid").select("sid", "component_id"), "groups")
    rows = t.select("doc_id", "text_key", "sid", "n")
    # texts without words have no class; they stay out of the join, where they would all meet under one key
    out = rows.where("sid is not null").join(named, "sid", "left").unionByName(rows.where("sid is null").withColumn("component_id", F.lit(None).cast("long")))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4).drop("text_key")
