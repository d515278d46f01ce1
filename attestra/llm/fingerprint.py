"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is a row of units: its words, hashed; in place of a word of more than LONG characters
stand its overlapping grams of GRAM characters, so texts without spaces have units as well. What
a word gives depends on that word alone, in texts of any length. s-mers are pairs of neighbouring units, k-mers runs of
four. A k-mer is an anchor if the smallest of its three s-mers stands at either
edge: that depends on the k-mer alone, so a passage keeps its anchors wherever it stands, and
two documents can be matched by the places of the anchors they share (see matches). About two
k-mers in three are anchors.

The fingerprint holds the SKETCH smallest distinct anchors as hexadecimal
numbers, each with the place where it stands first; the likeness of two fingerprints is the share they have in common of the smallest
anchors of both together, an estimate of the Jaccard similarity
of all anchors that is exact for documents with fewer. How much of what two fingerprints have in common stands at one distance is
their alignment.

The order by doc_id that op1 needs is dealt into ranges by quantiles of doc_id;
each range also gets the first row of the next, so no task sees all rows.

Cases: null text is empty; a text without words has the empty fingerprint, which
is like itself (1) and unlike all others (0); texts of one to three units have one anchor, all of them;
rows of one doc_id stand in the order of a hash of their text, null ids last;
a single document is its own next; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, documents, width

K = 4
SKETCH = 128
#: Words of more characters count by their overlapping grams.
LONG = 16
GRAM = 5
#: Most ranges by doc_id.
MAX_RANGES = 4000


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLANKS = " \t\n\x0b\f\r"


def units(text: Column) -> Column:
    """Hashes of the text's words; of a long word, of its grams."""
    words = F.split(F.btrim(text, F.lit(BLANKS)), WORD_GAP)
    grams = lambda w: F.transform(F.regexp_extract_all(w, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), 1), lambda g: F.xxhash64(F.lit("gram"), g))
    mixed = F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) > LONG, grams(w)).otherwise(F.array(F.xxhash64(w)))))
    # without a long word both are the same; the first is slower
    return F.when(text.rlike(rf"[^\x20\x09-\x0D]{{{LONG + 1}}}"), mixed).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def anchors(text: Column) -> Column:
    """Array of (anchor, place): the k-mer's hash and the unit at which it starts, in order of places."""

    def closed(m: Column) -> Column:
        edge = lambda x, i: F.when(F.least(x, m[i + 2]) <= m[i + 1], F.struct(F.xxhash64(x, m[i + 2]).alias("anchor"), i.alias("place")))
        return F.array_compact(F.transform(F.slice(m, F.lit(1), F.size(m) - 2), edge))

    def of(h: Column) -> Column:
        n = F.size(h)
        pairs = F.zip_with(F.slice(h, F.lit(1), n - 1), F.slice(h, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
        whole = F.array(F.struct(F.aggregate(h, F.lit(0).cast("long"), lambda s, x: F.xxhash64(s, x)).alias("anchor"), F.lit(0).alias("place")))
        return F.when(n >= K, let(pairs, closed)).otherwise(whole)

    empty = F.array().cast("array<struct<anchor:bigint,place:int>>")
    return F.when(F.btrim(text, F.lit(BLANKS)) == "", empty).otherwise(let(units(text), of))


def placed_sketch(text: Column) -> Column:
    """The SKETCH smallest distinct anchors, ascending, each with its first place."""

    def distinct(s: Column) -> Column:
        return F.slice(F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1).anchor != x.anchor)), 1, SKETCH)

    return let(F.sort_array(anchors(text)), distinct)


def alignment(a: Column, b: Column) -> Column:
    """Of two placed sketches: how many of the anchors in common stand at the most frequent distance, as a share; null without any."""

    def distances(both: Column) -> Column:
        gap = lambda x, i: F.when(x.anchor == F.get(both, i + 1).anchor, F.get(both, i + 1).place * (F.get(both, i + 1).side * 2 - 1) + x.place * (x.side * 2 - 1))
        return F.sort_array(F.array_compact(F.transform(both, gap)))

    def longest(d: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(s: Column, x: Column) -> Column:
            run = F.when(s.last == x, s.run + 1).otherwise(1)
            return F.struct(x.alias("last"), run.alias("run"), F.greatest(s.best, run).alias("best"))

        return F.when(F.size(d) > 0, F.aggregate(d, start, step).best / F.size(d))

    sided = lambda s, side: F.transform(s, lambda x: F.struct(x.anchor.alias("anchor"), F.lit(side).alias("side"), x.place.alias("place")))
    return let(let(F.sort_array(F.concat(sided(a, 0), sided(b, 1))), distances), longest)


def matches(docs: DataFrame, other: DataFrame, rarest: int = 64) -> DataFrame:
    """Passages that documents share, by the places of their anchors: doc_id, other_id, distance, anchors, first, last.

    A row for each pair and each distance (place in other less place in docs) at which they share anchors: how many, and the first and
    last place in docs. Anchors in more than `rarest` rows of other tell nothing of places and are left out. No document's anchors
    are gathered: rows are pairs of one anchor, at most `rarest` for each anchor of docs.
    """
    of = lambda d: d.select("doc_id", F.explode(anchors(F.coalesce("text", F.lit("")))).alias("a")).select("doc_id", "a.anchor", "a.place")
    theirs = of(other)
    rare = theirs.groupBy("anchor").count().where(F.col("count") <= rarest).select("anchor")
    theirs = theirs.join(rare, "anchor", "left_semi").select("anchor", F.col("doc_id").alias("other_id"), F.col("place").alias("at"))
    pairs = of(docs).join(theirs, "anchor").where("doc_id <> other_id")
    return pairs.groupBy("doc_id", "other_id", (F.col("at") - F.col("place")).alias("distance")).agg(F.countDistinct("place").alias("anchors"), F.min("place").alias("first"), F.max("place").alias("last"))


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches: the share in common among the smallest anchors of both."""
    smallest = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(a, b), smallest))
    n = F.least(F.size(F.array_union(a, b)), F.lit(SKETCH))
    return F.when(n == 0, 1.0).otherwise(common / n)


def fingerprint(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _below(points: list[int], value: Column) -> Column:
    """How many of the sorted points are at most value, by halving."""
    arr = F.array(*[F.lit(p).cast("long") for p in points])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(points).bit_length()))])
    n = len(points)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.try_element_at(arr, F.least(at + s, F.lit(n))) <= value), at + s).otherwise(at))


def in_ranges(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with `range` and `guest`: ranges of descending key, each with the first row of the one after it as guest (after the last: of the first)."""
    parts = max(1, min(MAX_RANGES, 4 * width(docs.sparkSession)))
    found = docs.select(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 20_000)).first()[0] or []
    points = sorted(set(found))
    at = F.coalesce(_below(points, F.col(key)), F.lit(-1)) if points else F.when(F.col(key).isNull(), -1).otherwise(0)
    docs = docs.withColumn("range", at)
    tops = sorted(((r["range"], r["top"]) for r in docs.select("range", key).groupBy("range").agg(F.max(key).alias("top")).collect()), reverse=True)
    if not tops:
        return docs.withColumn("guest", F.lit(0))
    before = {r: tops[i - 1][0] for i, (r, _) in enumerate(tops)}  # the first is guest in the last
    size = len(points) + 2
    top, to = [None] * size, [0] * size
    for r, t in tops:
        top[r + 1], to[r + 1] = t, before[r]
    of = lambda xs, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in xs]), F.col("range") + 2)
    first = F.col(key).eqNullSafe(of(top, "long"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    both = F.array(own, F.struct(of(to, "int").alias("range"), F.lit(1).alias("guest")))
    places = F.explode(F.when(first, both).otherwise(F.array(own)))
    rest = [c for c in docs.columns if c != "range"]
    return docs.select(*rest, places.alias("_place")).select(*rest, "_place.range", "_place.guest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    rows = in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "hash")
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("next_text", F.lead("text").over(order))
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (n - half).cast("int")), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "range", "guest", "hash", n.alias("n_chars"), F.when(F.col("guest") == 0, edited).alias("edited"), placed_sketch(F.col("text")).alias("own"))
    rows = rows.select("doc_id", "range", "guest", "hash", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", placed_sketch(F.col("edited")).alias("edit"))
    rows = rows.withColumn("next", F.lead("own.anchor").over(order)).where("guest = 0")
    own, edit = F.col("own.anchor"), F.col("edit.anchor")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(edit).alias("edited_fingerprint"),
        likeness(own, edit).alias("near_edited"), likeness(own, F.col("next")).alias("near_next"), F.col("own.place").alias("places"), alignment(F.col("own"), F.col("edit")).alias("aligned_edited"),
    )


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
