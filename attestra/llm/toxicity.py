"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word ends) and itself,
each hashed to a row of one embedding table; a passage of WINDOW words is the
mean of its words, a word the mean of its bag. A two-class softmax on that mean
gives the passage's probability, and a text scores as its worst passage, so a
long text does not dilute one insult. A misspelling nobody has seen shares most
n-grams, and so most of its vector, with the word it stands for.

Training fits table and softmax together (full-batch Adam) on a bounded sample
of labelled rows: MAX_DOCS documents in the order of a hash of doc_id, and at
most MAX_BYTES of text. Labels are those of documents, so after each
step the passages of a toxic document that look worst count as toxic, the others
not at all; every passage of a clean document is clean.

Because the softmax is linear in the mean of vectors, a trained table folds
into one number per n-gram; scoring adds numbers and is a map over documents.

Cases: null or empty text scores as a passage without words (the bias alone);
labels that are null or missing are not learned from, repeated labels count as
often as they stand; without labels of both classes there is nothing to tell them apart by, and every text scores near 0; rows with a null doc_id are scored, and held_out is null for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ASCII_LOWER, documents, mix, split_for, tune

WINDOW = 32
BITS = 18
DIM = 4
NGRAMS = (3, 4, 5)
#: Bounds of the labelled sample.
MAX_DOCS = 6000
MAX_BYTES = 10_000_000
#: Only n-grams of so many documents are learned.
MIN_DOCS = 3
STEPS = 60
CACHE_WORDS = 500_000
#: Letters, digits and ' @ $ belong to words.
SEPARATORS = bytes(c if chr(c).isalnum() or c >= 128 or c in b"'@$" else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII signs other than ' @ $ separate."""
    return text.encode().translate(ASCII_LOWER).translate(SEPARATORS).split()


def bags(words: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of every word, the word itself included."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    decoded = [f"<{w.decode(errors='replace')}>" for w in words]
    sizes = np.fromiter(map(len, decoded), np.int64, len(decoded))
    chars = np.frombuffer("".join(decoded).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    index, hashed = [np.arange(len(words))], [np.fromiter((zlib.crc32(w) for w in words), np.uint64, len(words)) + np.uint64(1 << 40)]
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            if len(chars) < n:
                continue
            h = np.full(len(chars) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h + chars[i : i + len(h)] + np.uint64(1)) * np.uint64(0x100000001B3)
            inside = np.arange(len(h)) + n <= ends[of[: len(h)]]
            index.append(of[: len(h)][inside])
            hashed.append(h[inside])
    return np.concatenate(index), (mix(np.concatenate(hashed)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """folded: each n-gram's share of the logit. A word's value is the mean over its bag, a passage's the mean over its words."""

    folded: np.ndarray
    bias: float
    window: int = WINDOW

    def word_values(self, words: list[bytes]) -> np.ndarray:
        index, bucket = bags(words)
        n = np.bincount(index, minlength=len(words))
        return np.bincount(index, self.folded[bucket].astype(float), len(words)) / np.maximum(n, 1)


class Values(dict):
    """word -> its value, forgetting all when too many are held."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def learn(self, texts: list[list[bytes]]) -> None:
        new = list({w for ws in texts for w in ws if w not in self})
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list({w for ws in texts for w in ws})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.update(zip(part, self.model.word_values(part).tolist()))


def passage_means(values: np.ndarray, window: int) -> np.ndarray:
    """Means over each run of `window` values; over all where there are fewer."""
    if len(values) <= window:
        return np.array([values.mean()]) if len(values) else np.zeros(1)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[window:] - total[:-window]) / window


def fit(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 7) -> Model:
    """Embeddings and softmax together, by full-batch Adam."""
    y_doc = np.array(labels, float)
    if not len(y_doc) or y_doc.min() == y_doc.max():
        return Model(np.zeros(1 << BITS, np.float32), -50.0)
    vocabulary: dict[bytes, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)), np.int32) for t in texts]
    sizes = np.array([len(x) for x in ids])
    tokens = np.concatenate(ids)
    del ids
    index, bucket = bags(list(vocabulary))
    n_words = len(vocabulary)
    per_word = np.bincount(index, minlength=n_words).astype(float)

    # passages: half-overlapping windows
    starts, ends, owner, at = [], [], [], 0
    for d, n in enumerate(sizes):
        s = np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)
        starts.append(at + s)
        ends.append(np.minimum(at + s + WINDOW, at + n))
        owner.append(np.full(len(s), d))
        at += n
    starts, ends, owner = map(np.concatenate, (starts, ends, owner))
    count = np.maximum(ends - starts, 1).astype(float)

    # buckets seen in enough documents
    pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * np.int64(n_words) + tokens)
    word_docs = np.bincount(pairs % n_words, minlength=n_words)
    del pairs
    bucket_docs = np.bincount(bucket, word_docs[index], 1 << BITS)
    learned = bucket_docs[bucket] >= MIN_DOCS
    index, bucket = index[learned], bucket[learned]
    used, column = np.unique(bucket, return_inverse=True)
    share = 1.0 / per_word[index]

    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.02, (len(used), DIM))
    weight, bias = rng.normal(0, 1.0, DIM), np.array([-3.0])  # most passages are clean: the bias says so, not every word
    slots = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, weight, bias)]
    y = y_doc[owner]
    n_docs, n_toxic, n_clean = len(sizes), (y_doc > 0).sum(), (y == 0).sum()
    first = np.searchsorted(owner, np.arange(n_docs))
    mean = np.empty((len(owner), DIM))
    run = np.zeros(len(tokens) + 1)
    for step in range(1, steps + 1):
        # one dimension at a time: what is held grows with the tokens, not with tokens times dimensions
        for j in range(DIM):
            np.cumsum(np.bincount(index, table[column, j] * share, n_words)[tokens], out=run[1:])
            mean[:, j] = (run[ends] - run[starts]) / count
        logit = mean @ weight * 10 + bias
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        # the worst passages of each toxic document carry its label: many at first, one in the end
        worst = np.maximum.reduceat(logit, first)
        slack = 4.0 * max(0.0, 1 - 2 * step / steps)
        w = np.where(y == 0, 1.0, (logit >= worst[owner] - slack).astype(float))
        per_doc = np.bincount(owner, w, n_docs)
        w = np.where(y == 0, n_docs / n_clean, w / np.maximum(per_doc[owner], 1) * n_docs / n_toxic * 0.25)
        g = w * (p - y) / n_docs
        grads_w, grads_b = (g[:, None] * mean * 10).sum(0), np.array([g.sum()])
        # a passage's gradient reaches each of its tokens alike: once for all dimensions, which differ by their weight alone
        g_token = np.cumsum(np.bincount(starts, g / count, len(tokens) + 1) - np.bincount(ends, g / count, len(tokens) + 1))[:-1]
        g_word = np.bincount(tokens, g_token, n_words)
        g_column = np.bincount(column, g_word[index] * share, len(used))
        g_table = g_column[:, None] * weight * 10 + 2e-5 * table
        for p_, g_, (m, v), rate in zip((table, weight, bias), (g_table, grads_w, grads_b), slots, (0.15, 0.05, 0.1)):
            m += 0.1 * (g_ - m)
            v += 0.01 * (g_ * g_ - v)
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    folded = np.zeros(1 << BITS, np.float32)
    folded[used] = table @ weight * 10
    return Model(folded, float(bias[0]))


def held_out(c: str = "doc_id"):
    return (F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0)


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, toxic of the labelled rows to learn from, never held-out ones: bounded, the same for the same tables."""
    rows = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(max_docs)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").where("text is not null")
    key = ["h", "doc_id", "t", "toxic"]
    found = found.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t"), "toxic", "text", F.octet_length("text").alias("n"))
    # texts until max_bytes, decided on hashes and sizes alone: documents may repeat an id, so this too is bounded
    sizes = found.select(*key, "n").orderBy(*key).limit(max_docs).collect()
    total, last = 0, None
    for r in sizes:
        if total + r.n > max_bytes and last is not None:
            break
        total, last = total + r.n, r
    if last is None:
        return found.where("false").select("doc_id", "text", "toxic")
    upto = F.struct(*key) <= F.struct(*[F.lit(last[k]).cast(found.schema[k].dataType) for k in key])
    # equal rows beyond the bound would all pass the last key: they count once
    return found.where(upto).dropDuplicates(key).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the sample's rows, fitted in one executor task; the driver gets the folded table alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        rows = rows.sort_values(["doc_id", "text", "toxic"], kind="stable")
        model = fit(rows.pop("text").tolist(), rows["toxic"].tolist())
        yield pd.DataFrame({"folded": [model.folded.tobytes()], "bias": [model.bias]})

    # one task on purpose: the whole sample, at most MAX_DOCS rows and MAX_BYTES beside its last text
    got = sample(docs, labels).repartition(1).mapInPandas(run, "folded binary, bias double").collect()
    if not got:
        return fit([], [])
    return Model(np.frombuffer(got[0].folded, np.float32), got[0].bias)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the probability that a reader would call the text toxic, in a column named `column` (with underscores behind it where docs has that name)."""
    column = split_for(docs, column)
    tune(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # one number per n-gram: 1 MB whatever the corpus
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        values = Values(model)
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                b = whole.slice(i, 250)
                texts = [words_of(t.as_py() or "") for t in b.column(at)]
                values.learn(texts)
                get = values.__getitem__
                worst = [passage_means(np.fromiter(map(get, ws), float, len(ws)), model.window).max() for ws in texts]
                p = 1 / (1 + np.exp(-np.clip(np.array(worst) + model.bias, -50, 50)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, column])

    return docs.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
