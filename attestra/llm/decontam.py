"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Every passage of every document (overlapping windows twice as long as the
longest item) is a query against the index of items, scored by BM25. Scores are
held against each item's own score, the score a passage with all its words
gets: all items above RATIO of it are retrieved, and then verified by the overlap of
word n-grams with the item's question and with its answer.

Posting lists are ordered by item and cut into blocks of BLOCK items, each with its largest
impact. Impacts are divided by the item's threshold, so a score of 1 is reached
just at it. Before the search a passage is screened against block maxima, all
passages of a batch at once: the terms that are common among items are left out
of the sum, and what an item can win by them at most is subtracted from what its
block needs. Nothing that reaches the threshold can fail that screen.

The index is broadcast. It holds about MAX_ITEMS items or MAX_BYTES of text at most; a larger benchmark is
dealt into parts by a hash, and documents are searched against one part after
the other. Statistics (document frequencies, mean length) are those of all items.

Cases: null or empty documents and items match nothing; copies of an item are
reported each; rows with the same doc_id are reported together; an empty
benchmark gives no rows; other columns are ignored. Items without a `question` and an
`answer` column: the last sentence is the answer, or the last third of the
words where there is but one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, documents, tune

K1, B = 1.2, 0.75
RATIO = 0.5
BLOCK = 8
MAX_ITEMS = 20_000
#: Most bytes of item text in one part, on average.
MAX_BYTES = 32_000_000
#: Verification: n-grams of words, and the least shares found of the question's and the answer's.
GRAM = 3
QUESTION, ANSWER = 0.5, 0.3
#: What an item may win by common terms, as a share of its threshold.
COMMON_SHARE = 0.5
CACHE_WORDS = 500_000

SIGNS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def terms_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII signs separate."""
    return text.encode().translate(ASCII_LOWER).translate(SIGNS).split() if text else []


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [p for p in SENTENCE.split(text.strip()) if terms_of(p)]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in terms_of(p)], terms_of(parts[-1])
    words = terms_of(text)
    cut = max(1, len(words) - max(1, len(words) // 3))
    return words[:cut], words[cut:]


def grams(words: list[bytes], n: int = GRAM) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Items in order, posting lists with block maxima."""

    def __init__(self, items: list[tuple], df: dict[bytes, int], n_items: int, mean_length: float, ratio: float = RATIO, block: int = BLOCK):
        """items: (id, question words, answer words)."""
        self.block, self.ids = block, [i[0] for i in items]
        self.qa = [(i[1], i[2]) for i in items]
        self.longest = max((len(q) + len(a) for q, a in self.qa), default=1)
        self.terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = []
        self.own = np.zeros(len(items))
        for k, (q, a) in enumerate(self.qa):
            words = q + a
            tf: dict[bytes, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / max(mean_length, 1e-9))
            impact = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            self.own[k] = sum(impact.values())
            for w, x in impact.items():
                t = self.terms.setdefault(w, len(self.terms))
                if t == len(postings):
                    postings.append([])
                postings[t].append((k, x / (ratio * self.own[k])))
        # a posting list by its blocks: block -> (largest impact, items, impacts)
        self.blocks: list[dict[int, tuple[float, list[int], list[float]]]] = []
        for p in postings:
            cut: dict[int, tuple[float, list[int], list[float]]] = {}
            for k, x in p:
                top, its, imps = cut.get(k // block, (0.0, [], []))
                cut[k // block] = (max(top, x), [*its, k], [*imps, x])
            self.blocks.append(cut)
        items = [np.array([k for k, _ in p], np.int64) for p in postings]
        impacts = [np.array([x for _, x in p]) for p in postings]
        # terms left out of the screen, most widespread first, as far as no item can win COMMON_SHARE by them
        won, self.rare = np.zeros(len(self.ids)), np.ones(len(postings), bool)
        for t in sorted(range(len(postings)), key=lambda t: -len(items[t])):
            if len(items[t]) > 2 and (won[items[t]] + impacts[t]).max() <= COMMON_SHARE:
                won[items[t]] += impacts[t]
                self.rare[t] = False
        blocks = -(-len(self.ids) // block)
        self.need = np.array([(1 - won[i * block : (i + 1) * block]).min() for i in range(blocks)]) - 1e-9
        entries = [(sorted((b, cut[0]) for b, cut in self.blocks[t].items()) if self.rare[t] else []) for t in range(len(postings))]
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in entries])]).astype(np.int64)
        self.entry_block = np.array([b for x in entries for b, _ in x], np.int64)
        self.entry_max = np.array([v for x in entries for _, v in x])

    def screen(self, terms: np.ndarray, passage: np.ndarray, n_passages: int) -> dict[int, list[int]]:
        """Passage -> the blocks that can reach their need in it. terms, passage: of each occurrence of an indexed term."""
        rare = self.rare[terms]
        terms, passage = terms[rare], passage[rare]
        counts = self.at[terms + 1] - self.at[terms]
        if not counts.sum():
            return {}
        first = np.repeat(self.at[terms] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        entry = first + np.arange(counts.sum())
        blocks = len(self.need)
        key = np.repeat(passage, counts) * blocks + self.entry_block[entry]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bound = np.add.reduceat(self.entry_max[entry[order]], starts)
        key = key[starts]
        out: dict[int, list[int]] = {}
        for k in key[bound >= self.need[key % blocks]].tolist():
            out.setdefault(k // blocks, []).append(k % blocks)
        return out

    def search(self, terms: list[int], blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: every (item, score) with a score of at least 1, terms counting once.

        blocks: those that the screen leaves; without it, all that the terms have postings in.
        """
        lists = [self.blocks[t] for t in set(terms)]
        found: list[tuple[int, float]] = []
        for b in sorted({b for x in lists for b in x}) if blocks is None else blocks:
            inside = [x[b] for x in lists if b in x]
            if sum(x[0] for x in inside) < 1 - 1e-9:
                continue  # by its maxima the block can't reach the threshold: skipped whole
            # cursors: current item, place, the list; the pivot is the first item that the maxima up to it allow to reach the threshold
            cursors = [[x[1][0], 0, x] for x in inside]
            while cursors:
                cursors.sort(key=lambda c: c[0])
                bound, item = 0.0, None
                for c in cursors:
                    bound += c[2][0]
                    if bound >= 1 - 1e-9:
                        item = c[0]
                        break
                if item is None:
                    break
                target = item
                if cursors[0][0] == item:
                    score = sum(c[2][2][c[1]] for c in cursors if c[0] == item)
                    if score >= 1 - 1e-9:
                        found.append((item, float(score)))
                    target = item + 1
                for c in cursors:
                    if c[0] < target:
                        its = c[2][1]
                        c[1] = at = bisect_left(its, target, c[1])
                        c[0] = its[at] if at < len(its) else -1
                cursors = [c for c in cursors if c[0] >= 0]
        return found

    def verify(self, item: int, words: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and the answer's n-grams that words hold."""
        q, a = self.qa[item]
        seen = {n: grams(words, n) for n in {min(GRAM, len(q)), min(GRAM, len(a))} if n}
        share = lambda part: len(grams(part) & seen[min(GRAM, len(part))]) / len(grams(part)) if part else 1.0
        return share(q), share(a)


class Matcher(dict):
    """word -> its number in the index, or -1; searches documents."""

    def __init__(self, index: Index):
        super().__init__()
        self.index, self.width = index, max(2 * index.longest, 8)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        t = self[word] = self.index.terms.get(word, -1)
        return t

    def documents(self, texts: list[list[bytes]]) -> Iterator[tuple]:
        """(document, item, score, question share, answer share): the best passage of each pair."""
        half, owners, starts = self.width // 2, [], []
        ids, passages = [], []
        for d, words in enumerate(texts):
            t = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            n = max(1, -(-max(0, len(words) - self.width) // half) + 1)
            hit = np.flatnonzero(t >= 0)
            # passage k holds words [k * half, k * half + width): each word is in up to two
            k = hit // half
            for p in (k, k - 1):
                ok = (p >= 0) & (p < n)
                ids.append(t[hit[ok]])
                passages.append(p[ok] + len(owners))
            owners += [d] * n
            starts += [i * half for i in range(n)]
        if not ids:
            return
        ids, passages = np.concatenate(ids), np.concatenate(passages)
        best: dict[tuple[int, int], tuple] = {}
        for p, blocks in self.index.screen(ids, passages, len(owners)).items():
            d = owners[p]
            words = texts[d][starts[p] : starts[p] + self.width]
            for item, score in self.index.search([t for t in map(self.__getitem__, words) if t >= 0], blocks):
                q, a = self.index.verify(item, words)
                if q >= QUESTION and a >= ANSWER and (score, q, a) > best.get((d, item), (0.0,)):
                    best[d, item] = (score, q, a)
        for (d, item), found in best.items():
            yield d, item, *found


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _items(bench: DataFrame) -> DataFrame:
    """item_id, question and answer: from their columns, or from text."""
    if {"question", "answer"} <= set(bench.columns):
        return bench.select(F.col("item_id").cast("long").alias("item_id"), "question", "answer", F.lit(None).cast("string").alias("text"))
    return bench.select(F.col("item_id").cast("long").alias("item_id"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"), "text")


def _parts(row) -> tuple[list[bytes], list[bytes]]:
    return (terms_of(row["question"]), terms_of(row["answer"])) if row["text"] is None else question_answer(row["text"])


def contaminated(docs: DataFrame, bench: DataFrame, ratio: float = RATIO, max_items: int = MAX_ITEMS) -> DataFrame:
    """Pairs of document and item, each once: BM25 score as a share of the item's own, overlaps."""
    spark = docs.sparkSession
    tune(spark)
    items = _items(bench).where("item_id is not null and (text is not null or question is not null or answer is not null)")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [q + a for q, a in map(_parts, b.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([list(set(r)) for r in rows], pa.list_(pa.binary())), pa.array([len(r) for r in rows], pa.int64())], names=["words", "length"])

    counted = items.mapInArrow(count, "words array<binary>, length long").where("length > 0")
    n_items, total = counted.agg(F.count("*"), F.sum("length")).first()
    out = spark.createDataFrame([], SCHEMA)
    if not n_items:
        return out
    frequencies = counted.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    found = None
    size = items.agg(F.sum(F.octet_length(F.concat_ws(" ", "text", "question", "answer")))).first()[0]
    n_parts = max(-(-n_items // max_items), -(-size // MAX_BYTES))
    for part in range(n_parts):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == part)
        rows = [(r["item_id"], *_parts(r)) for r in own.orderBy("item_id", "text", "question", "answer").collect()]
        rows = [r for r in rows if r[1] or r[2]]
        if not rows:
            continue
        words = own.mapInArrow(count, "words array<binary>, length long").select(F.explode("words").alias("word")).distinct()
        df = {bytes(r["word"]): r["df"] for r in frequencies.join(words, "word", "left_semi").collect()}
        shipped = spark.sparkContext.broadcast(Index(rows, df, n_items, total / n_items, ratio))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value)
            for whole in batches:
                for i in range(0, whole.num_rows, 250):
                    b = whole.slice(i, 250)
                    ids = b.column(0).to_pylist()
                    got = list(matcher.documents([terms_of(t.as_py()) for t in b.column(1)]))
                    if got:
                        d, item, *rest = zip(*got)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in d], pa.int64()), pa.array([shipped.value.ids[k] for k in item], pa.int64()), *map(pa.array, rest)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        new = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
        found = new if found is None else found.unionByName(new)
    if found is None:
        return out
    best = F.max(F.struct("score", "question_overlap", "answer_overlap"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", (F.col("b.score") * ratio).alias("score"), "b.question_overlap", "b.answer_overlap")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
