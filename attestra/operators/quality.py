"""Answer quality: every measure of a case from its answer, reference and contexts, in Arrow batches; alignment and best matches are loops over arrays of one case.

cases: case_id, query, answer, reference, contexts, noisy_contexts, reference_entities, reference_contexts (arrays of strings; null as empty).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import DIMENSION, word_vectors

# What makes a word, suffixes in the order in which they are tried, words that are no entities, thresholds.
TOKEN = re.compile(r"[a-z0-9]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
SUFFIXES = ["ingly", "edly", "ing", "ed", "ly", "es", "s"]
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "to", "was", "were", "with"]
SUPPORTED, COVERED = 0.72, 0.55
MEASURES = ["bert_score_f1", "rouge_l", "meteor", "faithfulness", "answer_relevancy", "context_precision", "context_recall", "context_entity_recall", "hallucination_score", "contextual_precision", "contextual_recall", "g_eval_legal_accuracy", "noise_robustness"]


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(" ".join(text.split())) if s]


def stem(token: str) -> str:
    """Without the first suffix that leaves three characters."""
    return next((token[: -len(s)] for s in SUFFIXES if token.endswith(s) and len(token) - len(s) >= 3), token)


def entities(text: str) -> list[str]:
    """Distinct words of three characters and more that are no stop words and no numbers, in order."""
    return list(dict.fromkeys(t for t in tokens(text) if len(t) > 2 and t not in STOPWORDS and not t.isdigit()))


def subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. A row of the table is the running maximum of what each cell can take from the row above."""
    if not a or not b:
        return 0
    ids = {t: i for i, t in enumerate(dict.fromkeys(b))}
    right = np.array([ids[t] for t in b])
    row = np.zeros(len(b) + 1, np.int64)
    for t in a:
        if t in ids:
            row[1:] = np.maximum.accumulate(np.where(right == ids[t], row[:-1] + 1, row[1:]))
    return int(row[-1])


def rouge_l(answer: list[str], reference: list[str]) -> float:
    n = subsequence(answer, reference)
    return 2 * n / (len(answer) + len(reference)) if n else 0.0


def meteor(answer: list[str], reference: list[str]) -> float:
    """Stems aligned greedily from the left: the k-th of an answer's stem with the k-th of the reference's. Weighted harmonic mean less a penalty for broken order."""
    a, b = [stem(t) for t in answer], [stem(t) for t in reference]
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    free: dict[str, list[int]] = {}
    for j in reversed(range(len(b))):
        free.setdefault(b[j], []).append(j)
    pairs = [(i, free[t].pop()) for i, t in enumerate(a) if free.get(t)]
    if not pairs:
        return 0.0
    m = len(pairs)
    p, r = m / len(a), m / len(b)
    runs = 1 + sum(not (i2 == i1 + 1 and j2 == j1 + 1) for (i1, j1), (i2, j2) in zip(pairs, pairs[1:]))
    return 10 * p * r / max(r + 9 * p, 1e-9) * (1 - 0.5 * (runs / m) ** 3)


def vectors(texts: list[str]) -> np.ndarray:
    """Unit vectors of hashed words, rounded as those of embedding; zeros without words."""
    words = word_vectors(DIMENSION)
    out = np.zeros((len(texts), DIMENSION))
    for i, t in enumerate(texts):
        if ws := t.lower().split():
            total = words.known(ws).sum(axis=0)
            n = np.sqrt((total * total).sum())
            out[i] = np.round(total / n, 8) if n else total
    n = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def supported(claims: list[str], facts: list[str]) -> float:
    """Share of claims that some fact comes close to."""
    return float(((vectors(claims) @ vectors(facts).T).max(1) >= SUPPORTED).mean()) if claims and facts else 0.0


def precision(answer: np.ndarray, contexts: list[str]) -> float:
    return float((vectors(contexts) @ answer >= COVERED).mean()) if contexts else 0.0


def measured(query: str, answer: str, reference: str, contexts: list[str], noisy: list[str], names: list[str], passages: list[str]) -> list[float]:
    q, a, r = vectors([query, answer, reference])
    facts = [s for c in contexts for s in sentences(c)]
    names = names or entities(reference)
    share = lambda text, empty: sum(n.lower() in text.lower() for n in names) / len(names) if names else empty
    similar, faithful, helpful = float(a @ r), supported(sentences(answer), facts), precision(a, contexts)
    recalled = supported(passages or sentences(reference), facts)
    robust = max(0.0, 1 - abs(helpful - precision(a, [*contexts, *noisy]))) if noisy else 1.0
    left, right = tokens(answer), tokens(reference)
    return [similar, rouge_l(left, right), meteor(left, right), faithful, float(q @ a), helpful, recalled, share(" ".join(contexts), 0.0), 1 - faithful, helpful, recalled, 0.6 * similar + 0.4 * share(answer, 1.0), robust]


def quality(cases: DataFrame) -> DataFrame:
    """case_id and its MEASURES."""
    lists = ["contexts", "noisy_contexts", "reference_entities", "reference_contexts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some = lambda x: list(x) if x is not None else []
            rows = [measured(x.query or "", x.answer or "", x.reference or "", *(some(getattr(x, c)) for c in lists)) for x in b.itertuples()]
            out = pd.DataFrame(rows, columns=MEASURES)
            out.insert(0, "case_id", b["case_id"].to_numpy())
            yield out

    kind = cases.schema["case_id"].dataType.simpleString()
    return cases.select("case_id", "query", "answer", "reference", *lists).mapInPandas(run, f"case_id {kind}, " + ", ".join(f"{m} double" for m in MEASURES))


def summary(measures: DataFrame) -> DataFrame:
    """One row: the mean of every measure, 0 without cases."""
    return measures.agg(F.count("*").alias("n_cases"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in MEASURES])


def code_awareness(cases: DataFrame, resolved: DataFrame) -> DataFrame:
    """cases (case_id, reference, reference_date, expected) with the preferred reference (resolved: state.mapped_references) and whether it is the expected one."""
    r = resolved.select(F.col("reference").alias("own"), F.col("reference_date").alias("day"), "preferred").distinct()
    c = cases.join(r, F.col("reference").eqNullSafe(F.col("own")) & F.col("reference_date").eqNullSafe(F.col("day")), "left").select("case_id", "expected", "preferred")
    return c.withColumn("correct", F.coalesce(F.col("preferred") == F.col("expected"), F.lit(False)))
