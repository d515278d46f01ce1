import collections
import hashlib
import random

import numpy as np
import pytest

from attestra.llm import substrings as S
from attestra.llm.fmindex import FMIndex


def brute(rows, window):
    counts, words = collections.Counter(), []
    for _, t in rows:
        w = (t or "").encode().split()
        words.append(w)
        counts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        kept = [x for x, y in zip(w, keep) if y]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 4)))
    make = lambda n: [word() for _ in range(n)]
    shared, phrase = make(60), make(12)
    rows = [(i, " ".join(make(80) + (shared if i % 3 == 0 else phrase) + make(50))) for i in range(12)]
    rows += [(50, " ".join(make(40))), (51, rows[1][1]), (52, "again " * 100), (53, " ".join(make(20) * 4)), (54, None), (55, ""), (56, "a\x0bb\tc\n d"), (57, " ".join(make(300)) + "\n" + rows[2][1][:400])]
    return rows + [rows[3]]


@pytest.mark.parametrize("hot", [1, 200])
def test_equals_brute_force(docs, hot, monkeypatch):
    monkeypatch.setattr(S, "HOT", hot)
    rows = corpus()
    got = sorted((tuple(r) for r in S.without_repeats(docs(rows)).collect()), key=str)
    assert got == brute(rows, 35)


def test_empty(docs):
    assert S.without_repeats(docs([])).count() == 0


def test_backward_search_counts():
    r = np.random.default_rng(1)
    text = np.concatenate([r.integers(1, 5, 400), [0], r.integers(1, 5, 300), [0]])
    index = FMIndex(text)
    s = text.tolist()
    for _ in range(50):
        at, n = int(r.integers(0, 390)), int(r.integers(1, 9))
        p = s[at : at + n]
        low, high = np.array([0]), np.array([len(s)])
        for c in reversed(p):
            low, high = index.back(np.array([c]), low, high)
        assert high[0] - low[0] == sum(s[i : i + n] == p for i in range(len(s)))
