import itertools
import random

import pytest

from attestra.llm import neardup as N
from attestra.llm.components import connected

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def brute(rows, n):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        k = len(sets[i] & sets[j])
        if k and 100 * k >= 80 * len(sets[i] | sets[j]):
            head[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def found(got):
    return sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect())


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows, i = [], 100
    common = [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i + k, " ".join(common + [word() for _ in range(40)])) for k in range(50)]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE two"), (6, "one"), (7, rows[0][1].upper()), (8, rows[0][1])]
    return rows


@pytest.mark.parametrize("hot", [2, 12])
def test_equals_brute_force(docs, hot, monkeypatch):
    monkeypatch.setattr(N, "HOT", hot)
    rows = corpus()
    assert found(N.near_duplicates(docs(rows), words=4)) == brute(rows, 4)


def test_empty_null_and_repeated(docs):
    assert N.near_duplicates(docs([])).count() == 0
    got = N.near_duplicates(docs([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 3, False), (3, 3, True), (3, 3, True)]


def test_long_paths_connect(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def group(r, size, length, edits, vocabulary):
    """Near copies of one text, each with up to `edits` words exchanged, put in or left out."""
    base = [r.choice(vocabulary) for _ in range(length)]
    for _ in range(size):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            at, how = r.randrange(len(w)), r.random()
            w[at : at + 1] = [] if how < 0.15 else [r.choice(vocabulary)] if how < 0.8 else [w[at], r.choice(vocabulary)]
        yield " ".join(w)


@pytest.mark.parametrize("hot, rare", [(2, 4), (12, 8), (12, 64)])
def test_large_groups_around_the_threshold(docs, hot, rare, monkeypatch):
    # most pairs of a group lie between 0.5 and 0.95, and many texts are just short of all others
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "RARE", rare)
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    texts = [t for size, length, edits in ((250, 140, 14), (120, 60, 6), (60, 30, 3)) for t in group(r, size, length, edits, words)]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(r.choice(words) for _ in range(r.randint(2, 60))) for _ in range(150)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(N.near_duplicates(docs(rows), words=4)) == brute(rows, 4)


def test_a_group_without_an_origin_just_below_the_threshold(docs, monkeypatch):
    # texts of the same 40 parts, each without 6: no two reach the similarity but the planted ones
    monkeypatch.setattr(N, "HOT", 4)
    r = random.Random(9)
    parts = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(12)) for _ in range(40)]
    rows = [(i, " ".join(p for k, p in enumerate(parts) if k not in out)) for i, out in enumerate(set(r.sample(range(40), 6)) for _ in range(80))]
    rows += [(900 + i, t + " a few more") for i, t in rows[:5]]
    assert found(N.near_duplicates(docs(rows), words=4)) == brute(rows, 4)


def test_pairs_in_buckets_that_a_passage_fills_are_compared(docs, monkeypatch):
    # 100 texts share the passage that makes two shorter ones near-copies
    monkeypatch.setattr(N, "HOT", 2)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    rows, want = [], {}
    for g in range(8):
        passage = [word() for _ in range(100)]
        texts = [[word() for _ in range(10 if k < 2 else 63)] + passage for k in range(102)]
        for k, t in enumerate(texts):
            rows.append((1000 * g + k, " ".join(t)))
            want[1000 * g + k] = 1000 * g + (0 if k < 2 else k)
    r.shuffle(rows)
    got = {x["doc_id"]: x["component_id"] for x in N.near_duplicates(docs(rows), words=4).collect()}
    assert got == want


def test_very_long_texts(docs):
    r = random.Random(4)
    w = [str(r.random()) for _ in range(120_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[3000:])), (3, " ".join(w[40_000:])), (4, "x" * 300_000)]
    assert found(N.near_duplicates(docs(rows), words=4)) == brute(rows, 4)
