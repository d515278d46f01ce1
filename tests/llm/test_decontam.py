import random

import numpy as np
import pytest

from attestra.llm import decontam as D


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)) + "."


@pytest.fixture
def bench(spark):
    r = random.Random(3)
    rows = [(i, prose(r, 25) + " " + prose(r, 10), "x") for i in range(30)] + [(30, None, "x"), (31, "", "x"), (32, "Lone.", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, score string")


def test_finds_passages_and_leaves_the_rest(docs, bench):
    r = random.Random(4)
    items = {b["item_id"]: b["text"] for b in bench.collect()}
    rows = [(i, prose(r, 300) + " " + items[i] + " " + prose(r, 200)) for i in range(10)]
    rows += [(20 + i, prose(r, 400)) for i in range(10)] + [(40, None), (41, ""), (42, items[5].upper().replace(" ", ", ")), (43, " ".join(items[6].split()[:8])), (44, items[1] + " " + items[2])]
    got = {(x["doc_id"], x["item_id"]) for x in D.contaminated(docs(rows + rows[:1]), bench).collect()}
    assert got == {(i, i) for i in range(10)} | {(42, 5), (44, 1), (44, 2)}


def test_parts_give_the_same(docs, bench):
    r = random.Random(4)
    items = {b["item_id"]: b["text"] for b in bench.collect()}
    d = docs([(i, prose(r, 100) + " " + items[i]) for i in range(6)])
    key = lambda rows: sorted((x["doc_id"], x["item_id"], round(x["score"], 6)) for x in rows.collect())
    assert key(D.contaminated(d, bench)) == key(D.contaminated(d, bench, max_items=7))


def test_wand_equals_full_scoring():
    r = random.Random(9)
    words = [f"w{i}".encode() for i in range(60)]
    items = [(i, [r.choice(words) for _ in range(12)], [r.choice(words) for _ in range(4)]) for i in range(80)]
    df = {}
    for _, q, a in items:
        for w in set(q + a):
            df[w] = df.get(w, 0) + 1
    index = D.Index(items, df, len(items), 16.0, ratio=0.4)
    for _ in range(60):
        terms = [index.terms[w] for w in {r.choice(words) for _ in range(20)} if w in index.terms]
        full = {}
        for t in set(terms):
            for _, its, imps in index.blocks[t].values():
                for k, x in zip(its, imps):
                    full[k] = full.get(k, 0) + x
        want = sorted((k, round(s, 9)) for k, s in full.items() if s >= 1 - 1e-9)
        assert sorted((k, round(s, 9)) for k, s in index.search(terms)) == want
        left = index.screen(np.array(terms), np.zeros(len(terms), np.int64), 1).get(0, [])
        assert sorted((k, round(s, 9)) for k, s in index.search(terms, left)) == want


def test_empty(spark, docs, bench):
    assert D.contaminated(docs([]), bench).count() == 0
    assert D.contaminated(docs([(1, "a b")]), bench.where("item_id < 0")).count() == 0


def test_whole_query_equals_full_scoring(spark, docs, bench):
    """Every pair, with every passage scored against every item and no index."""
    r = random.Random(12)
    items = {b["item_id"]: D.question_answer(b["text"]) for b in bench.collect() if b["text"]}
    texts = {i: q + a for i, (q, a) in items.items() if q + a}
    rows = [(i, prose(r, 200) + " " + b" ".join(texts[i]).decode() + " " + prose(r, 90)) for i in range(12)]
    for i in range(12):  # parts of items, and items with words exchanged
        w = [x.decode() for x in texts[i + 12]]
        for _ in range(i):
            w[r.randrange(len(w))] = "zzz"
        rows.append((100 + i, prose(r, 50) + " " + " ".join(w[: len(w) - i])))
    rows += [(300, (prose(r, 30_000) + " " + b" ".join(texts[7]).decode() + " " + prose(r, 30_000))), (301, "w" * 100_000)]
    n, df = len(texts), {}
    for w in texts.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    mean = sum(map(len, texts.values())) / n
    longest = max(map(len, texts.values()))
    impact = {}
    for i, w in texts.items():
        norm = D.K1 * (1 - D.B + D.B * len(w) / mean)
        impact[i] = {x: np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * (D.K1 + 1) / (w.count(x) + norm) for x in set(w)}
    want = set()
    for d, text in rows:
        words = D.terms_of(text)
        for at in range(0, max(1, len(words)), longest):
            passage = words[at : at + 2 * longest]
            seen = set(passage)
            for i, (q, a) in items.items():
                if i in texts and sum(v for x, v in impact[i].items() if x in seen) >= D.RATIO * sum(impact[i].values()) - 1e-9:
                    share = lambda part: len(D.grams(part) & D.grams(passage, min(D.GRAM, len(part)))) / len(D.grams(part)) if part else 1.0
                    if share(q) >= D.QUESTION and share(a) >= D.ANSWER:
                        want.add((d, i))
    assert len(want) > 12
    assert {(x["doc_id"], x["item_id"]) for x in D.contaminated(docs(rows), bench).collect()} == want


def test_query_finds_every_contained_item(spark):
    """op6's own query at sf0.001 against containment of the items' words in the documents' words."""
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: b" " + b" ".join(D.terms_of(r["text"])) + b" " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: b" " + b" ".join(D.terms_of(r["text"])) + b" " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    contained = {(d, i) for d, t in texts.items() for i, w in items.items() if w in t}
    got = {(x["doc_id"], x["item_id"]) for x in D.op6_decontamination(spark, sf).collect()}
    assert contained and contained <= got
