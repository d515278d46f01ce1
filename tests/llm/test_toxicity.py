import random
import zlib

import numpy as np

from attestra.llm import toxicity as X


def corpus(n=400):
    r = random.Random(2)
    words = ["".join(r.choice("bdfghklmnoprstu") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(10, 200))]
        bad = i % 4 == 0
        for _ in range(1 + len(w) // 30 if bad else 0):
            w[r.randrange(len(w))] = r.choice(["vexwazzle", "quixjabble", "zazzywix"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy_and_misspellings(spark, docs):
    rows = corpus()
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, toxic int, score int")
    d = docs([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "a calm vexwazle here")])
    model = X.train(d, labels)
    got = {r["doc_id"]: r["score_"] for r in X.score(d, model, "score_").collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in test) / len(test) > 0.9
    assert got[1002] >= 0.5 and got[1000] == got[1001] and 0 <= got[1000] < 0.5


def test_never_learns_from_held_out_rows(spark, docs):
    rows = corpus(60)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    texts = [r["text"] for r in X.sample(docs([(i, t) for i, t, _ in rows]), labels).collect()]
    assert texts and not {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0} & set(texts)


def test_without_labels(spark, docs):
    d = docs([(1, "words"), (2, None)])
    model = X.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["p"] < 0.5 for r in X.score(d, model, "p").collect())
    assert X.score(docs([]), model, "p").count() == 0


def test_sample_is_bounded_where_ids_repeat(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    d = docs([(i, f"text {i} {k % 7}") for i in range(1, 30) for k in range(50)])
    assert 0 < X.sample(d, labels, max_docs=20).count() <= 20
    assert 0 < X.sample(d, labels, max_bytes=100).count() <= 100 // 7
    assert X.sample(d.where("false"), labels).count() == 0


def test_score_equals_plain_numpy(spark, docs):
    """The cached, batched scorer against one word after the other."""
    rows = corpus(120)
    model = X.fit([t for _, t, _ in rows], [y for _, _, y in rows])

    def plain(text):
        values = []
        for w in X.words_of(text or ""):
            _, buckets = X.bags([w])
            values.append(float(np.mean(model.folded[buckets].astype(float))))
        runs = [np.mean(values[i : i + X.WINDOW]) for i in range(max(1, len(values) - X.WINDOW + 1))] if values else [0.0]
        return 1 / (1 + np.exp(-(max(runs) + model.bias)))

    texts = [(i, t) for i, t, _ in rows] + [(500, None), (501, ""), (502, "word " * 30_000), (503, rows[0][1]), (None, rows[0][1])]
    got = X.score(docs(texts), model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r["score_"] - plain(r["text"])) < 1e-9


def test_one_class_alone_rejects_nothing(spark, docs):
    d = docs([(i, f"words of {i}") for i in range(1, 20)])
    toxic = X.train(d, spark.createDataFrame([(i, 1) for i in range(1, 20)], "doc_id long, toxic int"))
    assert all(r["p"] < 0.5 for r in X.score(d, toxic, "p").collect())
