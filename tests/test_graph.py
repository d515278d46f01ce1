import random
from collections import deque

from pyspark.sql import functions as F

from attestra.operators import graph as G


def walked(anchors, edges, docs, depth, limit):
    """Breadth-first search with a queue, one query at a time."""
    found, order, queue = {}, [], deque()
    for node, score in anchors:
        if node in docs:
            found[node] = (score, 0, None)
            order.append(node)
            queue.append((node, 0))
    while queue and len(found) < limit:
        node, d = queue.popleft()
        if d >= depth:
            continue
        around = [(s, t) for s, x, t in sorted(edges) if x == node and t in G.RELATIONS and s in docs] + [(x, t) for x, s, t in sorted((x, s, t) for s, x, t in edges) if s == node and t in G.RELATIONS and x in docs]
        for other, kind in around:
            court, year = docs[other][:2]
            score = round(1 / (d + 2) + G.RELATIONS[kind] + (0.3 if court.lower().startswith("supreme court") else 0.1) + min(max(year - 1950, 0) / 250, 0.25), 6)
            new = other not in found
            if new:
                order.append(other)
            if new or score > found[other][0]:
                found[other] = (score, d + 1, kind)
            if new and len(found) < limit:
                queue.append((other, d + 1))
    return found, order


def pruned(found, order, edges, docs):
    left = dict(found)
    for node in order:
        if docs[node][2] in G.INVALID:
            del left[node]
            continue
        heirs = sorted({s for s, x, t in edges if x == node and t == "overrules" and s in docs})
        if heirs:
            del left[node]
            for h in heirs:
                if h not in left:
                    left[h] = (round(found[node][0] + 0.25, 6), found[node][1], "overrules")
    return left


def test_walk_and_pruning_equal_a_queue(spark):
    r = random.Random(6)
    kinds = [*G.RELATIONS, "refers_to"]
    docs = {i: (r.choice(["Supreme Court of India", "Delhi High Court", "Court"]), r.randint(1940, 2020), r.choice(["GOOD_LAW"] * 6 + ["OVERRULED"])) for i in range(120)}
    edges = sorted({(r.randrange(120), r.randrange(120)) for _ in range(240)})
    edges = [(a, b, r.choice(kinds)) for a, b in edges if a != b and r.random() < 0.9]
    starts = {q: [(r.randrange(120), 1.5), (r.randrange(120), 1.2)] for q in range(25)}
    starts = {q: a for q, a in starts.items() if a[0][0] != a[1][0]}
    d = spark.createDataFrame([(i, c, f"{y}-05-05", v) for i, (c, y, v) in docs.items()], "doc_id long, court string, date string, current_validity string").withColumn("date", F.to_date("date"))
    e = spark.createDataFrame(edges, "source long, target long, type string")
    a = spark.createDataFrame([(q, n, s, i) for q, xs in starts.items() for i, (n, s) in enumerate(xs)], "query_id long, node long, score double, rank int")
    for depth, limit in ((4, 50), (4, 9), (2, 50)):
        nodes = G.traversed(a, e, d, depth, limit).persist()
        got, left = {}, {}
        for x in nodes.collect():
            got.setdefault(x["query_id"], {})[x["node"]] = (x["score"], x["depth"], x["relation"])
        for x in G.without_overruled(nodes, e, d).collect():
            left.setdefault(x["query_id"], {})[x["node"]] = (x["score"], x["depth"], x["relation"])
        for q, xs in starts.items():
            found, order = walked(xs, edges, docs, depth, limit)
            assert got[q] == found
            assert left.get(q, {}) == pruned(found, order, edges, docs)


def test_anchors_by_name_come_first(spark):
    d = spark.createDataFrame([(1, "judgment", "Supreme Court", 5, "GOOD_LAW", "A v. B"), (2, "judgment", "Delhi High Court", 1, "GOOD_LAW", "C v D"), (3, "statute", None, 0, "GOOD_LAW", None), (4, "judgment", "Court", 1, "OVERRULED", "E v F")], "doc_id long, doc_type string, court string, coram int, current_validity string, case_name string")
    e = spark.createDataFrame([(2, 1, "follows")], "source long, target long, type string")
    hits = spark.createDataFrame([(q, n, 1.0) for q in (1, 2) for n in (1, 2, 3, 4)], "query_id long, doc_id long, score double")
    cases = spark.createDataFrame([(2, "C vs. D")], "query_id long, case_name string")
    got = [(r["query_id"], r["node"], r["score"], r["reason"]) for r in G.anchors(hits, d, e, cases).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, round(1 + 0.5 + 0.15 + 0.03, 6), "lexical_landmark"), (1, 2, round(1 + 0.2 + 0.02 + 0.03, 6), "lexical_landmark"), (2, 2, 2.22, "exact_case_match")]


def test_chains_of_any_length_and_circles(spark):
    links = [(i, i + 1) for i in range(1000)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(3000, 3001), (3001, 2003)] + [(4000, 4000)] + [(5000, 500)]
    got = {r["node"]: (r["last"], r["steps"]) for r in G.chains(spark.createDataFrame(links, "node long, next long")).collect()}
    want = {i: (1000, 1000 - i) for i in range(1000)} | {i: (None, None) for i in [*range(2000, 2007), 3000, 3001, 4000]} | {5000: (1000, 501)}
    assert got == want
    assert G.chains(spark.createDataFrame([], "node long, next long")).count() == 0
