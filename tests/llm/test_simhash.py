import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from attestra.llm import simhash as S

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def brute_fingerprint(text, words=4):
    w = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(items, bits):
    """items: (id, fingerprint); the smallest id reachable of each."""
    head = list(range(len(items)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, j in itertools.combinations(range(len(items)), 2):
        if (items[i][1] ^ items[j][1]).bit_count() <= bits:
            head[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(items))]


def patterns(n, seed=5):
    """Clusters around centres, dense balls, and lone patterns."""
    r = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    while len(out) < n:
        c = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 3, 30])):
            x = c
            for _ in range(r.randint(0, 7)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return sorted(out)


def test_gray_rank_orders_neighbours_by_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    codes = codes[np.argsort(S.gray_rank(codes))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(codes.tolist(), codes[1:].tolist()))


def test_nodes_hold_what_all_below_share():
    fps = np.array(patterns(100), np.uint64)
    index = S.GrayIndex(fps)
    for level, (pattern, mask) in enumerate(index.levels):
        for k, (p, m) in enumerate(zip(pattern.tolist(), mask.tolist())):
            below = [int(x) for x in index.fps[k << level : (k + 1) << level]]
            shared = ~0 & (1 << 64) - 1
            for x in below:
                shared &= ~(x ^ below[0]) & (1 << 64) - 1
            assert m == shared and p == below[0] & shared


def test_forest_spans_all_links():
    for n, bits in ((1, 4), (2, 4), (3, 4), (57, 4), (400, 4), (400, 0), (300, 9)):
        fps = patterns(n, n)[:n]
        a, b = S.GrayIndex(np.array(fps, np.uint64)).forest(bits)
        assert all((x ^ y).bit_count() <= bits for x, y in zip(a.tolist(), b.tolist()))
        label = {x: x for x in fps}

        def top(x):
            while label[x] != x:
                x = label[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            p, q = top(x), top(y)
            assert p != q
            label[max(p, q)] = min(p, q)
        assert [top(x) for x in fps] == components([(x, x) for x in fps], bits)


def test_tables_leave_no_pair_apart():
    r = random.Random(2)
    for count in (10, 10**8, 10**11):
        masks = S.tables(count, 4)
        assert len(masks) == {10: 5, 10**8: 15, 10**11: 35}[count]
        for _ in range(2000):
            x = 0
            for _ in range(4):
                x |= 1 << r.randrange(64)
            assert any(not x & m for m in masks)


def test_links_of_large_buckets_and_of_many_tables(spark):
    fps = patterns(500, 9)
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    want = components([(x, x) for x in fps], 4)
    for large, count in ((S.LARGE, None), (20, None), (S.LARGE, 10**8)):
        got = S.links(df, 4, large) if count is None else None
        if got is None:
            rows = S.bucketed(df, count, 4, large).groupBy("grp").agg(F.collect_set("fp").alias("fps")).collect()
            pairs = {(a, b) for r in rows for a, b in zip(*(x.tolist() for x in S.GrayIndex(np.array(r["fps"], np.int64).view(np.uint64)).forest(4)))}
        else:
            pairs = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in got.collect()}
        label = {x: x for x in fps}

        def top(x):
            while label[x] != x:
                x = label[x]
            return x

        for x, y in pairs:
            p, q = top(x), top(y)
            label[max(p, q)] = min(p, q)
        assert [top(x) for x in fps] == want


def test_whole_query_equals_brute_force(spark, docs):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    rows, i = [], 50
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 4, 5, 60, 400]))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            rows.append((i, r.choice([" ", "\n", "  \t"]).join(w).upper() if r.random() < 0.2 else " ".join(w)))
            i = i - 1 if r.random() < 0.3 else i + 7
    rows += [(3, ""), (9, None), (2, " \n"), (4, "x y"), (None, "x y"), (None, "quite alone here"), (5, "same row"), (5, "same row"), (77, "long " * 30_000)]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = components([(d, f) for (d, _), f in zip(rows, fps)], 4)
    got = S.near_duplicates(docs(rows), words=4).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((d, f & (1 << 64) - 1, c) for d, f, c in got), key=key) == sorted(((d, f, c) for (d, _), f, c in zip(rows, fps, want)), key=key)


def test_empty(docs):
    assert S.near_duplicates(docs([])).count() == 0


def test_query_over_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = components([(d, f) for (d, _), f in zip(rows, fps)], 4)
    got = sorted(tuple(r) for r in S.op13_simhash(spark, sf).collect())
    assert got == sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, want))
