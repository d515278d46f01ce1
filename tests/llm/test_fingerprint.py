import hashlib
import random
import re
import struct

import xxhash

from attestra.llm.fingerprint import GRAM, LONG, SKETCH, edited_fingerprints, matches


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_edited_texts_follow_descending_ids(docs):
    rows = [(5, prose(1, 300)), (9, prose(2, 300)), (1, None), (3, "one two"), (7, prose(1, 300)), (12, "  "), (4, "é" * 7)]
    got = {r["doc_id"]: r for r in edited_fingerprints(docs(rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[5]["fingerprint"] == got[7]["fingerprint"]
    assert got[9]["near_edited"] > 0.2 > got[9]["near_next"]
    assert got[1]["fingerprint"] == ""


def test_empty_single_and_repeated(docs):
    assert edited_fingerprints(docs([])).collect() == []
    one = edited_fingerprints(docs([(1, "just one text here")])).first()
    assert one["near_next"] == 1.0
    assert edited_fingerprints(docs([(1, "a b c d e"), (1, "a b c d e"), (None, "x")])).count() == 3


def test_likeness_does_not_hang_on_length_or_spaces(docs):
    text = prose(4, 60)
    solid = prose(6, 200).replace(" ", "")
    rows = [(9, text[:195]), (8, text[:205]), (5, solid[:400]), (4, prose(7, 90).replace(" ", "")[:400])]
    got = {r["doc_id"]: r for r in edited_fingerprints(docs(rows)).collect()}
    assert got[9]["near_next"] > 0.8
    assert got[5]["near_edited"] > 0.2 > got[5]["near_next"]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return signed(seed)


def plain(text):
    """Anchors, in plain Python: (hash, first place), the smallest SKETCH of them."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    units = []
    for w in words:
        units += [hashed(b"gram", w[i : i + GRAM].encode()) for i in range(len(w) - GRAM + 1)] if len(w) > LONG else [hashed(w.encode())]
    if not units:
        return {}
    if len(units) < 4:
        h = 0
        for u in units:
            h = hashed(h, u)
        return {h: 0}
    pairs = [hashed(a, b) for a, b in zip(units, units[1:])]
    found = {}
    for i in range(len(units) - 3):
        a, b, c = pairs[i : i + 3]
        if min(a, c) <= b:
            found.setdefault(hashed(a, c), i)
    return dict(sorted(found.items())[:SKETCH])


def alike(a, b):
    union = sorted({*a, *b})[:SKETCH]
    return len({*a} & {*b} & {*union}) / len(union) if union else 1.0


def test_query_equals_plain_python(docs):
    r = random.Random(8)
    texts = [prose(1, 300), prose(2, 5), None, "", " \t ", "one", "a b c", "a b c d", "x" * 400, "日本語の文章です" * 30, prose(3, 20) + " " + "deadbeef" * 9 + " " + prose(4, 20), prose(1, 299), prose(5, 4000)]
    texts += [prose(9, 50) + " " + prose(r.randint(10, 20), 50) for _ in range(10)] + ["same text twice over"] * 2
    rows = list(enumerate(texts))
    got = {x["doc_id"]: x for x in edited_fingerprints(docs(rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        own, edit, following = plain(t), plain(t[: len(t) - half] + after[:half]), plain(after)
        text = lambda a: "".join(f"{x & (1 << 64) - 1:016X}" for x in a)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"], got[i]["places"]) == (text(own), text(edit), list(own.values()))
        assert abs(got[i]["near_edited"] - alike(own, edit)) < 1e-12 and abs(got[i]["near_next"] - alike(own, following)) < 1e-12
        gaps = [edit[a] - own[a] for a in own if a in edit]
        assert got[i]["aligned_edited"] == (max(map(gaps.count, gaps)) / len(gaps) if gaps else None)


def test_matches_give_the_places_of_shared_passages(docs):
    shared = prose(30, 60)
    rows = [(1, prose(31, 100) + " " + shared + " " + prose(32, 40)), (2, prose(33, 7) + " " + shared), (3, prose(34, 200)), (4, None)]
    got = [x for x in matches(docs(rows), docs(rows)).collect() if x["doc_id"] < x["other_id"]]
    assert [(x["doc_id"], x["other_id"], x["distance"]) for x in got] == [(1, 2, -93)]
    assert got[0]["anchors"] > 20 and got[0]["first"] >= 100 and got[0]["last"] < 160


def test_very_long_text(docs):
    got = edited_fingerprints(docs([(1, prose(40, 60_000)), (2, "y" * 200_000)])).collect()
    assert len(got) == 2 and all(len(x["fingerprint"]) >= 16 for x in got)
