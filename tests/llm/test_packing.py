import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from attestra.llm import packing as P

TEXTS = ["", None, "one", "Hello,  world!\n\nIt's  here. ", " lead and trail ", "naïve café — “quotes” 123abc", "x" * 5000, "word " * 3000, "a\tb\r\nc\x0bd", "end<|endoftext|>more", "日本語 テキスト", "we'll they've'll", "tab\t ,x ,y", "a's, b't.", "Ends with a dot.\n", "<|endoftext|>", "<|endoftext|> .\n<|endoftext", "dots...\r\n"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.vocabulary_path())


def test_cached_ids_equal_the_tokenizer(tokenizer):
    ids = P.Ids(P.vocabulary_path())
    for _ in range(2):
        for t, got in zip(TEXTS, ids.all([t or "" for t in TEXTS])):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_ids_without_the_rank_file(tokenizer, tmp_path):
    import shutil

    path = shutil.copy(P.vocabulary_path(), tmp_path / "v.json")
    for t, got in zip(TEXTS, P.Ids(str(path)).all([t or "" for t in TEXTS])):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_ids_of_made_up_texts_equal_the_tokenizer(tokenizer):
    r = random.Random(4)
    parts = ["\n", "\r\n", " ", "  ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", ".", ",", "!?", "...", "'", "’", "'s", "“", "”", "…", "—", "_", "$", "<|endoftext|>", "<|endoftext", "|>", "a", "word", "Word", "12", "x1", "é", "e\u0301", "日本", "٣", "²", "Ⅷ", "ſ", "𝔘", "👍🏽", "ß", "-", "#"]
    ids = P.Ids(P.vocabulary_path())
    texts = ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(50_000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, got, w in zip(texts, ids.all(texts), want) if np.frombuffer(got, "<u4").tolist() != w]
    assert not wrong


def test_round_trip(docs, tokenizer):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    got = P.pack(docs(rows)).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in parts]).tolist() == want
        at = 0
        for r in parts:
            assert r["start"] == at and r["doc_tokens"] == len(want)
            at += len(r["ids"]) // 4
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += len(r["ids"]) // 4
        assert 0 < at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.01 * total
    d = P.digest(P.pack(docs(rows[:4]))).collect()
    assert all(r["length"] > 0 for r in d)
    assert zlib.crc32(np.array([0], "<u4").tobytes()) in {r["ids_crc32"] for r in d if r["doc_id"] == 0}


def test_level_minimises_squares():
    p = P.Packer(16)
    for n in (10, 9, 7, 5, 3):
        costs = {}
        for h in range(0, 16 - n + 1):
            if h == 0 or p.counts[h]:
                c = p.counts.copy()
                if h:
                    c[h] -= 1
                if h + n < 16:
                    c[h + n] += 1
                costs[h] = int((c[1:16] ** 2).sum())
        assert costs[p.level(n)] == min(costs.values())
        p.add(n, b"\0" * 4 * n)


def test_empty(docs):
    assert P.pack(docs([])).count() == 0


def test_ids_of_all_documents_equal_the_tokenizer(spark, tokenizer):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    got = P.Ids(P.vocabulary_path()).all(texts)
    assert all(np.frombuffer(g, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t, g in zip(texts, got))


def test_most_tokens_are_placed_by_the_sum_of_squares():
    r = np.random.default_rng(3)
    p, pieces, cut_from = P.Packer(), [], 0
    for i, n in enumerate(r.lognormal(5.5, 0.8, 3000).astype(int) + 1):
        pieces += p.add(i, b"\1\0\0\0" * int(n))
        cut_from += int(n) % 1024
        assert p.open <= P.OPEN_LIMIT
    pieces += p.flush()
    sizes = {}
    for x in pieces:
        sizes[x[4]] = sizes.get(x[4], 0) + len(x[2]) // 4
    assert p.cut <= 0.05 * cut_from
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes.values()) and sum(n < 1024 for n in sizes.values()) <= 10
