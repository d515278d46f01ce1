import random

from attestra.llm.common import hashed_words


def test_words_are_those_of_split_and_hashes_tell_them_apart():
    r = random.Random(2)
    alphabet = "abcé日 \t\n\r\x0b\x0c  \x1c\xa0"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))).encode() for _ in range(300)]
    texts += [b"", b" ", b"x" * 64, b"x" * 65, b"x" * 63 + b"y", b"y" + b"x" * 63, b"\0", b"\0\0", b"a\0", b"a", "ß" .encode() * 500, b"w" * 100_000 + b" tail"]
    h, sizes = hashed_words(texts)
    words = [t.split() for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    seen = {}
    for w, x in zip(flat, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    alone = hashed_words([b"a", b"b c"])[0].tolist()
    assert alone == hashed_words([b" a  b\tc\n"])[0].tolist()
    assert [len(x) for x in hashed_words([])] == [0, 0]
