import random
import re

import regex
from pyspark.sql import functions as F

from attestra.llm import pii as P

KEY = "key of the tests"
TEXTS = [
    "Mail Jane.Doe@example.com or JANE.DOE@EXAMPLE.COM, call +1 (743) 555-3824 or 743-555-3824.",
    "Card 4111 1111 1111 1111 and 4111111111111111 at 10.20.30.40, ssn 123-45-6789.",
    "Mrs. Anna Schmidt met Mr. Schmidt. Госпожа Анна Иванова", "nothing here, version 4.0. 12 apples", "", None, "﷐a@b.co﷑", "x" * 3000 + "@" + "y" * 10,
]


def test_kinds_formats_and_coreference(docs):
    d = docs(list(enumerate(TEXTS)))
    out = {r["doc_id"]: r for r in P.pseudonymised(d, KEY).collect()}
    a, b, c = out[0]["text"], out[1]["text"], out[2]["text"]
    m = re.fullmatch(r"Mail (\S+@\S+) or (\S+@\S+), call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})\.", a)
    assert m[1].upper() == m[2] and m.groups()[2:5] == m.groups()[5:8] and "doe" not in a.lower() and "3824" not in a
    n = re.fullmatch(r"Card (\d{4}) (\d{4}) (\d{4}) (\d{4}) and (\d{16}) at (\S+), ssn (\d{3}-\d{2}-\d{4})\.", b)
    assert "".join(n.groups()[:4]) == n[5] != "4111111111111111" and n[6] != "10.20.30.40" and n[7] != "123-45-6789"
    digits = [int(x) for x in n[5]]
    assert sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(digits)) % 10 == 0
    o = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+)\. Госпожа (\w+) (\w+)", c)
    assert o[2] == o[3] != "Schmidt" and o[1] in P.GIVEN["latin", "f"] and o[4] in P.GIVEN["cyrillic", "f"] and re.fullmatch("[а-я]+", o[5].lower())
    assert [out[i]["text"] for i in (3, 4, 5, 7)] == [TEXTS[3], "", None, TEXTS[7]]
    assert out[6]["text"].startswith("﷐") and "a@b.co" not in out[6]["text"]
    assert P.pseudonymised(d, KEY).columns == d.columns and out[3]["score"] == "x"


def test_distinct_entities_stay_distinct(docs):
    # so few letters that first draws collide
    d = docs([(i, f"write to {a}{i % 10}@x.com now") for i, a in enumerate("abcdefghijklmnopqrstuvwxyz" * 8)])
    e = P.assigned(d, KEY)
    assert e.where("attempt > 0").count() > 0
    n = e.agg(F.countDistinct("canonical").alias("a"), F.countDistinct("surrogate").alias("b")).first()
    assert n["a"] == n["b"]
    originals = {r["canonical"] for r in e.collect()}
    assert not originals & {r["surrogate"] for r in e.collect()}
    pairs = {}
    for x, y in zip(d.orderBy("doc_id").collect(), P.pseudonymised(d, KEY).orderBy("doc_id").collect()):
        assert pairs.setdefault(x["text"], y["text"]) == y["text"]
    assert len(set(pairs.values())) == len(pairs)


def test_key_and_empty(docs):
    d = docs([(1, "a@b.co")])
    assert P.pseudonymised(d, "k1").first()["text"] != P.pseudonymised(d, "k2").first()["text"]
    assert P.pseudonymised(docs([]), KEY).count() == 0


def test_given_names_stay_distinct(docs):
    # more given names than there are first draws, on either script and for one surname
    names = [f"{a}{b}n" for a in "BCDFGHJK" for b in ("a", "e", "i", "o", "u")]
    rows = [f"Mr {n} Smith" for n in names] + [f"Frau {n} Smith" for n in names] + [f"Господин {n} Иванов" for n in ("Адам", "Пётр", "Антон", "Борис")] + ["Mr Adam Smith", "Dr. Adam Smith", "Mr Smith"]
    d = docs(list(enumerate(rows * 2)))
    out = {r["doc_id"]: r["text"] for r in P.pseudonymised(d, KEY).collect()}
    assert all(out[i] == out[i + len(rows)] for i in range(len(rows)))
    assert len({out[i] for i in range(len(rows))}) == len(rows)
    assert len({out[i].split()[-1] for i in range(len(rows)) if rows[i].endswith("Smith")}) == 1
    assert not {out[i].split()[1] for i in range(len(rows)) if rows[i].count(" ") == 2} & {r.split()[1] for r in rows}


def test_further_forms_are_replaced(docs):
    rows = ["_john@example.com", "-john@example.com", "+44 20 7946 0958", "+49 30 1234567", "01 23 45 67 89", "+34 612 345 678", "5551234567", "Mr. McDonald", "Mr O'Brien", "Dr. J. Smith", "Mr John Paul Smith", "Mrs Smith-Jones", "Dr J.-P. Smith"]
    out = [r["text"] for r in P.pseudonymised(docs([(i, f"see {t}, ok") for i, t in enumerate(rows)]), KEY).orderBy("doc_id").collect()]
    for t, o in zip(rows, out):
        assert o.startswith("see ") and o.endswith(", ok") and not {w for w in t.replace("-", " ").split()[1:] if len(w) > 2} & set(o[4:-4].replace("-", " ").split()) and t not in o, (t, o)
    assert out[0][4] == "_" and out[1][4] == "-" and "john" not in "".join(out).lower() and out[9].split()[-2] == out[10].split()[-2]
    assert len(set(out)) == len(rows)


def test_titles_of_no_gender_take_that_of_the_name(docs):
    rows = ["Dr. Anna Schmidt", "Mrs. Anna Schmidt", "Dr. Kim Schmidt", "Prof. Robin Schmidt", "Mr Robin Schmidt", "Ms Robin Schmidt", "Mr. Emil Schmidt and Dr. Emil Schmidt"]
    out = [r["text"] for r in P.pseudonymised(docs(list(enumerate(rows))), KEY).orderBy("doc_id").collect()]
    given = lambda t: t.split()[1]
    assert given(out[0]) == given(out[1]) in P.GIVEN["latin", "f"] and given(out[2]) in P.GIVEN["latin", "n"]
    assert len({given(t) for t in out[3:6]}) == 3 and out[6].split()[1] == out[6].split()[5]
    assert len({t.split()[2] for t in out}) == 1


def test_forms_of_names_are_kept(docs):
    rows = ["MR. JOHN DOE", "Mr. John Doe", "Mr. Παπαδόπουλος", "Mr. SMITH", "Mr. Smith", "Herr Müller-Lüdenscheidt", "Mr O’Brien", "Mr O'Brien", "Mr Աբգարյան", "Mrs. ANNA-MARIA Smith", "at 1700000000123 ms", "4111111111111111", "I miss Paris", "dr. Smith"]
    out = [r["text"] for r in P.pseudonymised(docs(list(enumerate(rows))), KEY).orderBy("doc_id").collect()]
    john = out[1].split()
    assert out[0] == f"MR. {john[1].upper()} {john[2].upper()}" and john[0] == "Mr." and "DOE" not in out[0]
    assert regex.fullmatch(r"Mr\. \p{Lu}\p{Greek}+", out[2]) and out[2] != rows[2]
    assert out[3] == "Mr. " + out[4][4:].upper() and out[4][4:].istitle() and out[13] == "dr. " + out[4][4:]
    assert regex.fullmatch(r"Herr \p{Lu}\p{Ll}+-\p{Lu}\p{Ll}+", out[5]) and regex.fullmatch(r"Mr \p{Lu}’\p{Lu}\p{Ll}+", out[6]) and out[7] == out[6].replace("’", "'")
    assert regex.fullmatch(r"Mr \p{Armenian}+", out[8]) and out[8] != rows[8]
    assert out[9].split()[1].isupper() and out[9].split()[2] == out[4][4:]
    assert out[10] == rows[10] and out[12] == rows[12] and out[11] != rows[11] and P_luhn(out[11])


def P_luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def canonical(m):
    """What a mention names, by plain rules: kind and form."""
    digits = regex.sub(r"\D", "", m)
    if "@" in m:
        return "email", regex.sub(r"^[._+-]+", "", m.lower())
    if m[0].isalpha():
        return "name", regex.search(r"[^ .]+$", m)[0].lower().replace("’", "'")
    if regex.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        return "ip", m
    if regex.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        return "ssn", digits
    if m[0] not in "+(" and len(digits) >= 13:
        return ("card", digits) if P_luhn(digits) or not m.isdigit() else (None, m)
    return "phone", digits[-10:] if regex.fullmatch(P.NATIONAL, m) else digits


def test_whole_query_against_plain_python(docs, spark):
    """Every text outside of mentions stays, every mention keeps its form, and mentions agree just where their entities do."""
    r = random.Random(6)
    given, last = ["Anna", "JOHN", "J.", "Zoë", "Ján", "Νίκος"], ["Smith", "SMITH", "O’Brien", "O'Brien", "Müller-Lüdenscheidt", "Иванова", "Παπαδόπουλος", "McDonald", "Ng"]
    kinds = [
        lambda: f"{r.choice(['Mr', 'Mrs.', 'MR.', 'Dr', 'dr.', 'FRAU', 'Госпожа'])} {r.choice(['', r.choice(given) + ' '])}{r.choice(last)}",
        lambda: f"{r.choice('abc')}{r.randrange(9)}@x{r.randrange(3)}.Org",
        lambda: f"10.0.{r.randrange(5)}.{r.randrange(5)}",
        lambda: f"{r.choice(['+1 ', '', '+44-'])}{r.choice(['(555) 123-', '555-123-'])}{r.randrange(1000, 1020)}",
        lambda: r.choice(["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "1700000000123", "123456789012345678901"]),
        lambda: f"{r.randrange(100, 105)}-45-6789",
        lambda: r.choice(["version 4.0", "\n\n", "12 apples", "émigré", "﷐", "x" * 300, "I miss Paris", ""]),
    ]
    rows = [(r.choice([None, 1, 2, i]), "; ".join(r.choice(kinds)() for _ in range(r.randrange(8)))) for i in range(400)] + [(7, None), (None, None)]
    d = docs(rows)
    pairs = P.pseudonymised(d.withColumn("was", F.col("text")), KEY).select("doc_id", "was", "text").collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["was"] or "") for x in pairs) == sorted((i is None, i or 0, t or "") for i, t in rows)
    new, old = {}, {}
    for x in pairs:
        if x["was"] is None:
            assert x["text"] is None
            continue
        mentions = [m for m in regex.finditer(P.PATTERN, x["was"])]
        kept, at = [], 0
        for m in mentions:
            kept.append(x["was"][at : m.start()])
            at = m.end()
        kept.append(x["was"][at:])
        got = regex.fullmatch("(.+?)".join(map(regex.escape, kept)), x["text"], flags=regex.DOTALL)
        assert got, (x["was"], x["text"])
        for m, g in zip(mentions, got.groups()):
            kind, form = canonical(m[0])
            if kind is None:
                assert g == m[0]
                continue
            if kind in ("ssn", "phone", "card"):
                assert regex.sub(r"\d", "0", g) == regex.sub(r"\d", "0", m[0]) and g != m[0]
            if kind == "card" and P_luhn(form):
                assert P_luhn(regex.sub(r"\D", "", g))
            if kind == "name":
                a, b = m[0].split()[-1], g.split()[-1]
                assert a.isupper() == b.isupper() and regex.sub(r"\p{L}", "", a) == regex.sub(r"\p{L}", "", b) and m[0].split()[0] == g.split()[0]
                assert [bool(regex.search(rf"\p{{{s}}}", a)) for s in ("Latin", "Cyrillic", "Greek")] == [bool(regex.search(rf"\p{{{s}}}", b)) for s in ("Latin", "Cyrillic", "Greek")]
            drawn = canonical(g)[1]
            assert new.setdefault((kind, form), drawn) == drawn and old.setdefault((kind, drawn), form) == form, (m[0], g)
    assert not {(k, f) for k, f in new} & {(k, f) for k, f in old} and len(new) > 60


def test_a_session_draws_its_own_key(spark):
    key = P.key_of(spark)
    assert len(key) >= 32 and P.key_of(spark) == key
