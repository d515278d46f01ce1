import random
import re

from pyspark.sql import functions as F

from attestra.operators import research as R
from attestra.operators import similarity as S


def test_sharing_misses_no_pair(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["the", "of"]
    sets = lambda n: [(i, sorted({*r.choices(words, weights=[1] * 12 + [9, 9], k=r.randint(0, 8))})) for i in range(n)]
    qs, cs = sets(60), sets(80)
    q = spark.createDataFrame(qs, "q int, asked array<string>")
    c = spark.createDataFrame(cs, "c int, own array<string>")
    q = q.join(S.rarest_first(q, S.frequencies(c), "q"), "q")
    for least in (0.1, 0.5, 0.85, 1.0):
        got = {tuple(x) for x in S.sharing(q, c, "q", "c", F.lit(least)).collect()}
        want = {(i, j) for i, a in qs for j, b in cs if a and len(set(a) & set(b)) / len(a) >= least - 1e-12 and set(a) & set(b)}
        assert want <= got
    # pairs that are met by a common word alone are left out where some of the words are needed
    assert len(got) < sum(bool(set(a) & set(b)) for _, a in qs for _, b in cs) / 3


def test_contained_texts(spark):
    texts = ["the indian penal code 1860", "a", "", "xipcx", "code of criminal procedure and more", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    parts = ["ipc", "indian penal code", "a", "code of criminal procedure", "e", "aaaaaaaaaaaaaaaaa", "", "zz"]
    t = spark.createDataFrame([(x,) for x in texts] + [(None,)], "t string")
    p = spark.createDataFrame([(x,) for x in parts] + [(None,)], "p string")
    assert {tuple(x) for x in S.containing(t, p, "t", "p").collect()} == {(x, y) for x in texts for y in parts if y and y in x}


def tokens(*parts):
    return set(re.findall("[a-z0-9]+", " ".join(p for p in parts if p).lower()))


def best_laws(refs, finding, laws):
    out = []
    for ref in refs:
        parts = ref.upper().split()
        if len(parts) < 2:
            continue
        names, asked, best = R.CODE_NAMES.get(parts[0], [parts[0].lower()]), tokens(ref, finding), (0, None)
        for chunk, doc, act, section, header, text in laws:
            score = (0.8 if (section or "").upper() == parts[-1] else 0) + (0.75 if any(n in (act or "").lower() for n in names) else 0)
            own = tokens(act, section, header, text[:240])
            score = round(score + min(len(asked & own) / len(asked) if own else 0, 0.4), 9)
            if score > best[0]:
                best = (score, (doc, chunk))
        if best[0] >= 1.0 and best[1] not in out:
            out.append(best[1])
    return out[:2]


def best_cases(query, finding, stage, court, judgments):
    asked = tokens(query, finding, stage, court) | set(R.STAGE_WORDS.get((stage or "").lower(), []))
    scored = []
    for chunk, doc, citation, appellant, respondent, jcourt, header, text, binding in judgments:
        label = f"{appellant} v {respondent}" if appellant and respondent else citation or str(doc)
        own = tokens(citation, label, header, text[:320], jcourt)
        score = len(asked & own) / len(asked) + (0.35 if stage == "bail" and own & set(R.STAGE_WORDS["bail"]) else 0)
        score += 0.3 if (jcourt or "").lower().startswith("supreme court") else 0.2 if court and court in binding else 0.1 if "All India" in binding else 0
        if round(score, 9) >= 0.2:
            scored.append((-round(score, 9), chunk, doc))
    return [(d, c) for _, c, d in sorted(scored)[:2]]


def test_claims_are_grounded_as_by_looking_at_everything(spark):
    r = random.Random(12)
    w = ["bail", "custody", "murder", "theft", "section", "court", "evidence", "lease", "charge", "a", "302", "liberty", "appeal"]
    text = lambda n: " ".join(r.choices(w, k=n))
    laws = [(i, i // 2, r.choice(["Indian Penal Code, 1860", "Code of Criminal Procedure", "Lease Act", None, "Constitution of India"]), r.choice(["302", "34A", "21", None]), r.choice([None, text(2)]), text(r.randint(1, 12))) for i in range(60)]
    courts = ["Supreme Court of India", "Delhi High Court", "Bombay High Court", None]
    judgments = []
    for i in range(90):
        c = r.choice(courts)
        judgments.append((1000 + i, 500 + i // 2, r.choice([None, f"AIR {i}"]), r.choice([None, "A"]), r.choice(["State", None]), c, r.choice([None, text(1)]), text(r.randint(1, 10)), r.choice([["All India"], [c or "x"], [c or "x", "All India"], []])))
    answers = []
    for i in range(40):
        refs = [r.choice(["IPC 302", "LEASE 34a", "Specific Relief Act 21", "CrPC 34A", "alone", "Article 21", "XYZ 302"]) for _ in range(r.randint(0, 3))]
        finds = lambda: [text(r.randint(1, 5)) for _ in range(r.randint(0, 2))]
        answers.append((i, text(2), r.choice(["bail", "appeal", "trial", None, "other"]), r.choice(["Delhi High Court", "Bombay High Court", "", None]), refs, finds(), finds(), finds(), r.choice(["Legal Position: For  A. Statutory Findings: x", "plain", ""]), r.choice([0.96, 0.8, 0.1]), r.choice([0, 2])))
    a = spark.createDataFrame(answers, "case_id int, query string, stage string, court string, references array<string>, statutory array<string>, precedent array<string>, contradictions array<string>, synthesis string, ratio double, issues int")
    lw = spark.createDataFrame(laws, "chunk_id int, doc_id int, act string, section string, header string, chunk_text string")
    jd = spark.createDataFrame(judgments, "chunk_id int, doc_id int, citation string, appellant string, respondent string, court string, header string, chunk_text string, binding array<string>")
    got = {}
    for x in R.grounded_claims(a, lw, jd).collect():
        got.setdefault(x["case_id"], {})[x["section"], x["position"]] = (x["text"], x["status"], [(y["doc_id"], y["chunk_id"]) for y in x["authorities"]], x["citation"] is not None)
    for i, query, stage, court, refs, law, case, against, synthesis, ratio, issues in answers:
        want, firsts = {}, []
        for n, f in enumerate(law, 1):
            found = best_laws(refs, f, laws)
            want["APPLICABLE_LAW", n] = (f, "VERIFIED" if found else "UNVERIFIED", found, bool(found))
            firsts += found[:1]
        for n, f in enumerate(case, 1):
            found = best_cases(query, f, stage, court, judgments)
            want["KEY_CASES", n] = (f, "VERIFIED" if found else "UNCERTAIN" if stage == "bail" else "UNVERIFIED", found, bool(found))
            firsts += found[:1]
        for n, f in enumerate(against, 1):
            want["LEGAL_POSITION", n] = (f, "UNCERTAIN", [], False)
        firsts = list(dict.fromkeys(firsts))[:2]
        if synthesis:
            status = "VERIFIED" if ratio >= 0.95 and issues == 0 else "UNCERTAIN" if ratio >= 0.75 else "UNVERIFIED"
            status = ("UNCERTAIN" if status == "UNVERIFIED" else status) if firsts else "UNVERIFIED" if status == "VERIFIED" else status
            want["LEGAL_POSITION", 0] = ("For A." if synthesis.startswith("Legal") else synthesis, status, firsts, bool(firsts))
        assert got.get(i, {}) == want


def test_alike_candidates_are_one(spark):
    q = spark.createDataFrame([(1, ["bail", "theft"]), (2, ["lease"])], "query int, asked array<string>")
    rows = [(i, ["bail", f"w{i}"] if i % 2 else ["lease", "theft", f"w{i}"], "a" if i < 50 else "b") for i in range(100)] + [(100, [], "a"), (101, [f"x{n}" for n in range(300)], None), (102, None, None)]
    c = spark.createDataFrame(rows, "c int, own array<string>, kind string")
    got = sorted((r.c, r.own, r.kind) for r in S.alike(c, q, "c", ("kind",), 2).collect())
    one, two = ["bail"], ["lease", "theft"]
    assert got == [(0, two, "a"), (1, one, "a"), (2, two, "a"), (3, one, "a"), (50, two, "b"), (51, one, "b"), (52, two, "b"), (53, one, "b"), (100, [], "a"), (101, [], None), (102, [], None)]


def test_precedents_meet_one_of_many_alike(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "sharing", lambda q, c, *a, **k: seen.append(c.select("chunk_id").distinct().count()) or S.sharing(q, c, *a, **k))
    judgments = [(1000 + i, 500 + i, f"AIR {i}", "A", "State", "Delhi High Court", None, "bail was granted" if i % 2 else "a lease", ["Delhi High Court"]) for i in range(200)]
    j = spark.createDataFrame(judgments, "chunk_id long, doc_id long, citation string, appellant string, respondent string, court string, header string, chunk_text string, binding array<string>")
    c = spark.createDataFrame([(1, ["x"], None, "custody", "bail", "bail", "Delhi High Court")], "case_id int, references array<string>, statutory string, precedent string, query string, stage string, court string")
    assert [(r.rank, r.chunk_id) for r in R.precedent_authorities(c, j).orderBy("rank").collect()] == [(1, 1001), (2, 1003)]
    assert seen and max(seen) <= 4


def test_statutes_meet_one_of_many_alike(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "sharing", lambda q, c, *a, **k: seen.append(c.count()) or S.sharing(q, c, *a, **k))
    laws = spark.createDataFrame([(i, i // 2, "Indian Penal Code, 1860", str(i % 3), None, f"text {i}") for i in range(300)], "chunk_id long, doc_id long, act string, section string, header string, chunk_text string")
    c = spark.createDataFrame([(1, ["IPC 2", "IPC 9"], "theft of penal code"), (2, ["IPC 1"], None)], "case_id int, references array<string>, statutory string")
    assert sorted((r.case_id, r.rank, r.chunk_id) for r in R.statute_authorities(c, laws).collect()) == [(1, 1, 2), (1, 2, 9), (2, 1, 1)]
    assert seen and max(seen) <= 20
