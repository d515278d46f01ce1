import random

import pytest

from attestra.operators import daily as D
from attestra.operators.asof import asof
from attestra.sources.ledger import Ledger

DOCS = "doc_id long, doc_type string, current_validity string, overruled_by long, overruled_date string, replaced_by string, stale boolean, stale_reason string, reembed boolean"
SECTIONS = "doc_id long, section string, text string, original_text string, in_force boolean, cases array<long>"
STATUTES = "position long, doc_id long, valid boolean, replaced_by string"
CHANGES = "position long, doc_id long, section string, text string, in_force boolean, label string"
JUDGMENTS = "position long, doc_id long, validity string, authority long, authority_date string, note string"


def by_hand(docs, sections, edges, statutes, changes, judgments):
    """One update after the other."""
    d = {x[0]: dict(zip([c.split()[0] for c in DOCS.split(", ")], x)) for x in docs}
    s = {(x[0], x[1]): dict(zip([c.split()[0] for c in SECTIONS.split(", ")], x)) for x in sections}

    def stale(i, reason, anew):
        if i in d:
            d[i]["stale"], d[i]["stale_reason"], d[i]["reembed"] = True, reason, d[i]["reembed"] or anew

    for _, doc, valid, replaced in statutes:
        d[doc]["replaced_by"] = replaced
        amended = False
        if not valid:
            d[doc]["current_validity"] = "REPEALED"
            stale(doc, f"Statute repealed. Replacement: {replaced or 'not specified'}", False)
        for _, _, section, text, force, label in (c for c in changes if c[1] == doc):
            x = s[doc, section]
            changed = False
            if text is not None and text != x["text"]:
                x["original_text"] = x["text"] if x["original_text"] is None else x["original_text"]
                x["text"], changed = text, True
            if force is not None and force != x["in_force"]:
                x["in_force"], changed = force, True
            if changed or label:
                amended = True
                stale(doc, f"Section {section} amended.", True)
                for c in x["cases"]:
                    stale(c, f"Interpreted statute text changed for section {section}.", True)
        if valid and amended:
            d[doc]["current_validity"] = "AMENDED"
        elif valid and d[doc]["current_validity"] == "REPEALED":
            d[doc]["current_validity"] = "GOOD_LAW"
    for _, doc, validity, authority, day, note in judgments:
        d[doc].update(current_validity=validity, overruled_by=authority, overruled_date=day)
        stale(doc, note or f"Judgment validity updated to {validity}.", False)
        for a, b in edges:
            if b == doc:
                stale(a, f"Cites judgment {doc} whose validity changed to {validity}.", False)
    return d, s


def made(seed=4):
    r = random.Random(seed)
    docs = [(i, "statute" if i % 3 == 0 else "judgment", r.choice(["GOOD_LAW", "REPEALED" if i % 3 == 0 else "GOOD_LAW"]), None, None, None, False, None, False) for i in range(40)]
    sections = [(i, str(k), f"text {i} {k}", None, r.random() < 0.8, r.sample([x for x in range(40) if x % 3], 2) + [999]) for i in range(0, 40, 3) for k in range(3)]
    edges = [(a, b) for a in range(40) for b in r.sample(range(40), 2) if a != b]
    statutes = [(p, i, r.random() < 0.6, r.choice([None, "Act B"])) for p, i in enumerate(r.sample(range(0, 40, 3), 9))]
    changes = []
    for _, i, _, _ in statutes:
        for k in r.sample(range(3), r.randint(0, 3)):
            changes.append((len(changes), i, str(k), r.choice([None, f"text {i} {k}", "new"]), r.choice([None, True, False]), r.choice([None, None, "2024"])))
    judgments = [(p, i, r.choice(["OVERRULED", "DISTINGUISHED"]), r.choice([7, None]), "2024-01-01", r.choice([None, "noted"])) for p, i in enumerate(r.sample([x for x in range(40) if x % 3], 6))]
    return docs, sections, edges, statutes, changes, judgments


def frames(spark, rows):
    docs, sections, edges, statutes, changes, judgments = rows
    f = spark.createDataFrame
    return {"documents": f(docs, DOCS), "sections": f(sections, SECTIONS), "edges": f(edges, "source long, target long")}, (f(statutes, STATUTES), f(changes, CHANGES), f(judgments, JUDGMENTS))


def state(tables):
    return {r["doc_id"]: r.asDict() for r in tables["documents"].collect()}, {(r["doc_id"], r["section"]): r.asDict() for r in tables["sections"].collect()}


def test_a_day_equals_one_update_after_the_other(spark):
    for seed in (4, 5):
        rows = made(seed)
        tables, updates = frames(spark, rows)
        assert state(D.applied(tables, *updates)) == by_hand(*rows)


def test_runs_take_effect_once_or_not_at_all(spark, tmp_path, monkeypatch):
    rows = made()
    tables, updates = frames(spark, rows)
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.manifest() == {} and ledger.run("load", lambda _: tables)["documents"] == 40
    before = state(ledger.tables())
    # killed between the data and the line that makes it count
    line = Ledger._line

    def dies(self, batch_id, status, *a, **k):
        if status == "succeeded":
            raise KeyboardInterrupt
        line(self, batch_id, status, *a, **k)

    monkeypatch.setattr(Ledger, "_line", dies)
    with pytest.raises(KeyboardInterrupt):
        D.run(ledger, "day 1", *updates)
    monkeypatch.undo()
    assert state(Ledger(spark, str(tmp_path)).tables()) == before
    # run again, then replayed
    counts = D.run(ledger, "day 1", *updates)
    after = state(ledger.tables())
    assert after == by_hand(*rows)
    assert D.run(Ledger(spark, str(tmp_path)), "day 1", *updates) == counts and state(ledger.tables()) == after
    assert ledger.runs().where("status = 'succeeded'").count() == 2


def test_what_nobody_knows_fails_the_run(spark, tmp_path):
    rows = made()
    tables, (statutes, changes, judgments) = frames(spark, rows)
    ledger = Ledger(spark, str(tmp_path))
    ledger.run("load", lambda _: tables)
    before = state(ledger.tables())
    first = rows[3][0][1]
    odd = [
        (statutes.unionByName(spark.createDataFrame([(99, 1, True, None)], STATUTES)), changes, judgments, "Unknown statute document: 1"),
        (statutes, changes.unionByName(spark.createDataFrame([(99, first, "77", "x", None, None)], CHANGES)), judgments, f"Unknown section 77 for statute {first}"),
        (statutes, changes, judgments.unionByName(spark.createDataFrame([(99, 500, "OVERRULED", 1, None, None)], JUDGMENTS)), "Unknown judgment document: 500"),
    ]
    for n, (a, b, c, said) in enumerate(odd):
        with pytest.raises(ValueError, match=said):
            D.run(ledger, f"bad {n}", a, b, c)
        assert ledger.runs().where(f"batch_id = 'bad {n}' and status = 'failed' and error = '{said}'").count() == 1
    assert state(ledger.tables()) == before


def test_versions_as_of_days(spark):
    r = random.Random(7)
    versions = [(r.choice("abc"), r.choice([None, 1, 2]), r.randrange(20), f"v{i}") for i in range(40)]
    asked = [(i, r.choice("abcd"), r.choice([None, 1, 2]), r.choice([None, *range(-2, 24)])) for i in range(200)]
    v = spark.createDataFrame(versions, "act string, section int, since int, text string")
    a = spark.createDataFrame(asked, "i int, act string, section int, day int")
    want = {}
    for i, act, section, day in asked:
        fit = [(s, t) for x, y, s, t in versions if (x, y) == (act, section) and day is not None and s <= day]
        want[i] = max(fit) if fit else (None, None)
    assert {x["i"]: (x["since"], x["text"]) for x in asof(a, v, ["act", "section"]).collect()} == want
