from pyspark.sql import functions as F

from attestra.llm import urlfilter as U


def test_rules_longest_wins(spark):
    urls = ["https://x.example.org/es/1", "http://example.org/en/12", "http://EXAMPLE.org/en/2?u=/en/1", "http://a.com/fr/x", "ftp://a.com/de/#f", "http://badexample.org/es/", "no scheme", None, "http://org", "http://b.net/"]
    p = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int").drop("rule")
    got = {r["page_id"]: r for r in U.judged(p, U.RULES).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", "org/", None, None, None, None]
    assert (got[2]["host"], got[2]["path"]) == ("example.org", "/en/2") and (got[7]["host"], got[7]["path"]) == ("", "") and got[8]["path"] == ""


def test_trees_learn_held_out():
    urls = [f"https://site{i}.example.com/{'casino-win-8' if i % 2 else 'news'}/{i}?{'a=1&b=2&c=3' if i % 2 else ''}" for i in range(400)]
    y = [i % 2 for i in range(400)]
    m = U.fit(urls[:300], y[:300])
    assert ((m.score(urls[300:]) >= 0.5) == [v == 1 for v in y[300:]]).mean() > 0.95
    assert U.fit([], []).score(["x", None]).max() < 0.5 and U.fit(["a"], [1]).score(["b"])[0] > 0.5


def test_empty(spark):
    p = spark.createDataFrame([], "page_id long, url string")
    assert U.score(U.judged(p, U.RULES), U.fit([], [])).count() == 0
    assert U.train(p.select("url", F.lit(1).alias("blocked"))).trees == []


def plain(url):
    """host, path, rule, verdict in plain Python."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    fit = [r for r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fit, key=len, default=None)
    return host, path, best, rules.get(best)


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = U.op2_urlfilter(spark, sf).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] >= 0.5 else "allow"))


def test_held_out_rules(spark):
    """Trained on four fifths of the URLs that rules decide, scored on the rest."""
    p = U.judged(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), U.RULES).where("ruled is not null")
    rows = [(r["url"], int(r["ruled"] == "block")) for r in p.select("url", "ruled").distinct().orderBy(F.xxhash64("url")).collect()]
    train, test = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    scores = U.fit(*map(list, zip(*train))).score([u for u, _ in test])
    right = sum((s >= 0.5) == bool(y) for s, (_, y) in zip(scores, test)) / len(test)
    pairs = [(a > b) + (a == b) / 2 for a, (_, y) in zip(scores, test) if y for b, (_, z) in zip(scores, test) if not z]
    area = sum(pairs) / len(pairs)
    print("held-out accuracy", right, "area under the curve", area)
    # rules part pages by a path's first word, of which lexical features see little: measured 0.68 and 0.80 (largest class 0.79) when this test was written
    assert area > 0.6 and right > 0.75


def test_clashing_columns_ties_and_long_urls(spark):
    rows = [(1, "http://a.org/x", 0.5), (1, "http://a.org/x", 0.5), (None, None, 0.1), (2, "http://b.com/" + "y" * 100_000, 0.2)]
    p = spark.createDataFrame(rows, "page_id long, url string, block_score double")
    got = U.score(p, U.fit(["http://a.org/x"] * 30 + ["http://b.com/z"] * 30, [1] * 30 + [0] * 30))
    assert got.columns == ["page_id", "url", "block_score", "block_score_"]
    scores = [(r["url"], r["block_score_"]) for r in got.collect()]
    assert len(scores) == 4 and len({s for u, s in scores if u == "http://a.org/x"}) == 1 and all(0 <= s <= 1 for _, s in scores)
