import datetime
import hashlib
import random

import duckdb
import pytest

from attestra.llm import sessions as S

EPOCH = datetime.datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, us long, bucket string"
COLUMNS = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256"]


def brute(rows):
    """rows: (click_id, us, arrived us, client, kind, value)."""
    seen, out = {}, []
    least = lambda r: [(v is not None, v) for v in (r[3], r[1], r[2], r[4], r[5])]
    for r in rows:
        if r[3] is not None and r[1] is not None:
            seen[r[0]] = min(seen.get(r[0], r), r, key=least)
    for client in sorted({r[3] for r in seen.values()}):
        own = [r for r in seen.values() if r[3] == client]
        late = [r for r in own if r[2] is not None and r[2] - r[1] > 15 * 60 * 10**6]
        timely = sorted((r for r in own if r not in late), key=lambda r: (r[1], r[0]))
        final = lambda r: r[5] is not None and r[5] >= 60 and r[4] in ("purchase", "signup")
        found, reasons = [], []
        for r in timely:
            if not found:
                found.append([r])
                continue
            last, first = found[-1][-1], found[-1][0]
            why = "end" if final(last) else "gap" if r[1] - last[1] >= 15 * 60 * 10**6 else "length" if r[1] - first[1] > 60 * 60 * 10**6 else None
            if why:
                reasons.append(why)
                found.append([r])
            else:
                found[-1].append(r)
        if found:
            reasons.append("end" if final(found[-1][-1]) else "none")
        for i, (s, why) in enumerate(zip(found, reasons)):
            until = found[i + 1][0][1] if i + 1 < len(found) else float("inf")
            n_late = sum(s[0][1] <= r[1] < until for r in late)
            cents = sum(int((100 * (r[5] or 0) + 0.5) // 1) for r in s)
            out.append((client, s[0][0], s[0][1], s[-1][1], len(s), n_late, cents, why, hashlib.sha256(",".join(str(r[0]) for r in s).encode()).hexdigest()))
    return sorted(out)


def frame(spark, rows):
    at = lambda us: None if us is None else EPOCH + datetime.timedelta(microseconds=us)
    return spark.createDataFrame([(i, at(us), at(arrived), c, k, v, "{}", 1, "x") for i, us, arrived, c, k, v in rows], SCHEMA)


def made(seed, n, clients, mean_s, final_share):
    r = random.Random(seed)
    rows, i = [], 0
    for c in clients:
        us = 1_704_000_000_000_000 + r.randrange(10**10)
        for _ in range(n):
            us += r.choice([0, 0, 1, 15 * S.MINUTE - 1, 15 * S.MINUTE]) if r.random() < 0.1 else int(r.expovariate(1 / (mean_s * 10**6)))
            i += r.choice([1, 3])
            kind = "purchase" if r.random() < final_share else r.choice(["view", "click", None])
            arrived = us + (r.choice([15 * S.MINUTE, 15 * S.MINUTE + 1, 40 * S.MINUTE]) if r.random() < 0.15 else 10**6)
            rows.append((10**6 - i if r.random() < 0.5 else i + 10**7, us, None if r.random() < 0.02 else arrived, c, kind, r.choice([None, 59.99, 60.0, 61.005, -3.335])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket_minutes", [20, 120, 360])
def test_sessions_equal_brute_force(spark, bucket_minutes):
    """Sparse clients, dense ones, ones without a final click whose pieces cover many buckets."""
    rows = made(1, 60, [1, 2, 3], 400, 0.1) + made(2, 300, [7], 90, 0.0) + made(3, 200, [-5], 30, 0.02) + made(4, 3, [8, 9], 5000, 0.5)
    rows += [(r[0], None, r[2], r[3], r[4], r[5]) for r in rows[:3]] + [(5 * 10**8, 10**9, None, None, "view", 1.0)] + rows[10:30]
    rows += [(4 * 10**8, -5 * S.MINUTE, None, 20, "signup", 100.0), (4 * 10**8 + 1, 3 * S.MINUTE, 4 * S.MINUTE, 20, None, None)]
    # a client with late clicks alone, and one whose first is late
    rows += [(6 * 10**8, 10**9, 10**13, 30, "view", 1.0), (6 * 10**8 + 1, 10**9, 10**13, 31, "view", 1.0), (6 * 10**8 + 2, 2 * 10**9, None, 31, "view", 1.0), (6 * 10**8 + 3, 10**12, 10**13, 31, "view", 1.0)]
    got = S.sessionised(frame(spark, rows), bucket=bucket_minutes * S.MINUTE)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_odd_values_and_zone(spark):
    rows = [(1, 0, 0, 1, "purchase", float("nan")), (2, 1, 1, 1, "purchase", float("inf")), (None, 2, 2, 1, "view", 1.0), (None, 2, 2, 1, "view", 1.0)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [tuple(r) for r in S.sessionised(frame(spark, rows)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(1, 1, 0, 2, 3, 0, 100, "none", hashlib.sha256(b"1,2,").hexdigest())]


def test_empty(spark):
    assert S.sessionised(frame(spark, [])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    got = sorted(tuple(r) for r in S.op12_sessions(spark, f"/root/testdata/{sf}").collect())
    con = duckdb.connect()
    con.sql(f"create view clicks as select * from '/root/testdata/{sf}/clicks.parquet'")
    assert got == sorted(con.sql(f"select {', '.join(COLUMNS)} from ({S.ORACLE})").fetchall())


def test_given_clicks_equal_brute_force(spark):
    path = "/root/testdata/sf0.001/clicks.parquet"
    con = duckdb.connect()
    rows = con.sql(f"select click_id, epoch_us(ts), epoch_us(arrived_at), client_id, kind, value from '{path}'").fetchall()
    assert sorted(tuple(r) for r in S.sessionised(spark.read.parquet(path)).collect()) == brute(rows)
