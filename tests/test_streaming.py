"""Streams against what the batch operators give for the same rows."""

import datetime
import random

from pyspark.sql import functions as F

from attestra.streaming import build as B
from attestra.streaming import events as E


def run_stream(spark, tmp_path, batches):
    """The rows that come out of batches of events, and how many rows of state are left."""
    source, seen, kept = str(tmp_path / "in"), [], []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
        q = E.each_batch(E.reduced_stream(stream, "1 minute", 5, first=0), lambda x, _: seen.extend(x.collect()), str(tmp_path / "check"), "update")
        q.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return seen, kept[-1]


def test_shuffled_batches_give_the_batch_result_and_state_ends(spark, tmp_path):
    r = random.Random(5)
    kinds = ["STEP_START", "TOKEN", "STEP_COMPLETE", "TOKEN", "STEP_ERROR", "TOKEN", "COMPLETE"]
    # some queries never complete, one has a gap that is never filled
    all_ = [(f"q{q}", i, k, f"s{i % 2}", "", "bad" if k == "STEP_ERROR" else None, f"t{i}", 0.5) for q in range(8) for i, k in enumerate(kinds if q % 3 else kinds[:5])]
    all_ = [x for x in all_ if not (x[0] == "q3" and x[1] == 2)]
    rows = [(*x, datetime.datetime(2024, 7, 1, 0, 0, x[1])) for x in all_]
    whole = spark.createDataFrame([x[:-1] for x in rows], E.EVENT)
    r.shuffle(rows)
    schema = E.EVENT + ", ts timestamp"
    parts = [spark.createDataFrame(rows[i::4], schema) for i in range(4)]
    # the same events once more, then later ones by which the watermark passes all timers
    later = [spark.createDataFrame([("end", 0, "COMPLETE", None, None, None, None, 1.0, datetime.datetime(2024, 7, 1, h))], schema) for h in (1, 2, 3)]
    seen, kept = run_stream(spark, tmp_path, [*parts, parts[0], *later])
    last = {x["query_id"]: x.asDict() for x in seen if x["query_id"] != "end"}
    assert last == {x["query_id"]: x.asDict() for x in E.reduced(whole).collect()}
    assert kept <= 2  # what is left is of the last row alone


def test_each_batch_runs_once_for_new_rows(spark, tmp_path):
    source, counts = str(tmp_path / "in"), []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("a long").parquet(source)
    for n in (3, 4):
        spark.range(n).toDF("a").coalesce(1).write.mode("append").parquet(source)
        E.each_batch(stream, lambda b, i: counts.append((i, b.count())), str(tmp_path / "check")).awaitTermination()
    assert counts == [(0, 3), (1, 4)]


def test_daily_quota_in_batch_and_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-07-01 01:00:00"), (1, "2024-07-01 23:00:00"), (2, "2024-07-02 00:00:00"), (1, "2024-07-05 00:00:00")], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    want = [(1, "2024-07-01", 2), (1, "2024-07-05", 1), (2, "2024-07-02", 1)]
    batch = sorted((r["user_id"], str(r["day"]), r["used"]) for r in E.daily_quota(e).collect())
    assert batch == want
    e.write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    E.daily_quota(stream, "1 day").writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: out.extend(b.collect())).start().awaitTermination()
    assert sorted((r["user_id"], str(r["day"]), r["used"]) for r in out) == want


def test_accepted_queries_have_one_id_each(spark):
    r = spark.createDataFrame([("u", "q", None, "2024-07-01"), ("u", "q", None, "2024-07-01"), (None, "q", "w", "2024-07-01")], "user_id string, query string, workspace_id string, asked_at string")
    got = B.accepted(r).collect()
    assert len({x["query_id"] for x in got}) == 2 and {x["status"] for x in got} == {"accepted"}


def test_failures_end_without_confidence(spark):
    got = B.failed_events(spark.createDataFrame([("q", "Verified query execution", "down", "query_error")], "query_id string, step string, error string, mode string")).orderBy("sequence").collect()
    assert [(x["sequence"], x["type"], x["error"], x["confidence"]) for x in got] == [(1, "STEP_ERROR", "down", None), (2, "COMPLETE", None, 0.0)]
