"""Sessions of clicks by gap, final click and length.

Time is cut into buckets. session_window merges a client's timely clicks of a bucket into islands without a gap; an island is split after
its final clicks by running sums, and each piece is cut greedily where it gets too long. No group is larger than a client's clicks of one bucket, so a client
with a third of all rows is dealt out by time.

Pieces that may go on beyond their bucket are put aside as fragments. A fragment joins that of the bucket before where the gap is small and the
last click isn't final; then only the start of the session that is open goes from one to the next. A round settles all
fragments whose predecessor is settled, so there are as many rounds as the longest run of buckets that one piece covers, whatever the number of clicks. The parts of a session that crosses buckets are
put together by grouping.

Late clicks join sessions by range: they go to the bucket of the session that is open at their time, and a merge by time inside this bucket counts them. What has to be known
across buckets is one row for each client and bucket.

Cases: clicks without client or time are left out; of rows with one click_id the smallest by client, time, arrival, kind and value is taken (null ids are one id, first in order, written as empty text);
clicks without arrival are timely; values that are null, infinite or not a number count 0 and close nothing; clicks of one time go by click_id; late clicks before a client's first session
count nowhere; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tune, written

MINUTE = 60_000_000
GAP = 15 * MINUTE
LENGTH = 60 * MINUTE
LATE = 15 * MINUTE
#: A time's share of a client's clicks that one task holds together.
BUCKET = 6 * 60 * MINUTE
FINAL_KINDS = ("purchase", "signup")
FINAL_VALUE = 60


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 as the clock reads, whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(name)
    since = F.col(name) - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since).cast("long")
    return ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * MINUTE + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")


def unique(clicks: DataFrame) -> DataFrame:
    """client_id, ts, late, click (us, click_id, final, cents), each click_id once."""
    named = clicks.select("click_id", "client_id", "ts", "arrived_at", "kind", "value").where("client_id is not null and ts is not null")
    whole = F.struct("client_id", "ts", "arrived_at", "kind", "value")
    one = named.groupBy("click_id").agg(F.min(whole).alias("c")).select("click_id", "c.*")
    sound = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    final = F.coalesce((sound >= FINAL_VALUE) & F.col("kind").isin(*FINAL_KINDS), F.lit(False))
    cents = F.coalesce(F.floor(100 * sound + 0.5).cast("long"), F.lit(0).cast("long"))
    late = F.coalesce(F.col("arrived_at") > F.col("ts") + F.expr(f"INTERVAL {LATE // MINUTE} MINUTES"), F.lit(False))
    return one.select("client_id", "ts", late.alias("late"), F.struct(micros(one, "ts").alias("us"), "click_id", final.alias("final"), cents.alias("cents")).alias("click"))


PIECE = "kind string, client_id long, bucket long, head boolean, tail boolean, session_id long, start_us long, end_us long, n long, cents long, final boolean, path string, us array<long>, ids array<long>, each_cents array<long>"
_ARROW = pa.schema(
    [("kind", pa.string()), ("client_id", pa.int64()), ("bucket", pa.int64()), ("head", pa.bool_()), ("tail", pa.bool_()), ("session_id", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64())]
    + [("n", pa.int64()), ("cents", pa.int64()), ("final", pa.bool_()), ("path", pa.string()), ("us", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("each_cents", pa.list_(pa.int64()))]
)


def cuts(us: np.ndarray, length: int, start: int | None = None) -> list[int]:
    """Where sessions start in a piece: each as soon as the one before has lasted longer than length; start: since when one is open already."""
    out = [] if start is not None else [0]
    at = int(np.searchsorted(us, (us[0] if start is None else start) + length, "right"))
    while at < len(us):
        out.append(at)
        at = int(np.searchsorted(us, us[at] + length, "right"))
    return out


def _joined(ids: list) -> str:
    return ",".join("" if i is None else str(i) for i in ids)


def pieces(islands: DataFrame, bucket: int, gap: int, length: int) -> DataFrame:
    """Sessions that end in their bucket, fragments that may not, and late clicks, from islands (client_id, bucket, late, clicks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            client, begin, late = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(3).offsets.to_numpy()))
            flat = b.column(3).flatten()
            us, final, cents = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            ids = flat.field(1)
            unnamed = np.asarray(ids.is_null())
            number = np.where(unnamed, 0, ids.fill_null(0).to_numpy())
            order = np.lexsort((number, ~unnamed, us, row))
            row, us, final, cents, number, unnamed = (x[order] for x in (row, us, final, cents, number, unnamed))
            ids = number.astype(object)
            ids[unnamed] = None
            ids = ids.tolist()
            # running sums of final clicks number the pieces of an island
            before = np.cumsum(final) - final
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (before[1:] != before[:-1])])
            at = np.flatnonzero(first)
            ends = np.append(at[1:], len(us))
            inside = begin[row[at]]
            opens = np.concatenate([[True], row[at[1:]] != row[at[1:] - 1]]) & (us[at] - (inside - 1) < gap)
            closes = np.append(row[at[1:]] != row[at[1:] - 1], True) & ~final[ends - 1] & (inside + bucket - us[ends - 1] < gap)
            running = np.concatenate([[0], np.cumsum(cents)])
            text = list(map(str, ids)) if not unnamed.any() else ["" if i is None else str(i) for i in ids]
            out: list[tuple] = []
            for i, j, head, tail, start in zip(at.tolist(), ends.tolist(), opens.tolist(), closes.tolist(), inside.tolist()):
                c = int(client[row[i]])
                if late[row[i]]:
                    out += [("late", c, start, None, None, None, u, None, None, None, None, None, None, None, None) for u in us[i:j].tolist()]
                elif head or tail:
                    out.append(("fragment", c, start, head, tail, ids[i], int(us[i]), int(us[j - 1]), j - i, None, bool(final[j - 1]), None, us[i:j], ids[i:j], cents[i:j]))
                else:
                    starts = [i] if us[j - 1] - us[i] <= length else [i + k for k in cuts(us[i:j], length)]
                    for s, e in zip(starts, [*starts[1:], j]):
                        digest = hashlib.sha256(",".join(text[s:e]).encode()).hexdigest()
                        out.append(("session", c, start, None, None, ids[s], int(us[s]), int(us[e - 1]), e - s, int(running[e] - running[s]), bool(final[e - 1]), digest, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return islands.mapInArrow(run, PIECE)


PART = "client_id long, session_id long, start_us long, bucket long, end_us long, n long, cents long, final boolean, path string, open boolean"


def settled(fragments: DataFrame, length: int) -> DataFrame:
    """The parts of sessions in fragments, which say what is open before them (open_us null: nothing is); open: the session goes on in the next fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PART.split(", ")]
        types = [pa.bool_() if x.endswith("boolean") else pa.string() if x.endswith("string") else pa.int64() for x in PART.split(", ")]
        for b in batches:
            out: list[tuple] = []
            for k in range(b.num_rows):
                client, bucket, final, goes, open_id, open_us = (b.column(c)[k].as_py() for c in range(6))
                us, cents, ids = b.column(6)[k].values.to_numpy(), b.column(8)[k].values.to_numpy(), b.column(7)[k].as_py()
                starts = cuts(us, length, open_us)
                parts = [(open_id, open_us, 0, starts[0] if starts else len(us))] if open_us is not None else []
                parts += [(ids[s], int(us[s]), s, e) for s, e in zip(starts, [*starts[1:], len(us)])]
                for i, (sid, begin, s, e) in enumerate(parts):
                    if e > s or i == len(parts) - 1:
                        n = e - s
                        out.append((client, sid, begin, bucket, int(us[e - 1]) if n else None, n, int(cents[s:e].sum()), final if e == len(us) and n else False, _joined(ids[s:e]) if n else None, goes and i == len(parts) - 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), types)], names=names)

    return fragments.select("client_id", "bucket", "final", "goes", "open_id", "open_us", "us", "ids", "each_cents").mapInArrow(run, PART)


def crossing(fragments: DataFrame, bucket: int, gap: int, length: int) -> DataFrame:
    """Sessions in fragments: client_id, session_id, start_us, end_us, n, cents, final, path."""
    fragments = written(fragments, "fragments")
    ends = fragments.where("tail").select("client_id", (F.col("bucket") + bucket).alias("bucket"), F.col("end_us").alias("before_us"))
    joins = fragments.where("head").select("client_id", "bucket", "start_us").hint("merge").join(ends, ["client_id", "bucket"]).where(F.col("start_us") - F.col("before_us") < gap)
    joins = joins.select("client_id", "bucket", F.col("start_us").alias("follows"))
    # a bucket can have a head and a tail of their own: only the first of them follows
    linked = fragments.hint("merge").join(joins, ["client_id", "bucket"], "left")
    linked = linked.withColumn("follows", F.col("head") & F.col("follows").isNotNull())
    goes_on = joins.select("client_id", (F.col("bucket") - bucket).alias("bucket"), F.lit(True).alias("goes"))
    linked = written(linked.hint("merge").join(goes_on, ["client_id", "bucket"], "left").withColumn("goes", F.col("tail") & F.col("goes").isNotNull()), "linked")

    nothing = F.lit(None).cast("long")
    new = parts = written(settled(linked.where("not follows").withColumns({"open_id": nothing, "open_us": nothing}), length), "parts")
    while True:
        opened = new.where("open").select("client_id", (F.col("bucket") + bucket).alias("bucket"), F.col("session_id").alias("open_id"), F.col("start_us").alias("open_us"))
        if opened.isEmpty():
            break
        new = written(settled(linked.where("follows").hint("merge").join(opened, ["client_id", "bucket"]), length), "parts")
        parts = parts.unionByName(new)
    ordered = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("bucket", "path"))))
    grouped = parts.groupBy("client_id", "session_id", "start_us").agg(F.max("end_us").alias("end_us"), F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("final").alias("final"), ordered.alias("ordered"))
    return grouped.withColumn("path", F.sha2(F.array_join(F.transform("ordered", lambda x: x.path), ","), 256)).drop("ordered")


def with_lates(sessions: DataFrame, lates: DataFrame, bucket: int, gap: int) -> DataFrame:
    """n_late and closed_by, from sessions (as crossing gives them) and lates (client_id, bucket, us)."""
    own = F.col("start_us") - F.pmod("start_us", F.lit(bucket))
    sessions = sessions.withColumn("bucket", own)
    marks = sessions.groupBy("client_id", "bucket").agg(F.min("start_us").alias("first_us"))
    marks = marks.unionByName(lates.groupBy("client_id", "bucket").agg(F.lit(None).cast("long").alias("first_us"))).groupBy("client_id", "bucket").agg(F.min("first_us").alias("first_us"))
    # a row for each client and bucket: as many as there are buckets in the time that the table covers
    by_time = Window.partitionBy("client_id").orderBy("bucket")
    held = F.when(F.col("first_us").isNotNull(), F.col("bucket"))
    spans = written(
        marks.select(
            "client_id",
            "bucket",
            "first_us",
            F.last(held, ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
            F.first("first_us", ignorenulls=True).over(by_time.rowsBetween(1, Window.unboundedFollowing)).alias("next_us"),
        ),
        "spans",
    )
    at_home = lates.hint("merge").join(spans.select("client_id", "bucket", "first_us", "before"), ["client_id", "bucket"])
    at_home = at_home.withColumn("bucket", F.when(F.col("us") >= F.col("first_us"), F.col("bucket")).otherwise(F.col("before"))).where("bucket is not null")
    rows = sessions.withColumns({"us": F.col("start_us"), "order": F.lit(0), "next_us": F.lit(None).cast("long")})
    rows = rows.unionByName(at_home.select("client_id", "bucket", "us", F.lit(1).alias("order")), allowMissingColumns=True)
    rows = rows.unionByName(spans.where("first_us is not null and next_us is not null").select("client_id", "bucket", F.lit(-1).alias("order"), "next_us"), allowMissingColumns=True)
    together = Window.partitionBy("client_id", "bucket")
    by_us = together.orderBy("us", "order", "session_id")
    is_late = (F.col("order") == 1).cast("long")
    rows = rows.withColumn("so_far", F.sum(is_late).over(by_us.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"all": F.sum(is_late).over(together), "after": F.max("next_us").over(together)})
    rows = rows.where(F.col("order") == 0)
    rows = rows.withColumns({"then": F.coalesce(F.lead("start_us").over(by_us), "after"), "n_late": F.coalesce(F.lead("so_far").over(by_us), "all") - F.col("so_far")})
    closed = F.when(F.col("final"), "end").when(F.col("then").isNull(), "none").when(F.col("then") - F.col("end_us") >= gap, "gap").otherwise("length")
    return rows.withColumn("closed_by", closed)


def sessionised(clicks: DataFrame, gap: int = GAP, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path_sha256."""
    tune(clicks.sparkSession)
    own = F.col("click.us") - F.pmod("click.us", F.lit(bucket))
    # windows that touch are merged, so that of a click ends a microsecond before the gap does
    window = F.session_window("ts", f"{gap - 1} microseconds")
    islands = unique(clicks).groupBy("client_id", own.alias("bucket"), "late", window).agg(F.collect_list("click").alias("clicks"))
    found = written(pieces(islands.select("client_id", "bucket", "late", "clicks"), bucket, gap, length), "pieces")
    columns = ["client_id", "session_id", "start_us", "end_us", "n", "cents", "final", "path"]
    sessions = found.where("kind = 'session'").select(columns).unionByName(crossing(found.where("kind = 'fragment'"), bucket, gap, length).select(columns))
    lates = found.where("kind = 'late'").select("client_id", "bucket", F.col("start_us").alias("us"))
    out = with_lates(written(sessions, "sessions"), lates, bucket, gap)
    return out.select("client_id", "session_id", "start_us", "end_us", F.col("n").alias("n_clicks"), "n_late", F.col("cents").alias("value_cents"), "closed_by", F.col("path").alias("path_sha256"))


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionised(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


_KINDS = ", ".join(f"'{k}'" for k in FINAL_KINDS)

ORACLE = f"""
WITH RECURSIVE one AS (
    SELECT click_id, client_id, epoch_us(ts) AS us, epoch_us(arrived_at) AS arrived, kind, CASE WHEN isfinite(value) THEN value END AS value,
        row_number() OVER (PARTITION BY click_id ORDER BY client_id, ts, arrived_at, kind, value) AS k
    FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)
, c AS (SELECT click_id, client_id, us, coalesce(arrived - us > {LATE}, false) AS late, coalesce(value >= {FINAL_VALUE} AND kind IN ({_KINDS}), false) AS final,
    CAST(coalesce(floor(100 * value + 0.5), 0) AS BIGINT) AS cents FROM one WHERE k = 1)
, timely AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY us, click_id) AS place,
    lag(us) OVER (PARTITION BY client_id ORDER BY us, click_id) AS before_us, lag(final) OVER (PARTITION BY client_id ORDER BY us, click_id) AS before_final FROM c WHERE NOT late)
, pieced AS MATERIALIZED (SELECT *, sum(CASE WHEN before_us IS NULL OR before_final OR us - before_us >= {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY place) AS piece FROM timely)
, times AS (SELECT client_id, piece, us, min(place) AS place FROM pieced GROUP BY ALL)
, onward AS MATERIALIZED (SELECT a.client_id, a.piece, a.place, b.place AS onto FROM times a ASOF JOIN times b ON a.client_id = b.client_id AND a.piece = b.piece AND a.us + {LENGTH} < b.us)
, started AS (SELECT client_id, piece, min(place) AS place FROM pieced GROUP BY ALL
    UNION ALL SELECT o.client_id, o.piece, o.onto FROM started s JOIN onward o ON o.client_id = s.client_id AND o.piece = s.piece AND o.place = (SELECT min(t.place) FROM times t WHERE t.client_id = s.client_id AND t.piece = s.piece AND t.us = (SELECT p.us FROM pieced p WHERE p.client_id = s.client_id AND p.place = s.place)))
, numbered AS (SELECT p.*, count(s.place) OVER (PARTITION BY p.client_id ORDER BY p.place) AS session FROM pieced p LEFT JOIN (SELECT DISTINCT client_id, place FROM started) s ON s.client_id = p.client_id AND s.place = p.place)
, grouped AS (SELECT client_id, session, arg_min(click_id, place) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents,
    arg_max(final, place) AS final, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY place)) AS path_sha256 FROM numbered GROUP BY client_id, session)
, sessions AS (SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY session) AS next_us FROM grouped)
, counted AS (SELECT s.client_id, s.session, count(*) AS n_late FROM sessions s JOIN c l ON l.late AND l.client_id = s.client_id AND l.us >= s.start_us AND (s.next_us IS NULL OR l.us < s.next_us) GROUP BY ALL)
SELECT s.client_id, s.session_id, s.start_us, s.end_us, s.n_clicks, coalesce(n.n_late, 0) AS n_late, s.value_cents,
    CASE WHEN s.final THEN 'end' WHEN s.next_us IS NULL THEN 'none' WHEN s.next_us - s.end_us >= {GAP} THEN 'gap' ELSE 'length' END AS closed_by, s.path_sha256
FROM sessions s LEFT JOIN counted n ON n.client_id = s.client_id AND n.session = s.session
"""
