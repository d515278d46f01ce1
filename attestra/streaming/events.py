"""Streams: query events reduced per key, daily quotas, validity updates by micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "query_id string, sequence int, type string, step string, data string, error string, token string, confidence double"
RESULT = "query_id string, status string, output string, steps string, n_events int, confidence double, error string"
DONE = {"STEP_COMPLETE": "completed", "STEP_ERROR": "error"}


def blank() -> dict:
    return {"status": "idle", "output": "", "steps": [], "n_events": 0, "confidence": None, "error": None}


def finished(steps: list[list[str]], name: str, status: str) -> None:
    """The last step of that name changes; else the last that runs; else one is added."""
    at = next((i for i in reversed(range(len(steps))) if steps[i][0] == name), None)
    if at is None:
        at = next((i for i in reversed(range(len(steps))) if steps[i][1] == "running"), None)
    if at is None:
        steps.append([name, status])
    else:
        steps[at][1] = status


def applied(state: dict, e: dict) -> dict:
    kind = e["type"]
    state["n_events"] += 1
    if kind == "STEP_START":
        state["status"] = "streaming"
        state["steps"].append([e["step"], "running"])
    elif kind in DONE:
        state["status"] = "streaming" if kind == "STEP_COMPLETE" else "error"
        state["error"] = e["error"] if kind == "STEP_ERROR" else state["error"]
        finished(state["steps"], e["step"], DONE[kind])
    elif kind == "TOKEN":
        state["status"] = "streaming"
        state["output"] += e["token"] or ""
    elif kind == "ANSWER_READY":
        state["status"] = "streaming"
    elif kind == "COMPLETE":
        state["status"], state["confidence"] = "complete", e["confidence"]
    return state


def _row(key: str, s: dict) -> pd.DataFrame:
    return pd.DataFrame([{"query_id": key, "status": s["status"], "output": s["output"], "steps": json.dumps(s["steps"]), "n_events": s["n_events"], "confidence": s["confidence"], "error": s["error"]}])


def reduced(events: DataFrame) -> DataFrame:
    """Batch: the final state of every query, its events in order of sequence."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        s = blank()
        for e in part.sort_values("sequence").to_dict("records"):
            applied(s, e)
        return _row(part["query_id"].iloc[0], s)

    return events.groupBy("query_id").applyInPandas(run, RESULT)


class Reducer(StatefulProcessor):
    """The state of a query, its events folded in order of sequence however they arrive.

    An event that is not the next one waits in a map by its sequence; what was folded before is not folded again. The event that completes a query ends it: what waits is
    dropped, and a mark stays so that nothing starts it anew. A timer follows the query's latest event: when the watermark passes it, a query that is not complete is
    folded over its gaps and told as it is; either way nothing of it is kept.
    """

    def __init__(self, first: int, keep_ms: int):
        self.first, self.keep_ms = first, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.body = handle.getValueState("body", "body string")
        self.waiting = handle.getMapState("waiting", "sequence int", "event string")

    def _held(self) -> dict:
        found = self.body.get() if self.body.exists() else None
        return json.loads(found[0]) if found else {"next": self.first, "until": 0, "done": False, "state": blank()}

    def _fold(self, held: dict, e: dict) -> None:
        held["state"] = applied(held["state"], e)
        held["done"] = e["type"] == "COMPLETE"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held["done"]:
            for _ in rows:
                pass
            return
        for part in rows:
            held["until"] = max(held["until"], int(part["ts"].max().timestamp() * 1000) + self.keep_ms)
            for e in json.loads(part.drop(columns=["ts"]).to_json(orient="records")):
                if e["sequence"] > held["next"]:
                    self.waiting.updateValue((e["sequence"],), (json.dumps(e),))
                elif e["sequence"] == held["next"] and not held["done"]:
                    self._fold(held, e)
                    held["next"] += 1
                    while not held["done"] and self.waiting.containsKey((held["next"],)):
                        self._fold(held, json.loads(self.waiting.getValue((held["next"],))[0]))
                        self.waiting.removeKey((held["next"],))
                        held["next"] += 1
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(held["until"])
        yield _row(key[0], held["state"])
        if held["done"]:
            self.waiting.clear()
            held["state"] = None
        self.body.update((json.dumps(held),))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if not held["done"]:
            for _, e in sorted((k[0], v[0]) for k, v in self.waiting.iterator()):
                if not held["done"]:
                    self._fold(held, json.loads(e))
            yield _row(key[0], held["state"])
        self.waiting.clear()
        self.body.clear()

    def close(self) -> None:
        pass


def reduced_stream(events: DataFrame, late: str = "10 minutes", keep_minutes: int = 30, first: int = 0) -> DataFrame:
    """Stream: the state of every query after each micro-batch that has events of it, or ends it.

    The watermark follows the events' ts, or without that column the time of their batch; sequences start at `first` (those of streaming.build at 1). In whatever order batches bring events, the last row of a query is that of reduced(). Keyed state needs the
    state store of the session to be RocksDB.
    """
    timed = events if "ts" in events.columns else events.withColumn("ts", F.current_timestamp())
    out = timed.withWatermark("ts", late).groupBy("query_id")
    return out.transformWithStateInPandas(statefulProcessor=Reducer(first, keep_minutes * 60_000), outputStructType=RESULT, outputMode="Update", timeMode="EventTime")


def daily_quota(events: DataFrame, late: str | None = None) -> DataFrame:
    """Queries per user and day; with a watermark for append mode."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    w = e.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("used"))
    return w.select("user_id", F.to_date("window.start").alias("day"), "used")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Run `apply` on every micro-batch of what is there now; it must be idempotent by batch id."""
    return stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()
