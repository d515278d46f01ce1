"""Runs that change tables once: a ledger of runs, data written aside, and a manifest that takes effect with the run's last line.

A run writes its tables to folders of its own and then a line in the ledger, which names the folders that make up every table from then on. Whatever ends a run before that
line leaves the tables as they were; a run that is repeated after it finds the line and does nothing. Lines are rows of a Parquet folder that Spark appends to, a file each.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "batch_id string, status string, sequence long, manifest string, counts string, error string, at timestamp"
RUNNING, SUCCEEDED, FAILED = "running", "succeeded", "failed"


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self) -> DataFrame:
        """Every line, by sequence and time; none before the first run."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(f"{self.path}/runs")

    def _line(self, batch_id: str, status: str, sequence: int, manifest: dict | None = None, counts: dict | None = None, error: str | None = None) -> None:
        text = lambda x: None if x is None else json.dumps(x, sort_keys=True)
        row = self.spark.createDataFrame([(batch_id, status, sequence, text(manifest), text(counts), error)], RUNS.rpartition(",")[0])
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def _done(self) -> list:
        """Runs that took effect, in order; of two lines of one batch the first holds."""
        rows = self.runs().where(F.col("status") == SUCCEEDED).orderBy("sequence", "at").collect()
        return list({r["batch_id"]: r for r in reversed(rows)}.values())[::-1]

    def manifest(self) -> dict[str, str]:
        """The folder of each table as it is now."""
        done = self._done()
        return json.loads(max(done, key=lambda r: r["sequence"])["manifest"]) if done else {}

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(folder) for name, folder in self.manifest().items()}

    def run(self, batch_id: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> dict[str, int]:
        """Tables after change(tables), once for each batch_id: the number of rows of each table that was written.

        change gets the tables as they are and returns those that become others. What it raises is written down, and raised on.
        """
        done = self._done()
        for r in done:
            if r["batch_id"] == batch_id:
                return json.loads(r["counts"])
        sequence = 1 + max((r["sequence"] for r in done), default=0)
        self._line(batch_id, RUNNING, sequence)
        try:
            manifest, counts = self.manifest(), {}
            for name, df in change(self.tables()).items():
                folder = f"{self.path}/tables/{name}/{batch_id}-{uuid.uuid4().hex}"
                df.write.parquet(folder)
                manifest[name] = folder
                counts[name] = self.spark.read.parquet(folder).count()
        except Exception as e:
            self._line(batch_id, FAILED, sequence, error=str(e)[:2000])
            raise
        self._line(batch_id, SUCCEEDED, sequence, manifest, counts)
        return counts
