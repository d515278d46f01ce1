"""What the corpus operators share: the shared folder, written tables, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the ASCII controls 0x09-0x0D. bytes.split() splits at just these.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"

#: A-Z to a-z, all else unchanged.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Rows per Arrow batch: texts can be long, and a batch is held whole in a worker.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of this machine's own, as long as this machine is all there is."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        found = context._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="attestra-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attestra/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and reread, so that a lost executor loses no rows."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_for(df: DataFrame, name: str) -> str:
    """A column name that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def joined_evenly(rows: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """rows with the columns of by_key, which has a row for each key of rows that isn't null; null keys join the null key.

    Keys of a hundredth of the rows and more, of which there are at most a hundred, are broadcast; all others are shuffled.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = [r[0] for r in counts.where(F.col("_n") * 100 >= total).select(key).collect()] if total else []
    of = lambda df, name: df.withColumnRenamed(key, name)
    kind = rows.schema[key].dataType
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], f"_k {kind.simpleString()}"))
    few = of(by_key, "_k2").join(keys, F.col("_k2").eqNullSafe(F.col("_k")), "left_semi")
    some = of(by_key, "_k2").join(keys, F.col("_k2").eqNullSafe(F.col("_k")), "left_anti")
    is_hot = rows.join(keys, F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    rest = rows.join(keys, F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    on = F.col(key).eqNullSafe(F.col("_k2"))
    return is_hot.join(F.broadcast(few), on).drop("_k2").unionByName(rest.join(some, on).drop("_k2"))


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: The lowest 0 to 8 bytes of eight.
_MASKS = np.array([*((1 << (8 * i)) - 1 for i in range(9))], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and how many words each text has.

    All words at once, eight bytes a round, straight from the bytes: each round mixes them into the word's state, which starts from its
    length, by steps that lose nothing.
    """
    joined = b" ".join(texts) + b" "
    pad = np.frombuffer(joined + bytes(8), np.uint8)
    blank = _BLANK[pad[: len(joined)]]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    length = end - start
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x5EED)
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        h[k] = xxhash.xxh64_intdigest(joined[start[k] : end[k]], 0x5EED)
    left, at, rest = np.flatnonzero(length <= LONG_WORD), start, length
    at, rest = at[left], rest[left]
    with np.errstate(over="ignore"):
        while len(left):
            v = pad[at].astype(np.uint64)
            for i in range(1, 8):
                v |= pad[at + i].astype(np.uint64) << np.uint64(8 * i)
            x = (h[left] ^ (v & _MASKS[np.minimum(rest, 8)])) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            h[left] = x ^ (x >> np.uint64(29))
            more = rest > 8
            left, at, rest = left[more], at[more] + 8, rest[more] - 8
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.diff(np.searchsorted(start, begins))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each element; the last n - 1 elements start none."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out + h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix(out)
