"""What held on a day: versions of a key, each valid from its day until the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(asked: DataFrame, versions: DataFrame, keys: list[str], day: str = "day", since: str = "since") -> DataFrame:
    """asked with the columns of the latest version of its keys that starts on or before its day; nulls where there is none. Of versions of one day the last by its other columns holds.

    Versions and distinct days are merged by one sort, in which the last version is carried on: as many rows as there are of both, however many versions lie before a day. A key that
    many ask for meets its versions once a day, not once a row.
    """
    values = [c for c in versions.columns if c not in (*keys, since)]
    v = versions.groupBy(*keys, F.col(since).alias("_at")).agg(F.max(F.struct(*values)).alias("_v"))
    days = asked.where(F.col(day).isNotNull()).select(*keys, F.col(day).alias("_at")).distinct()
    both = v.withColumn("_turn", F.lit(0)).unionByName(days.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_v", F.last("_v", ignorenulls=True).over(by)).withColumn(since, F.last(F.when(F.col("_turn") == 0, F.col("_at")), ignorenulls=True).over(by))
    found = carried.where("_turn = 1").select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_at", since, *[F.col(f"_v.{c}").alias(c) for c in values])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(day) == F.col("_at")]
    return asked.join(found, on, "left").drop("_at", *[f"_k_{k}" for k in keys])
