"""Joins by shared tokens and by contained text that never hold a common token against everything that has it.

A set that must share at least n of its m tokens with another shares one of the first m - n + 1 of them in any order. In the order of rarity these are
the rare ones, so candidates are met by rare tokens alone, and common ones only count in the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored

#: Lengths of the pieces by which contained texts are met.
PIECES = (16, 8, 4, 2, 1)


def alike(candidates: DataFrame, queries: DataFrame, candidate: str, by: tuple[str, ...] = (), keep: int = 1) -> DataFrame:
    """candidate, own, by: own cut to what any query asks (asked), and of candidates that then agree in own and in by the `keep` smallest, as a table.

    A score made of by and of the tokens shared with a query is the same for all that agree, so where the smallest candidate comes first, no other can be among a query's `keep` best.
    What is left hangs on how many ways the queries' tokens are held, not on how many candidates hold them.
    """
    asked = stored(queries.select(F.explode("asked").alias("token")).distinct()).withColumn("held", F.col("token"))
    one = candidates.select(candidate, *by, F.explode_outer("own").alias("token")).join(asked, "token", "left")
    cut = one.groupBy(candidate, *by).agg(F.sort_array(F.collect_set("held")).alias("own"))
    place = F.row_number().over(Window.partitionBy("own", *by).orderBy(candidate))
    return stored(cut.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place"))


def frequencies(candidates: DataFrame) -> DataFrame:
    """token, df over candidates (own: distinct tokens)."""
    return candidates.select(F.explode("own").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def rarest_first(queries: DataFrame, frequencies_: DataFrame, key: str) -> DataFrame:
    """key, rare: a query's (asked: distinct tokens) tokens that any candidate has, the rarest first."""
    held = queries.select(key, F.explode("asked").alias("token")).join(frequencies_, "token")
    return held.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x.token).alias("rare"))


def must_share(share: Column, asked: Column) -> Column:
    """How many of asked a candidate must have for that share of them; one at least."""
    return F.greatest(F.ceil(F.round(share * F.size(asked), 9)).cast("int"), F.lit(1))


def prefix(rare: Column, needed: Column) -> Column:
    """The tokens of which a candidate with so many of them has one."""
    n = F.size(rare) - needed + 1
    return F.when(n > 0, F.slice(rare, F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def sharing(queries: DataFrame, candidates: DataFrame, query: str, candidate: str, share: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(query, candidate): all pairs in which the candidate has that share of the query's tokens, and some that have less.

    queries: query, asked, rare and the columns of by; candidates: candidate, own and the columns of by, in which both must agree. share may depend on queries.
    """
    asked = queries.select(query, *by, F.explode(prefix(F.col("rare"), must_share(share, F.col("asked")))).alias("token"))
    return asked.join(candidates.select(candidate, *by, F.explode("own").alias("token")), ["token", *by]).select(query, candidate).distinct()


def containing(texts: DataFrame, parts: DataFrame, text: str, part: str) -> DataFrame:
    """(text, part): all pairs of distinct texts and distinct non-empty parts such that the text contains the part.

    Parts are met by their first characters, as many as the longest piece that fits into them. For names and descriptions: a text is cut at every character.
    """
    t = texts.select(text).where(F.col(text).isNotNull()).distinct()
    p = parts.select(part).where(F.col(part) != "").distinct()
    size = F.lit(PIECES[-1])
    for n in reversed(PIECES):
        size = F.when(F.char_length(part) >= n, n).otherwise(size)
    p = p.withColumn("size", size).withColumn("piece", F.substr(part, F.lit(1), F.col("size")))
    used = [r[0] for r in p.select("size").distinct().collect()] or [1]
    long = F.char_length(text)
    starts = lambda n: F.when(long >= n, F.transform(F.sequence(F.lit(1), F.greatest(long - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.array_distinct(starts(n)).alias("pieces")) for n in used]))
    t = t.select(text, pieces.alias("at")).select(text, "at.size", F.explode("at.pieces").alias("piece"))
    return t.join(p, ["size", "piece"]).where(F.contains(text, F.col(part))).select(text, part)
