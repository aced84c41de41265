"""Joins of many rows a key with one row a key, where a few keys may hold much of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hot keys at most; that their list is no longer follows from how they are told.
MOST_HOT = 100_000
#: Rows of one key that a task takes without a split.
LEAST_HOT = 1_000


def most_rows(total: int, least: int = LEAST_HOT) -> int:
    """Rows of one key beyond which it is split. Fewer than MOST_HOT keys can have more of ``total`` rows."""
    return max(least, -(-total // MOST_HOT))


def parts(n: Column, most: int) -> Column:
    """Parts that a key of ``n`` rows is cut into."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(n / F.lit(most)))


def part(parts_: Column, *by: str) -> Column:
    """The part of a row, by the hash of what tells the rows of a key apart."""
    return F.pmod(F.xxhash64(*by), parts_)


def in_parts(small: DataFrame, n: Column, most: int, name: str = "part") -> DataFrame:
    """``small``, one row a key, with a copy for each part of its key."""
    return small.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), parts(n, most) - 1)))


def spread_join(rows: DataFrame, small: DataFrame, keys: list[str], by: list[str], total: int, counts: DataFrame | None = None, least: int = LEAST_HOT, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small``, few rows a key, on ``keys``; the rows of a hot key are dealt to several tasks by the hash of ``by``.

    ``total`` is the number of rows and ``counts`` (keys, n) how many a key has, counted here if not given. Keys of null
    meet nothing. The list of hot keys is broadcast; ``most_rows`` bounds it.
    """
    most = most_rows(total, least)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_rows")) if counts is None else counts.select(*keys, F.col("n").alias("_rows"))
    hot = F.broadcast(counted.filter(F.col("_rows") > most).select(*keys, parts(F.col("_rows"), most).alias("_parts")))
    left = rows.join(hot, keys, "left").withColumn("_part", F.coalesce(part(F.col("_parts"), *by), F.lit(0).cast("long"))).drop("_parts")
    ends = F.coalesce(F.col("_parts"), F.lit(1).cast("long")) - 1
    right = small.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), ends))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")
