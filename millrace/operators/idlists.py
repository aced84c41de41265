"""Joins and set operations on id lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_listed(df: DataFrame, ids: DataFrame, key: str = "job_id") -> DataFrame:
    """Left semi join; Catalyst broadcasts the list where its size allows."""
    return df.join(ids.select(key), key, "left_semi")


def drop_listed(df: DataFrame, ids: DataFrame, key: str = "job_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def in_list_order(df: DataFrame, ids: DataFrame, key: str = "job_id", position: str = "pos", strict: bool = False) -> DataFrame:
    """Rows in the list's order. ``strict``: an id without a row is an error when the result is read."""
    marked = df.withColumn("_here", F.lit(True))
    joined = ids.select(key, position).join(marked, key, "left" if strict else "inner")
    if strict:
        lost = F.raise_error(F.concat(F.lit("no row for id "), F.col(key).cast("string")))
        joined = joined.withColumn("_here", F.when(F.col("_here"), F.lit(True)).otherwise(lost.cast("boolean"))).filter("_here")
    return joined.drop("_here").orderBy(position)


def union_ids(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, lists).distinct()


def common_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def except_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)
