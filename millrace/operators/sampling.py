"""Deterministic samples. Rows are ordered by a hash of seed and key, so a rerun draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Experience level to seniority band.
BANDS = {
    "Internship": "junior",
    "Entry level": "junior",
    "Associate": "mid",
    "Mid-Senior level": "mid",
    "Director": "senior",
    "Executive": "senior",
    "": "unspecified",
}
MIN_SKILLS = 3
SEED = 42


def band(level: Column, bands: dict[str, str] = BANDS) -> Column:
    """Null for null and for levels outside the map."""
    table = F.create_map(*[F.lit(x) for pair in bands.items() for x in pair])
    return F.try_element_at(table, level)


def population(df: DataFrame, count: str = "n_skills", least: int = MIN_SKILLS) -> DataFrame:
    return df.filter(F.col(count) >= least)


def draw_key(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def _ranked(df: DataFrame, stratum: str, key: str, seed: int, most: Column | int) -> DataFrame:
    """First rows by hash in each stratum. Spark's window-group limit cuts each task's rows before the shuffle."""
    order = Window.partitionBy(stratum).orderBy(draw_key(F.col(key), seed), F.col(key))
    return df.filter(F.col(stratum).isNotNull()).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)


def equal_sample(df: DataFrame, stratum: str, per_stratum: int, key: str = "job_id", seed: int = SEED) -> DataFrame:
    """``per_stratum`` rows of every stratum; rows without one aren't drawn."""
    return _ranked(df, stratum, key, seed, per_stratum).drop("_rank")


def require_full_strata(sample: DataFrame, stratum: str, per_stratum: int) -> DataFrame:
    """The sample, or an error at run time where a stratum was too small to fill it."""
    sizes = sample.groupBy(stratum).agg(F.count("*").alias("_n"))
    short = F.when(F.col("_n") < per_stratum, F.raise_error(F.concat(F.lit("stratum too small: "), F.col(stratum)))).otherwise(F.lit(True))
    return sample.join(sizes.select(stratum, short.cast("boolean").alias("_full")), stratum).filter("_full").drop("_full")


def proportional_sample(df: DataFrame, stratum: str, target: int, key: str = "job_id", seed: int = SEED) -> DataFrame:
    """About ``target`` rows: each stratum gives its share, half-even rounded, one at least.

    Rows without a stratum count in the total but aren't drawn, so the sample may miss the target.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    take = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(target)) / F.col("_total")).cast("long"))
    quotas = sizes.filter(F.col(stratum).isNotNull()).crossJoin(F.broadcast(total)).select(stratum, take.alias("_take"))  # total: one row
    order = Window.partitionBy(stratum).orderBy(draw_key(F.col(key), seed), F.col(key))
    ranked = df.filter(F.col(stratum).isNotNull()).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= target)
    return ranked.join(quotas, stratum).filter(F.col("_rank") <= F.col("_take")).select(*df.columns)


def in_band_order(sample: DataFrame, stratum: str, key: str = "job_id") -> DataFrame:
    """A sample, small by nature, in order of stratum and key."""
    return sample.orderBy(stratum, key)


def simple_sample(df: DataFrame, n: int, key: str = "job_id", seed: int = SEED) -> DataFrame:
    return df.orderBy(draw_key(F.col(key), seed), F.col(key)).limit(n)


def held_out(df: DataFrame, taken: DataFrame, n: int, key: str = "job_id", seed: int = SEED) -> DataFrame:
    """A simple sample of what ``taken`` left, so the two are disjoint."""
    return simple_sample(df.join(taken.select(key), key, "left_anti"), n, key, seed)


def assert_disjoint(left: DataFrame, right: DataFrame, key: str = "job_id") -> None:
    if not left.select(key).intersect(right.select(key)).isEmpty():
        raise ValueError(f"samples share values of {key}")
